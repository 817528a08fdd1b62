"""Encoding of whole texts with a public byte-pair vocabulary.

Texts are encoded where they are read, without a shuffle.  A long text is halved, wherever
the middle may be, until its parts are short; the parts are encoded side by side and joined
as a tree.  At each join the text around it is encoded again in a window that grows on both
sides until its ends are places where the vocabulary's pre-tokenizer always separates and
where both encodings end a token: outside of it nothing can change, so the joined list is
the encoding of the joined text.

A piece without any such place for very long, such as a run of one letter, is cut at bytes
and joined the same way on tokens: a window of the last tokens of the left and the first of
the right part is encoded again and grown until its outermost tokens on both sides come out
as they were.  A byte-pair encoding is right if and only if each two neighbouring tokens
are encoded as these two, so the joined list is then the encoding of the whole piece.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters from which a text is encoded by halves, the longest part that is encoded at once, the longest stretch without a safe place, threads of a task.
LONG, LEAF, PART, THREADS = 1_000, 500, 100_000, 4
# Fixed value: the pre-tokenizer pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The blanks of the pattern spelled out, as libraries differ in the control characters they count.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAME_PATTERN = PATTERN.replace(r"[^\s\p", rf"[^{_BLANK}\p").replace(r"(?!\S)", rf"(?![^{_BLANK}])").replace(r"\s+", rf"[{_BLANK}]+")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
# Places that separate in any context: before a single blank between visible characters, and between a letter and a punctuation mark but an apostrophe.
_APART = regex.compile(r"(?<=\S) (?=\S)|(?<=[A-Za-z\u00c0-\u024f\u0370-\u03ff\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?<=\p{L})(?=[.,;:!?()\[\]，。！？；：（）])")
TEXT, PIECE, MORE = range(3)  # a part is text, the start of a pre-token, or the next bytes of the pre-token before it


def encoder(where: str = TOKENIZERS, name: str = VOCABULARY):
    """The encoder of a vocabulary file; strings of special tokens are ordinary text."""
    import tiktoken

    with open(f"{where}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_piece(enc, piece: bytes) -> list[int]:
    """Byte-pair encoding of one pre-token."""
    return enc._encode_single_piece(piece) if piece else []


def join(enc, left: list[int], right: list[int], window: int = 8) -> list[int]:
    """Encoding of the bytes of two neighbouring parts of one pre-token, from their encodings."""
    if not left or not right:
        return left + right
    while True:
        a, b = left[-window:], right[:window]
        new = encode_piece(enc, enc.decode_bytes(a + b))
        left_agrees = window >= len(left) or new[0] == a[0]
        right_agrees = window >= len(right) or new[-1] == b[-1]
        # an outermost token that came out again has its old neighbour outside the window
        if left_agrees and right_agrees:
            return left[:-window] + new + right[window:]
        window *= 2


def join_all(enc, parts: list[list[int]]) -> list[int]:
    """Joins parts of one pre-token as a balanced tree."""
    while len(parts) > 1:
        parts = [join(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def cut_long(text: str, part: int = PART) -> list[tuple[int, bytes]]:
    """The parts (kind, bytes) of a long text, in order."""
    out: list[tuple[int, bytes]] = []
    pattern = regex.compile(_SAME_PATTERN)
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > part:
            # the last safe place of the part, or else the first one after it
            near = text.rfind(" ", start + 1, start + part)
            while near > start and not _SAFE.match(text, near):
                near = text.rfind(" ", start + 1, near)
            if near > start:
                end = near
            elif m := _SAFE.search(text, start + max(part - 1, 1)):
                end = m.start()
        chunk = text[start:end]
        out += [(TEXT, chunk.encode())] if len(chunk) <= part else _cut_unsplit(pattern, chunk, part)
        start = end
    return out


def _cut_unsplit(pattern, chunk: str, part: int) -> list[tuple[int, bytes]]:
    """Parts of a chunk without a safe place; its ends are such places, so its own pre-tokens are those of the text."""
    out: list[tuple[int, bytes]] = []
    held: list[str] = []
    size = 0

    def flush() -> None:
        # blanks at the end would be read otherwise than before what follows: each is a pre-token of its own
        cut = len(held)
        while cut and held[cut - 1].isspace():
            cut -= 1
        if cut:
            out.append((TEXT, "".join(held[:cut]).encode()))
        out.extend((PIECE, h.encode()) for h in held[cut:])
        held.clear()

    for m in pattern.finditer(chunk):
        piece = m.group()
        if size + len(piece) > part:
            flush()
            size = 0
        if len(piece) > part:
            raw = piece.encode()
            out += [(MORE if i else PIECE, raw[i : i + part]) for i in range(0, len(raw), part)]
        else:
            held.append(piece)
            size += len(piece)
    flush()
    return out


@lru_cache(4)
def token_sizes(enc) -> list[int]:
    """Bytes of each token of a vocabulary."""
    size = [0] * enc.n_vocab
    for b in enc.token_byte_values():
        size[enc.encode_single_token(b)] = len(b)
    return size


def join_texts(enc, left: tuple[str, list[int]], right: tuple[str, list[int]], window: int = 12) -> tuple[str, list[int]]:
    """Text and encoding of two neighbouring parts of a text; the window counts characters on each side."""
    (a, x), (b, y) = left, right
    if not a or not b:
        return a + b, x + y
    size = token_sizes(enc)
    while True:
        first = _APART.search(a, max(1, len(a) - window)) if window < len(a) else None
        start = first.start() if first else 0 if window >= len(a) else None
        last = None
        for m in _APART.finditer(b, 1, min(len(b), window + 1)) if window < len(b) else ():
            last = m
        end = last.start() if last else len(b) if window >= len(b) else None
        if start is not None and end is not None:
            i, off = len(x), len(a[start:].encode())
            while off > 0 and i:
                i -= 1
                off -= size[x[i]]
            j, on = 0, len(b[:end].encode())
            while on > 0 and j < len(y):
                on -= size[y[j]]
                j += 1
            if off == 0 and on == 0:  # both sides end a token there
                return a + b, x[:i] + enc.encode_ordinary(a[start:] + b[:end]) + y[j:]
        window *= 2


def encode_tree(enc, text: str, leaf: int, run: Callable = map) -> list[int]:
    """Encoding of a text by halves of halves of at most ``leaf`` characters, joined as a tree."""
    n = 1
    while n * leaf < len(text):
        n *= 2
    at = [len(text) * i // n for i in range(n + 1)]
    parts = [text[i:j] for i, j in zip(at, at[1:])]
    coded = list(zip(parts, run(enc.encode_ordinary, parts)))
    while len(coded) > 1:
        coded = [join_texts(enc, coded[i], coded[i + 1]) for i in range(0, len(coded), 2)]
    return coded[0][1]


def encode_long(enc, text: str, pool: ThreadPoolExecutor, part: int = PART, leaf: int | None = None) -> list[int]:
    """Encoding of a long text in parts that the pool encodes side by side."""
    leaf = leaf or max(1, part // 4)
    parts = cut_long(text, part)

    def one(p: tuple[int, bytes]) -> list[int]:
        return encode_tree(enc, p[1].decode(), leaf) if p[0] == TEXT else encode_piece(enc, p[1])

    coded = [one(p) for p in parts] if len(parts) == 1 else list(pool.map(one, parts))
    out: list[int] = []
    i = 0
    while i < len(parts):
        j = i + 1
        while j < len(parts) and parts[j][0] == MORE:
            j += 1
        out += join_all(enc, coded[i:j])
        i = j
    return out


def _encode_checked(where: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where, name)
        n = joined = equal = 0
        with ThreadPoolExecutor(THREADS) as pool:
            for b in batches:
                for t in b.column(0).to_pylist():
                    t = t or ""
                    long = len(t) > LONG
                    n, joined = n + 1, joined + long
                    equal += enc.encode_ordinary(t) == (encode_long(enc, t, pool, leaf=LEAF) if long else enc.encode_ordinary(t))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (n, joined, equal)], ["n", "joined", "equal"])

    return run


def joined_exactly(df: DataFrame, text: str, where: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``n_texts, n_joined, n_equal``: all texts, those encoded by halves, and those whose encoding equals that of the whole text at once."""
    got = df.select(F.col(text).cast("string").alias("t")).mapInArrow(_encode_checked(where, name), "n long, joined long, equal long")
    return got.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{d}") for c, d in (("n", "texts"), ("joined", "joined"), ("equal", "equal"))])


def _encode(where: str, name: str, count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where, name)
        with ThreadPoolExecutor(THREADS) as pool:
            for b in batches:
                ids = [[] if not t else enc.encode_ordinary(t) if len(t) <= LONG else encode_long(enc, t, pool, leaf=LEAF) for t in b.column(b.num_columns - 1).to_pylist()]
                col = pa.array([len(x) for x in ids], pa.int64()) if count else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], col], [*b.schema.names[:-1], "n_tokens" if count else "ids"])

    return run


def token_ids(df: DataFrame, columns: list[str], text: str, where: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``columns`` of each row and ``ids array<int>``, the encoding of ``text`` without special tokens.

    Null and empty texts give an empty list; blank texts are encoded as they are; strings
    that look like special tokens are ordinary text.  Rows are kept one for one, repeated
    keys too, in any order of the partitions.  Texts of any length are encoded whole.
    """
    return _mapped(df, columns, text, _encode(where, name, False), "ids array<int>")


def token_counts(df: DataFrame, columns: list[str], text: str, where: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``columns`` of each row and ``n_tokens``, the length of its encoding; 0 for null and empty texts."""
    return _mapped(df, columns, text, _encode(where, name, True), "n_tokens long")


def _mapped(df: DataFrame, columns: list[str], text: str, run, result: str) -> DataFrame:
    narrow = df.select(*columns, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in narrow.dtypes[:-1])
    return narrow.mapInArrow(run, f"{schema}, {result}")
