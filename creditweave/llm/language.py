"""Language of texts and of their segments, by hyperdimensional letter profiles.

Each letter has a random vector of +1 and -1.  A letter n-gram is the product of its
letters' vectors, each rotated by its place in the n-gram (binding); a text is the sum of
its n-gram vectors (bundling).  A language's prototype bundles short built-in texts with
the profiles of labelled segments of the corpus; labels that a profile contradicts are
replaced, and the prototypes are corrected on the segments they get wrong.  A segment gets the language
whose prototype has the highest cosine with it, and as confidence the share of that language
in the softmax of the cosines, of which the scale is calibrated on labelled segments held
out of the fit.  A segment whose best cosine is below what held-out segments of the
languages have gets the language ``und``: it is none of them.

A cosine with a bundle is the sum of the cosines with its n-grams, over the length of the
bundle, which is that of orthogonal vectors as random ones nearly are.  So a task keeps one
row of cosines for each n-gram it has met, and a batch is one look-up and one sum.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("de", "en", "es", "fr", "it", "pt")
DIMENSIONS = 2048
GRAM = 3
#: Softmax scales of the cosines, of which the confidence takes the one that fits held-out labels best; that without enough of these.
SHARPNESS, SHARPNESSES = 40.0, (10.0, 15.0, 20.0, 30.0, 40.0, 60.0, 80.0, 120.0)
#: Rows with a language label that the prototypes are fitted on, at most, the longest text among them, and the segments of all.
TRAINING_ROWS, TRAINING_CHARS, TRAINING_SEGMENTS = 5_000, 4_000, 15_000
#: Part of the segments held out of the fit, and the part of these below the cosine of which half is the least one.
HELD_OUT, STRANGE = 0.2, 0.001
UNKNOWN = "und"
#: Share of segments whose label is taken for wrong, rounds of bundling, correction passes, their step, and the lead a right prototype must have.
WRONG_LABELS, ROUNDS, EPOCHS, RATE, MARGIN = 0.15, 4, 50, 0.3, 0.05

# Notations of language labels, ISO 639-1, 639-2 (both forms) and names.
NOTATIONS = {
    "de": "de ger deu german deutsch tedesco",
    "en": "en eng english inglese englisch",
    "es": "es spa spanish español espanol castellano spagnolo",
    "fr": "fr fre fra french français francais francese",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues portoghese",
}

# Built-in texts, written for this purpose: common words and phrases of each language.
SEED = {
    "de": "der die das und ist nicht mit von auf für ein eine einer dem den des im zu wurde sich auch nach bei aus er sie es wir ihr ich war sind hat haben werden kann noch nur aber wie über vor zur zum durch seit zwischen "
    "geboren in einer kleinen Stadt spielte er viele Jahre im Orchester und schrieb Lieder für den Chor. Sie unterrichtet heute an der Schule und tritt noch immer auf. Die Gruppe gründete sich und veröffentlichte mehrere Platten. Nicht zu verwechseln mit dem Sänger gleichen Namens. Seine Schwester war ebenfalls Musikerin. bekannt für seinen warmen Klang, Schlagzeuger aus dem Norden",
    "en": "the of and to in is was that for it with as his her on be at by this had not are but from or have an they which one you were all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over "
    "born in a small town he played for many years in the orchestra and wrote songs for the choir. She teaches at the school today and still performs. The group was formed and released several records. Not to be confused with the singer of the same name. Known for his warm sound, drummer from the north",
    "es": "el la los las de que y en un una es no con por para su se del al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos fue era había ha nacido "
    "nació en una pequeña ciudad, tocó muchos años en la orquesta y escribió canciones para el coro. Ella enseña hoy en la escuela y todavía actúa. El grupo se formó y publicó varios discos. No debe confundirse con el cantante del mismo nombre. Conocido por su sonido cálido, batería del norte, ingeniero de sonido",
    "fr": "le la les de des et en un une est pas avec pour que qui dans sur au aux du ce il elle ils nous vous je ne se son sa ses par plus mais ou où cette ces comme été être sont était fut a ont leur leurs y même tout tous après avant depuis entre chez sans sous très bien aussi encore deux "
    "né dans une petite ville, il a joué de longues années dans l'orchestre et écrit des chansons pour la chorale. Elle enseigne aujourd'hui à l'école et se produit encore. Le groupe s'est formé et a publié plusieurs disques. À ne pas confondre avec le chanteur du même nom. Connu pour sa sonorité chaude, batteur du nord, ingénieur du son",
    "it": "il lo la i gli le di che e è un una non con per del della dei delle nel nella al alla ai da dal dalla in su sul sulla si come più ma anche o se sono era ha hanno fu stato suo sua suoi loro questo questa quello tra fra dopo prima ancora quando molto tutti tutto essere cui poi "
    "nato in una piccola città, suonò per molti anni nell'orchestra e scrisse canzoni per il coro. Oggi insegna alla scuola e suona ancora. Il gruppo si è formato e ha pubblicato diversi dischi. Da non confondere con l'omonimo cantante. Conosciuto per il suono caldo, batterista del nord, fonico e arrangiatore",
    "pt": "o a os as de que e em um uma é não com por para seu sua se do da dos das no na nos nas ao à como mais mas foi ele ela eles lhe já ou muito também até entre quando depois sem sobre mesmo são era tem há ter pelo pela isso este esta desde todos durante ainda "
    "nasceu numa pequena cidade, tocou muitos anos na orquestra e escreveu canções para o coro. Hoje ensina na escola e ainda se apresenta. O grupo formou-se e publicou vários discos. Não confundir com o cantor do mesmo nome. Conhecido pelo som quente, baterista do norte, engenheiro de som",
}

_MARKUP = re.compile(r"\[(?:url|img)=[^\]]*\]|\[/?[a-z]{1,8}(?:=[^\]]*)?\]|\[[a-z]?=?\d+\]|\[[alrmt]=[^\]]*\]|<[^>]{1,200}>|https?://\S+|&[a-z]{2,8};", re.I)
# Ends of sentences; a point after one or two letters, or after a title, ends none.
_END = re.compile(r"\s+[/—–|•·]+\s+|\s+-+\s+|\s*[\r\n]\s*|(?<=[.!?…])[\"'»”)\]]*\s+|\s*;\s+")
_ABBREVIATED = re.compile(r"(?:^|[\s(\"'.])(?:[^\W\d]{1,2}|Mr|Mrs|Dott|Prof|Sig|Sra|Srta|Orch|Strum|Ens|Quart|Bnd)\.$")
_WORD = re.compile(r"[^\W\d_]+")
_NO_LETTERS = re.compile(r"(?:[^\w\n]|[\d_])+")
BLOCK = 4_000  # n-gram vectors that are made at once
HELD_GRAMS = 500_000  # n-grams whose cosines a task keeps
SHORTEST = 3  # words of a segment; shorter ones belong to the segment before


def plain_text(text: str) -> str:
    """Text without markup."""
    return _MARKUP.sub(" ", text) if any(c in text for c in "[<&:") else text


def segments(text: str) -> list[str]:
    """Sentences of a text without markup, in order."""
    out: list[str] = []
    start = 0
    text = plain_text(text)
    cuts = [(m.start(), m.end()) for m in _END.finditer(text)] + [(len(text), len(text))]
    for end, after in cuts:
        piece = text[start:end]
        signs, ended = text[end:after].strip(" \t\r\n"), piece.endswith((".", "!", "?", "…"))
        if not signs and end < len(text) and (_ABBREVIATED.search(piece) or (not ended and text[after : after + 1].islower())):
            continue  # an abbreviation, or a line that goes on
        piece = " ".join(piece.split())
        start = after
        words = _WORD.findall(piece)
        if not words:
            continue
        if len(words) < SHORTEST and out:
            out[-1] += " " + piece
        else:
            out.append(piece)
    if len(out) > 1 and len(_WORD.findall(out[0])) < SHORTEST:
        out[1] = out[0] + " " + out[1]
        del out[0]
    return out


def label_of(label: str | None) -> str | None:
    """The language that a label names, or None."""
    if not label:
        return None
    first = re.split(r"[-_\s(/]", label.strip().lower(), maxsplit=1)[0]
    return next((k for k, names in NOTATIONS.items() if first in names.split()), None)


def label_column(label: F.Column) -> F.Column:
    """As ``label_of``, as a column."""
    first = F.element_at(F.split(F.lower(F.trim(label)), r"[-_\s(/]"), 1)
    out = F.lit(None).cast("string")
    for k, names in NOTATIONS.items():
        out = F.when(first.isin(*names.split()), F.lit(k)).otherwise(out)
    return out


def letter_lines(segments: list[str]) -> list[str]:
    """What n-grams are taken of, for each segment: words in lower case between single blanks; accents stay."""
    text = "\n".join(segments)
    text = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    return [f" {x.strip(' ')} " for x in _NO_LETTERS.sub(" ", text).split("\n")]


def gram_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all lines as integers, 21 bits a letter, and the line that each is of."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.int64)
    line = np.repeat(np.arange(len(lines)), size)
    n = max(0, len(codes) - GRAM + 1)
    keys = np.zeros(n, np.int64)
    for place in range(GRAM):
        keys = (keys << 21) | codes[place : place + n]
    inside = line[:n] == line[GRAM - 1 :]
    return keys[inside], line[:n][inside]


class Space:
    """The random letter vectors and the n-gram vectors made of them."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.letter: dict[int, np.ndarray] = {}

    def of_letter(self, code: int) -> np.ndarray:
        if code not in self.letter:
            self.letter[code] = (np.random.default_rng((self.seed, code)).integers(0, 2, self.dimensions) * 2 - 1).astype(np.int8)
        return self.letter[code]

    def of_grams(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of n-grams: letters rotated by their place and multiplied."""
        out = np.ones((len(keys), self.dimensions), np.int8)
        for place in range(GRAM):
            codes, at = np.unique((keys >> (21 * (GRAM - 1 - place))) & 0x1FFFFF, return_inverse=True)
            if len(codes):
                out *= np.stack([np.roll(self.of_letter(int(c)), place) for c in codes])[at]
        return out

    def of_texts(self, texts: list[str]) -> np.ndarray:
        """Profiles of texts: the sums of their n-gram vectors."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        keys, line = gram_keys(letter_lines(texts))
        codes, grams = pd.factorize(keys)
        for lo in range(0, len(grams), BLOCK):  # so many n-gram vectors at a time
            here = (codes >= lo) & (codes < lo + BLOCK)
            if here.any():
                pairs, n = np.unique(line[here] * len(grams) + codes[here], return_counts=True)
                at, gram = np.divmod(pairs, len(grams))
                vectors = self.of_grams(grams[lo : lo + BLOCK]).astype(np.float32)
                rows, first = np.unique(at, return_index=True)
                ends = [*first[1:].tolist(), len(at)]
                for r, i, j in zip(rows.tolist(), first.tolist(), ends):
                    out[r] += n[i:j].astype(np.float32) @ vectors[gram[i:j] - lo]
        return out

    def of_text(self, text: str) -> np.ndarray:
        return self.of_texts([text])[0]


@dataclass
class Prototypes:
    """A unit vector per language, the scale of the softmax and the least cosine of a segment of one of them."""

    vectors: np.ndarray
    sharpness: float = SHARPNESS
    least: float = -1.0


class Scorer:
    """Cosines of segments with the prototypes, by the n-grams met so far."""

    def __init__(self, prototypes: Prototypes) -> None:
        self.space, self.vectors = Space(), prototypes.vectors.astype(np.float32)
        self.known: dict[int, int] = {}
        self.rows = np.zeros((0, len(self.vectors)), np.float32)

    def of_grams(self, keys: np.ndarray) -> np.ndarray:
        new = [k for k in keys.tolist() if k not in self.known]
        if len(self.known) + len(new) > HELD_GRAMS and self.known:
            self.known.clear()
            self.rows = self.rows[:0]
            new = keys.tolist()
        if new:
            made = [self.space.of_grams(np.array(new[i : i + BLOCK])).astype(np.float32) @ self.vectors.T for i in range(0, len(new), BLOCK)]
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, *made])
        return self.rows[[self.known[k] for k in keys.tolist()]]

    def __call__(self, segments: list[str]) -> np.ndarray:
        """Cosines, a row per segment; 0 for one without an n-gram."""
        out = np.zeros((len(segments), len(self.vectors)))
        keys, line = gram_keys(letter_lines(segments)) if segments else (np.zeros(0, np.int64),) * 2
        if not len(keys):
            return out
        codes, grams = pd.factorize(keys)
        pair, pairs = pd.factorize(line * len(grams) + codes)
        n = np.bincount(pair).astype(np.float64)
        at, gram = np.divmod(pairs, len(grams))
        cos = self.of_grams(grams)[gram]
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(at, n * cos[:, k], len(segments))
        length = np.sqrt(self.space.dimensions * np.bincount(at, n * n, len(segments)))
        return out / np.where(length == 0, 1, length)[:, None]


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def centred(p: np.ndarray) -> np.ndarray:
    """Prototypes without what all languages share (blanks, common letters)."""
    return unit(unit(p) - unit(p).mean(0))


def retrain(profiles: np.ndarray, labels: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Prototypes bundled from labelled profiles and corrected on those they get wrong.

    A label holds for a document, is wrong at times and says nothing of a segment in another
    language.  So each segment first gets the language that its cosines and its label,
    of which the part WRONG_LABELS is wrong, make likeliest; the prototypes are bundled
    anew from these languages, ROUNDS times.  Then each profile that does not come nearer to its
    own prototype than to any other by MARGIN is added to its own and taken from the other,
    for EPOCHS passes.
    """
    v = profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-9)
    k = len(LANGUAGES)
    prior = np.full((len(v), k), np.log(WRONG_LABELS / (k - 1)))
    prior[np.arange(len(v)), labels] = np.log(1 - WRONG_LABELS)
    proto, own = centred(start), labels
    for _ in range(ROUNDS):
        own = (SHARPNESS * (v @ proto.T) + prior).argmax(1)
        bundles = np.stack([v[own == i].sum(0) if (own == i).any() else np.zeros(v.shape[1]) for i in range(k)])
        proto = centred(unit(start) + 3 * unit(bundles))
    return unit(_correct(v, own, proto))


def calibrate(prototypes: Prototypes, texts: list[str], labels: np.ndarray) -> None:
    """Scale of the softmax by the likelihood of held-out labels, of which an unknown part is wrong, and the least cosine, halfway from 0, that of unrelated text, to what hardly any of these segments falls below."""
    cos = Scorer(prototypes)(texts)
    rows = np.arange(len(labels))
    best = -np.inf
    for scale in SHARPNESSES:
        e = np.exp(scale * (cos - cos.max(1, keepdims=True)))
        p = (e / e.sum(1, keepdims=True))[rows, labels]
        for wrong in (0.02, 0.05, 0.1, 0.15, 0.2, 0.3):
            fit = float(np.log((1 - wrong) * p + wrong / len(LANGUAGES)).sum())
            if fit > best:
                best, prototypes.sharpness = fit, scale
    prototypes.least = float(np.quantile(cos.max(1), STRANGE)) / 2


def _margins(v: np.ndarray, labels: np.ndarray, proto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lead of the right prototype over the best other one, and that other one."""
    cos = v @ proto.T
    rows = np.arange(len(v))
    own = cos[rows, labels].copy()
    cos[rows, labels] = -2
    return own - cos.max(1), cos.argmax(1)


def _correct(v: np.ndarray, labels: np.ndarray, proto: np.ndarray) -> np.ndarray:
    step = RATE * len(LANGUAGES) / max(1, len(v))
    for _ in range(EPOCHS):
        margin, other = _margins(v, labels, unit(proto))
        at = np.flatnonzero(margin < MARGIN)
        if not len(at):
            break
        give = np.zeros((len(LANGUAGES), len(at)), np.float32)
        give[labels[at], np.arange(len(at))] = step
        give[other[at], np.arange(len(at))] -= step
        proto = proto + give @ v[at]
    return proto


def fit_prototypes(df: DataFrame, text: str, label: str, rows: int = TRAINING_ROWS) -> Prototypes:
    """Prototypes from the built-in texts and at most ``rows`` labelled rows of the corpus of up to TRAINING_CHARS characters, those of smallest hash."""
    space = Space()
    start = np.stack([unit(space.of_text(SEED[k])) for k in LANGUAGES])
    named = df.select(F.col(text).alias("text"), label_column(F.col(label)).alias("label")).where(r"label is not null and text rlike '[a-zA-Z]'").where(F.length("text") <= TRAINING_CHARS)
    found = [(s, LANGUAGES.index(r["label"])) for r in named.orderBy(F.xxhash64("text")).limit(rows).collect() for s in segments(r["text"])]  # bounded by rows and characters
    # a segment that comes again, such as a fixed phrase, counts once, with the label it has most often
    often: dict[str, Counter] = {}
    for s, k in found:
        often.setdefault(s, Counter())[k] += 1
    found = [(s, max(n, key=lambda k: (n[k], -k))) for s, n in often.items()]
    found = sorted(found, key=lambda x: (zlib.crc32(x[0].encode()), x[0]))[:TRAINING_SEGMENTS]
    if len(found) < 50:
        return Prototypes(centred(start))
    held = round(len(found) * HELD_OUT)
    out = Prototypes(retrain(space.of_texts([s for s, _ in found[held:]]), np.array([k for _, k in found[held:]]), start))
    calibrate(out, [s for s, _ in found[:held]], np.array([k for _, k in found[:held]]))
    return out


_SEGMENTS = pa.struct([("segment", pa.string()), ("lang", pa.string()), ("confidence", pa.float64())])


def _segment_rows(prototypes: Prototypes):
    names = np.array([*LANGUAGES, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(prototypes)
        for b in batches:
            cuts = [segments(text) if text else [] for text in b.column(b.num_columns - 1).to_pylist()]
            every = [s for c in cuts for s in c]
            cos = scorer(every)
            e = np.exp(prototypes.sharpness * (cos - cos.max(1, keepdims=True))) if len(cos) else cos
            best = cos.argmax(1) if len(cos) else np.zeros(0, int)
            rows = np.arange(len(best))
            strange = cos[rows, best] < prototypes.least
            sure = np.round(np.where(strange, 0.0, e[rows, best] / e.sum(1)), 6)
            ends = np.concatenate([[0], np.cumsum([len(c) for c in cuts])]).astype(np.int32)
            parts = [pa.array(every, pa.string()), pa.array(names[np.where(strange, len(LANGUAGES), best)], pa.string()), pa.array(sure, pa.float64())]
            got = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(_SEGMENTS)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], [*b.schema.names[:-1], "segments"])

    return run


def languages(df: DataFrame, columns: list[str], text: str, prototypes: Prototypes) -> DataFrame:
    """``columns`` of each row and ``segments array<struct<segment, lang, confidence>>`` in the order of the text.

    Null, empty and blank texts, and texts of markup or signs without words, have no
    segments.  Very short segments belong to their neighbour.  A segment in none of the
    languages is ``und`` with confidence 0.  Texts are read whole; rows are kept one for
    one, repeated ones too.
    """
    narrow = df.select(*columns, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in narrow.dtypes[:-1])
    return narrow.mapInArrow(_segment_rows(prototypes), f"{schema}, segments array<struct<segment: string, lang: string, confidence: double>>")


def _is(lang: str):
    return lambda s: s["lang"] == lang


def document_language(judged: DataFrame) -> DataFrame:
    """Adds ``lang`` and ``confidence`` of the document: its language by words, and the mean confidence of its segments times that language's share; ``und`` if all segments are."""
    size = F.aggregate("segments", F.lit(0.0), lambda a, s: a + F.length(s["segment"]))
    best = None
    for k in (*LANGUAGES, UNKNOWN):  # the confidence of und is 0, so it wins only alone
        own = F.filter("segments", _is(k))
        n = F.aggregate(own, F.lit(0.0), lambda a, s: a + F.length(s["segment"]) * s["confidence"])
        best = (best or []) + [F.struct(n.alias("n"), F.lit(k != UNKNOWN).alias("named"), F.lit(k).alias("k"))]
    top = F.array_max(F.array(*best))
    alone = F.forall("segments", _is(UNKNOWN))
    return judged.withColumn("__top", top).withColumn("lang", F.when(F.size("segments") > 0, F.when(alone, UNKNOWN).otherwise(F.col("__top.k")))).withColumn(
        "confidence", F.when(F.size("segments") > 0, F.round(F.col("__top.n") / size, 6))
    ).drop("__top")
