"""One consistent form for text that looks the same but is stored with different characters.

Look-alike classes are the transitive closure (union-find) of pairs of strings: a fixed
list of letters of other scripts and marks, and a rule over code points (width, font, numeral
and ligature forms, which stand for the string of their Unicode decomposition).  The rule
also holds for characters that the corpus behind the classes never had.  The representative
of a class is its member that occurs most often in the corpus, so in a mostly Cyrillic
table it is the Cyrillic letter; dashes of other lengths (– —) are visible differences.  A multi-pattern automaton rewrites each
text greedily, longest member first; invisible characters are dropped, blanks of any kind
and number become one, and accents are composed.  Case, accents and numbers stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.session import cut

# Characters (Greek, Cyrillic, Armenian, Cherokee, Lisu, phonetic, marks) that look like the first one of their line.
LETTERS = """
A Α А Ꭺ ꓮ
B Β В Ᏼ ꓐ
C С Ꮯ ꓚ
D Ꭰ ꓓ
E Ε Е Ꭼ ꓰ
F ꓝ Ϝ
G Ꮐ ꓖ Ԍ
H Η Н Ꮋ ꓧ
I Ι І Ӏ ꓲ
J Ј Ꭻ ꓙ
K Κ К Ꮶ ꓗ
L Ꮮ ꓡ
M Μ М Ꮇ ꓟ Ϻ
N Ν ꓠ
O Ο О Օ ꓳ
P Ρ Р Ꮲ ꓑ
Q Ԛ
R Ꮢ ꓣ
S Ѕ Ꮪ ꓢ Տ
T Τ Т Ꭲ ꓔ
U Ս ꓴ
V Ꮩ ꓦ Ѵ
W Ꮃ Ԝ ꓪ
X Χ Х ꓫ
Y Υ Ү ꓬ
Z Ζ Ꮓ ꓜ
a а ɑ
c с
d ԁ
e е
g ɡ ց
h һ հ
i і
j ј ϳ
l ӏ ǀ
n ո
o ο о օ
p р ρ
q ԛ զ
s ѕ
u υ ս
v ν ѵ
w ԝ
x х
y у
- ‐ ‑ ‒ − ﹣
' ’ ‘ ʼ ＇ ′ ʹ
" “ ” ＂ ″ ʺ
"""
# Characters without a mark of their own that are no control or format characters.
BLANK_LETTERS = "⠀ㅤﾠᅟᅠ"
HIDDEN = "͏឴឵" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Kinds of Unicode decomposition that keep the look of a character.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>"}


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)


def same_look(char: str) -> str | None:
    """The string that a width, font or ligature form stands for."""
    kind, _, codes = unicodedata.decomposition(char).partition(" ")
    if kind not in SAME_LOOK:
        return None
    text = unicodedata.normalize("NFD", "".join(chr(int(c, 16)) for c in codes.split()))
    return text if text.strip() and not text[0].isspace() else None


def is_hidden(char: str) -> bool:
    return char in HIDDEN or (unicodedata.category(char) in ("Cf", "Cc") and not char.isspace())


def look_alike_classes(counts: dict[str, int]) -> dict[str, str]:
    """Member -> representative, for all members that are not their own representative.

    ``counts`` has the code points of the corpus (canonically decomposed) and how often
    each occurs; it may also hold longer strings.  A member of several characters is
    counted by its rarest one if it isn't in ``counts``.  Ties go to the shorter, then
    to the smaller string.
    """
    sets = UnionFind()
    for line in LETTERS.strip().splitlines():
        first, *others = line.split(" ")
        for other in others:
            sets.union(other, first)
    for char in [c for c in {*counts, *sets.parent} if len(c) == 1]:
        if other := same_look(char):
            sets.union(char, other)
    classes: dict[str, list[str]] = {}
    for member in list(sets.parent):
        classes.setdefault(sets.find(member), []).append(member)

    def often(s: str) -> int:
        return counts.get(s, min(counts.get(c, 0) for c in s))

    out = {}
    for members in classes.values():
        # a ligature or width form is never the form to write, however often it occurs
        fit = [m for m in members if len(m) > 1 or same_look(m) is None] or members
        best = min(fit, key=lambda m: (-often(m), len(m), m))
        out |= {m: best for m in members if m != best}
    return out


class Rewriter:
    """Greedy leftmost-longest rewriting of the members of look-alike classes."""

    def __init__(self, classes: dict[str, str]) -> None:
        import ahocorasick

        self.classes, self.by_rule = classes, {}
        self.first = {m[0] for m in classes}
        self.automaton = ahocorasick.Automaton()
        for member, best in classes.items():
            self.automaton.add_word(member, (len(member), best))
        self.automaton.make_automaton()
        self.empty = not classes
        self.plain = self.empty or not any(c.isascii() for c in self.first)

    def shown(self, char: str) -> str:
        """What a character shows: nothing for a hidden one, and what it stands for by rule if no class has it."""
        if char.isascii() and char.isprintable():
            return char
        got = self.by_rule.get(char)
        if got is None:
            got = " " if char in BLANK_LETTERS else "" if is_hidden(char) else char if char in self.classes else same_look(char) or char
            self.by_rule[char] = got
        return got

    def __call__(self, text: str) -> str:
        if not (self.plain and text.isascii() and text.isprintable()):
            text = unicodedata.normalize("NFD", text)
            text = "".join(self.shown(c) for c in text)
            if not self.empty:
                out, at = [], 0
                for end, (size, best) in self.automaton.iter_long(text):
                    out += [text[at : end + 1 - size], best]
                    at = end + 1
                text = "".join(out) + text[at:]
            text = unicodedata.normalize("NFC", text)
        return " ".join(text.split())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0x110000, np.int64)
    for b in batches:
        text = unicodedata.normalize("NFD", "\n".join(x for x in b.column(0).to_pylist() if x))
        codes, n = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)
        total[codes] += n
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in used], pa.string()), pa.array(total[used])], ["char", "n"])


def corpus_classes(df: DataFrame, column: str) -> dict[str, str]:
    """Look-alike classes with representatives by the counts of the whole column.

    What comes to the driver is one count per code point, 1,114,112 rows at most.
    """
    counted = df.select(F.col(column).cast("string")).mapInArrow(_count, "char string, n long").groupBy("char").agg(F.sum("n").alias("n"))
    return look_alike_classes({r["char"]: r["n"] for r in counted.collect()})


def consistent(df: DataFrame, column: str, out: str, classes: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``out``, the consistent form of ``column``.

    Null stays null; empty and blank texts, and texts of invisible characters only, become
    empty.  Rows are kept as they are, repeated ones too; long texts are rewritten whole.
    """
    classes = corpus_classes(df, column) if classes is None else classes

    @F.pandas_udf("string")
    def rewrite(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = Rewriter(classes)
        for s in parts:
            yield s.map(rewriter, na_action="ignore")

    return df.withColumn(out, rewrite(F.col(column).cast("string")))


def look_alike_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """``<key>_a, <key>_b``: pairs of rows whose text looks the same but is not the same string.

    Rows without text (null) have no pairs.  Rows with the same string are no pair; each
    of them is paired with all rows that hold another spelling.
    """
    rows = df.select(F.col(key).alias("id"), F.col(column).cast("string").alias("text")).where("text is not null")
    # each spelling is rewritten once, however many rows hold it
    forms = cut(consistent(rows.groupBy("text").agg(F.count(F.lit(1)).alias("n_rows")), "text", "form", corpus_classes(rows, "text")))
    several = forms.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    met = rows.join(forms.join(several, "form", "left_semi").select("text", "form"), "text")
    met = cut(met)
    # a form of very many rows is a skewed key of a plain equi-join, which adaptive execution splits
    a, b = (met.select("form", F.col("id").alias(f"{key}_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab")
    return a.join(b, "form").where((F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col("text_a") != F.col("text_b"))).select(f"{key}_a", f"{key}_b")
