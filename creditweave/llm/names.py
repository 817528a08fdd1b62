"""Variant spellings of the names of one person or group, linked.

Each name (and real name) is taken apart into a core, the rarest long word such as a family
name, and what stands beside it: given names, initials, nicknames, titles, a number that
tells bearers apart, or the kind of group.  Cores within k edits of each other are found by
a pigeonhole join: a core is cut into k + 1 segments, one of which k edits leave alone, and
substrings of the cores, shifted as far as the edits allow, are looked up for each length
within reach in an inverted index of the segments; hits are verified with a banded edit
distance.  Names
of the same or of a neighbouring core are then compared by their other parts and by the
rough agreement of years, and the links are closed over by connected components.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.llm.lookalike import LETTERS, Rewriter, is_hidden, look_alike_classes
from creditweave.operators.graph import connected_components
from creditweave.session import cut

#: Words in at least this share of the names (and COMMON_ROWS of them) are common: given names, titles, kinds of groups.
COMMON_SHARE, COMMON_ROWS = 0.0015, 10
#: Nicknames written beside a given name count if in this share of the rows (and NICK_ROWS).
NICK_SHARE, NICK_ROWS = 2e-5, 2
#: Edits that two cores may be apart, and letters that a core needs for each of them.
EDITS, SHORTEST = 1, 5
NEAR, FAR = 2, 4  # years apart up to which rows agree, and from which they disagree

# Fixed values.
TITLES = set("dr prof sig sra srta dott maestro don mo mrs ms sir herr frau mme".split())
STAGE = set("dj mc lady el mr".split())
PARTICLES = set("de di del della dal da la le lo van von der den du dos das".split())
KINDS = {
    "band": "band bnd",
    "quartet": "quartet quart quartetto 4tet",
    "trio": "trio",
    "ensemble": "ensemble ens",
    "orchestra": "orchestra orch orchestre orchester",
    "coro": "coro choir",
    "gruppo": "gruppo gr grp group",
    "strumentale": "strumentale strum",
    "friends": "friends frnds",
}
KIND_OF = {w: k for k, ws in KINDS.items() for w in ws.split()}
FILLERS = set("the il lo l la los las i and e und et y a".split())
NICKNAMES = """
giuseppe peppe beppe pino
giuseppina pina giusy
luigi gino gigi
francesco franco checco ciccio
giovanni gianni nanni
antonio tonino toni nino
antonella nella anto
vincenzo enzo
raffaele lello
salvatore turi totò
alessandro sandro ale
alessandra sandra ale
elisabetta betta lisa
margherita rita
roberto robi berto
umberto berto
ferdinando nando
maddalena lena
michael mike mick
william bill will
robert bob rob bobby
richard dick rick
edward ed ned ted
james jim jimmy
thomas tom tommy
margaret peggy maggie meg
elizabeth liz beth betty
katherine kathy kate
friedrich fritz
johannes hans
johanna hanna
ursula uschi
susanna susi
jose pepe
ignacio nacho
concepcion concha
dolores lola
"""


def banded_distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, in a band of ``most`` beside the diagonal; most + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    j = 0
    while j < len(a) - i and j < len(b) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            d = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            now[j] = d
        if min(now) > most:
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)


class Remembered(dict):
    """A table for ``str.translate`` that asks once for each character."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, code: int) -> str | None:
        self[code] = got = self.of(chr(code))
        return got


class Folder:
    """Names in small letters without accents, hidden signs and look-alikes; words of mostly Cyrillic letters stay Cyrillic."""

    def __init__(self) -> None:
        latin = {}
        for line in LETTERS.strip().splitlines():
            first, *others = line.split(" ")
            latin |= {o: first for o in others}
        back = {f.lower(): o.lower() for o, f in latin.items() if "Ѐ" <= o <= "ԯ" and f.isalpha() and o.islower()}
        self.to_cyrillic = str.maketrans({k: v for k, v in back.items() if k in "aceopxyk"} | {"p": "р", "c": "с"})
        self.seen, self.plain = Remembered(lambda c: None if is_hidden(c) else c), Remembered(lambda c: None if unicodedata.combining(c) else latin.get(c, c))
        self.own = {chr(c) for c in range(0x0430, 0x0460)} - {o.lower() for o in latin}

    def __call__(self, text: str) -> str:
        if text.isascii() and text.isprintable():
            return text.lower()
        text = unicodedata.normalize("NFKD", text).translate(self.seen)
        if text.isascii():
            return text.lower()
        low = text.lower()
        if sum(c in self.own for c in low) > 1:
            low = unicodedata.normalize("NFC", low)  # й and ё are letters of their own
            return low.translate(self.to_cyrillic)
        return text.translate(self.plain).lower()


_NUMBER = re.compile(r"\s*\(\s*(\d+)\s*\)\s*$")
_ASIDE = re.compile(r"\"([^\"]*)\"|\(([^()]*)\)|[“”]([^“”]*)[“”]")
_WORD = re.compile(r"[^\W_]+")


def words_of(folder: Folder, name: str | None) -> list[str]:
    return _WORD.findall(folder(name or ""))


@lru_cache(100_000)
def kind_of(word: str) -> str | None:
    """The kind of group that a word names, one edit allowed in longer words."""
    return KIND_OF.get(word) or next((k for x, k in KIND_OF.items() if len(word) > 4 and banded_distance(word, x, 1) <= 1), None)


class Parts:
    """What a name says: core, given words, nicknames, number, kinds."""

    __slots__ = ("core", "given", "nicks", "number", "kinds")

    def __init__(self, folder: Folder, name: str, is_group: bool, common: set[str]) -> None:
        s = folder(name)
        m = _NUMBER.search(s)
        self.number = int(m.group(1)) if m else -1
        if m:
            s = s[: m.start()]
        nicks: list[str] = []
        if not is_group:
            if any(c in s for c in "\"(“”"):
                for a in _ASIDE.finditer(s):
                    nicks += _WORD.findall(next(filter(None, a.groups()), ""))
                s = _ASIDE.sub(" ", s)
            if "m." in s:
                s = re.sub(r"\bm\.\s?o\b", " ", s)
            head, comma, tail = s.partition(",")
            if comma and tail.strip():
                s = f"{tail} {head}"
        words = _WORD.findall(s)
        kinds: list[str] = []
        if is_group:
            rest = []
            for w in words:
                kind = kind_of(w)
                if kind:
                    kinds.append(kind)
                elif w not in FILLERS:
                    rest.append(w)
            long = [w for w in rest if len(w) > 2]
            self.core = max(long or rest or words or [""], key=len)
            # single letters are short for the kind
            kinds += [w for w in rest if w != self.core and len(w) <= 2]
            self.given: list[str] = sorted(w for w in rest if w != self.core and len(w) > 2)
        else:
            while len(words) > 1 and words[0] in TITLES:
                del words[0]
            rest = [w for w in words if w not in PARTICLES] or words
            rare = [w for w in rest if w not in common and len(w) > 3]
            self.core = max(rare or rest or [""], key=len)
            given = list(rest)
            if self.core in given:
                given.remove(self.core)
            if given and given[0] in STAGE:
                kinds.append(given.pop(0))
            self.given = given
        self.nicks, self.kinds = nicks, sorted(set(kinds))


def common_words(names: DataFrame) -> tuple[set[str], dict[str, set[str]]]:
    """Common words of ``names(name, is_group)``, and nicknames with the given names they stand for.

    Both are bounded: a word must hold a share of all rows to come to the driver.
    """
    total = names.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for b in batches:
            words: dict[tuple[str, str], int] = defaultdict(int)
            for name, is_group in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not name or is_group:
                    continue
                for w in set(words_of(folder, name)):
                    words[w, ""] += 1
                s = _NUMBER.sub("", folder(name))
                first = _WORD.findall(_ASIDE.sub(" ", s))[:2]
                for a in _ASIDE.finditer(s):
                    for n in _WORD.findall(next(filter(None, a.groups()), ""))[:1]:
                        for f in first[:1]:
                            words[n, f] += 1
            keys = list(words)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(words.values()), pa.int64())], ["w", "of", "n"])

    counts = names.select("name", "is_group").mapInArrow(run, "w string, of string, n long").groupBy("w", "of").agg(F.sum("n").alias("n"))
    least, least_nick = max(COMMON_ROWS, math.ceil(COMMON_SHARE * total)), max(NICK_ROWS, math.ceil(NICK_SHARE * total))
    got = counts.where(((F.col("of") == "") & (F.col("n") >= least)) | ((F.col("of") != "") & (F.col("n") >= least_nick))).collect()
    common = {r["w"] for r in got if not r["of"]}
    nicks: dict[str, set[str]] = defaultdict(set)
    for line in NICKNAMES.strip().splitlines():
        given, *short = line.split()
        for n in short:
            nicks[n].add(given)
    for r in got:
        if r["of"] and r["of"] in common and r["w"] != r["of"]:
            nicks[r["w"]].add(r["of"])
    return common, dict(nicks)


_FORM = "id long, form string, is_group boolean, core string, given array<string>, nicks array<string>, number int, kinds array<string>, year int, gender string, alias boolean"


def _parse(common: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for b in batches:
            out: list[tuple] = []
            for i, name, real, is_group, year, gender in zip(*(c.to_pylist() for c in b.columns)):
                is_group = bool(is_group)
                year = int(year) if year is not None and year == year and 0 < year < 3000 else None
                gender = gender if gender in ("M", "F") else None
                seen = set()
                for alias, text in ((False, name), (True, real)):
                    if not text or not text.strip():
                        continue
                    p = Parts(folder, text, is_group, common)
                    key = (p.core, *p.given)
                    if not p.core or key in seen:
                        continue
                    seen.add(key)
                    said = (is_group, p.core, p.given, p.nicks, p.number, p.kinds, year, gender, alias)
                    out.append((i, repr(said), *said))
            kinds = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.bool_()]
            names = ["id", "form", "is_group", "core", "given", "nicks", "number", "kinds", "year", "gender", "alias"]
            cols = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


def segment_starts(n: int, edits: int) -> list[int]:
    """Where the edits + 1 segments of a core of n letters begin, and its end."""
    return [i * n // (edits + 1) for i in range(edits + 2)]


def segment_keys(core: str, edits: int) -> set[str]:
    """The segments of a core with its length and their number."""
    n = len(core)
    at = segment_starts(n, edits)
    return {f"{n}.{i}.{core[at[i] : at[i + 1]]}" for i in range(edits + 1)}


def probe_keys(core: str, edits: int) -> set[str]:
    """Substrings of a core that are a segment of any core within reach.

    Of edits + 1 segments of the other core one is left alone, with at most as many edits
    before it as there are segments before it, and likewise behind it; that bounds its shift.  A swap of neighbours
    over the end of a segment touches two of them, so it is also undone at each such place.
    """
    m, out = len(core), set()
    for n in range(max(SHORTEST * edits, m - edits), m + edits + 1):
        at, off = segment_starts(n, edits), m - n
        forms = {core}
        if abs(off) < edits:
            for end in at[1:-1]:
                for p in range(max(1, end - edits + 1), min(m - 1, end + edits - 1) + 1):
                    forms.add(core[: p - 1] + core[p] + core[p - 1] + core[p + 1 :])
        for form in forms:
            for i in range(edits + 1):
                size = at[i + 1] - at[i]
                for p in range(max(0, at[i] - i, at[i] + off - (edits - i)), min(m - size, at[i] + i, at[i] + off + edits - i) + 1):
                    out.add(f"{n}.{i}.{form[p : p + size]}")
    return out


def _keys(probe: bool, edits: int):
    """Segments of cores for the index, or substrings to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cores, keys = [], []
            for g, core in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(core) >= SHORTEST * edits:
                    found = probe_keys(core, edits) if probe else segment_keys(core, edits)
                    cores += [core] * len(found)
                    keys += [g + k for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(cores, pa.string())], ["key", "core"])

    return run


def near_cores(cores: DataFrame, edits: int = EDITS) -> DataFrame:
    """``is_group, core_a, core_b`` with core_a < core_b: pairs of the distinct ``cores(is_group, core)`` up to ``edits`` apart.

    Complete, with one edit allowed for each SHORTEST letters of the shorter core.
    """
    tagged = cores.select(F.when(F.col("is_group"), "g").otherwise("p").alias("g"), "core")
    found = None
    for e in range(1, edits + 1):
        index = tagged.mapInArrow(_keys(False, e), "key string, core string")
        probes = tagged.mapInArrow(_keys(True, e), "key string, core string").withColumnRenamed("core", "other")
        # swaps of neighbours are two edits here; what is left is verified with the banded distance
        close = F.levenshtein("core", "other", 2 * e).between(0, 2 * e)
        pairs = index.join(probes, "key").where("core < other").where(close).select(F.substring("key", 1, 1).alias("g"), F.col("core").alias("core_a"), F.col("other").alias("core_b")).distinct()
        one = pairs.where(_within(e)("core_a", "core_b")).select((F.col("g") == "g").alias("is_group"), "core_a", "core_b")
        found = one if found is None else found.unionByName(one).distinct()
    return found


def _within(edits: int):
    @F.pandas_udf("boolean")
    def within(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([banded_distance(x, y, edits) <= edits for x, y in zip(a, b)])

    return within


class Matcher:
    """Compares the parts of names of the same core, or of neighbouring ones."""

    def __init__(self, common: set[str], nicks: dict[str, set[str]]) -> None:
        self.common, self.nicks = common, nicks

    def bases(self, word: str) -> set[str]:
        return {word} | self.nicks.get(word, set())

    def word(self, a: str, b: str) -> int:
        """2: the same given name, 1: may be (initial or short form), 0: another."""
        if a == b or self.bases(a) & self.bases(b):
            return 1 if len(a) == 1 else 2
        short, long = sorted((a, b), key=len)
        if len(short) == 1:
            return int(any(x.startswith(short) for x in self.bases(long)))
        if short not in self.common and len(short) <= 5 and len(long) > len(short) and any(x.startswith(short) for x in self.bases(long)):
            return 1
        if len(short) >= 3 and not (a in self.common and b in self.common) and banded_distance(a, b, 1) <= 1 and (len(short) > 3 or a[0] == b[0]):
            return 2
        return 0

    def given(self, a: list[str], b: list[str]) -> int:
        """As ``word``, of the given names of two persons; 1 also if one has none."""
        if not a and not b:
            return 2
        if not a or not b:
            return 0
        first = self.word(a[0], b[0])
        if not first:
            return 0
        for x, y in zip(a[1:], b[1:]):
            other = self.word(x, y)
            if not other:
                return 0
        return first


def _agree(a, b) -> int:
    """1: years or genders speak for one person, -1: against, 0: neither."""
    if a.gender and b.gender and a.gender != b.gender:
        return -1
    if a.year is not None and b.year is not None:
        gap = abs(a.year - b.year)
        return 1 if gap <= NEAR else -1 if gap > FAR else 0
    return 0


class _Form:
    __slots__ = ("rep", "core", "given", "nicks", "number", "kinds", "year", "gender", "alias")

    def __init__(self, *values) -> None:
        for name, value in zip(self.__slots__, values):
            setattr(self, name, value)
        self.kinds = tuple(self.kinds)


_BLOCK = ["is_group", "block", "rep", "core", "given", "nicks", "number", "kinds", "year", "gender", "alias"]


def _link_blocks(common: set[str], nicks: dict[str, set[str]]):
    """Links of the blocks of a partition that is sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(common, nicks)
        links: list[tuple[int, int]] = []

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["u", "v"])
            links.clear()
            return got

        def close(key: tuple[bool, str], forms: list[_Form]) -> None:
            if len(forms) > 1:
                guests = "|" in key[1]
                links.extend(_stars(_group_links(forms) if key[0] else _person_links(matcher, forms, guests)))

        now, forms = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[:2] != now:
                    if now is not None:
                        close(now, forms)
                    now, forms = r[:2], []
                    if len(links) > 50_000:
                        yield batch()
                forms.append(_Form(*r[2:]))
        if now is not None:
            close(now, forms)
        yield batch()

    return run


def _stars(links: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The same sets with one link less than they have members, to the smallest of them."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    for x in list(up):
        if top(x) != x:
            yield x, top(x)


def _group_links(forms: list[_Form]) -> Iterator[tuple[int, int]]:
    by: dict[tuple, list[_Form]] = defaultdict(list)
    for f in forms:
        by[tuple(f.given), tuple(k for k in f.kinds if len(k) > 2)].append(f)
    for same in by.values():
        for f in same[1:]:
            yield same[0].rep, f.rep
    # a single letter stands for the one kind of this core that begins with it
    for f in forms:
        letters = [k for k in f.kinds if len(k) <= 2]
        if letters and not any(len(k) > 2 for k in f.kinds):
            fit = [v for (given, kinds), v in by.items() if kinds and any(k.startswith(letters[0]) for k in kinds)]
            if len(fit) == 1:
                yield fit[0][0].rep, f.rep


def _person_links(matcher: Matcher, forms: list[_Form], guests: bool) -> Iterator[tuple[int, int]]:
    by: dict[tuple[str, ...], list[_Form]] = defaultdict(list)
    for f in forms:
        by[tuple(f.given)].append(f)
    # the same given names
    for same in by.values():
        yield from _same_name(same, guests)
    # other spellings of them: what a first given name is short for, its beginnings, and what is left when a letter falls out
    names = list(by)
    index: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, g in enumerate(names):
        for w in g[:1]:
            for x in matcher.bases(w):
                index["base", x].add(i)
                for n in range(1, min(len(x), 6)):
                    index["begins", x[:n]].add(i)
            for x in _without_a_letter(w):
                index["near", x].add(i)
    weak: dict[int, set[int]] = defaultdict(set)
    for i, g in enumerate(names):
        if not g:
            continue
        w = g[0]
        near = set().union(*(index["base", x] for x in matcher.bases(w)), *(index["near", x] for x in _without_a_letter(w)))
        if len(w) == 1 or (len(w) <= 5 and w not in matcher.common):
            near |= index["begins", w]
        for j in near:
            if i == j:
                continue
            kind = matcher.given(list(g), list(names[j]))
            if kind == 2 and i < j:
                yield from _across(by[g], by[names[j]])
            elif kind == 1:
                weak[i].add(j)
                weak[j].add(i)
    # initials and short forms: the one full name that they fit
    for i, g in enumerate(names):
        full = sorted(j for j in weak.get(i, ()) if len(names[j][0]) > len(g[0]))
        if not full:
            continue
        for f in by[g]:
            # of another core: only where the years speak for it too
            fit = [(j, x) for j in full for x in by[names[j]] if _numbers_fit(f, x) and _agree(f, x) >= 0 and (not guests or (x.core != f.core and _agree(f, x) > 0))]
            sure = [(j, x) for j, x in fit if _agree(f, x) > 0]
            chosen = sure or fit
            if len({x.number for _, x in chosen} - {f.number}) > 1 and not any(x.number == f.number for _, x in chosen):
                continue
            chosen = [(j, x) for j, x in chosen if x.number == f.number] or chosen
            full_names = sorted({j for j, _ in chosen}, key=lambda j: -len(names[j][0]))
            if all(matcher.given(list(names[full_names[0]]), list(names[j])) == 2 for j in full_names[1:]):
                for _, x in chosen:
                    yield f.rep, x.rep


def _without_a_letter(word: str) -> set[str]:
    """The word, and the word without each of its letters: words one edit apart share one of these."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) > 2 else {word}


def _numbers_fit(a: _Form, b: _Form) -> bool:
    return a.number == b.number or -1 in (a.number, b.number)


def _same_name(forms: list[_Form], guests: bool) -> Iterator[tuple[int, int]]:
    """Links among names with the same given names: the same number is one person; none is the one with it if there is just one, or the years agree."""
    by: dict[int, list[_Form]] = defaultdict(list)
    for f in forms:
        by[f.number].append(f)
    if guests:
        cores = sorted({f.core for f in forms})
        if len(cores) == 2:
            yield from _across([f for f in forms if f.core == cores[0]], [f for f in forms if f.core == cores[1]])
        return
    for number, same in by.items():
        for f in same[1:]:
            yield same[0].rep, f.rep
    numbers = [n for n in by if n >= 0]
    if -1 in by and numbers:
        for f in by[-1]:
            if len(numbers) == 1:
                x = by[numbers[0]][0]
                if any(_agree(f, y) >= 0 for y in by[numbers[0]]):
                    yield f.rep, x.rep
            else:
                fit = [n for n in numbers if any(_agree(f, y) > 0 for y in by[n])]
                if len(fit) == 1:
                    yield f.rep, by[fit[0]][0].rep


def _across(left: list[_Form], right: list[_Form]) -> Iterator[tuple[int, int]]:
    """Links between two spellings of the same name."""
    for a in left:
        fit = [b for b in right if (a.number == b.number or -1 in (a.number, b.number)) and _agree(a, b) >= 0]
        same = [b for b in fit if b.number == a.number] or fit
        sure = [b for b in same if _agree(a, b) > 0] or same
        if len({b.number for b in sure}) == 1:
            for b in sure:
                yield a.rep, b.rep


def name_links(rows: DataFrame, key: str, edits: int = EDITS) -> DataFrame:
    """``u, v``: links between rows of ``rows(key, name, realname, is_group, debut_year, gender)``."""
    base = rows.select(F.col(key).alias("id"), "name", "realname", "is_group", F.col("debut_year").cast("double").alias("debut_year"), "gender")
    common, nicks = common_words(base.select("name", "is_group"))
    forms = cut(base.mapInArrow(_parse(common), _FORM))
    # rows that say the same are one form; its smallest id stands for it
    parts = ["is_group", "core", "given", "nicks", "number", "kinds", "year", "gender", "alias"]
    same = cut(forms.groupBy("form").agg(F.min("id").alias("rep"), *[F.first(p).alias(p) for p in parts]))
    inside = forms.select("id", "form").join(same.select("form", F.col("rep").alias("v")), "form").where("id <> v").select(F.col("id").alias("u"), "v")
    same = same.select("rep", *parts)
    near = cut(near_cores(same.select("is_group", "core").distinct(), edits))
    home = same.withColumn("block", F.col("core"))
    pairs = near.select("is_group", F.concat_ws("|", "core_a", "core_b").alias("block"), F.explode(F.array("core_a", "core_b")).alias("core"))
    guest = same.join(pairs, ["is_group", "core"])
    blocks = home.unionByName(guest).select(*_BLOCK).repartition("is_group", "block").sortWithinPartitions("is_group", "block", "rep")
    linked = blocks.mapInArrow(_link_blocks(common, nicks), "u long, v long")
    return inside.unionByName(linked)


def linked_sets(rows: DataFrame, key: str, edits: int = EDITS) -> DataFrame:
    """``key, entity, n_rows``: each row with the smallest key of its linked set and the rows of the set.

    Rows without a name and real name, or with blank ones only, are sets of their own.
    Null years and genders speak neither for nor against a link; a null ``is_group`` is
    a person.  Persons and groups are never linked.  Keys must be unique.
    """
    own = rows.select(F.col(key).alias("u"), F.col(key).alias("v"))
    found = cut(connected_components(name_links(rows, key, edits).unionByName(own)))
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("n_rows"))
    return found.join(size, "component").select(F.col("node").alias(key), F.col("component").alias("entity"), "n_rows")


def linked_pairs(rows: DataFrame, key: str, edits: int = EDITS) -> DataFrame:
    """All pairs of rows of the same linked set, ``<key>_a < <key>_b``; ``linked_sets`` has the membership alone."""
    sets = linked_sets(rows, key, edits).where("n_rows > 1")
    a, b = (sets.select("entity", F.col(key).alias(f"{key}_{s}")) for s in "ab")
    return a.join(b, "entity").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
