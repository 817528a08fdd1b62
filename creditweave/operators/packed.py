"""Fields that hold several values, split into one value per row.

A field is first cut at signs that always separate (``, ; | ·`` and line ends, and any of
``& + /`` with a blank beside it), never inside double quotes or brackets.  What is left
may still hold ``& + /`` between two words without blanks, as ``Vocals/Producer`` (two
values) or ``A&R`` (one).  For these runs a lattice of the possible cuts is built:
expectation-maximisation over the runs of the whole column learns how often each value
occurs, starting from the values seen alone, and a Viterbi pass picks the likeliest cuts.
Expected counts of values with inner signs are discounted, as likelihood alone would take
whole runs for values.
Quoted spans and bracketed notes are atoms of the lattice and never cut.

Everything is done on distinct runs with counts; the learned values stay in a table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.session import cut, keep

ROUNDS = 3
#: Weight of a value with n inner signs that is seen nowhere alone, against its parts (n in the exponent).
INNER = 1e-4
#: Taken off the expected count of a value with inner signs in each round, or the runs of a column would be learned as values themselves.
DISCOUNT = 1.0
#: Probability of nothing between two signs.
BLANK = 1e-2
#: Atoms that one value may be made of, as R, B in R&B: by definition no value has more inner signs than 63.
LONGEST = 64
#: Parts of a frequent run in the join with its values.
SALTS = 16
#: Pseudo count of a value that was never met, so no path has probability 0.
FLOOR = 1e-3

# A quoted span opens at the start of a value only and may hold doubled quotes; an unpaired quote or bracket is an ordinary sign.
_OPEN = r'"(?:[^"]|"")*"|\[[^\[\]]*\]|\([^()]*\)'
_HARD = r"[,;|·\t\r\n，；、｜・•]|(?<=\s)[&+/](?=\S)|[&+/](?=\s|$)|^[&+/]|(?<=[,;|·\s，；、｜・•])[&+/]"
_TOKEN = re.compile(rf"(?P<span>{_OPEN})|(?P<hard>{_HARD})|(?P<soft>[&+/])|(?P<text>[^\"\[\](),;|·\t\r\n，；、｜・•&+/]+)|(?P<sign>.)", re.S)
_MANY = r'[,;|·\t\r\n，；、｜・•&+/]'
_NOTE = re.compile(r"\s*(?:\[[^\[\]]*\]|\([^()]*\))")


def pieces(value: str) -> list[list[str]]:
    """The runs of a field; each run is its atoms with the inner signs between them.

    A run of one atom is a finished value; a longer one alternates atom, sign, atom, ...
    Blank atoms at a run's ends fall away with their signs.
    """
    out: list[list[str]] = []
    run, atom = [], ""

    def close() -> None:
        nonlocal run, atom
        run.append(atom)
        atom = ""
        while len(run) > 1 and not run[0].strip():
            run = run[2:]
        while len(run) > 1 and not run[-1].strip():
            run = run[:-2]
        if run[0].strip():
            out.append([run[0].lstrip(), *run[1:]])
            out[-1][-1] = out[-1][-1].rstrip()
        run = []

    for m in _TOKEN.finditer(value):
        kind, text = m.lastgroup, m.group()
        if kind == "hard":
            close()
        elif kind == "soft":
            run += [atom, text]
            atom = ""
        elif kind == "span" and text[0] == '"' and atom.strip():
            # a quote after text is no opening quote: what is in it is read again as ordinary text
            for part in re.split(r"([,;|·\t\r\n，；、｜・•])", text):
                if len(part) == 1 and part in ",;|·\t\r\n，；、｜・•":
                    close()
                else:
                    atom += part
        else:
            atom += text
    close()
    return out


def clean(item: str) -> str:
    """A value without blanks at its ends and without enclosing quotes, doubled quotes inside made single."""
    item = item.strip()
    if len(item) >= 2 and item[0] == item[-1] == '"':
        item = item[1:-1].replace('""', '"').strip()
    return item


def known_form(item: str) -> str:
    """How a value is counted: without bracketed notes and case."""
    return _NOTE.sub("", clean(item)).strip().lower()


def lattice(run: list[str]) -> list[tuple[int, int, str]]:
    """All segments (from atom, to atom, text) of a run, of up to LONGEST atoms."""
    atoms = (len(run) + 1) // 2
    return [(i, j, "".join(run[2 * i : 2 * j + 1])) for i in range(atoms) for j in range(i, min(atoms, i + LONGEST))]


def weight(text: str, inner: int, counts: dict[str, float], total: float) -> float:
    form = known_form(text)
    if not form:
        return math.log(BLANK)
    got = counts.get(form, 0.0)
    return math.log((got + FLOOR * INNER**inner) / (total + 1.0))


def best_cuts(run: list[str], counts: dict[str, float], total: float) -> list[str]:
    """Viterbi: the likeliest values of a run; ties go to more values."""
    atoms = (len(run) + 1) // 2
    score, back = [0.0] + [-math.inf] * atoms, [0] * (atoms + 1)
    for i, j, text in lattice(run):
        s = score[i] + weight(text, j - i, counts, total)
        if s > score[j + 1] or (s == score[j + 1] and i > back[j + 1]):
            score[j + 1], back[j + 1] = s, i
    cuts, end = [], atoms
    while end:
        cuts.append("".join(run[2 * back[end] : 2 * end - 1]))
        end = back[end]
    return cuts[::-1]


def expected(run: list[str], counts: dict[str, float], total: float) -> dict[tuple[str, bool], float]:
    """Forward-backward: how often each segment of a run is expected to be a value; by form and whether it has inner signs."""
    atoms = (len(run) + 1) // 2
    segs = [(i, j + 1, text, math.exp(weight(text, j - i, counts, total))) for i, j, text in lattice(run)]
    ahead, behind = [1.0] + [0.0] * atoms, [0.0] * atoms + [1.0]
    for i, j, _, p in sorted(segs, key=lambda s: s[1]):
        ahead[j] += ahead[i] * p
    for i, j, _, p in sorted(segs, key=lambda s: -s[0]):
        behind[i] += p * behind[j]
    got: dict[tuple[str, bool], float] = Counter()
    for i, j, text, p in segs:
        got[known_form(text), j - i > 1] += ahead[i] * p * behind[j] / ahead[-1] if ahead[-1] else 0.0
    return got


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, field, value -> the items of the field in order, and the places of those that are open runs."""
    for b in batches:
        items, opens = [], []
        for v in b.column(2).to_pylist():
            runs = pieces(v)
            at = [i for i, r in enumerate(runs) if len(r) > 1]
            items.append(["".join(r) if len(r) > 1 else clean(r[0]) for r in runs])
            opens.append(at)
        cols = [b.column(0), b.column(1), pa.array(items, pa.list_(pa.string())), pa.array(opens, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, ["row_id", "field_name", "items", "opens"])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        forms = [sorted({known_form(t) for _, _, t in lattice(pieces(r)[0])}) for r in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(forms, pa.list_(pa.string()))], ["field_name", "run", "n", "forms"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expected counts of the segments of each run, times the times it occurs; one sum per form and batch."""
    for b in batches:
        got: Counter = Counter()
        for f, run, n, total, seen in zip(*(c.to_pylist() for c in b.columns)):
            for (form, inner), e in expected(pieces(run)[0], dict(seen), total).items():
                if form:
                    got[f, form, inner] += n * e
        keys = list(got)
        cols = [*(pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))), pa.array([got[k] for k in keys], pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, ["field_name", "form", "inner", "c"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cuts = [[clean(c) for c in best_cuts(pieces(r)[0], dict(seen), total)] for r, total, seen in zip(*(b.column(i).to_pylist() for i in (1, 3, 4)))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cuts, pa.list_(pa.string()))], ["field_name", "run", "values"])


_SEEN = "field_name string, run string, n long, total double, seen map<string,double>"


def _with_counts(runs: DataFrame, values: DataFrame) -> DataFrame:
    """Each run with the counts of its segments that have been met."""
    total = values.groupBy("field_name").agg(F.sum("c").alias("total"))  # a row per field
    met = (
        runs.select("field_name", "run", "n", F.explode("forms").alias("form"))
        .join(values, ["field_name", "form"])
        .groupBy("field_name", "run")
        .agg(F.map_from_entries(F.collect_list(F.struct("form", "c"))).alias("seen"))
    )
    none = F.create_map().cast("map<string,double>")
    return (
        runs.select("field_name", "run", "n")
        .join(met, ["field_name", "run"], "left")
        .join(F.broadcast(total), "field_name", "left")
        .select("field_name", "run", "n", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("seen", none).alias("seen"))
    )


def likely_splits(fields: DataFrame, alone: DataFrame) -> DataFrame:
    """``field_name, run, values``: the likeliest values of each distinct open run.

    ``fields(field_name, items, opens)`` are cut fields, ``alone(field_name, form, c)`` the counts of values that stand alone.
    """
    open_ = fields.where(F.size("opens") > 0).select("field_name", F.explode(F.transform("opens", lambda i: F.element_at("items", i + 1))).alias("run"))
    runs = cut(open_.groupBy("field_name", "run").agg(F.count(F.lit(1)).alias("n")).mapInArrow(_forms, "field_name string, run string, n long, forms array<string>"))
    # only values that are a segment of some run matter, besides the totals
    wanted = runs.select("field_name", F.explode("forms").alias("form")).distinct()
    rest = F.lit("\0rest")  # all others, for the totals
    near = alone.join(wanted.withColumn("w", F.lit(1)), ["field_name", "form"], "left").select("field_name", F.when(F.col("w") == 1, F.col("form")).otherwise(rest).alias("form"), "c")
    base = cut(near.groupBy("field_name", "form").agg(F.sum("c").alias("c")))
    values = base
    for _ in range(ROUNDS):
        learned = _with_counts(runs, values).mapInArrow(_learn, "field_name string, form string, inner boolean, c double").groupBy("field_name", "form", "inner").agg(F.sum("c").alias("c"))
        learned = learned.select("field_name", "form", F.when(F.col("inner"), F.col("c") - DISCOUNT).otherwise(F.col("c")).alias("c")).where("c > 0")
        values = cut(base.unionByName(learned).groupBy("field_name", "form").agg(F.sum("c").alias("c")))
    return _with_counts(runs, values).mapInArrow(_choose, "field_name string, run string, values array<string>")


def _form(item: F.Column) -> F.Column:
    return F.lower(F.trim(F.regexp_replace(item, _NOTE.pattern, "")))


def split_fields(rows: DataFrame, fields: list[str], key: str = "row_id") -> DataFrame:
    """``key, field_name, pos, item, n_items``: one row per value of each field, in the order of the field.

    ``pos`` counts from 1, ``n_items`` is the number of values of the field.  Null, empty
    and blank fields and fields of separators only give no row; empty values between
    separators are dropped and not counted, repeated values stay.  An unpaired quote or
    bracket is ordinary text.  Rows with the same key are split one by one.  The table may
    have any other columns; they are not read.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]))
    long = rows.select(F.col(key).cast("long").alias("row_id"), stacked.alias("x")).select("row_id", "x.field_name", "x.value").where(F.col("value").rlike(r"\S"))
    plain = long.where(~F.col("value").rlike(_MANY))
    bare = F.regexp_replace("value", r"^\s+|\s+$", "")
    quoted = bare.rlike(r'(?s)^".*"$') & (F.length(bare) >= 2)
    bare = F.when(quoted, F.regexp_replace(F.regexp_replace(bare, r'(?s)^"\s*(.*?)\s*"$', "$1"), '""', '"')).otherwise(bare)
    plain = plain.select("row_id", "field_name", bare.alias("value"))
    cutted = keep(long.where(F.col("value").rlike(_MANY)).mapInArrow(_cut_rows, "row_id long, field_name string, items array<string>, opens array<int>"))

    closed = cutted.select("field_name", F.explode(F.filter("items", lambda x, i: ~F.array_contains("opens", i))).alias("value"))
    alone = plain.select("field_name", "value").unionByName(closed).groupBy("field_name", _form(F.col("value")).alias("form")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    splits = likely_splits(cutted, alone)

    sure = cutted.where(F.size("opens") == 0).select("row_id", "field_name", "items")
    open_ = cutted.where(F.size("opens") > 0).select(F.monotonically_increasing_id().alias("id"), "row_id", "field_name", "items", "opens")
    # only open runs are joined with their values; a run that very many rows hold is spread over SALTS keys
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    runs = open_.select("id", salt, "field_name", F.explode("opens").alias("nr"), "items").select("id", "salt", "field_name", "nr", F.element_at("items", F.col("nr") + 1).alias("run"))
    spread = splits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = runs.join(spread, ["field_name", "run", "salt"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("nr", "values"))).alias("found"))
    put = open_.join(found, "id").select("row_id", "field_name", F.flatten(F.transform("items", lambda v, i: F.coalesce(F.col("found")[i], F.array(v)))).alias("items"))
    one = plain.select("row_id", "field_name", F.array("value").alias("items"))
    all_ = one.unionByName(sure).unionByName(put).select("row_id", "field_name", F.filter("items", lambda v: v != "").alias("items"))
    return all_.select(F.col("row_id").alias(key), "field_name", F.size("items").alias("n_items"), F.posexplode("items").alias("pos", "item")).select(
        key, "field_name", (F.col("pos") + 1).cast("int").alias("pos"), "item", "n_items"
    )
