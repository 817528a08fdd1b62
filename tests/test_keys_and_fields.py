from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from creditweave.operators import keyed, orphans, packed


def test_counts_match_brute_force_with_a_hot_key(spark):
    rng = np.random.default_rng(1)
    keys = [7] * 3000 + rng.integers(-50, 5000, 3000).tolist() + rng.integers(-(2**62), 2**62, 500).tolist() + [None] * 20
    rows = [(k, i % 3, "x") for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "a long, extra int, n_rows string").repartition(5)
    got = {r["key_id"]: (r["n_rows"], r["s"]) for r in keyed.keyed_counts(df, ["a"], {"s": df.extra}).collect()}
    want = Counter(k for k in keys if k is not None)
    sums = Counter()
    for k, e, _ in rows:
        if k is not None:
            sums[k] += e
    assert got == {k: (n, sums[k]) for k, n in want.items()}
    assert [r["key_id"] for r in keyed.heavy_keys(df, ["a"], 0.3).collect()] == [7]


def test_counts_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert keyed.keyed_counts(df, ["a", "b"]).count() == 0
    assert keyed.heavy_keys(df, ["a", "b"], 0.02).count() == 0


CASES = [
    ("A, B", ["A", "B"]),
    ('"Vocals, Lead"; Bass', ["Vocals, Lead", "Bass"]),
    ('"Remix 12"" Version" / Organ', ['Remix 12" Version', "Organ"]),
    ("Trombone [Lead, Slide] & Drums (Mix; Strings)", ["Trombone [Lead, Slide]", "Drums (Mix; Strings)"]),
    ("A1 ,B5 a C6", ["A1", "B5 a C6"]),
    ("2–3,8 |  | 9", ["2–3", "8", "9"]),
    ("Choir，Bass\nFlute", ["Choir", "Bass", "Flute"]),
    (", ;", []),
    ('12" Mix, 7" Mix', ['12" Mix', '7" Mix']),
    ("[open, Bass", ["[open", "Bass"]),
    ("Vocals, Vocals", ["Vocals", "Vocals"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_sure_separators(text, want):
    assert [packed.clean("".join(r)) for r in packed.pieces(text)] == want


def test_open_runs_are_split_by_learned_values(spark):
    values = ["Vocals", "Producer", "Bass", "Drums", "R&B Vocals", "A&R"]
    rows = [(i, v, None) for i, v in enumerate(v for v in values for _ in range(30))]
    rows += [(1000 + i, f"{a}/{b}", "x") for i, (a, b) in enumerate((a, b) for a in values for b in values if a != b)]
    rows += [(2000, None, None), (2001, "", None), (2002, "  ", None), (2003, ",", None), (2004, '"' + "x" * 50_000 + '", y', None), (2004, "p, q", None)]
    df = spark.createDataFrame(rows, "row_id long, role string, field_name string")
    got: dict[int, list] = {}
    for r in packed.split_fields(df, ["role"]).collect():
        got.setdefault(r["row_id"], []).append((r["pos"], r["item"], r["n_items"]))
    for i, (a, b) in enumerate((a, b) for a in values for b in values if a != b):
        assert [x[1] for x in sorted(got[1000 + i])] == [a, b]
    assert [x[1] for x in got[0]] == ["Vocals"] and not {2000, 2001, 2002, 2003} & set(got)
    assert sorted((p, len(t), n) for p, t, n in got[2004]) == [(1, 1, 2), (1, 50_000, 2), (2, 1, 2), (2, 1, 2)]


def test_values_of_many_parts_and_a_hot_run(spark):
    long = "/".join(f"Part{i}" for i in range(12))
    rows = [(i, f'"{long}"', None) for i in range(20)] + [(100 + i, long, None) for i in range(3)] + [(1000 + i, "Organ/Harp", None) for i in range(3000)] + [(9000 + i, v, None) for i, v in enumerate(["Organ", "Harp"] * 20)]
    got: dict[int, list] = {}
    for r in packed.split_fields(spark.createDataFrame(rows, "row_id long, role string, extra string"), ["role"]).collect():
        got.setdefault(r["row_id"], []).append(r["item"])
    assert all(got[i] == [long] for i in (0, 100, 102)) and all(got[1000 + i] == ["Organ", "Harp"] for i in range(3000))


def test_runs_of_known_values_are_not_learned_as_values(spark):
    rows = [(i, f"{s}{n}") for i, (s, n) in enumerate((s, n) for s in "ABCD" for n in range(1, 7) for _ in range(40))]
    rows += [(5000 + i, "A1/A2/A3/A4/A5/B6") for i in range(4)] + [(6000, "A4/B4/D1 - D2"), (6001, "C1//C3"), (6002, "Q&A"), (6003, "Q&A, B2")]
    got: dict[int, list] = {}
    for r in sorted(packed.split_fields(spark.createDataFrame(rows, "row_id long, tracks string"), ["tracks"]).collect(), key=lambda r: r["pos"]):
        got.setdefault(r["row_id"], []).append(r["item"])
    assert got[5000] == ["A1", "A2", "A3", "A4", "A5", "B6"] and got[6000] == ["A4", "B4", "D1 - D2"] and got[6001] == ["C1", "C3"]
    assert got[6002] == ["Q&A"] and got[6003] == ["Q&A", "B2"]


def test_split_of_an_empty_table(spark):
    assert packed.split_fields(spark.createDataFrame([], "row_id long, role string"), ["role"]).count() == 0


def test_bitmap_round_trip():
    codes, rows = np.array([0, 5, 77, 1023, 5]), np.array([0, 0, 0, 0, 2])
    bits = orphans.unpack_bits(orphans.pack_bits(codes, rows, (3, 1024)), (3, 1024))
    assert sorted(zip(*np.nonzero(bits))) == sorted(zip(rows, codes))


@pytest.mark.parametrize("keys", [pa.array([-(2**62), -3, 0, 7, 2**62]), pa.array(["", "a", "é日本", "z" * 70_000]), pa.array([], pa.int64()), pa.array([], pa.string())])
def test_dictionary_round_trip(keys):
    assert orphans.unpack_keys(orphans.pack_keys(keys), len(keys), pa.types.is_string(keys.type)).equals(keys)


def test_orphans_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    day = lambda d: datetime(2024, 1 + d // 28, 1 + d % 28)
    parents = {int(k): day(int(rng.integers(0, 300))) for k in rng.integers(0, 60, 45)}
    refs = [(i, int(rng.integers(0, 80)) if i % 3 else 5, day(int(rng.integers(0, 300)))) for i in range(3000)] + [(9001, None, day(3)), (9002, 79, None), (9003, 5, None)]
    r = spark.createDataFrame(refs, "row_id long, key long, loaded_at timestamp_ntz")
    p = spark.createDataFrame(list(parents.items()), "key long, first_seen timestamp_ntz")
    got = {(x["row_id"], x["load_month"]) for x in orphans.orphan_rows(r, p, "t").collect()}
    want = {(i, t and t.strftime("%Y-%m")) for i, k, t in refs if k is not None and (k not in parents or (t and parents[k] > t))}
    assert got == want
    # keys as texts, in blocks of few rows, with parents listed twice
    monkeypatch.setattr(orphans, "HELD_ROWS", 100)
    text = lambda d: d.withColumn("key", F.concat(F.lit("K"), F.col("key").cast("string")))
    late = p.withColumn("first_seen", F.expr("first_seen + interval 400 days"))
    assert {(x["row_id"], x["load_month"]) for x in orphans.orphan_rows(text(r), text(p.union(late)), "t", ranges=3).collect()} == want
    assert orphans.orphan_rows(r.limit(0), p, "t").count() == 0
    assert orphans.orphan_rows(r, p.limit(0), "t").count() == 3002
