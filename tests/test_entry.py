import sys

import __spark_entry__ as entry
from creditweave.functions import text as T
from creditweave.operators import project
from creditweave.sources import sinks
from pyspark.sql import functions as F


def test_contract():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60


def test_nothing_needs_the_optional_part(monkeypatch):
    for m in [m for m in sys.modules if m.startswith("creditweave.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "creditweave.llm", None)
    assert not [k for k in entry.queries() if k.startswith(("p1_", "p2_", "p3_", "p6_", "p8_", "p9_", "p10_"))]


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r["attribute"] for r in rows} == {"gender", "genre"}


def test_text_functions(spark):
    one = lambda c, v, t="string": spark.createDataFrame([(v,)], f"v {t}").select(c(F.col("v"))).first()[0]
    assert one(T.clean_name, "Mina (3)") == "Mina"
    assert one(T.first_token, "Dr. Anna Rossi") == "Anna" and one(T.first_token, None) == ""
    assert one(T.looks_like_person, "Anna Rossi") and not one(T.looks_like_person, "Orchestra X") and not one(T.looks_like_person, "I Farmers")
    assert one(T.norm, "Élodie D'Or") == "elodiedor"
    cls = lambda r, s: spark.createDataFrame([(r, s)], "r string, s string").select(T.role_class(F.col("r"), F.col("s"))).first()[0]
    assert [cls("Written-By, Guitar", "main"), cls("Engineer [Assistant]", "main"), cls(None, "track"), cls(None, "umbrella"), cls("Arranged By", "main"), cls("arrang", "main")] == ["creative", "technical", "performance", "other", "creative", "creative"]
    parts = lambda x: one(T.track_field, x)
    assert [tuple(p) for p in parts("A1, B2 to B4")] == [("ONE", "A1", None), ("RANGE", "B2", "B4")]
    assert parts("all tracks except A1") is None and parts(" ") is None and parts(None) is None


def test_positions_resolve_whole_or_not(spark):
    tl = spark.createDataFrame([(1, i, p, f"T{i}") for i, p in enumerate(["A1", "A2", "A3", "A2"])], "release_id long, sequence int, position string, track_key string")
    c = spark.createDataFrame([(1, 1, "A1"), (2, 1, "A1 to A3"), (3, 1, "A1, C9"), (4, 1, "a2"), (5, 1, None)], "row_id long, release_id long, tracks string")
    got = {}
    for r in project.resolve_positions(c, tl).collect():
        got.setdefault(r["row_id"], set()).add(r["track_key"])
    assert got == {1: {"T0"}, 2: {"T0", "T1", "T2"}, 4: {"T3"}}


def test_save_once_and_manifest(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.save_once(spark, f"{tmp_path}/t", make).count() == 3
    assert len(made) == 1
    assert [tuple(r) for r in sinks.export({"t": spark.range(3)}, f"{tmp_path}/x").collect()] == [("t", 3, 1)]
    assert sinks.manifest(spark, f"{tmp_path}/x").count() > 2
