import json
import sqlite3
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from creditweave.functions import maths
from creditweave.operators import selection
from creditweave.plans.figures import figures
from creditweave.plans.watch import within
from creditweave.sources import entities, external, sinks
from creditweave.streaming import incremental


def test_database_by_query_and_by_ranges(spark, tmp_path):
    db = external.Database(f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver")
    spark.range(100).select(F.col("id").alias("K"), (F.col("id") % 7).alias("V")).write.format("jdbc").options(**db.options()).option("dbtable", "T").save()
    assert external.read_query(spark, db, "select K from T where V = 3").count() == 14
    parts = external.read_ranges(spark, db, "T", "K", 0, 100, 4)
    assert parts.count() == 100 and parts.rdd.getNumPartitions() == 4


def test_secrets_come_from_the_environment(monkeypatch):
    monkeypatch.setenv("CW_SECRET", "s3")
    got = external.Database("jdbc:x", user="u", secret="CW_SECRET", statement="set x").options()
    assert got == {"url": "jdbc:x", "user": "u", "password": "s3", "sessionInitStatement": "set x", "fetchsize": "10000"}


def test_csv_by_schema(spark, tmp_path):
    external.write_query(spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "id long, s string, x double"), f"{tmp_path}/c")
    df = external.read_csv(spark, f"{tmp_path}/c", "id long, s string, x double", ["x", "id"])
    assert df.columns == ["x", "id"] and sorted((r["id"], r["x"]) for r in df.collect()) == [(1, 2.5), (2, None)]
    with pytest.raises(Exception, match="(?i)malformed|schema|header|cast"):
        external.read_csv(spark, f"{tmp_path}/c", "id long, s long, x double").collect()


def test_sqlite_rows_that_are_filled(spark, tmp_path):
    at = f"{tmp_path}/x.db"
    with sqlite3.connect(at) as con:
        con.execute("create table t (id integer, name text)")
        con.executemany("insert into t values (?, ?)", [(i, ["n", " ", None][i % 3]) for i in range(50)])
        con.execute("create table e (id integer)")
    assert sorted(r["id"] for r in external.read_sqlite(spark, at, "t", "id long, name string", ["name"], 3).collect()) == list(range(0, 50, 3))
    assert external.read_sqlite(spark, at, "t", "id long, name string").count() == 50 and external.read_sqlite(spark, at, "e", "id long").count() == 0


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"network": {"most": 5}}))
    s = external.load_settings(str(tmp_path / "s.json"))
    assert s.network["most"] == 5 and s.network["per_track"] == 1.0 and s.population["least_all"] == 3
    (tmp_path / "s.json").write_text('{"nothing": {}}')
    with pytest.raises(ValueError, match="nothing"):
        external.load_settings(str(tmp_path / "s.json"))


def _entity(i, **more):
    value = lambda v: {"mainsnak": {"datavalue": {"value": v}}}
    return json.dumps({"id": f"Q{i}", "labels": {"en": {"value": f"E{i}"}}, "claims": {"P1": [value("a"), value("b")]}, **more})


def test_entities_whole_and_in_steps(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ["[", _entity(1, aliases={"it": [{"value": "uno"}], "en": [{"value": "one"}, {"value": "uno"}]}) + ",", _entity(2), '{"id": "Q3", "claims": {"P9": []}}', "no json P1", "]"]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    got = {r["id"]: tuple(r)[1:] for r in entities.entity_rows(spark, f"{tmp_path}/in", ['"P1"'], {"p": "P1", "q": "P2"}).collect()}
    assert got == {"Q1": ("E1", "uno|one", "a|b", ""), "Q2": ("E2", "", "a|b", "")}
    step = lambda: entities.ingest_entities(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", [], {"p": "P1"})
    step()
    (tmp_path / "in" / "b.json").write_text(_entity(7))
    step()
    step()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["Q1", "Q2", "Q3", "Q7"]


def test_new_files_are_read_once(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    go = lambda: incremental.ingest_new(spark, f"{tmp_path}/in", "id long", f"{tmp_path}/out", f"{tmp_path}/ck", lambda d: d.where("id > 0"))
    go()
    spark.range(10, 12).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 10, 11]


def test_streams_without_second_deliveries_and_by_window(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 5)), (1, datetime(2024, 1, 6)), (2, datetime(2024, 1, 7)), (3, datetime(2024, 3, 9))]
    spark.createDataFrame(rows, "k long, at timestamp").write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("k long, at timestamp").parquet(f"{tmp_path}/in")
    for name, df, mode in (("one", incremental.first_deliveries(read(), ["k"], "at", "10 days"), "append"), ("two", incremental.monthly_counts(read(), "at", "10 days"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["k"] for r in spark.table("one").collect()) == [1, 2, 3] and sum(r["n"] for r in spark.table("two").collect()) == 4


def test_tables_status_and_timings(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1.5, None), ("50 %", 2.0, 3)], "name string, x double, n int")
    sinks.save_table(df, f"{tmp_path}/t", "Shares & more")
    tex = (tmp_path / "t.tex").read_text()
    assert r"\caption{Shares \& more}" in tex and r"a\_b & 1.5000 &  \\" in tex and "{lrr}" in tex
    assert (tmp_path / "t.csv").read_text().splitlines() == ["name,x,n", "a_b,1.5,", "50 %,2.0,3"]
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.save_table(df, f"{tmp_path}/u", "", most_rows=1)
    assert sinks.read_status(f"{tmp_path}/s.json") == {}
    sinks.write_status(f"{tmp_path}/s.json", {"done": ["é"]})
    assert sinks.read_status(f"{tmp_path}/s.json") == {"done": ["é"]}
    sinks.log_timings(f"{tmp_path}/log.csv", {"a": 1.0})
    sinks.log_timings(f"{tmp_path}/log.csv", {"b": 2.0})
    assert (tmp_path / "log.csv").read_text().splitlines() == ["step,seconds", "a,1.0", "b,2.0"]


def test_export_with_manifest(spark, tmp_path):
    tables = {"t": spark.range(30), "nested": spark.createDataFrame([(1, [1, 2])], "id long, xs array<int>")}
    stats = sinks.with_bytes(sinks.export(tables, f"{tmp_path}/x", gzip_rows=10), f"{tmp_path}/x")
    sinks.write_manifest(stats, sinks.column_dictionary(tables), sinks.manifest(spark, f"{tmp_path}/x"), f"{tmp_path}/m")
    assert len((tmp_path / "m" / "manifest.csv").read_text().splitlines()) == 3 and "| nested | xs | array<int> |" in (tmp_path / "m" / "MANIFEST.md").read_text()
    assert all(len(x.split()[0]) == 64 for x in (tmp_path / "m" / "checksums.sha256").read_text().splitlines())
    assert list((tmp_path / "x" / "csv" / "t").glob("*.csv.gz")) and list((tmp_path / "x" / "csv" / "nested").glob("*.csv"))
    assert all(r["parquet_bytes"] > 0 and r["csv_bytes"] > 0 for r in stats.collect())


def test_actions_within_a_time(spark):
    assert within(spark, 60, lambda: spark.range(10).count()) == 10

    def slow(batches):
        time.sleep(20)
        yield from batches

    began = time.time()
    with pytest.raises(TimeoutError, match="cancelled"):
        within(spark, 1.5, lambda: spark.range(4).mapInPandas(slow, "id long").count())
    assert time.time() - began < 15 and spark.range(3).count() == 3


def test_figures(spark):
    a = spark.createDataFrame([(1, 2.5, "x")], "n long, r double, s string")
    assert {tuple(r) for r in figures({"a": a, "b": a.select("n")}).collect()} == {("a.n", 1.0), ("a.r", 2.5), ("b.n", 1.0)}


def test_functions_at_their_edges(spark):
    one = lambda c, v, t="double": spark.createDataFrame([(v,)], f"v {t}").select(c(F.col("v"))).first()[0]
    assert one(maths.expit, -800.0) == 0 and one(maths.expit, 800.0) == 1 and one(maths.log1p_exp, 800.0) == 800 and one(maths.log1p_exp, -800.0) == 0
    assert one(maths.log_count, 0, "long") == 0 and one(lambda c: maths.log2_clipped(c, F.lit(1.0)), 100.0) == 3 and one(lambda c: maths.log2_clipped(c, F.lit(1.0)), 0.0) is None
    assert [one(maths.valid_id, x, "string") for x in ("12", " 7 ", "0", "x", "2147483648", None, "9" * 30)] == [12, 7, None, None, None, None, None]
    assert one(lambda c: maths.coded(c, {"a": "1"}), " A ", "string") == "1" and one(lambda c: maths.coded(c, {"a": "1"}), None, "string") == "other"
    assert one(maths.suffix_of, "nodematch.gender.F", "string") == "F" and one(maths.suffix_of, "edges", "string") is None
    assert one(maths.listed, "a| |b ", "string") == ["a", "b"] and abs(one(maths.normal_p, 1.959963984540054) - 0.05) < 1e-12


@pytest.mark.parametrize(("name", "want"), [("Coro della Scala", "marker"), ("I Farmers", "marker"), ("Le Forestier", None), ("Anna e la sua orchestra", "marker"), ("Various (3)", "placeholder"), ("AA. VV.", "placeholder"), ("Mina", None), (None, None), ("Bandini", None)])
def test_names_of_no_person(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(selection.no_person(F.col("n"))).first()[0] == want
