"""Credits to person-person edges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditweave.functions.text import blank_to_null, track_field


@dataclass(frozen=True)
class Weights:
    """Specificity of credits by scope, weight of a shared track and of a shared release, and the largest cast."""

    track: float = 1.0
    main: float = 0.7
    umbrella: float = 0.3
    per_track: float = 1.0
    per_release: float = 1.0
    most: int = 8
    least_weight: float = 0.0


def specificity(w: Weights) -> Column:
    return F.when(F.col("scope") == "track", w.track).when(F.col("scope") == "main", w.main).otherwise(w.umbrella)


def in_band(df: DataFrame, key: str, least: int, most: int, member: str = "artist_id") -> DataFrame:
    """Rows of the keys that have ``least`` to ``most`` distinct members."""
    ok = df.groupBy(key).agg(F.count_distinct(member).alias("__n")).where(F.col("__n").between(least, most))
    return df.join(ok.select(key), key, "left_semi")


def casts(df: DataFrame, key: str, most: int, strength: str | None = None) -> DataFrame:
    """``key, cast array<struct<m, s>>``: the distinct members of each key that has 2 to ``most``, in order, with their greatest strength.

    Members beyond ``most + 1`` are cut off before and after the one shuffle by key, so a key that holds a third of the
    rows brings a few rows of each task, and no task gathers it.
    """
    one = df.where(F.col(key).isNotNull()).groupBy(key, "artist_id").agg((F.max(strength) if strength else F.lit(1.0)).alias("s"))
    few = one.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy("artist_id"))).where(F.col("__i") <= most + 1)
    return few.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("artist_id").alias("m"), "s"))).alias("cast")).where(F.size("cast").between(2, most))


def cast_pairs(cast: str = "cast") -> Column:
    """Pairs ``u < v, w`` of an ordered cast, at most most x (most - 1) / 2 of them."""
    c = F.col(cast)
    return F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y: F.struct(x["m"].alias("u"), y["m"].alias("v"), (x["s"] * y["s"]).alias("w")))))


def pairs(df: DataFrame, key: str, strength: str | None, factor: float, most: int) -> DataFrame:
    """``u < v, w``: members that share a key, a row per key, weighted by the product of their strengths or by 1."""
    return casts(df, key, most, strength).select(F.explode(cast_pairs()).alias("p")).select("p.u", "p.v", (F.col("p.w") * factor).alias("w"))


def project(credits: DataFrame, w: Weights = Weights()) -> DataFrame:
    """``u, v, w`` from ``credits(artist_id, release_id, track_key, scope)``; track keys count on any scope that has one."""
    c = credits.withColumn("s", specificity(w))
    both = pairs(c, "track_key", None, w.per_track, w.most).unionByName(pairs(c, "release_id", "s", w.per_release, w.most))
    e = both.groupBy("u", "v").agg(F.round(F.sum("w"), 6).alias("w"))
    return e.where(F.col("w") >= w.least_weight) if w.least_weight > 0 else e


def _members(key: pa.Array, member: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the distinct members of each key, in order of member (null first) within the key; the place of each in its cast; the size of that."""
    code, member = key.dictionary_encode().indices.to_numpy(), member.dictionary_encode()
    n = len(member.dictionary) + 1
    rank = np.zeros(n, np.int64)
    rank[np.argsort(member.dictionary.to_numpy())] = np.arange(1, n)
    at = code * np.int64(n) + rank[member.indices.fill_null(-1).to_numpy()]
    row = np.argsort(at)
    row = row[np.diff(at[row], prepend=-1) > 0]
    head = np.flatnonzero(np.diff(code[row], prepend=-1))
    size = np.diff(head, append=len(row))
    return row, np.arange(len(row)) - np.repeat(head, size), np.repeat(size, size)


def links(credits: DataFrame, most: int = 8, chunk: int = 500_000) -> DataFrame:
    """``u < v``: the pairs that ``project`` gives a weight above 0, for what needs no weight; a pair may come more than once.

    Casts are gathered and paired as arrays, ``chunk`` credits and a shuffle partition of keys at a time.  Of a key only ``most + 1``
    members of a chunk are sent on, enough to tell that it has too many, so no task gathers a key that holds a third of the rows.
    """
    parts = int(credits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("track_key", "release_id")
    c = credits.select(F.col("artist_id").cast("long").alias("m"), *keys, *[F.pmod(F.xxhash64(k), F.lit(parts)).cast("int").alias(f"p{i}") for i, k in enumerate(keys)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blobs(held):
            t = pa.Table.from_batches(held)
            out = []
            for i, k in enumerate(keys):
                x = t.select([k, "m", f"p{i}"]).filter(t[k].is_valid()).combine_chunks()
                if not x.num_rows:
                    continue
                row, place, _ = _members(x[k].chunk(0), x["m"].chunk(0))
                part, row = x[f"p{i}"].chunk(0).to_numpy(), row[place <= most]
                row = row[np.argsort(part[row], kind="stable")]
                part, x = part[row], x.select([k, "m"]).rename_columns(["k", "m"]).take(row).combine_chunks()
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                for lo, hi in zip(cuts, cuts[1:]):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, x.schema) as w:
                        w.write_table(x.slice(lo, hi - lo))
                    out.append((i * parts + int(part[lo]), sink.getvalue().to_pybytes()))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["part", "casts"])

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk:
                yield blobs(held)
                held, rows = [], 0
        if rows:
            yield blobs(held)

    def pair(t: pa.Table) -> pa.Table:
        x = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in t["casts"]]).combine_chunks()
        k, m = x["k"].chunk(0), x["m"].chunk(0)
        row, place, size = _members(k, m)
        size = np.where(size <= most, size, 0)
        known, m = m.is_valid().to_numpy(zero_copy_only=False)[row], m.fill_null(0).to_numpy()[row]
        first = [np.flatnonzero(place + d < size) for d in range(1, most)]
        u = np.concatenate(first)
        v = u + np.repeat(np.arange(1, most), [len(i) for i in first])
        both = known[u] & known[v]
        return pa.table({"u": m[u[both]], "v": m[v[both]]})

    return c.mapInArrow(route, "part int, casts binary").groupBy("part").applyInArrow(pair, "u long, v long")


def dated_edges(credits: DataFrame, releases: DataFrame, years: tuple[int, int], most: int = 8) -> DataFrame:
    """``u, v, year, n_shared``: pairs with the year of their first shared work and the number of those.

    The year joins the cast of a release, one row, not its credits.
    """
    when = releases.where(F.col("year").between(*years)).groupBy("release_id").agg(F.min("year").alias("year"))
    each = casts(credits.select("artist_id", "release_id"), "release_id", most).join(when, "release_id").select("year", F.explode(cast_pairs()).alias("p"))
    return each.groupBy("p.u", "p.v").agg(F.min("year").alias("year"), F.count(F.lit(1)).alias("n_shared"))


def filter_credits(credits: DataFrame, sizes: DataFrame, various: DataFrame, *, most: int = 8, exclude_compilations: bool = False, track_credits: bool = True) -> DataFrame:
    """Credits of releases of up to ``most`` credited artists (1 if unknown) that are no sampler.

    Without ``track_credits`` credits of tracks count as umbrella ones and lose their track.
    """
    c = credits.join(sizes, "release_id", "left").where(F.coalesce("n_credited", F.lit(1)) <= most)
    c = c.join(various.select("release_id").distinct(), "release_id", "left_anti")
    if exclude_compilations:
        c = c.where(F.coalesce("n_main", F.lit(1)) <= 1)
    if not track_credits:
        c = c.withColumn("track_key", F.lit(None).cast("string")).withColumn("scope", F.when(F.col("scope") == "track", "umbrella").otherwise(F.col("scope")))
    return c.drop("n_credited", "n_main")


def resolve_positions(credits: DataFrame, tracklist: DataFrame) -> DataFrame:
    """Credits ``(row_id, release_id, tracks)`` resolved to tracks of the release: ``row_id, release_id, track_key``.

    ``tracklist(release_id, sequence, position, track_key)``.  Positions are ordinals of the
    track list; of a position given twice the last one counts.  A credit resolves only if all of
    its parts do; a range goes from its first to its last ordinal.  Each track field of a release is
    resolved once, however many credits have it, and a range is opened to its ordinals, so
    that all joins are on equal keys that spread a release of very many credits.
    """
    w = Window.partitionBy("release_id").orderBy("sequence", "track_key")
    order = tracklist.withColumn("ordinal", F.row_number().over(w) - 1)
    at = order.where(blank_to_null(F.col("position")).isNotNull()).groupBy("release_id", F.upper(F.trim("position")).alias("position")).agg(F.max("ordinal").alias("ordinal"))
    fields = credits.where(F.col("tracks").isNotNull()).select("release_id", "tracks").distinct()
    parts = fields.select("release_id", "tracks", F.posexplode(track_field(F.col("tracks"))).alias("nr", "p")).select("release_id", "tracks", "nr", "p.kind", "p.first", "p.last")
    first = at.select("release_id", F.col("position").alias("first"), F.col("ordinal").alias("lo"))
    last = at.select("release_id", F.col("position").alias("last"), F.col("ordinal").alias("hi"))
    got = parts.join(first, ["release_id", "first"], "left").join(last, ["release_id", "last"], "left")
    got = got.withColumn("hi", F.when(F.col("kind") == "ONE", F.col("lo")).otherwise(F.col("hi")))
    good = F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("lo") <= F.col("hi"))
    whole = got.groupBy("release_id", "tracks").agg(F.bool_and(good).alias("ok"), F.collect_list(F.struct("lo", "hi")).alias("spans")).where("ok")
    places = whole.select("release_id", "tracks", F.explode(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["lo"], s["hi"]))))).alias("ordinal"))
    found = places.join(order.select("release_id", "ordinal", "track_key"), ["release_id", "ordinal"]).select("release_id", "tracks", "track_key").distinct()
    return credits.select("row_id", "release_id", "tracks").join(found, ["release_id", "tracks"]).select("row_id", "release_id", "track_key").distinct()
