"""Queries of skewed keys, packed fields and orphan references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweave.operators import keyed, orphans, packed
from creditweave.session import keep
from creditweave.sources import load

#: Share of all rows from which a key counts as heavy.
HEAVY_SHARE = 0.02


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    ra = load(spark, base, "raw_ra", "artist_id", "release_id")
    return keyed.heavy_keys(ra, ["artist_id", "release_id"], HEAVY_SHARE).select("field_name", "key_id")


def p4_counts(spark: SparkSession, base: str) -> DataFrame:
    ra = load(spark, base, "raw_ra")
    return keyed.keyed_counts(ra, ["artist_id", "release_id"], {"n_main": F.when(F.col("extra") == 0, 1).otherwise(0), "n_with_role": F.col("role").isNotNull().cast("int")})


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    values = packed.split_fields(load(spark, base, "raw_ra", "row_id", "role", "tracks"), ["role", "tracks"])
    return values.where("n_items > 1").select("row_id", "field_name", "pos", "item")


def p5_values(spark: SparkSession, base: str) -> DataFrame:
    """How often each value occurs in a field."""
    values = packed.split_fields(load(spark, base, "raw_rta", "row_id", "role"), ["role"])
    return values.groupBy("field_name", "item").agg(F.count(F.lit(1)).alias("n"))


def _references(spark: SparkSession, base: str) -> DataFrame:
    ra = load(spark, base, "raw_ra").select("row_id", F.col("release_id").alias("key"), "loaded_at")
    rta = load(spark, base, "raw_rta").select("row_id", orphans.track_key("track_id").alias("key"), "loaded_at")
    of_releases = orphans.orphan_rows(ra, orphans.current_releases(load(spark, base, "raw_releases")), "raw_ra")
    of_tracks = orphans.orphan_rows(rta, orphans.known_tracks(load(spark, base, "raw_reltracks")), "raw_rta")
    return of_releases.unionByName(of_tracks)


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return _references(spark, base)


def p7_report(spark: SparkSession, base: str) -> DataFrame:
    """Orphan references and all references, per table and month."""
    months = None
    for name in ("raw_ra", "raw_rta"):
        refers = F.col("release_id").isNotNull() if name == "raw_ra" else orphans.track_key("track_id").isNotNull()
        one = load(spark, base, name).groupBy(F.lit(name).alias("ref_table"), F.date_format("loaded_at", "yyyy-MM").alias("load_month")).agg(F.count_if(refers).alias("n_refs"))
        months = one if months is None else months.unionByName(one)
    found = keep(_references(spark, base)).groupBy("ref_table", "load_month").agg(F.count(F.lit(1)).alias("n_orphans"))
    on = [months[c].eqNullSafe(found[c]) for c in ("ref_table", "load_month")]
    return months.join(found, on, "left").select(months.ref_table, months.load_month, "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))


QUERIES = {f.__name__: f for f in (p4_found, p4_counts, p5_found, p5_values, p7_found, p7_report)}

_P7 = """
WITH rel AS (
  SELECT release_id, min(loaded_at) AS first_seen,
         arg_max(coalesce(upper(trim(status)), ''), struct_pack(a := loaded_at, b := coalesce(status, ''))) AS state
  FROM raw_releases GROUP BY 1),
trk AS (
  SELECT upper(trim(track_id)) AS k, min(loaded_at) AS first_seen FROM raw_reltracks WHERE trim(track_id) <> '' GROUP BY 1),
orph AS (
  SELECT 'raw_ra' AS ref_table, strftime(a.loaded_at, '%Y-%m') AS load_month, a.row_id
  FROM raw_ra a LEFT JOIN rel USING (release_id)
  WHERE a.release_id IS NOT NULL AND (rel.first_seen IS NULL OR state = 'DELETED' OR rel.first_seen > a.loaded_at)
  UNION ALL
  SELECT 'raw_rta', strftime(a.loaded_at, '%Y-%m'), a.row_id
  FROM raw_rta a LEFT JOIN trk ON trk.k = upper(trim(a.track_id))
  WHERE trim(a.track_id) <> '' AND (trk.first_seen IS NULL OR trk.first_seen > a.loaded_at))
"""

SQL = {
    "p4_found": """
SELECT 'artist_id' AS field_name, artist_id AS key_id FROM raw_ra WHERE artist_id IS NOT NULL
GROUP BY artist_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM raw_ra)
UNION ALL
SELECT 'release_id', release_id FROM raw_ra WHERE release_id IS NOT NULL
GROUP BY release_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM raw_ra)""",
    "p4_counts": """
SELECT 'artist_id' AS field_name, artist_id AS key_id, count(*) AS n_rows,
       count(*) FILTER (WHERE extra = 0) AS n_main, count(role) AS n_with_role
FROM raw_ra WHERE artist_id IS NOT NULL GROUP BY artist_id
UNION ALL
SELECT 'release_id', release_id, count(*), count(*) FILTER (WHERE extra = 0), count(role)
FROM raw_ra WHERE release_id IS NOT NULL GROUP BY release_id""",
    "p7_found": _P7 + "SELECT ref_table, load_month, row_id FROM orph",
    "p7_report": _P7
    + """, months AS (
  SELECT 'raw_ra' AS ref_table, strftime(loaded_at, '%Y-%m') AS load_month, count(release_id) AS n_refs FROM raw_ra GROUP BY 1, 2
  UNION ALL
  SELECT 'raw_rta', strftime(loaded_at, '%Y-%m'), count(*) FILTER (WHERE trim(track_id) <> '') FROM raw_rta GROUP BY 1, 2)
SELECT m.ref_table, m.load_month, n_refs, coalesce(n, 0) AS n_orphans
FROM months m LEFT JOIN (SELECT ref_table, load_month, count(*) AS n FROM orph GROUP BY 1, 2) o USING (ref_table, load_month)""",
}
