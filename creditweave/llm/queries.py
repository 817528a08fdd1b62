"""Queries of the training-data operators for text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweave.llm import language, lookalike, mixing, names, quota, subjects, tokens
from creditweave.session import cut
from creditweave.sources import load

SAMPLE_FIELDS = ["confidence_bin", "label_source", "musical_genre"]


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return lookalike.look_alike_pairs(load(spark, base, "validation_sample", "artist_id", "name"), "artist_id", "name")


def p1_names(spark: SparkSession, base: str) -> DataFrame:
    """Every name in its consistent form."""
    rows = load(spark, base, "validation_sample", "artist_id", "name")
    return lookalike.consistent(rows, "name", "name_consistent").withColumn("changed", ~F.col("name").eqNullSafe(F.col("name_consistent")))


def _profiles(spark: SparkSession, base: str) -> DataFrame:
    rows = load(spark, base, "validation_sample", "artist_id", "profile", "profile_lang")
    return language.languages(rows, ["artist_id", "profile_lang"], "profile", language.fit_prototypes(rows, "profile", "profile_lang"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    found = _profiles(spark, base).select("artist_id", language.label_column(F.col("profile_lang")).alias("label"), F.array_remove(F.array_distinct("segments.lang"), language.UNKNOWN).alias("langs"))
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return found.where((F.size("langs") > 0) & wrong).select("artist_id", F.explode("langs").alias("lang"))


def p2_segments(spark: SparkSession, base: str) -> DataFrame:
    """Each segment of each profile with its language and confidence."""
    return _profiles(spark, base).select("artist_id", F.posexplode("segments").alias("pos", "s")).select("artist_id", (F.col("pos") + 1).alias("pos"), "s.segment", "s.lang", "s.confidence")


def p2_profiles(spark: SparkSession, base: str) -> DataFrame:
    """Each profile with its language, confidence and number of languages; null language: no words."""
    judged = language.document_language(_profiles(spark, base))
    return judged.select("artist_id", "profile_lang", "lang", "confidence", F.size(F.array_distinct("segments.lang")).alias("n_languages"))


def _names(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "validation_sample", "artist_id", "name", "realname", "is_group", "debut_year", "gender")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return names.linked_pairs(_names(spark, base), "artist_id")


def p3_entities(spark: SparkSession, base: str) -> DataFrame:
    """Each row with the entity it belongs to and the rows of that entity."""
    return names.linked_sets(_names(spark, base), "artist_id")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    _, report = _sample(spark, base)
    return report.where("unavailable > 0").select("field_name", "category")


def p6_sample(spark: SparkSession, base: str) -> DataFrame:
    return _sample(spark, base)[0]


def p6_report(spark: SparkSession, base: str) -> DataFrame:
    return _sample(spark, base)[1]


def _sample(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, base, "validation_sample", "artist_id", *SAMPLE_FIELDS)
    return quota.quota_sample(rows, "artist_id", SAMPLE_FIELDS, load(spark, base, "sample_targets"))


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return tokens.token_ids(load(spark, base, "documents"), ["doc_id"], "text")


def p8_joined(spark: SparkSession, base: str) -> DataFrame:
    """How many documents are encoded by halves, and how many encodings equal that of the whole text."""
    return tokens.joined_exactly(load(spark, base, "documents", "text"), "text")


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[1].where("short").select("source")


def _mix(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    counts = cut(tokens.token_counts(load(spark, base, "documents"), ["doc_id", "source"], "text"))
    return mixing.mix(counts, load(spark, base, "source_targets"))


def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[0]


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[1]


def _subjects(spark: SparkSession, base: str, mentions: bool = False) -> DataFrame:
    docs = load(spark, base, "documents", "doc_id", "text")
    model = subjects.fit_subjects(docs, load(spark, base, "doc_subjects"), load(spark, base, "subject_areas"))
    return subjects.subjects_of(docs, ["doc_id"], "text", model, mentions)


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return _subjects(spark, base).select("doc_id", "subject")


def p10_subjects(spark: SparkSession, base: str) -> DataFrame:
    """Subjects with the sentences that speak of them and the mean confidence; ones mentioned in passing too."""
    return _subjects(spark, base, mentions=True)


def p10_composition(spark: SparkSession, base: str) -> DataFrame:
    """Documents and share of the corpus by subject."""
    found = _subjects(spark, base).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"))
    total = load(spark, base, "documents").agg(F.count(F.lit(1)).alias("total"))
    areas = load(spark, base, "subject_areas", "subject")
    n = F.coalesce("n_docs", F.lit(0))
    return areas.join(found, "subject", "left").crossJoin(F.broadcast(total)).select("subject", n.alias("n_docs"), F.when(F.col("total") > 0, n / F.col("total")).otherwise(0.0).alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_names, p2_found, p2_segments, p2_profiles, p3_found, p3_entities, p6_found, p6_sample, p6_report, p8_ids, p8_joined, p9_found, p9_mix, p9_shares, p10_found, p10_subjects, p10_composition)}

SQL = {
    "p8_joined": f"SELECT count(*) AS n_texts, count(*) FILTER (WHERE length(text) > {tokens.LONG}) AS n_joined, count(*) AS n_equal FROM documents",
    "p6_found": """
WITH n AS (SELECT (count(*) // 10)::double AS n FROM validation_sample),
have AS (
  SELECT 'confidence_bin' AS field_name, confidence_bin AS category, count(*) AS k FROM validation_sample GROUP BY 2
  UNION ALL SELECT 'label_source', label_source, count(*) FROM validation_sample GROUP BY 2
  UNION ALL SELECT 'musical_genre', musical_genre, count(*) FROM validation_sample GROUP BY 2)
SELECT t.field_name, t.category FROM sample_targets t CROSS JOIN n
LEFT JOIN have h ON h.field_name = t.field_name AND h.category = t.category
WHERE coalesce(k, 0) < greatest(t.target_share * n, t.min_rows::double)""",
}
