"""Selection of the population, its attributes and the label cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditweave.functions.text import decade
from creditweave.operators.rank import group_rank

# Names that stand for nobody in particular.
EXCLUDED_NAMES = [r"^various( artists?)?( \(\d+\))?$", r"^unknown artist", r"^no artist", r"^traditional$"]


def credit_counts(credits: DataFrame, inside: Column) -> DataFrame:
    """``artist_id, n_it, n_all, share``: credit rows of each artist, and those where ``inside`` holds, in one pass."""
    c = credits.groupBy("artist_id").agg(F.count_if(inside).alias("n_it"), F.count(F.lit(1)).alias("n_all"))
    return c.withColumn("share", F.col("n_it") / F.col("n_all"))


def select_population(counts: DataFrame, names: DataFrame, least_in: int = 2, least_all: int = 3, least_share: float = 0.5) -> DataFrame:
    """Artists with enough credits and share whose name is not an excluded one."""
    kept = counts.where((F.col("n_it") >= least_in) & (F.col("n_all") >= least_all) & (F.col("share") >= least_share))
    bad = F.lit(False)
    for p in EXCLUDED_NAMES:
        bad = bad | F.col("name").rlike(f"(?i){p}")
    return kept.join(names.where(~bad), "artist_id", "left_semi")


def activity(credits: DataFrame, releases: DataFrame, inside: Column | None = None) -> DataFrame:
    """Distinct releases and first, last and median year of each artist."""
    one = credits.select("artist_id", "release_id").distinct().join(releases, "release_id", "left")
    return one.groupBy("artist_id").agg(
        F.count(F.lit(1)).alias("n_release"), F.count_if(inside if inside is not None else F.lit(True)).alias("n_inside"), F.min("year").alias("debut_year"), F.max("year").alias("last_year"), F.median("year").alias("median_year")
    )


def cohorts(acts: DataFrame, floor: int, split: int) -> DataFrame:
    """Adds the cohort decade, of which the lowest holds unknown years too, and the era."""
    y = F.col("debut_year")
    return acts.withColumn("cohort_decade", decade(y, floor)).withColumn("era", F.when(y < split, "early").when(y >= split, "late"))


def top_tags(tags: DataFrame, key: str, tag: str, weak_share: float = 0.4) -> DataFrame:
    """First and second tag of each key with the share of the first; ties go to the smaller tag."""
    n = tags.groupBy(key, tag).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    ranked = n.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), tag))).withColumn("total", F.sum("n").over(w)).where("rank <= 2")
    top = ranked.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col(tag))).alias("tag_1"), F.max(F.when(F.col("rank") == 2, F.col(tag))).alias("tag_2"), F.max(F.when(F.col("rank") == 1, F.col("n") / F.col("total"))).alias("share"), F.max("total").alias("n_tags")
    )
    return top.withColumn("weak", F.col("share") < weak_share)


def first_by_priority(levels: list[DataFrame], key: str) -> DataFrame:
    """One row per key: that of the first of ``levels`` that has it; within a level the smallest label."""
    every = None
    for i, level in enumerate(levels):
        one = level.withColumn("level", F.lit(i))
        every = one if every is None else every.unionByName(one)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("level", "label"))
    return every.withColumn("rank", rank).where("rank = 1").drop("rank")


def name_dictionary(names: DataFrame, least_n: int, least_purity: float) -> DataFrame:
    """``fn, n_f, n_m, n, purity, label`` of first names that are used for one class nearly always; ties go to M."""
    d = names.where("fn <> ''").groupBy("fn").agg(F.count_if(F.col("label") == "F").alias("n_f"), F.count_if(F.col("label") == "M").alias("n_m"))
    d = d.withColumn("n", F.col("n_f") + F.col("n_m")).where(F.col("n") >= least_n)
    d = d.withColumn("purity", F.greatest("n_f", "n_m") / F.col("n")).withColumn("label", F.when(F.col("n_m") >= F.col("n_f"), "M").otherwise("F"))
    return d.where(F.col("purity") >= least_purity)


def group_composition(members: DataFrame, least_known: int = 2) -> DataFrame:
    """Label of each group by its members' labels: mixed, the one label, or unknown if too few are known."""
    known = F.col("label").isin("M", "F")
    g = members.groupBy("group_id").agg(F.count_if(known).alias("n_known"), F.count_if(F.col("label") == "F").alias("n_f"), F.count(F.lit(1)).alias("n_members"))
    label = F.when(F.col("n_known") < least_known, "unknown").when((F.col("n_f") > 0) & (F.col("n_f") < F.col("n_known")), "mixed").when(F.col("n_f") > 0, "F").otherwise("M")
    return g.withColumn("label", label)


def unique_name_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join on a name that is unique on both sides."""
    w = Window.partitionBy(on)
    l, r = (d.where(F.col(on).isNotNull() & (F.col(on) != "")).withColumn("__n", F.count(F.lit(1)).over(w)).where("__n = 1").drop("__n") for d in (left, right))
    return l.join(r, on)


def exact_join(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """Inner join on an id, ids that ``right`` gives several labels left out; repeated rows of ``right`` count once."""
    one = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("__most")).where(F.col(label) == F.col("__most")).drop("__most")
    return left.join(one, key)


def rank_quintile(df: DataFrame, column: str, key: str, bins: int = 5, by: list[str] | None = None) -> DataFrame:
    """Bin 1..bins of each row by rank, edges at equal steps of the rank; ties by ``key``."""
    r = group_rank(df, by or [], [column, key])
    k = F.ceil((F.col("__r") - 1) * bins / F.greatest(F.col("__n") - 1, F.lit(1)))
    return r.withColumn("quintile", F.greatest(k, F.lit(1)).cast("int")).drop("__r", "__n")
