"""Quality of labels against coded ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """``truth, guess, n`` on the full grid of labels, 0 where nothing was met."""
    grid = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "truth string, guess string")
    n = df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["truth", "guess"], "left").select("truth", "guess", F.coalesce("n", F.lit(0)).alias("n"))


def precision_recall(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class from a confusion matrix, and their means weighted by support, undefined ones as 0."""
    x = matrix.select("truth", "guess", "n", F.explode(F.array("truth", "guess")).alias("label"))
    x = x.groupBy("label").agg(
        F.sum(F.when((F.col("truth") == F.col("label")) & (F.col("guess") == F.col("label")), F.col("n")).otherwise(0) / F.when(F.col("truth") == F.col("guess"), 2).otherwise(1)).cast("long").alias("tp"),
        F.sum(F.when((F.col("guess") == F.col("label")) & (F.col("truth") != F.col("label")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("truth") == F.col("label")) & (F.col("guess") != F.col("label")), F.col("n")).otherwise(0)).alias("fn"),
    )
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    x = x.select("label", (F.col("tp") + F.col("fn")).alias("support"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"))
    x = x.withColumn("f1", F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))

    def mean(c: str) -> F.Column:
        return F.try_divide(F.sum(F.coalesce(c, F.lit(0.0)) * F.col("support")), F.sum("support")).alias(c)

    return x.unionByName(x.agg(F.lit("weighted").alias("label"), F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), mean("precision"), mean("recall"), mean("f1")))


def accuracy_by(df: DataFrame, truth: str, guess: str, by: str) -> DataFrame:
    """Rows, accuracy and mean confidence by a column, over rows with a coded label."""
    known = df.where(F.col(truth).isNotNull())
    return known.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))


def replica_summary(df: DataFrame, by: list[str], value: str, digits: int = 6) -> DataFrame:
    """Replicas, mean, sample standard deviation, least, most and the middle 95 % of a figure."""
    return df.groupBy(*by).agg(
        F.count(value).alias("replicas"), F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_samp(value), digits).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.round(F.percentile(value, F.lit(0.025)), digits).alias("lo"), F.round(F.percentile(value, F.lit(0.975)), digits).alias("hi"),
    )


def bins(value: F.Column, edges: list[float]) -> F.Column:
    """Label of the right-closed bin that a value falls in; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        out = F.when((value > lo) & (value <= hi), f"{lo:g}-{hi:g}").otherwise(out)
    return out
