"""Queries of null-model spreads, replicated labels, regressions on centralities and further logits over the order tables.

Draws and fits have no SQL; they are tested against brute force on small fixtures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweave.functions import maths
from creditweave.operators import dyads, graph, homophily, nulls, project, regress
from creditweave.queries import network
from creditweave.session import cut


def NUL12_spread(spark: SparkSession, base: str) -> DataFrame:
    """Exact mean, sd and z under permutation within degree strata, for each year and for all (year null)."""
    e, n = cut(network.dated(spark, base)), cut(network.known(spark, base))
    by_year = nulls.stratified_spread(e, n, "gender", ["F", "M"], ["year"])
    whole = nulls.stratified_spread(e.withColumn("part", F.lit(0)), n, "gender", ["F", "M"], ["part"])
    return by_year.unionByName(whole.drop("part").withColumn("year", F.lit(None).cast("int")))


def NUL13_cells(spark, base):
    """Observed over expected, sd and z within each gender of each genre and year, and edges between genders against what is left."""
    g = network.known(spark, base)
    e = homophily.edge_classes(network.dated(spark, base), g, "genre").where("ci = cj").withColumnRenamed("ci", "genre").select("u", "v", "year", "genre")
    x = nulls.stratified_spread(cut(e), g, "gender", ["F", "M"], ["year", "genre"])
    total = e.join(g.select(F.col("artist_id").alias("u")), "u", "left_semi").join(g.select(F.col("artist_id").alias("v")), "v", "left_semi").groupBy("year", "genre").agg(F.count(F.lit(1)).alias("m"))
    between = x.groupBy("year", "genre").agg(F.sum("observed").alias("o"), F.sum("expected").alias("e")).join(total, ["year", "genre"])
    none = F.lit(None).cast("double")
    mf = between.select("year", "genre", F.lit("between").alias("category"), (F.col("m") - F.col("o")).alias("observed"), (F.col("m") - F.col("e")).alias("expected"), none.alias("sd"), none.alias("z"))
    return x.unionByName(mf).withColumn("ratio", F.try_divide("observed", F.col("expected")))


def NUL1_cells(spark, base):
    """Each pair of genres against stub matching: mean, sd, ratio and z."""
    return nulls.cell_figures(homophily.edge_classes(network.dated(spark, base), network.nodes(spark, base), "genre"))


def NUL4_networks(spark, base):
    """r with interval and null by network (all, tracks, releases), era of both ends (or all) and attribute."""
    c, n = cut(network.credits(spark, base)), cut(network.nodes(spark, base))
    era = lambda x: F.when(F.col(x) <= 1995, "early").when(F.col(x) > 1995, "late")
    every = None
    for name, part in (("all", c), ("tracks", c.where("scope = 'track'")), ("releases", c.where("scope <> 'track'"))):
        e = cut(project.project(part))
        for attr in ("gender", "genre"):
            x = homophily.edge_classes(e, n, attr, keep=("debut_year",)).select("ci", "cj", era("debut_year_u").alias("eu"), era("debut_year_v").alias("ev"))
            x = x.select("ci", "cj", F.explode(F.when(F.col("eu") == F.col("ev"), F.array(F.lit("all"), F.col("eu"))).otherwise(F.array(F.lit("all")))).alias("era"), F.lit(name).alias("network"), F.lit(attr).alias("attribute"))
            every = x if every is None else every.unionByName(x)
    return nulls.class_figures(every, ["network", "era", "attribute"])


def NUL16_shape(spark, base):
    """log2 of the share of each number of shared partners after swaps over the observed share, by year and for all years (null)."""
    h = network.NUL15_reprojection(spark, base)
    b = h.groupBy("period").agg(F.count_distinct(F.when(F.col("replica") >= 0, F.col("replica"))).alias("b"))
    x = h.groupBy("period", "esp").agg(F.sum(F.when(F.col("replica") < 0, F.col("n")).otherwise(0)).cast("double").alias("observed"), F.sum(F.when(F.col("replica") >= 0, F.col("n")).otherwise(0)).alias("s"))
    x = x.join(b, x.period.eqNullSafe(b.period)).select(F.coalesce(x.period, F.lit(-1)).alias("period"), "esp", "observed", (F.col("s") / F.col("b")).alias("simulated"))
    return nulls.shape_deviation(x, ["period"], "esp", "observed", "simulated").withColumn("period", F.nullif("period", F.lit(-1)))


def GRF9_betweenness_exact(spark, base):
    """Betweenness from all sources of the largest component."""
    return graph.betweenness(network._adjacency(spark, base))


def _centralities(spark: SparkSession, base: str) -> DataFrame:
    e = network._adjacency(spark, base, "w")
    d = e.table("degree", e.degrees(), "long")
    for x in (graph.pagerank(e, rounds=1000, tolerance=1e-10), graph.eigenvector(e), graph.non_backtracking(e)):
        d = d.join(x, "node")
    n = network.known(spark, base)
    d = d.join(n, F.col("node") == F.col("artist_id"))
    return cut(d.withColumn("female", (F.col("gender") == "F").cast("double")).withColumn("log_n", maths.log_count(F.col("n_release"))).withColumn("cohort", F.col("cohort").cast("string")))


def _outcomes(d: DataFrame) -> dict[str, F.Column]:
    n = d.count()
    return {"pagerank": F.ln(F.col("pagerank") * n), "eigenvector": maths.log_rank(F.col("eigenvector")), "nonbacktracking": maths.log_rank(F.col("nonbacktracking")), "degree": F.log1p("degree")}


def REG8_centralities(spark, base):
    """The additive model on each centrality: gender, genre, cohort and number of releases."""
    d = _centralities(spark, base)
    x, genres = regress.dummies(regress.pool_rare(d, "genre", 20), "genre")
    x, cohorts = regress.dummies(x, "cohort")
    out = None
    for name, y in _outcomes(d).items():
        one = regress.ols_table(x.withColumn("__y", y), "__y", ["female", *genres, *cohorts, "log_n"]).withColumn("outcome", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def REG9_sampled_betweenness(spark, base):
    """The additive model on betweenness from 400 sources."""
    b = cut(graph.betweenness(network._adjacency(spark, base), sources=400))
    d = b.join(network.known(spark, base), F.col("node") == F.col("artist_id")).withColumn("female", (F.col("gender") == "F").cast("double")).withColumn("log_n", maths.log_count(F.col("n_release")))
    x, genres = regress.dummies(regress.pool_rare(d, "genre", 20), "genre")
    return regress.ols_table(x.withColumn("__y", maths.log_rank(F.col("betweenness"))), "__y", ["female", *genres, "log_n"])


def REG7_permuted_coefficient(spark, base):
    """Coefficient of gender in the additive model of degree, and its p by permutation within genre, cohort and quintile of releases."""
    d = cut(homophily.degrees(network.dated(spark, base)).join(network.known(spark, base), F.col("node") == F.col("artist_id")))
    d = d.withColumn("female", (F.col("gender") == "F").cast("double")).withColumn("log_n", maths.log_count(F.col("n_release"))).withColumn("cohort", F.col("cohort").cast("string")).withColumn("__y", F.log1p("degree"))
    x, genres = regress.dummies(regress.pool_rare(d, "genre", 20), "genre")
    x, cohorts = regress.dummies(x, "cohort")
    return regress.permuted_coefficient(x, "__y", "female", [*genres, *cohorts, "log_n"], ["genre", "cohort"], "log_n", "artist_id")


def REG4_case_control_by_year(spark, base):
    """Case-control logit of the edges first seen in each year over the nodes active in it."""
    e, n, out = cut(network.dated(spark, base)), cut(network.known(spark, base)), None
    for y in range(network.YEARS[0], network.YEARS[1] + 1):
        here = e.where(F.col("year") == y).join(n.select(F.col("artist_id").alias("u")), "u", "left_semi").join(n.select(F.col("artist_id").alias("v")), "v", "left_semi")
        active = n.join(here.select(F.explode(F.array("u", "v")).alias("artist_id")).distinct(), "artist_id", "left_semi")
        one = dyads.case_control(active, cut(here)).withColumn("year", F.lit(y))
        out = one if out is None else out.unionByName(one)
    return out


def REG3_node_bootstrap(spark, base):
    """Case-control logit with intervals from 200 random halves of the nodes."""
    return dyads.node_bootstrap(cut(network.known(spark, base)), cut(network.dated(spark, base)))


def GRF20_trimmed(spark, base):
    """The snowball of up to 1500 nodes without hubs until 6000 edges are left."""
    return graph.trimmed(cut(network.GRF20_snowball(spark, base)), 6000)


def REG14_difference(spark, base):
    """Difference of the coefficients of the first and the last year's exact logit, with z and p."""
    t = cut(network.REG2_logit_by_year(spark, base))
    a, b = (t.where(F.col("year") == y).withColumn("model", F.lit("exact")).select("model", "term", "coef", "se") for y in network.YEARS)
    return regress.difference_test(a, b, ["model", "term"])


QUERIES = {k: f for k, f in globals().items() if callable(f) and k.split("_")[0].rstrip("0123456789") in {"GRF", "NUL", "REG"}}
SQL: dict[str, str] = {}
