"""Queries of projection, homophily, null models, graph structure and models, over the order tables, with their SQL.

A part is an artist, an order a release, a line a credit whose return flag gives the scope;
``p_size`` gives the gender and the first word of ``p_type`` the genre of an artist.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweave.operators import dyads, graph, homophily, nulls, project, regress, resample
from creditweave.operators.adjacency import Adjacency, adjacency
from creditweave.session import cut
from creditweave.sources import load

YEARS = (1995, 2001)


def credits(spark: SparkSession, base: str) -> DataFrame:
    l = load(spark, base, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")
    scope = F.when(F.col("l_returnflag") == "A", "track").when(F.col("l_returnflag") == "N", "main").otherwise("umbrella")
    key = F.when(F.col("l_returnflag") == "A", F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return l.select(F.col("l_partkey").alias("artist_id"), F.col("l_orderkey").alias("release_id"), key.alias("track_key"), scope.alias("scope"))


def releases(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("release_id"), F.year("o_orderdate").alias("year"))


def nodes(spark: SparkSession, base: str) -> DataFrame:
    act = credits(spark, base).select("artist_id", "release_id").distinct().join(releases(spark, base), "release_id", "left").groupBy("artist_id").agg(F.count(F.lit(1)).alias("n_release"), F.min("year").alias("debut_year"))
    p = load(spark, base, "part", "p_partkey", "p_size", "p_type")
    g = F.when(F.col("p_size") % 10 == 0, "F").when((F.col("p_size") % 10).isin(1, 2), "unknown").otherwise("M")
    n = p.select(F.col("p_partkey").alias("artist_id"), g.alias("gender"), F.substring_index("p_type", " ", 1).alias("genre")).join(act, "artist_id", "left")
    return n.select("artist_id", "gender", "genre", F.coalesce("n_release", F.lit(0)).alias("n_release"), "debut_year", F.col("debut_year").alias("cohort"))


def known(spark: SparkSession, base: str) -> DataFrame:
    return nodes(spark, base).where("gender in ('F', 'M')")


def dated(spark: SparkSession, base: str) -> DataFrame:
    return project.dated_edges(credits(spark, base), releases(spark, base), YEARS)


def _small(spark: SparkSession, base: str) -> DataFrame:
    """Dated edges of the first year, the graph that the SQL of GRF14 and GRF17 is written for; the ``_whole`` queries take all edges."""
    return dated(spark, base).where(F.col("year") == YEARS[0]).select("u", "v", F.col("n_shared").cast("double").alias("w"))


def _giant(spark: SparkSession, base: str) -> DataFrame:
    """Largest component of the projection over all years, the graph of the centralities."""
    return cut(graph.giant_component(cut(GRF1_projection(spark, base))))


def _adjacency(spark: SparkSession, base: str, weight: str | None = None) -> Adjacency:
    """The same in files, for what needs vectors over its nodes only."""
    return adjacency(GRF1_projection(spark, base, weight is not None), weight, simple=weight is None).giant()


def _r(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def GRF1_projection(spark, base, weighted=True):
    """The edges with their weights, or only the pairs, some of them more than once."""
    return project.project(credits(spark, base)) if weighted else project.links(credits(spark, base))


def GRF4_subnetworks(spark, base):
    """Edges and weight of the projection of each kind of credits."""
    c = credits(spark, base)
    out = None
    for name, part in (("all", c), ("tracks", c.where("scope = 'track'")), ("releases", c.where("scope <> 'track'"))):
        e = project.project(part).agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("w"), 4).alias("weight"), F.max("w").alias("w_max")).withColumn("network", F.lit(name))
        out = e if out is None else out.unionByName(e)
    return out


def GRF5_dated_edges(spark, base):
    return dated(spark, base)


def GRF6_degree(spark, base):
    return homophily.degrees(GRF1_projection(spark, base), weight="w")


def AGG11_mixing(spark, base):
    c = homophily.edge_classes(GRF1_projection(spark, base), nodes(spark, base), "gender")
    return _r(homophily.mixing(c, weight="w").select("ci", "cj", F.round("m", 4).alias("m"), "share"))


def NUL1_observed_expected(spark, base):
    c = homophily.edge_classes(dated(spark, base), nodes(spark, base), "genre")
    return _r(homophily.observed_expected(homophily.mixing(c)))


def MTH2_assortativity(spark, base):
    """Newman's r of gender and genre, plain and weighted, with the mean under stub matching."""
    e, n = cut(GRF1_projection(spark, base)), nodes(spark, base)
    out = None
    for attr in ("gender", "genre"):
        c = homophily.edge_classes(e, n, attr)
        plain = homophily.assortativity(homophily.mixing(c))
        heavy = homophily.assortativity(homophily.mixing(c, weight="w")).select(F.col("r").alias("r_weighted"))
        one = plain.crossJoin(heavy).select(F.lit(attr).alias("attribute"), "r", "r_weighted", "r_expected")
        out = one if out is None else out.unionByName(one)
    return _r(out)


def NUL4_strata(spark, base):
    """r by scope of the edge's first year and era of both ends."""
    c = homophily.edge_classes(dated(spark, base), nodes(spark, base).where("debut_year is not null"), "gender", keep=("debut_year",))
    era = lambda x: F.when(F.col(x) <= 1995, "early").otherwise("late")
    c = c.withColumn("era", era("debut_year_u")).where(F.col("era") == era("debut_year_v"))
    return _r(homophily.assortativity(homophily.mixing(c, ["year", "era"]), ["year", "era"]))


def NUL5_known_only(spark, base):
    n = nodes(spark, base)
    kept = n.withColumn("gender", F.when(F.col("gender").isin("F", "M"), F.col("gender")))
    e = dated(spark, base)
    a = homophily.assortativity(homophily.mixing(homophily.edge_classes(e, n, "gender"))).withColumn("nodes", F.lit("all"))
    b = homophily.assortativity(homophily.mixing(homophily.edge_classes(e, kept, "gender"))).withColumn("nodes", F.lit("known"))
    return _r(a.unionByName(b))


def NUL6_within_genre(spark, base):
    c = homophily.edge_classes(dated(spark, base), known(spark, base), "gender", keep=("genre",)).where("genre_u = genre_v").withColumnRenamed("genre_u", "genre")
    return _r(homophily.observed_expected(homophily.mixing(c, ["genre"]), ["genre"]))


def NUL7_uniform(spark, base):
    return _r(homophily.uniform_permutation(dated(spark, base).withColumn("part", F.lit("whole")), known(spark, base), "gender", ["F", "M"], ["part"]), 6)


def NUL9_uniform_by_year(spark, base):
    return _r(homophily.uniform_permutation(dated(spark, base), known(spark, base), "gender", ["F", "M"], ["year"]), 6)


def NUL11_strata(spark, base):
    d = homophily.degrees(homophily.edge_classes(dated(spark, base), known(spark, base), "gender"), ["year"])
    return homophily.degree_strata(d, ["year"])


def NUL10_degree_strata(spark, base):
    return _r(homophily.stratified_permutation(dated(spark, base), known(spark, base), "gender", ["F", "M"], ["year"]), 6)


def GRF23_cells(spark, base):
    return _r(homophily.cell_densities(dated(spark, base), nodes(spark, base), "year"), 9)


def AGG12_wilson(spark, base):
    n = known(spark, base).groupBy("genre", "debut_year").agg(F.count_if(F.col("gender") == "F").alias("n_f"), F.count(F.lit(1)).alias("n"))
    lo, hi = homophily.wilson(F.col("n_f"), F.col("n"))
    return _r(n.select("genre", "debut_year", "n_f", "n", (F.col("n_f") / F.col("n")).alias("share"), lo.alias("lo"), hi.alias("hi")))


def GRF14_clustering(spark, base):
    return _r(graph.clustering(_small(spark, base)), 7)


def GRF14_clustering_whole(spark, base):
    return _r(graph.clustering(_giant(spark, base)), 7)


def GRF17_shared_partners(spark, base):
    inc = credits(spark, base).select(F.col("artist_id").alias("a"), F.col("release_id").alias("r")).distinct()
    inc = inc.join(releases(spark, base).where(F.col("year") == YEARS[0]).select(F.col("release_id").alias("r")), "r", "left_semi")
    return graph.explained_partners(_small(spark, base), project.in_band(inc.withColumnRenamed("a", "artist_id"), "r", 2, 8).withColumnRenamed("artist_id", "a"))


def GRF17_shared_partners_whole(spark, base):
    """Shared partners of all edges of the projection, explained by the releases of all years."""
    inc = project.in_band(credits(spark, base).select("artist_id", "release_id").distinct(), "release_id", 2, 8)
    return graph.explained_partners(cut(GRF1_projection(spark, base)), inc.select(F.col("artist_id").alias("a"), F.col("release_id").alias("r")))


def _esp_histogram(x: DataFrame) -> DataFrame:
    x = x.withColumn("share", F.coalesce(F.try_divide("esp_explained", "esp"), F.lit(0.0)))
    return _r(x.groupBy(F.least("esp", F.lit(26)).alias("esp")).agg(F.count(F.lit(1)).alias("n"), F.avg("share").alias("explained")))


def AGG27_esp_histogram(spark, base):
    return _esp_histogram(GRF17_shared_partners(spark, base))


def AGG27_esp_histogram_whole(spark, base):
    return _esp_histogram(GRF17_shared_partners_whole(spark, base))


def _esp_summary(x: DataFrame) -> DataFrame:
    return _r(x.agg(F.count(F.lit(1)).alias("n_edges"), F.avg("esp").alias("esp_mean"), F.count_if(F.col("esp") == 0).alias("n_zero"), F.count_if((F.col("esp") > 0) & (F.col("esp") == F.col("esp_explained"))).alias("n_explained"), F.try_divide(F.sum("esp_explained"), F.sum("esp")).alias("explained_share")))


def GRF18_summary(spark, base):
    return _esp_summary(GRF17_shared_partners(spark, base))


def GRF18_summary_whole(spark, base):
    return _esp_summary(GRF17_shared_partners_whole(spark, base))


def _ceiling(x: DataFrame) -> DataFrame:
    return _r(x.groupBy("beyond").agg(F.count(F.lit(1)).alias("n"), F.avg("esp").alias("esp_mean"), F.median("n_shared").alias("shared_median"), F.max("largest_cast").alias("largest_cast")))


def AGG28_ceiling(spark, base):
    return _ceiling(GRF17_shared_partners(spark, base))


def AGG28_ceiling_whole(spark, base):
    return _ceiling(GRF17_shared_partners_whole(spark, base))


def AGG14_degree_by_gender(spark, base):
    d = homophily.degrees(dated(spark, base)).join(nodes(spark, base), F.col("node") == F.col("artist_id"))
    return _r(d.groupBy("genre", "gender").agg(F.count(F.lit(1)).alias("n"), F.median("degree").alias("degree_median"), F.avg("degree").alias("degree_mean")))


def AGG15_year_totals(spark, base):
    c = GRF23_cells(spark, base)
    return c.groupBy("year").agg(F.sum("ff").alias("ff"), F.sum("mm").alias("mm"), F.sum("mf").alias("mf"), F.count_if("reliable").alias("n_reliable"))


def FIL10_induced(spark, base):
    """Edges of weight 1 or more among the artists of one genre."""
    n = nodes(spark, base).where("genre = 'STANDARD'").select(F.col("artist_id").alias("u"))
    e = GRF1_projection(spark, base).where("w >= 1")
    return e.join(n, "u", "left_semi").join(n.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v", "w")


def NUL13_cell_expectations(spark, base):
    """Edges within each gender of a genre and year against permutation within degree strata."""
    g = known(spark, base)
    e = homophily.edge_classes(dated(spark, base), g, "genre").where("ci = cj").withColumnRenamed("ci", "genre").select("u", "v", "year", "genre")
    return _r(homophily.stratified_permutation(e, g, "gender", ["F", "M"], ["year", "genre"]), 6)


def NUL20_without_marked(spark, base):
    """r with and without the artists of very many releases, as for names that are no persons."""
    n = cut(nodes(spark, base))
    e = cut(dated(spark, base))
    marked = n.where("n_release % 7 = 0").select("artist_id")
    a = homophily.assortativity(homophily.mixing(homophily.edge_classes(e, n, "gender"))).withColumn("nodes", F.lit("all"))
    b = homophily.assortativity(homophily.mixing(homophily.edge_classes(e, n.join(marked, "artist_id", "left_anti"), "gender"))).withColumn("nodes", F.lit("unmarked"))
    return _r(a.unionByName(b))


def GRF7_components(spark, base):
    return graph.connected_components(GRF1_projection(spark, base))


def GRF8_coreness(spark, base):
    return graph.core_numbers(_adjacency(spark, base))


def GRF12_pagerank(spark, base):
    return _r(graph.pagerank(_giant(spark, base), rounds=1000, tolerance=1e-14), 9)


def GRF11_eigenvector(spark, base):
    return _r(graph.eigenvector(_giant(spark, base), tolerance=1e-13))


def GRF13_non_backtracking(spark, base):
    return _r(graph.non_backtracking(_giant(spark, base), tolerance=1e-13))


def GRF16_localisation(spark, base):
    """Inverse participation ratio and effective number of nodes of the eigenvector."""
    x = graph.eigenvector(_giant(spark, base), tolerance=1e-13).agg((F.sum(F.pow("eigenvector", F.lit(4))) / F.pow(F.sum(F.pow("eigenvector", F.lit(2))), F.lit(2))).alias("ipr"), F.count(F.lit(1)).alias("n"))
    return x.select(F.round("ipr", 8).alias("ipr"), "n", F.round(1 / F.col("ipr"), 3).alias("effective"))


def GRF10_betweenness(spark, base):
    return graph.betweenness(_adjacency(spark, base), sources=400)


def GRF20_snowball(spark, base):
    """Snowball of up to 1500 nodes from the node of largest degree, the smallest id of equal ones."""
    e = _giant(spark, base)
    first = graph.symmetric(e).groupBy("a").agg(F.count(F.lit(1)).alias("d")).orderBy(F.desc("d"), "a").limit(1).collect()
    return graph.snowball(e, [r["a"] for r in first], 1500)


def AGG13_descriptives(spark, base):
    e = GRF1_projection(spark, base)
    d = homophily.degrees(e, weight="w")
    a = d.agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("degree").alias("degree_mean"), F.median("degree").alias("degree_median"), F.max("degree").alias("degree_max"))
    b = e.agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("w"), 4).alias("weight"), F.median("w").alias("w_median"))
    x = a.crossJoin(b)
    return _r(x.withColumn("density", F.try_divide(2 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1))))


def AGG26_majority(spark, base):
    return resample.neighbour_majority(GRF1_projection(spark, base), nodes(spark, base))


def REG1_class_pairs(spark, base):
    return dyads.class_pairs(known(spark, base), dated(spark, base))


def REG1_exact_logit(spark, base):
    return dyads.exact_logit(known(spark, base), dated(spark, base))


def REG2_logit_by_year(spark, base):
    """Exact logit of the edges first seen in each year over the nodes active in it."""
    out = None
    e = cut(dated(spark, base))
    n = known(spark, base)
    for y in range(YEARS[0], YEARS[1] + 1):
        here = e.where(F.col("year") == y)
        active = n.join(here.select(F.explode(F.array("u", "v")).alias("artist_id")).distinct(), "artist_id", "left_semi")
        one = dyads.exact_logit(active, here).withColumn("year", F.lit(y))
        out = one if out is None else out.unionByName(one)
    return out


def REG3_case_control(spark, base):
    return dyads.case_control(known(spark, base), dated(spark, base))


def _design(spark, base):
    # a row per node, read for the levels and twice for the fit
    d = cut(homophily.degrees(dated(spark, base)).join(known(spark, base), F.col("node") == F.col("artist_id")))
    d = regress.pool_rare(d.withColumn("genre", F.col("genre")), "genre", 20)
    d = d.withColumn("y", F.log1p("degree")).withColumn("female", (F.col("gender") == "F").cast("double")).withColumn("log_n", F.log(F.greatest("n_release", F.lit(1))))
    return regress.dummies(d, "genre")


def REG5_ols(spark, base):
    d, levels = _design(spark, base)
    cross = []
    for c in levels:
        d = d.withColumn(f"female x {c}", F.col("female") * F.col(f"`{c}`"))
        cross.append(f"female x {c}")
    return regress.ols_table(d, "y", ["female", *levels, *cross, "log_n"])


def REG6_additive_wald(spark, base):
    """Additive model, and the joint test of the interactions that it leaves out."""
    d, levels = _design(spark, base)
    add = regress.ols_table(d, "y", ["female", *levels, "log_n"])
    cross = []
    for c in levels:
        d = d.withColumn(f"female x {c}", F.col("female") * F.col(f"`{c}`"))
        cross.append(f"female x {c}")
    beta, cov, names, n = regress.ols(d, "y", ["female", *levels, *cross, "log_n"])
    stat, k, p = regress.wald(beta, cov, [names.index(c) for c in cross])
    row = spark.createDataFrame([("wald(interactions)", stat, None, None, p, None, None, n)], add.schema)
    return add.unionByName(row)


def NUL3_bootstrap(spark, base):
    c = homophily.edge_classes(dated(spark, base), known(spark, base), "gender")
    b = resample.bootstrap_r(c, 1000)
    return b.agg(F.count("r").alias("replicas"), F.avg("r").alias("mean"), F.percentile("r", F.lit(0.025)).alias("lo"), F.percentile("r", F.lit(0.975)).alias("hi"))


def NUL8_permuted(spark, base):
    """Edges within each gender against 1000 permutations of the labels: mean, sd, ratio, z and one-sided p; compare with the closed form."""
    e, n, out = cut(dated(spark, base).select("u", "v")), cut(known(spark, base)), None
    seen = homophily.edge_classes(e, n, "gender").where("ci = cj").groupBy(F.col("ci").alias("category")).agg(F.count(F.lit(1)).alias("observed"))
    got = cut(nulls.permuted_counts(e, n, "gender", "F"))
    for c, col in (("F", "n_both"), ("M", "n_neither")):
        one = got.select(F.lit(c).alias("category"), F.col(col).alias("k"))
        out = one if out is None else out.unionByName(one)
    x = out.join(seen, "category").groupBy("category", "observed").agg(F.avg("k").alias("expected"), F.stddev_pop("k").alias("sd"), ((F.count_if(F.col("k") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    return x.select("category", "observed", "expected", "sd", F.try_divide("observed", F.col("expected")).alias("ratio"), F.try_divide(F.col("observed") - F.col("expected"), F.col("sd")).alias("z"), "p")


def _incidence(spark: SparkSession, base: str) -> DataFrame:
    """Artists and releases with the year of the release."""
    inc = credits(spark, base).select("artist_id", "release_id").distinct().join(releases(spark, base), "release_id", "left")
    return inc.select(F.col("artist_id").alias("a"), F.col("release_id").alias("r"), F.col("year").alias("period"))


def _swap_figures(a, r, s) -> pd.DataFrame:
    works, w = np.unique(np.concatenate([r, s]), return_inverse=True)
    c = np.unique(a, return_inverse=True)[1] * len(works)
    old, new = np.unique(c + w[: len(a)]), np.unique(c + w[len(a) :])
    same_degrees = bool(np.array_equal(np.sort(r), np.sort(s)))
    return pd.DataFrame({"n": [len(a)], "n_a": [len(np.unique(a))], "n_r": [len(np.unique(s))], "n_distinct": [len(new)], "unchanged": [len(np.intersect1d(old, new, assume_unique=True))], "same_degrees": [same_degrees]})


def NUL14_swaps(spark, base):
    """Size and degrees of the bipartite graph of each year and of all years (null), observed (replica -1) and after swaps."""
    return resample.over_swaps(_incidence(spark, base), _swap_figures, "n long, n_a long, n_r long, n_distinct long, unchanged long, same_degrees boolean")


def _reprojected(a, r, s) -> pd.DataFrame:
    n = resample.esp_histogram(a, s)
    at = np.flatnonzero(n)
    return pd.DataFrame({"esp": at, "n": n[at]})


def NUL15_reprojection(spark, base):
    """Shared-partner histogram of each year and of all years (null), observed (replica -1) and of swapped bipartite graphs."""
    inc = project.in_band(_incidence(spark, base), "r", 2, 8, member="a")
    return resample.over_swaps(inc, _reprojected, "esp long, n long")


def NUL17_imputation(spark, base):
    """r under bounds on the unknown labels and 200 draws of them."""
    return resample.imputed_r(cut(GRF1_projection(spark, base)), cut(nodes(spark, base)))


def NUL18_sensitivity(spark, base):
    """Key figures of the projection under one change of its construction at a time."""
    from creditweave.queries.more import key_figures

    c, n = cut(credits(spark, base)), cut(nodes(spark, base))
    sizes = cut(c.groupBy("release_id").agg(F.count_distinct("artist_id").alias("n_credited"), F.count_distinct(F.when(F.col("scope") == "main", F.col("artist_id"))).alias("n_main")))
    none = sizes.select("release_id").limit(0)
    filtered = lambda **kw: project.filter_credits(c, sizes, none, **kw)
    often = n.where("n_release >= 10")
    grid = {
        "default": (c, n, project.Weights()), "most_5": (c, n, project.Weights(most=5)), "most_12": (c, n, project.Weights(most=12)), "weight_0.5": (c, n, project.Weights(least_weight=0.5)), "weight_1": (c, n, project.Weights(least_weight=1.0)),
        "no_compilations": (filtered(exclude_compilations=True), n, project.Weights()), "no_track_credits": (filtered(track_credits=False), n, project.Weights()), "specificity_1_1_1": (c, n, project.Weights(1.0, 1.0, 1.0)),
        "specificity_1_0.5_0.1": (c, n, project.Weights(1.0, 0.5, 0.1)), "ten_releases": (c.join(often, "artist_id", "left_semi"), often, project.Weights()),
    }
    out = None
    for name, (part, pop, w) in grid.items():
        one = key_figures(project.project(part, w), pop).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return _r(out)


QUERIES = {k: f for k, f in globals().items() if callable(f) and k.split("_")[0].rstrip("0123456789") in {"GRF", "AGG", "NUL", "MTH", "REG", "FIL"}}

_BASE = """WITH RECURSIVE credits AS (
  SELECT l_partkey AS artist_id, l_orderkey AS release_id, CASE WHEN l_returnflag = 'A' THEN l_orderkey::varchar || '_' || l_linenumber::varchar END AS track_key,
         CASE l_returnflag WHEN 'A' THEN 'track' WHEN 'N' THEN 'main' ELSE 'umbrella' END AS scope FROM lineitem),
releases AS (SELECT o_orderkey AS release_id, year(o_orderdate)::int AS year FROM orders),
act AS (SELECT artist_id, count(*) AS n_release, min(year) AS debut_year FROM (SELECT DISTINCT artist_id, release_id FROM credits) LEFT JOIN releases USING (release_id) GROUP BY 1),
nodes AS (SELECT p_partkey AS artist_id, CASE WHEN p_size % 10 = 0 THEN 'F' WHEN p_size % 10 IN (1, 2) THEN 'unknown' ELSE 'M' END AS gender,
          split_part(p_type, ' ', 1) AS genre, coalesce(n_release, 0) AS n_release, debut_year FROM part LEFT JOIN act ON artist_id = p_partkey),
known AS (SELECT * FROM nodes WHERE gender IN ('F', 'M')),
"""


def _project(name: str, source: str) -> str:
    """SQL of the projection of a credit table; weights in ten-thousandths, so that sums are exact."""
    return f"""
{name}_rb AS (SELECT release_id FROM {source} GROUP BY 1 HAVING count(DISTINCT artist_id) BETWEEN 2 AND 8),
{name}_tb AS (SELECT track_key FROM {source} WHERE track_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT artist_id) BETWEEN 2 AND 8),
{name}_s AS (SELECT artist_id, release_id, max(CASE scope WHEN 'track' THEN 100 WHEN 'main' THEN 70 ELSE 30 END) AS s FROM {source} SEMI JOIN {name}_rb USING (release_id) GROUP BY 1, 2),
{name}_t AS (SELECT DISTINCT artist_id, track_key FROM {source} SEMI JOIN {name}_tb USING (track_key)),
{name} AS (SELECT u, v, sum(w)::double / 10000 AS w FROM (
  SELECT a.artist_id AS u, b.artist_id AS v, a.s * b.s AS w FROM {name}_s a JOIN {name}_s b USING (release_id) WHERE a.artist_id < b.artist_id
  UNION ALL SELECT a.artist_id, b.artist_id, 10000 FROM {name}_t a JOIN {name}_t b USING (track_key) WHERE a.artist_id < b.artist_id) GROUP BY 1, 2)"""


_EDGES = _BASE + _project("edges", "credits")
_DATED = (
    _BASE
    + """
band AS (SELECT release_id FROM credits GROUP BY 1 HAVING count(DISTINCT artist_id) BETWEEN 2 AND 8),
dc AS (SELECT DISTINCT artist_id, release_id, year FROM credits SEMI JOIN band USING (release_id) JOIN releases USING (release_id) WHERE year BETWEEN 1995 AND 2001),
dated AS (SELECT a.artist_id AS u, b.artist_id AS v, min(a.year) AS year, count(DISTINCT release_id) AS n_shared FROM dc a JOIN dc b USING (release_id) WHERE a.artist_id < b.artist_id GROUP BY 1, 2)"""
)


def _mixing(edges: str, attr: str, by: str = "", nodes: str = "nodes", w: str = "1", where: str = "TRUE", prefix: str = "") -> str:
    """SQL of the long mixing matrix ``{prefix}mx`` with margins ``{prefix}mg`` and figures ``{prefix}fig``."""
    b, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON TRUE")
    part = f"PARTITION BY {by}" if by else ""
    p = prefix
    cols = f"SELECT {by} FROM" if by else "SELECT 1 AS one FROM"
    return f""",
{p}cl AS (SELECT e.*, x.{attr} AS ci, y.{attr} AS cj, x.genre AS genre_u, y.genre AS genre_v, x.debut_year AS yu, y.debut_year AS yv FROM {edges} e JOIN {nodes} x ON e.u = x.artist_id JOIN {nodes} y ON e.v = y.artist_id WHERE x.{attr} IS NOT NULL AND y.{attr} IS NOT NULL),
{p}sy AS (SELECT {b}ci, cj, {w}::double AS w FROM (SELECT *, CASE WHEN yu <= 1995 THEN 'early' ELSE 'late' END AS era, genre_u AS genre FROM {p}cl WHERE {where}) UNION ALL SELECT {b}cj, ci, {w}::double FROM (SELECT *, CASE WHEN yu <= 1995 THEN 'early' ELSE 'late' END AS era, genre_u AS genre FROM {p}cl WHERE {where})),
{p}mx AS (SELECT *, m / sum(m) OVER ({part}) AS share FROM (SELECT {b}ci, cj, sum(w) AS m FROM {p}sy GROUP BY ALL)),
{p}mg AS (SELECT {b}ci, sum(share) AS a, sum(m) AS s FROM {p}mx GROUP BY ALL),
{p}f1 AS (SELECT {b}sum(a * a) AS a2, sum(s * (s - 1)) AS same, sum(s) AS stubs FROM {p}mg {"GROUP BY ALL" if by else ""}),
{p}f2 AS (SELECT {b}sum(CASE WHEN ci = cj THEN share ELSE 0 END) AS trace FROM {p}mx {"GROUP BY ALL" if by else ""}),
{p}fig AS (SELECT {b}round(trace, 8) AS trace, round((trace - a2) / nullif(1 - a2, 0), 8) AS r, round(same / nullif(stubs * (stubs - 1), 0), 8) AS trace_expected,
  round((same / nullif(stubs * (stubs - 1), 0) - a2) / nullif(1 - a2, 0), 8) AS r_expected FROM {p}f2 JOIN {p}f1 {on})"""


def _oe(by: str = "") -> str:
    b = f"{by}, " if by else ""
    on = f"AND mx.{by} = a.{by}" if by else ""
    on2 = f"AND mx.{by} = b.{by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f""", tot AS (SELECT *, sum(s) OVER ({part}) AS alls FROM mg)
SELECT {"mx." + by + ", " if by else ""}mx.ci, mx.cj, round(mx.m, 8) AS m, round(mx.share, 8) AS share, round(ex, 8) AS expected, round(mx.share / nullif(ex, 0), 8) AS ratio FROM (
  SELECT mx.*, CASE WHEN mx.ci = mx.cj THEN a.s * (a.s - 1) ELSE a.s * b.s END / nullif(a.alls * (a.alls - 1), 0) AS ex
  FROM mx JOIN tot a ON mx.ci = a.ci {on} JOIN tot b ON mx.cj = b.ci {on2}) mx"""


def _uniform(by: str, edges: str) -> str:
    return f""",
e AS (SELECT d.*, x.gender AS ci, y.gender AS cj FROM {edges} d JOIN known x ON u = x.artist_id JOIN known y ON v = y.artist_id),
en AS (SELECT {by}, u AS node, ci AS c FROM e UNION ALL SELECT {by}, v, cj FROM e),
dg AS (SELECT {by}, node, c, count(*) AS d FROM en GROUP BY ALL),
sz AS (SELECT {by}, count(*)::double AS n, sum(d)::double / 2 AS m, sum(d * (d - 1))::double AS adj FROM dg GROUP BY ALL),
ct AS (SELECT {by}, c, count(*)::double AS nc FROM dg GROUP BY ALL),
ob AS (SELECT {by}, ci AS c, count(*) AS o FROM e WHERE ci = cj GROUP BY ALL),
p AS (SELECT {by}, c, nc, n, m, adj, coalesce(o, 0) AS o, nc * (nc - 1) / (n * (n - 1)) AS p2 FROM ct JOIN sz USING ({by}) LEFT JOIN ob USING ({by}, c) WHERE nc >= 4 AND m >= 2 AND n >= 4),
q AS (SELECT *, m * p2 AS mean, p2 * (nc - 2) / (n - 2) AS p3 FROM p),
z AS (SELECT *, mean + adj * p3 + (m * (m - 1) - adj) * p3 * (nc - 3) / (n - 3) - mean * mean AS var FROM q)
SELECT {by}, c AS category, nc::bigint AS n_category, o AS observed, round(mean, 6) AS expected, round(CASE WHEN var > 0 THEN sqrt(var) END, 6) AS sd, round(o / nullif(mean, 0), 6) AS ratio, round((o - mean) / CASE WHEN var > 0 THEN sqrt(var) END, 6) AS z FROM z"""


_STRATA = """,
e AS (SELECT d.u, d.v, d.year, x.gender AS ci, y.gender AS cj FROM dated d JOIN known x ON u = x.artist_id JOIN known y ON v = y.artist_id),
en AS (SELECT year, u AS node, ci AS c FROM e UNION ALL SELECT year, v, cj FROM e),
dg AS (SELECT year, node, c, count(*) AS degree FROM en GROUP BY ALL),
hs AS (SELECT year, degree, count(*) AS n, row_number() OVER (PARTITION BY year ORDER BY degree) AS i FROM dg GROUP BY year, degree),
fo(year, i, degree, n, s, acc) AS (SELECT year, i, degree, n, 0, n FROM hs WHERE i = 1
  UNION ALL SELECT hs.year, hs.i, hs.degree, hs.n, CASE WHEN fo.acc >= 30 THEN fo.s + 1 ELSE fo.s END, CASE WHEN fo.acc >= 30 THEN hs.n ELSE fo.acc + hs.n END FROM fo JOIN hs ON hs.year = fo.year AND hs.i = fo.i + 1),
ta AS (SELECT year, max(s) AS last_s, arg_max(acc, i) AS last_acc FROM fo GROUP BY 1),
st AS (SELECT year, degree, n, (CASE WHEN last_acc < 30 AND last_s > 0 THEN least(s, last_s - 1) ELSE s END)::int AS stratum FROM fo JOIN ta USING (year))"""

SQL = {
    "GRF1_projection": _EDGES + " SELECT u, v, w FROM edges",
    "GRF4_subnetworks": _EDGES
    + ", c_t AS (SELECT * FROM credits WHERE scope = 'track'), c_r AS (SELECT * FROM credits WHERE scope <> 'track'),"
    + _project("et", "c_t") + "," + _project("er", "c_r")
    + """ SELECT 'all' AS network, count(*) AS n_edges, round(sum(w), 4) AS weight, max(w) AS w_max FROM edges
UNION ALL SELECT 'tracks', count(*), round(sum(w), 4), max(w) FROM et UNION ALL SELECT 'releases', count(*), round(sum(w), 4), max(w) FROM er""",
    "GRF5_dated_edges": _DATED + " SELECT u, v, year, n_shared FROM dated",
    "GRF6_degree": _EDGES + " SELECT node, count(*) AS degree, round(sum(w), 6) AS strength FROM (SELECT u AS node, w FROM edges UNION ALL SELECT v, w FROM edges) GROUP BY 1",
    "AGG11_mixing": _EDGES + _mixing("edges", "gender", w="w") + " SELECT ci, cj, round(m, 4) AS m, round(share, 8) AS share FROM mx",
    "NUL1_observed_expected": _DATED + _mixing("dated", "genre") + _oe(),
    "MTH2_assortativity": _EDGES + _mixing("edges", "gender", prefix="a") + _mixing("edges", "gender", w="w", prefix="b") + _mixing("edges", "genre", prefix="c") + _mixing("edges", "genre", w="w", prefix="d")
    + " SELECT 'gender' AS attribute, x.r, y.r AS r_weighted, x.r_expected FROM afig x, bfig y UNION ALL SELECT 'genre', x.r, y.r, x.r_expected FROM cfig x, dfig y",
    "NUL4_strata": _DATED + _mixing("dated", "gender", by="year, era", where="yu IS NOT NULL AND yv IS NOT NULL AND (yu <= 1995) = (yv <= 1995)") + " SELECT * FROM fig",
    "NUL5_known_only": _DATED + _mixing("dated", "gender", prefix="a") + _mixing("dated", "gender", nodes="known", prefix="b") + " SELECT *, 'all' AS nodes FROM afig UNION ALL SELECT *, 'known' FROM bfig",
    "NUL6_within_genre": _DATED + _mixing("dated", "gender", by="genre", nodes="known", where="genre_u = genre_v") + _oe("genre"),
    "NUL7_uniform": _DATED + ", whole AS (SELECT *, 'whole' AS part FROM dated)" + _uniform("part", "whole"),
    "NUL9_uniform_by_year": _DATED + _uniform("year", "dated"),
    "NUL11_strata": _DATED + _STRATA + " SELECT year, degree, n, stratum FROM st",
    "NUL10_degree_strata": _DATED + _STRATA
    + """, ns AS (SELECT dg.year, node, c, dg.degree, stratum FROM dg JOIN st USING (year, degree)),
f AS (SELECT year, k AS category, stratum, count(*) FILTER (WHERE c = k)::double AS f, count(*)::double AS n FROM ns CROSS JOIN (SELECT unnest(['F', 'M']) AS k) GROUP BY ALL),
ce AS (SELECT e.year, a.stratum AS su, b.stratum AS sv, count(*) AS m FROM e JOIN ns a ON a.year = e.year AND a.node = u JOIN ns b ON b.year = e.year AND b.node = v GROUP BY ALL),
ex AS (SELECT ce.year, a.category, sum(m * CASE WHEN su = sv THEN coalesce(a.f * (a.f - 1) / nullif(a.n * (a.n - 1), 0), 0) ELSE a.f * b.f / (a.n * b.n) END) AS expected, sum(m)::double AS m
  FROM ce JOIN f a ON a.year = ce.year AND a.stratum = su JOIN f b ON b.year = ce.year AND b.stratum = sv AND b.category = a.category GROUP BY ALL),
rl AS (SELECT year, k AS category, avg(degree) FILTER (WHERE c = k) AS dc, avg(degree) AS da, coalesce(sum(degree) FILTER (WHERE c = k), 0)::double AS stubs, count(*) FILTER (WHERE c = k) AS nc, count(*) AS n FROM ns CROSS JOIN (SELECT unnest(['F', 'M']) AS k) GROUP BY ALL),
ob AS (SELECT year, ci AS category, count(*) AS o FROM e WHERE ci = cj GROUP BY ALL)
SELECT year, category, nc AS n_category, coalesce(o, 0) AS observed, round(m * nc * (nc - 1) / (n * (n - 1)), 6) AS expected_uniform, round(expected, 6) AS expected, round(coalesce(o, 0) / nullif(expected, 0), 6) AS ratio,
  round(coalesce(o, 0) / nullif(m * (stubs / (2 * m)) * (stubs / (2 * m)), 0), 6) AS ratio_configuration, round(dc / nullif(da, 0), 6) AS relative_degree
FROM ex JOIN rl USING (year, category) LEFT JOIN ob USING (year, category)""",
    "GRF23_cells": _DATED
    + """, e AS (SELECT d.*, x.gender AS ci, y.gender AS cj, x.genre FROM dated d JOIN known x ON u = x.artist_id JOIN known y ON v = y.artist_id WHERE x.genre = y.genre),
en AS (SELECT DISTINCT year, genre, u AS n, ci AS c FROM e UNION SELECT DISTINCT year, genre, v, cj FROM e),
sz AS (SELECT year, genre, count(*) FILTER (WHERE c = 'F')::double AS nf, count(*) FILTER (WHERE c = 'M')::double AS nm FROM en GROUP BY ALL),
m AS (SELECT year, genre, count(*) FILTER (WHERE ci = 'F' AND cj = 'F') AS ff, count(*) FILTER (WHERE ci = 'M' AND cj = 'M') AS mm, count(*) FILTER (WHERE ci <> cj) AS mf FROM e GROUP BY ALL),
d AS (SELECT *, ff / (nf * (nf - 1) / 2) AS dff, mm / (nm * (nm - 1) / 2) AS dmm, mf / (nf * nm) AS dmf, sqrt(1.0::double / nullif(ff, 0) + 1.0::double / nullif(mf, 0)) AS se FROM m JOIN sz USING (year, genre) WHERE nf >= 2 AND nm >= 2)
SELECT year, genre, nf::bigint AS n_f, nm::bigint AS n_m, ff, mm, mf, round(dff, 9) AS density_ff, round(dmm, 9) AS density_mm, round(dmf, 9) AS density_mf, round(dff / nullif(dmf, 0), 9) AS ff_over_mf,
  round(dff / nullif(dmf, 0) * exp(-1.96::double * se), 9) AS ff_over_mf_lo, round(dff / nullif(dmf, 0) * exp(1.96::double * se), 9) AS ff_over_mf_hi, round(dmm / nullif(dmf, 0), 9) AS mm_over_mf, nf >= 30 AND ff >= 10 AS reliable FROM d""",
    "AGG12_wilson": _BASE
    + """ g AS (SELECT genre, debut_year, count(*) FILTER (WHERE gender = 'F') AS n_f, count(*) AS n, count(*) FILTER (WHERE gender = 'F')::double / count(*) AS p, 1.96::double AS z FROM known GROUP BY 1, 2)
SELECT genre, debut_year, n_f, n, round(p, 8) AS share, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0::double * n * n))) / (1 + z * z / n), 0), 8) AS lo,
  round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0::double * n * n))) / (1 + z * z / n), 1), 8) AS hi FROM g""",
    "GRF14_clustering": _DATED
    + """, g AS (SELECT u, v, n_shared::double AS w FROM dated WHERE year = 1995), s AS (SELECT u AS a, v AS b, w FROM g UNION ALL SELECT v, u, w FROM g), top AS (SELECT max(w) AS t FROM g),
t AS (SELECT x.a AS node, count(*) AS t, sum(pow(x.w / t * (y.w / t) * (g.w / t), 1.0::double / 3)) AS gm FROM s x JOIN s y ON x.a = y.a AND x.b < y.b JOIN g ON g.u = x.b AND g.v = y.b CROSS JOIN top GROUP BY 1),
d AS (SELECT a AS node, count(*) AS d FROM s GROUP BY 1)
SELECT node, coalesce(t, 0) AS triangles, round(coalesce(t / nullif(d * (d - 1) / 2, 0), 0), 7) AS clustering, round(coalesce(gm / nullif(d * (d - 1) / 2, 0), 0), 7) AS weighted FROM d LEFT JOIN t USING (node)""",
    "GRF17_shared_partners": _DATED
    + """, g AS (SELECT u, v FROM dated WHERE year = 1995), s AS (SELECT u AS a, v AS b FROM g UNION ALL SELECT v, u FROM g),
i AS (SELECT DISTINCT artist_id AS a, release_id AS r FROM dc WHERE year = 1995), k AS (SELECT r, count(*) AS k FROM i GROUP BY 1),
es AS (SELECT g.u, g.v, count(*) AS n FROM g JOIN s x ON x.a = g.u JOIN s y ON y.a = g.v AND y.b = x.b GROUP BY 1, 2),
wk AS (SELECT g.u, g.v, x.r FROM g JOIN i x ON x.a = g.u JOIN i y ON y.a = g.v AND y.r = x.r),
w AS (SELECT u, v, count(*) AS n_shared, max(k) AS largest_cast FROM wk JOIN k USING (r) GROUP BY 1, 2),
xp AS (SELECT u, v, count(DISTINCT i.a) AS n FROM wk JOIN i USING (r) WHERE i.a <> u AND i.a <> v GROUP BY 1, 2)
SELECT g.u, g.v, coalesce(es.n, 0) AS esp, coalesce(xp.n, 0) AS esp_explained, coalesce(n_shared, 0) AS n_shared, largest_cast, greatest(coalesce(largest_cast, 0) - 2, 0) AS ceiling,
  coalesce(es.n, 0) > greatest(coalesce(largest_cast, 0) - 2, 0) AS beyond FROM g LEFT JOIN es USING (u, v) LEFT JOIN w USING (u, v) LEFT JOIN xp USING (u, v)""",
    "AGG13_descriptives": _EDGES
    + """, d AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY 1), a AS (SELECT count(*) AS n_nodes, avg(degree) AS dm, median(degree) AS de, max(degree) AS dx FROM d),
b AS (SELECT count(*) AS n_edges, round(sum(w), 4) AS weight, median(w) AS w_median FROM edges)
SELECT n_nodes, round(dm, 8) AS degree_mean, de AS degree_median, dx AS degree_max, n_edges, weight, round(w_median, 8) AS w_median, round(2 * n_edges / (n_nodes * (n_nodes - 1))::double, 8) AS density FROM a, b""",
    "AGG26_majority": _EDGES
    + """, s AS (SELECT u AS node, v AS o, w FROM edges UNION ALL SELECT v, u, w FROM edges), x AS (SELECT node, round(sum(CASE WHEN gender = 'F' THEN w ELSE 0 END), 6) AS w_f, round(sum(CASE WHEN gender = 'M' THEN w ELSE 0 END), 6) AS w_m FROM s JOIN known ON o = artist_id GROUP BY 1)
SELECT node, w_f, w_m, CASE WHEN w_m > w_f THEN 'M' WHEN w_m + w_f > 0 THEN 'F' END AS majority FROM x""",
    "REG1_class_pairs": _DATED
    + """, n AS (SELECT artist_id, gender AS g, genre AS m, coalesce(debut_year, -1) AS c, greatest(n_release, 1) AS k FROM known), cl AS (SELECT g, m, c, k, count(*) AS n, row_number() OVER () AS id FROM n GROUP BY 1, 2, 3, 4),
pr AS (SELECT (a.g = 'F' AND b.g = 'F')::int AS same_f, (a.g = 'M' AND b.g = 'M')::int AS same_m, (a.m = b.m)::int AS same_genre, (a.c = b.c)::int AS same_cohort, a.k * b.k AS product, sum(CASE WHEN a.id = b.id THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END)::bigint AS n_pairs
  FROM cl a JOIN cl b ON a.id <= b.id GROUP BY ALL),
ed AS (SELECT (a.g = 'F' AND b.g = 'F')::int AS same_f, (a.g = 'M' AND b.g = 'M')::int AS same_m, (a.m = b.m)::int AS same_genre, (a.c = b.c)::int AS same_cohort, a.k * b.k AS product, count(*) AS n_edges FROM dated JOIN n a ON u = a.artist_id JOIN n b ON v = b.artist_id GROUP BY ALL)
SELECT pr.*, coalesce(n_edges, 0) AS n_edges FROM pr LEFT JOIN ed USING (same_f, same_m, same_genre, same_cohort, product) WHERE n_pairs > 0""",
}

# read several times each
for _name in ("GRF14_clustering", "GRF17_shared_partners"):
    for _part in ("\ndated AS (", "\ndc AS (", " g AS (", " s AS (", "\ni AS (", "\nwk AS ("):
        SQL[_name] = SQL[_name].replace(_part, _part.replace("AS (", "AS MATERIALIZED ("))
_E17 = SQL["GRF17_shared_partners"]
# a year and genre as one number, for the SQL that is written for years
_CELLS = _DATED + ", gi AS (SELECT genre, row_number() OVER (ORDER BY genre) AS i FROM (SELECT DISTINCT genre FROM nodes)), cellsd AS MATERIALIZED (SELECT u, v, d.year * 100 + i AS year FROM dated d JOIN known x ON u = x.artist_id JOIN known y ON v = y.artist_id JOIN gi ON gi.genre = x.genre WHERE x.genre = y.genre)"
SQL |= {
    "NUL13_cell_expectations": "SELECT (c.year // 100)::int AS year, gi.genre, category, n_category, observed, expected_uniform, expected, ratio, ratio_configuration, relative_degree FROM ("
    + SQL["NUL10_degree_strata"].replace("FROM dated d JOIN known x", "FROM cellsd d JOIN known x").replace(_DATED, _CELLS)
    + ") c JOIN (SELECT genre, row_number() OVER (ORDER BY genre) AS i FROM (SELECT DISTINCT split_part(p_type, ' ', 1) AS genre FROM part)) gi ON gi.i = c.year % 100",
    "AGG27_esp_histogram": f"SELECT least(esp, 26)::bigint AS esp, count(*) AS n, round(avg(coalesce(esp_explained / nullif(esp, 0), 0)), 8) AS explained FROM ({_E17}) GROUP BY 1",
    "GRF18_summary": f"SELECT count(*) AS n_edges, round(avg(esp), 8) AS esp_mean, count(*) FILTER (WHERE esp = 0) AS n_zero, count(*) FILTER (WHERE esp > 0 AND esp = esp_explained) AS n_explained, round(sum(esp_explained) / nullif(sum(esp), 0), 8) AS explained_share FROM ({_E17})",
    "AGG28_ceiling": f"SELECT beyond, count(*) AS n, round(avg(esp), 8) AS esp_mean, median(n_shared) AS shared_median, max(largest_cast) AS largest_cast FROM ({_E17}) GROUP BY 1",
    "AGG14_degree_by_gender": _DATED + ", d AS (SELECT node, count(*) AS d FROM (SELECT u AS node FROM dated UNION ALL SELECT v FROM dated) GROUP BY 1) SELECT genre, gender, count(*) AS n, median(d) AS degree_median, round(avg(d), 8) AS degree_mean FROM d JOIN nodes ON node = artist_id GROUP BY 1, 2",
    "AGG15_year_totals": f"SELECT year, sum(ff)::bigint AS ff, sum(mm)::bigint AS mm, sum(mf)::bigint AS mf, count(*) FILTER (WHERE reliable) AS n_reliable FROM ({SQL['GRF23_cells']}) GROUP BY 1",
    "FIL10_induced": _EDGES + " SELECT u, v, w FROM edges WHERE w >= 1 AND u IN (SELECT artist_id FROM nodes WHERE genre = 'STANDARD') AND v IN (SELECT artist_id FROM nodes WHERE genre = 'STANDARD')",
    "NUL20_without_marked": _DATED + ", plain AS (SELECT * FROM nodes WHERE n_release % 7 <> 0)" + _mixing("dated", "gender", prefix="a") + _mixing("dated", "gender", nodes="plain", prefix="b") + " SELECT *, 'all' AS nodes FROM afig UNION ALL SELECT *, 'unmarked' FROM bfig",
}
