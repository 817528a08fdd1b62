"""Mixing, assortativity and null models of attributed edges.

Means of the null models have closed forms, which are used throughout: stub matching
(configuration), uniform permutation of node labels, and permutation within degree strata.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edge_classes(edges: DataFrame, nodes: DataFrame, attr: str, key: str = "artist_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``edges`` with the class of both ends; edges with an end without class are left out."""
    n = nodes.where(F.col(attr).isNotNull())
    a = n.select(F.col(key).alias("u"), F.col(attr).alias("ci"), *[F.col(k).alias(f"{k}_u") for k in keep])
    b = n.select(F.col(key).alias("v"), F.col(attr).alias("cj"), *[F.col(k).alias(f"{k}_v") for k in keep])
    return edges.join(a, "u").join(b, "v")


def mixing(classed: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """``(by,) ci, cj, m, share``: the symmetric mixing matrix in long form; shares of a stratum sum to 1."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1.0)
    # classes are counted first, so that both directions are added on the small matrix
    half = classed.groupBy(*by, "ci", "cj").agg(F.sum(w).alias("m"))
    both = half.unionByName(half.select(*by, F.col("cj").alias("ci"), F.col("ci").alias("cj"), "m"))
    full = both.groupBy(*by, "ci", "cj").agg(F.sum("m").alias("m"))
    return full.withColumn("share", F.col("m") / F.sum("m").over(Window.partitionBy(*by)))


def assortativity(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Newman's r of each stratum, and the mean of the trace under stub matching."""
    by = by or []
    margin = matrix.groupBy(*by, "ci").agg(F.sum("share").alias("a"), F.sum("m").alias("stubs"))
    m = margin.groupBy(*by).agg(F.sum(F.col("a") * F.col("a")).alias("a2"), F.sum(F.col("stubs") * (F.col("stubs") - 1)).alias("same"), F.sum("stubs").alias("stubs"))
    t = matrix.groupBy(*by).agg(F.sum(F.when(F.col("ci") == F.col("cj"), F.col("share")).otherwise(0.0)).alias("trace"))
    j = t.join(m, by) if by else t.crossJoin(m)  # one row each
    r = F.try_divide(F.col("trace") - F.col("a2"), 1 - F.col("a2"))
    e = F.try_divide(F.col("same"), F.col("stubs") * (F.col("stubs") - 1))
    return j.select(*by, "trace", r.alias("r"), e.alias("trace_expected"), F.try_divide(e - F.col("a2"), 1 - F.col("a2")).alias("r_expected"))


def observed_expected(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each cell of an unweighted matrix with its share under stub matching and the ratio, null where nothing is expected."""
    by = by or []
    s = matrix.groupBy(*by, "ci").agg(F.sum("m").alias("s"))
    total = Window.partitionBy(*by)
    s = s.withColumn("all", F.sum("s").over(total))
    a = s.withColumnRenamed("s", "si")
    b = s.select(*by, F.col("ci").alias("cj"), F.col("s").alias("sj"))
    x = matrix.join(a, [*by, "ci"]).join(b, [*by, "cj"])
    e = F.try_divide(F.when(F.col("ci") == F.col("cj"), F.col("si") * (F.col("si") - 1)).otherwise(F.col("si") * F.col("sj")), F.col("all") * (F.col("all") - 1))
    return x.select(*by, "ci", "cj", "m", "share", e.alias("expected"), F.try_divide(F.col("share"), e).alias("ratio"))


def degrees(edges: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """``(by,) node, degree, strength``."""
    w = F.col(weight) if weight else F.lit(1.0)
    ends = edges.select(*(by or []), F.explode(F.array("u", "v")).alias("node"), w.alias("w"))
    return ends.groupBy(*(by or []), "node").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("w"), 6).alias("strength"))


def uniform_permutation(edges: DataFrame, nodes: DataFrame, attr: str, categories: list[str], by: list[str]) -> DataFrame:
    """Exact mean and standard deviation of edges within a category when labels are permuted over the nodes that have edges.

    Categories of fewer than four nodes, and strata of fewer than two edges, give no row.
    """
    labels = nodes.where(F.col(attr).isNotNull()).select(F.col("artist_id").alias("node"), F.col(attr).alias("c"))
    known = edge_classes(edges, nodes, attr)
    d = degrees(known, by).join(labels, "node")
    size = d.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), (F.sum("degree") / 2).alias("m"), F.sum(F.col("degree") * (F.col("degree") - 1)).cast("double").alias("adj"))
    cats = d.where(F.col("c").isin(categories)).groupBy(*by, "c").agg(F.count(F.lit(1)).cast("double").alias("nc"))
    seen = known.where(F.col("ci") == F.col("cj")).groupBy(*by, F.col("ci").alias("c")).agg(F.count(F.lit(1)).alias("observed"))
    x = cats.join(size, by).join(seen, [*by, "c"], "left").where("nc >= 4 and m >= 2 and n >= 4")
    p2 = F.col("nc") * (F.col("nc") - 1) / (F.col("n") * (F.col("n") - 1))
    p3 = p2 * (F.col("nc") - 2) / (F.col("n") - 2)
    p4 = p3 * (F.col("nc") - 3) / (F.col("n") - 3)
    mean = F.col("m") * p2
    var = mean + F.col("adj") * p3 + (F.col("m") * (F.col("m") - 1) - F.col("adj")) * p4 - mean * mean
    sd = F.when(var > 0, F.sqrt(var))
    obs = F.coalesce("observed", F.lit(0))
    return x.select(*by, F.col("c").alias("category"), F.col("nc").cast("long").alias("n_category"), obs.alias("observed"), mean.alias("expected"), sd.alias("sd"), F.try_divide(obs, mean).alias("ratio"), F.try_divide(obs - mean, sd).alias("z"))


def _merge(least: int):
    def run(h: pd.DataFrame) -> pd.DataFrame:
        h = h.sort_values("degree").reset_index(drop=True)
        stratum, now, held = [], 0, 0
        for n in h["n"]:
            stratum.append(now)
            held += n
            if held >= least:
                now, held = now + 1, 0
        if held and now > 0:
            stratum = [min(s, now - 1) for s in stratum]
        return h.assign(stratum=stratum)

    return run


def degree_strata(deg: DataFrame, by: list[str], least: int = 30) -> DataFrame:
    """``(by,) degree, n, stratum``: neighbouring degrees merged until each stratum has ``least`` nodes; the rest joins the last.

    What is merged is the histogram of degrees, one row per distinct degree.
    """
    hist = deg.groupBy(*by, "degree").agg(F.count(F.lit(1)).alias("n"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in hist.dtypes)
    return hist.groupBy(*by).applyInPandas(_merge(least), f"{kinds}, stratum int")


def stratified_permutation(edges: DataFrame, nodes: DataFrame, attr: str, categories: list[str], by: list[str], least: int = 30) -> DataFrame:
    """Observed edges within a category against their mean when labels are permuted within degree strata; also the uniform and configuration ratios."""
    known = edge_classes(edges, nodes, attr)
    labels = nodes.where(F.col(attr).isNotNull()).select(F.col("artist_id").alias("node"), F.col(attr).alias("c"))
    d = degrees(known, by).select(*by, "node", "degree")
    d = d.join(degree_strata(d, by, least).select(*by, "degree", "stratum"), [*by, "degree"]).join(labels, "node")
    cats = d.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    f = d.crossJoin(F.broadcast(cats)).groupBy(*by, "category", "stratum").agg(F.count_if(F.col("c") == F.col("category")).cast("double").alias("f"), F.count(F.lit(1)).cast("double").alias("n"))
    # edges by the strata of their ends
    s = d.select(*by, "node", "stratum")
    e = known.select(*by, "u", "v").join(s.withColumnsRenamed({"node": "u", "stratum": "su"}), [*by, "u"]).join(s.withColumnsRenamed({"node": "v", "stratum": "sv"}), [*by, "v"])
    cell = e.groupBy(*by, "su", "sv").agg(F.count(F.lit(1)).alias("m"))
    a = f.select(*by, "category", F.col("stratum").alias("su"), F.col("f").alias("fu"), F.col("n").alias("nu"))
    b = f.select(*by, "category", F.col("stratum").alias("sv"), F.col("f").alias("fv"), F.col("n").alias("nv"))
    p = F.when(F.col("su") == F.col("sv"), F.coalesce(F.try_divide(F.col("fu") * (F.col("fu") - 1), F.col("nu") * (F.col("nu") - 1)), F.lit(0.0))).otherwise(F.col("fu") * F.col("fv") / (F.col("nu") * F.col("nv")))
    expected = cell.join(a, [*by, "su"]).join(b, [*by, "sv", "category"]).groupBy(*by, "category").agg(F.sum(F.col("m") * p).alias("expected"), F.sum("m").alias("m"))
    seen = known.where(F.col("ci") == F.col("cj")).groupBy(*by, F.col("ci").alias("category")).agg(F.count(F.lit(1)).alias("observed"))
    rel = d.crossJoin(F.broadcast(cats)).groupBy(*by, "category").agg(
        F.avg(F.when(F.col("c") == F.col("category"), F.col("degree"))).alias("dc"), F.avg("degree").alias("da"), F.sum(F.when(F.col("c") == F.col("category"), F.col("degree")).otherwise(0)).alias("stubs"),
        F.count_if(F.col("c") == F.col("category")).alias("n_category"), F.count(F.lit(1)).alias("n"),
    )
    x = expected.join(rel, [*by, "category"]).join(seen, [*by, "category"], "left")
    obs = F.coalesce("observed", F.lit(0))
    ac = F.col("stubs") / (2 * F.col("m"))
    uniform = F.col("m") * F.col("n_category") * (F.col("n_category") - 1) / (F.col("n") * (F.col("n") - 1))
    return x.select(
        *by, "category", "n_category", obs.alias("observed"), uniform.alias("expected_uniform"), "expected", F.try_divide(obs, F.col("expected")).alias("ratio"),
        F.try_divide(obs, F.col("m") * ac * ac).alias("ratio_configuration"), F.try_divide(F.col("dc"), F.col("da")).alias("relative_degree"),
    )


def wilson(k, n, z: float = 1.96):
    """Bounds of the Wilson interval of k out of n."""
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    d = 1 + z * z / n
    return F.greatest((mid - half) / d, F.lit(0.0)), F.least((mid + half) / d, F.lit(1.0))


def cell_densities(edges: DataFrame, nodes: DataFrame, period: str, least_women: int = 30, least_edges: int = 10) -> DataFrame:
    """Edges and densities within and between two genders, by period and genre of same-genre edges, with ratios and their log-Poisson bounds."""
    g = nodes.where(F.col("gender").isin("M", "F"))
    e = edge_classes(edges, g, "gender", keep=("genre",)).where("genre_u = genre_v").withColumn("genre", F.col("genre_u"))
    ends = e.select(period, "genre", F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("ci").alias("c")), F.struct(F.col("v").alias("n"), F.col("cj").alias("c")))).alias("x")).select(period, "genre", "x.n", "x.c").distinct()
    size = ends.groupBy(period, "genre").agg(F.count_if(F.col("c") == "F").cast("double").alias("nf"), F.count_if(F.col("c") == "M").cast("double").alias("nm"))
    is_f = (F.col("ci") == "F").cast("int") + (F.col("cj") == "F").cast("int")
    m = e.groupBy(period, "genre").agg(F.count_if(is_f == 2).alias("ff"), F.count_if(is_f == 0).alias("mm"), F.count_if(is_f == 1).alias("mf"))
    x = m.join(size, [period, "genre"]).where("nf >= 2 and nm >= 2")
    dff, dmm, dmf = F.col("ff") / (F.col("nf") * (F.col("nf") - 1) / 2), F.col("mm") / (F.col("nm") * (F.col("nm") - 1) / 2), F.col("mf") / (F.col("nf") * F.col("nm"))
    r = F.try_divide(dff, dmf)
    se = F.sqrt(F.try_divide(F.lit(1.0), F.col("ff")) + F.try_divide(F.lit(1.0), F.col("mf")))
    return x.select(
        period, "genre", F.col("nf").cast("long").alias("n_f"), F.col("nm").cast("long").alias("n_m"), "ff", "mm", "mf", dff.alias("density_ff"), dmm.alias("density_mm"), dmf.alias("density_mf"),
        r.alias("ff_over_mf"), (r * F.exp(-1.96 * se)).alias("ff_over_mf_lo"), (r * F.exp(1.96 * se)).alias("ff_over_mf_hi"), F.try_divide(dmm, dmf).alias("mm_over_mf"),
        ((F.col("nf") >= least_women) & (F.col("ff") >= least_edges)).alias("reliable"),
    )
