"""Queries of coding, counting, set and series operators, role networks and small graph tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweave.functions import maths
from creditweave.functions import text as T
from creditweave.operators import graph, homophily, population, project, selection
from creditweave.plans.figures import figures
from creditweave.queries import music, network
from creditweave.session import cut
from creditweave.sources import load

LIST_SHARES = (0.5, 0.6, 0.7, 0.8)
ITALIAN = ("it", "ita", "italian")


def _r(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- sources, filters, codes


def SRC6_union(spark: SparkSession, base: str) -> DataFrame:
    """Release credits with the second source of credits, one row per artist and release."""
    a, b = load(spark, base, "raw_ra", "artist_id", "release_id", "role"), load(spark, base, "raw_rta", "artist_id", "release_id", "track_id")
    return selection.union_sources(a, [b], ["artist_id", "release_id"]).select("artist_id", "release_id")


def SRC12_accumulated(spark, base):
    s = load(spark, base, "doc_subjects").join(load(spark, base, "subject_areas"), "subject")
    return selection.accumulated(s, "doc_id", "subject").withColumnRenamed("values", "subjects")


def FIL15_valid_ids(spark, base):
    n = maths.valid_id(F.substring(F.trim("track_id"), 2, 30))
    return load(spark, base, "raw_reltracks").select("release_id", "sequence", n.alias("track_no")).where("track_no is not null").distinct()


def FIL16_large_enough(spark, base):
    e = network.dated(spark, base).join(network.nodes(spark, base).select(F.col("artist_id").alias("u"), "genre"), "u")
    return selection.large_enough(e, ["year", "genre"])


def FIL13_marked(spark, base):
    """Names of no person, by words and by placeholders."""
    return load(spark, base, "validation_sample", "artist_id", "name").select("artist_id", selection.no_person(F.col("name")).alias("reason")).where("reason is not null")


def STR8_years(spark, base):
    y = T.year_of(F.col("loaded_at").cast("string"))
    return load(spark, base, "raw_releases", "loaded_at").groupBy(y.alias("year"), F.concat(F.substring(F.col("loaded_at").cast("string"), 1, 3), F.lit("0s")).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


def STR9_uri_tail(spark, base):
    v = load(spark, base, "validation_sample", "artist_id")
    return v.select("artist_id", T.uri_tail(F.concat(F.lit("http://entity/a/"), F.col("artist_id").cast("string"))).alias("tail"))


def STR11_codes(spark, base):
    c = maths.coded(F.col("status"), {"accepted": "A", "draft": "D", "deleted": "X"})
    return load(spark, base, "raw_releases", "status").groupBy(c.alias("code")).agg(F.count(F.lit(1)).alias("n"))


def STR12_suffixes(spark, base):
    term = F.concat(F.lit("nodematch."), F.col("label_source"), F.lit("."), F.col("gender"))
    return load(spark, base, "validation_sample").groupBy(maths.suffix_of(term).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def ARR1_lists(spark, base):
    """Roles listed with bars: how many values, and whether vocals are among them."""
    x = maths.listed(F.col("role"))
    return load(spark, base, "raw_ra", "role").where("role like '%|%'").groupBy(F.size(x).alias("n_values"), F.array_contains(x, "Vocals").alias("vocals")).agg(F.count(F.lit(1)).alias("n"))


def AGG23_exploded(spark, base):
    x = load(spark, base, "raw_ra", "role").where("role like '%|%'").select(F.explode(maths.listed(F.col("role"))).alias("value"))
    return x.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(12)


def HSH1_digests(spark, base):
    return load(spark, base, "validation_sample", "artist_id", "name").select("artist_id", F.md5(F.col("name").cast("binary")).alias("md5"), F.sha2(F.col("name").cast("binary"), 256).alias("sha256"))


def JSN1_paths(spark, base):
    """A value at a path of a JSON text, with a default, by kind of event."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    return load(spark, base, "events", "event_type", "props").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(F.get_json_object("props", "$.missing.path").isNull()).alias("n_without"))


def MTH1_logs(spark, base):
    n = network.nodes(spark, base)
    return _r(n.select("artist_id", maths.log_count(F.col("n_release")).alias("log_n"), maths.log_rank(F.col("n_release") / 1e6).alias("log_rank"), maths.log2_clipped(F.col("n_release").cast("double"), F.lit(30.0), 0.5).alias("log2_ratio")))


def MTH3_percentiles(spark, base):
    e = network.dated(spark, base)
    return _r(e.groupBy("year").agg(F.percentile("n_shared", F.lit(0.025)).alias("lo"), F.percentile("n_shared", F.lit(0.5)).alias("mid"), F.percentile("n_shared", F.lit(0.975)).alias("hi")))


def MTH8_stable(spark, base):
    x = (F.col("n_release") - 30.0) * 20
    return _r(network.nodes(spark, base).select("artist_id", maths.expit(x).alias("expit"), maths.log1p_exp(x).alias("log1p_exp")))


# ---- joins of tables


def JN8_exact_ids(spark, base):
    """Artists joined on their id with a second source, ids that it gives to several releases left out."""
    return population.exact_join(load(spark, base, "validation_sample", "artist_id", "gender"), load(spark, base, "raw_rta", "artist_id", "release_id"), "artist_id", "release_id")


def JN9_disagreements(spark, base):
    """First names that two dictionaries give to different classes."""
    v = load(spark, base, "validation_sample").where("not is_group").withColumn("fn", F.lower(T.first_token(F.col("name_clean"))))
    a, b = (population.name_dictionary(v.where(F.col(c).isin("F", "M")).select("fn", F.col(c).alias("label")), 1, 0.5).select("fn", F.col("label").alias(n)) for c, n in (("gender", "label_a"), ("human_gender", "label_b")))
    return a.join(b, "fn").where("label_a <> label_b")


def JN12_series(spark, base):
    """r by year over all nodes beside r over nodes of known gender."""
    e, n = cut(network.dated(spark, base)), network.nodes(spark, base)
    both = [homophily.assortativity(homophily.mixing(homophily.edge_classes(e, x, "gender"), ["year"]), ["year"]).select("year", F.col("r").alias(name)) for x, name in ((n, "r_all"), (n.where("gender in ('F', 'M')"), "r_known"))]
    return _r(both[0].join(both[1], "year"))


def JN17_via_master(spark, base):
    """Countries of a release by way of its master: those of all releases of that master."""
    s = music._state(spark, base)
    tags = s.where("master_id is not null and country is not null").select("master_id", F.col("country").alias("tag")).distinct()
    return s.where("master_id is not null").select("release_id", "master_id").join(tags, "master_id").select("release_id", "tag")


def SET4_releases(spark, base):
    """Releases that the ends of an edge share and have together, of edges with several shared ones."""
    c = network.credits(spark, base).select("artist_id", "release_id").distinct().groupBy("artist_id").agg(F.collect_set("release_id").alias("rs"))
    e = network.dated(spark, base).where("n_shared > 1").select("u", "v")
    x = e.join(c.withColumnsRenamed({"artist_id": "u", "rs": "ru"}), "u").join(c.withColumnsRenamed({"artist_id": "v", "rs": "rv"}), "v")
    return x.select("u", "v", F.size(F.array_intersect("ru", "rv")).alias("n_common"), F.size(F.array_union("ru", "rv")).alias("n_together"))


# ---- aggregates


def AGG12_odds(spark, base):
    """Women by genre with their odds against all other genres."""
    n = network.known(spark, base).groupBy("genre").agg(F.count_if(F.col("gender") == "F").alias("n_f"), F.count_if(F.col("gender") == "M").alias("n_m"))
    t = n.agg(F.sum("n_f").alias("tf"), F.sum("n_m").alias("tm"))
    odds = F.try_divide((F.col("n_f") * (F.col("tm") - F.col("n_m"))).cast("double"), (F.col("n_m") * (F.col("tf") - F.col("n_f"))).cast("double"))
    return _r(n.crossJoin(F.broadcast(t)).select("genre", "n_f", "n_m", odds.alias("odds_ratio")))  # one row


def AGG13_components(spark, base):
    """Components of the projection and the share of the largest."""
    c = graph.connected_components(network.GRF1_projection(spark, base)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return _r(c.agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("giant"), F.sum("n").alias("n_nodes")).withColumn("giant_share", F.col("giant") / F.col("n_nodes")))


def AGG16_pivot(spark, base):
    v = load(spark, base, "validation_sample").where("debut_year is not null").withColumn("decade", (F.floor(F.col("debut_year") / 10) * 10).cast("int"))
    return v.groupBy("decade").pivot("gender", ["F", "M", "unknown"]).agg(F.median("n_release"))


def AGG17_rounded(spark, base):
    v = load(spark, base, "validation_sample").where("confidence is not null").groupBy(F.floor(F.col("confidence") * 20 + 0.5).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    t = v.agg(F.sum("n").alias("total"))
    return _r(v.crossJoin(F.broadcast(t)).select("step", "n", (F.col("n") / F.col("total")).alias("share")))  # one row


def AGG18_totals(spark, base):
    e = load(spark, base, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))
    return e.orderBy(F.desc("total"), "user_id").limit(20)


def AGG24_replicas(spark, base):
    """Summary of a figure over the replicas of each category, events standing for replicas."""
    from creditweave.operators import metrics

    return metrics.replica_summary(load(spark, base, "events", "event_type", "value"), ["event_type"], "value")


def AGG21_by_bin(spark, base):
    from creditweave.operators import metrics

    v = load(spark, base, "validation_sample").withColumn("bin", metrics.bins(F.col("confidence"), [0, 0.5, 0.75, 0.9, 1]))
    return metrics.accuracy_by(v, "human_gender", "gender", "bin").select("bin", "n", F.round("accuracy", 9).alias("accuracy"), F.round("mean_confidence", 6).alias("mean_confidence"))


def ORD5_sizes(spark, base):
    """Rows of each stratum of the stratified sample."""
    return music.ORD5_stratified_sample(spark, base).groupBy("gender", "label_source").agg(F.count(F.lit(1)).alias("n"))


# ---- networks


def _role_credits(spark: SparkSession, base: str) -> DataFrame:
    c = music._credits(spark, base).where("artist_id is not null")
    return c.select("artist_id", "release_id", F.lit(None).cast("string").alias("track_key"), "scope", T.role_class(F.col("role"), F.col("scope")).alias("role_class"))


def GRF4_role_networks(spark, base):
    """The projection of all credits, of creative and of performing ones."""
    c = cut(_role_credits(spark, base))
    out = None
    for name in ("all", "creative", "performance"):
        e = project.project(c if name == "all" else c.where(F.col("role_class") == name))
        one = e.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.round(F.sum("w"), 4), F.lit(0.0)).alias("weight")).withColumn("network", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def GRF15_mean_clustering(spark, base):
    """Mean clustering of the network of each year."""
    e, out = cut(network.dated(spark, base)), None
    for y in range(network.YEARS[0], network.YEARS[1] + 1):
        c = graph.clustering(e.where(F.col("year") == y).select("u", "v", F.lit(1.0).alias("w"))).agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("clustering").alias("clustering")).withColumn("year", F.lit(y))
        out = c if out is None else out.unionByName(c)
    return _r(out.where("n_nodes > 0"), 7)


def GRF19_histogram(spark, base):
    """Edges of the projection by shared partners, 26 and more together."""
    x = graph.shared_partners(cut(network.GRF1_projection(spark, base)))
    return x.groupBy(F.least("esp", F.lit(26)).alias("esp"), (F.col("esp") > 25).alias("overflow")).agg(F.count(F.lit(1)).alias("n"))


def GRF21_subnetworks(spark, base):
    """Edges within each of the five genres of most artists, within each era, and of all."""
    n = network.nodes(spark, base).withColumn("era", F.when(F.col("debut_year") <= 1995, "early").when(F.col("debut_year") > 1995, "late"))
    top = n.groupBy("genre").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "genre").limit(5)
    sets = n.join(F.broadcast(top), "genre").select("artist_id", F.concat(F.lit("genre:"), "genre").alias("network"))  # five rows
    sets = sets.unionByName(n.where("era is not null").select("artist_id", F.concat(F.lit("era:"), "era").alias("network"))).unionByName(n.select("artist_id", F.lit("whole").alias("network")))
    e = network.GRF1_projection(spark, base).select("u", "v")
    inside = e.join(sets.withColumnRenamed("artist_id", "u"), "u").join(sets.withColumnRenamed("artist_id", "v"), ["v", "network"])
    edges = inside.groupBy("network").agg(F.count(F.lit(1)).alias("n_edges"))
    nodes = inside.select("network", F.explode(F.array("u", "v")).alias("node")).distinct().groupBy("network").agg(F.count(F.lit(1)).alias("n_nodes"))
    return edges.join(nodes, "network")


def GRF22_node_export(spark, base):
    """Nodes that have edges with attributes defaulted, for other programs."""
    ends = network.GRF1_projection(spark, base).select(F.explode(F.array("u", "v")).alias("artist_id")).distinct()
    n = network.nodes(spark, base).join(ends, "artist_id", "left_semi")
    return _r(n.select("artist_id", F.coalesce("gender", F.lit("unknown")).alias("gender"), F.coalesce("genre", F.lit("Unknown")).alias("genre"), F.coalesce("cohort", F.lit(1940)).alias("cohort"), maths.log_count(F.col("n_release")).alias("log_nrel")))


def key_figures(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of a network: nodes, edges, density, share of the largest component, the four r's, share of women and median weight."""
    e, n = cut(edges), cut(nodes)
    known = n.where("gender in ('F', 'M')")
    # the edges meet their nodes once; every r is one of this small table of classes
    side = lambda end: n.select(F.col("artist_id").alias(end), F.col("gender").alias(f"gender_{end}"), F.col("genre").alias(f"genre_{end}"))
    classes = cut(e.join(side("u"), "u").join(side("v"), "v").groupBy("gender_u", "gender_v", "genre_u", "genre_v").agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum("w").alias("w")))

    def r(attr: str, name: str, weight: str = "m", among: list[str] | None = None) -> DataFrame:
        a, b = F.col(f"{attr}_u"), F.col(f"{attr}_v")
        have = a.isin(among) & b.isin(among) if among else a.isNotNull() & b.isNotNull()
        return homophily.assortativity(homophily.mixing(classes.where(have).select(a.alias("ci"), b.alias("cj"), weight), weight=weight)).select(F.col("r").alias(name))

    comp = graph.connected_components(e).groupBy("component").agg(F.count(F.lit(1)).alias("k")).agg(F.sum("k").alias("n_nodes"), F.max("k").alias("giant"))
    base = e.agg(F.count(F.lit(1)).alias("n_edges"), F.median("w").alias("w_median")).crossJoin(comp)
    for x in (r("gender", "r_gender"), r("gender", "r_gender_known", among=["F", "M"]), r("gender", "r_gender_weighted", "w"), r("genre", "r_genre"), known.agg(F.avg((F.col("gender") == "F").cast("double")).alias("share_f"))):
        base = base.crossJoin(x)  # one row each
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return base.select("n_nodes", "n_edges", F.try_divide(2 * F.col("n_edges"), pairs).alias("density"), F.try_divide("giant", "n_nodes").alias("giant_share"), "r_gender", "r_gender_known", "r_gender_weighted", "r_genre", "share_f", "w_median")


def GRF24_key_figures(spark, base):
    return _r(key_figures(network.GRF1_projection(spark, base), network.nodes(spark, base)))


def NUL19_weak_genres(spark, base):
    """r of genre with the first genre, with the second where the first is weak, and without artists of a weak genre.

    The brand is the second genre, and one is weak where the size is a multiple of four.
    """
    p = load(spark, base, "part", "p_partkey", "p_brand", "p_size")
    n = cut(network.nodes(spark, base).join(p, F.col("artist_id") == F.col("p_partkey")).select("artist_id", "genre", F.col("p_brand").alias("genre_2"), (F.col("p_size") % 4 == 0).alias("weak")))
    e = cut(network.dated(spark, base))
    out = None
    for name, x in (("top1", n), ("top2", n.withColumn("genre", F.when(F.col("weak") & F.col("genre_2").isNotNull(), F.col("genre_2")).otherwise(F.col("genre")))), ("exclude", n.where("not weak"))):
        c = homophily.edge_classes(e, x, "genre")
        size = x.agg(F.count(F.lit(1)).alias("n_artists"), F.count_distinct("genre").alias("n_genres"))
        one = homophily.assortativity(homophily.mixing(c)).select("r").crossJoin(size).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return _r(out)


def _music_edges(spark: SparkSession, base: str) -> DataFrame:
    c = load(spark, base, "raw_ra", "artist_id", "release_id").where("artist_id is not null")
    return project.casts(c, "release_id", 8).select(F.explode(project.cast_pairs()).alias("p")).select("p.u", "p.v").distinct()


def NUL20_non_persons(spark, base):
    """r of gender among artists of a release, with and without the names that are no persons."""
    v = cut(load(spark, base, "validation_sample", "artist_id", "name", "gender").where("gender in ('F', 'M')"))
    e = cut(_music_edges(spark, base))
    out = None
    for name, x in (("all", v), ("persons", v.where(selection.no_person(F.col("name")).isNull()))):
        c = homophily.edge_classes(e, x.select("artist_id", "gender"), "gender")
        one = c.agg(F.count(F.lit(1)).alias("n_edges")).crossJoin(homophily.assortativity(homophily.mixing(c)).select("r")).withColumn("nodes", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return _r(out)


def NUL5_edges_used(spark, base):
    """Share of edges that have a known gender at both ends, by year."""
    e = network.dated(spark, base)
    c = homophily.edge_classes(e, network.nodes(spark, base), "gender")
    return _r(c.groupBy("year").agg(F.count(F.lit(1)).alias("n_edges"), F.avg((F.col("ci").isin("F", "M") & F.col("cj").isin("F", "M")).cast("double")).alias("used")))


def NUL6_genres(spark, base):
    """Share of women and observed over expected within a gender, for genres of at least 500 edges."""
    c = cut(homophily.edge_classes(network.dated(spark, base), network.known(spark, base), "gender", keep=("genre",)).where("genre_u = genre_v").withColumnRenamed("genre_u", "genre"))
    big = c.groupBy("genre").agg(F.count(F.lit(1)).alias("n_edges")).where("n_edges >= 500")
    oe = homophily.observed_expected(homophily.mixing(c, ["genre"]), ["genre"]).where("ci = cj").groupBy("genre").agg(F.max(F.when(F.col("ci") == "F", F.col("ratio"))).alias("oe_f"), F.max(F.when(F.col("ci") == "M", F.col("ratio"))).alias("oe_m"))
    women = network.nodes(spark, base).groupBy("genre").agg(F.avg((F.col("gender") == "F").cast("double")).alias("share_f"))
    return _r(big.join(oe, "genre").join(women, "genre"))


def NUL21_u_shape(spark, base):
    from creditweave.operators.nulls import u_shape

    gof = load(spark, base, "lineitem").groupBy((F.col("l_quantity").cast("int") % 12).alias("value")).agg(F.count(F.lit(1)).alias("obs"), (F.count_if(F.col("l_returnflag") == "N") * 2.5).alias("mean"), F.avg("l_discount").alias("p"))
    return _r(u_shape(gof), 7)


# ---- pipelines


def PIP1_population(spark, base):
    """Population, activity, cohort and first tag of each selected artist."""
    kept = music.FIL1_population(spark, base).select("artist_id", "n_it", "n_all")
    act = music.AGG3_activity(spark, base).select("artist_id", "n_release", "debut_year", "last_year")
    tags = music.AGG4_top_tags(spark, base).select("artist_id", F.col("tag_1").alias("tag"), "weak")
    x = population.cohorts(kept.join(act, "artist_id").join(tags, "artist_id", "left"), 1950, 2000)
    return x.select("artist_id", "n_it", "n_all", "n_release", "debut_year", "last_year", "cohort_decade", "era", F.coalesce("tag", F.lit("Unknown")).alias("tag"), F.coalesce("weak", F.lit(True)).alias("weak"))


def PIP5_series(spark, base):
    """Uniform and degree-stratified expectations of each year and gender in one row."""
    a = network.NUL9_uniform_by_year(spark, base).select("year", "category", "observed", F.col("ratio").alias("ratio_uniform"), F.col("z").alias("z_uniform"))
    b = network.NUL10_degree_strata(spark, base).select("year", "category", F.col("ratio").alias("ratio_degree"), "ratio_configuration", "relative_degree")
    return a.join(b, ["year", "category"])


def PIP7_heuristic(spark, base):
    """How many artists with a share of Italian releases above each bound have an Italian profile label."""
    ra = load(spark, base, "raw_ra", "artist_id", "release_id").where("artist_id is not null").join(music._state(spark, base).select("release_id", "country"), "release_id", "left")
    c = population.credit_counts(ra, F.col("country") == "Italy")
    v = load(spark, base, "validation_sample", "artist_id", "profile_lang").select("artist_id", F.lower(F.trim("profile_lang")).isin(*ITALIAN).alias("italian")).where("italian is not null")
    t = spark.createDataFrame([(x,) for x in LIST_SHARES], "threshold double")
    x = c.join(v, "artist_id").crossJoin(F.broadcast(t)).where("share >= threshold")  # four rows
    return _r(x.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("italian").cast("double")).alias("precision")))


def PIP10_numbers(spark, base):
    """The numbers of a report as keys and values."""
    labels = load(spark, base, "validation_sample").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gender") == "F").alias("n_f"))
    return _r(figures({"network": network.AGG13_descriptives(spark, base), "labels": labels}))


QUERIES = {k: f for k, f in globals().items() if callable(f) and k.split("_")[0].rstrip("0123456789") in {"SRC", "FIL", "STR", "ARR", "AGG", "HSH", "JSN", "MTH", "JN", "SET", "ORD", "GRF", "NUL", "PIP"}}

_N = network
_RELEASE = "arg_max(struct_pack(year := year, country := country, master_id := master_id), struct_pack(a := loaded_at, b := coalesce(status, ''), c := coalesce(country, ''), d := coalesce(year, -1), e := coalesce(master_id, -1)))"
_STATE = f"state AS (SELECT release_id, s.year AS year, s.country AS country, s.master_id AS master_id FROM (SELECT release_id, {_RELEASE} AS s FROM raw_releases GROUP BY 1))"


def _components(rounds: int = 10) -> str:
    """SQL of the smallest node id reached in so many steps; enough on graphs of smaller diameter."""
    out = ", sy AS MATERIALIZED (SELECT u AS a, v AS b FROM edges UNION ALL SELECT v, u FROM edges), c0 AS MATERIALIZED (SELECT a AS node, a AS c FROM sy GROUP BY 1)"
    for i in range(1, rounds + 1):
        out += f", c{i} AS MATERIALIZED (SELECT x.node, least(x.c, min(y.c)) AS c FROM c{i - 1} x JOIN sy ON a = x.node JOIN c{i - 1} y ON y.node = b GROUP BY x.node, x.c)"
    return out + f", comp AS (SELECT node, c AS component FROM c{rounds})"


def _mat(sql: str, *names: str) -> str:
    for n in names:
        sql = sql.replace(f"\n{n} AS (", f"\n{n} AS MATERIALIZED (")
    return sql


_EDGES, _DATED = _mat(_N._EDGES, "edges"), _mat(_N._DATED, "dated", "dc")
_GIANT = ", g AS MATERIALIZED (SELECT e.* FROM edges e JOIN comp ON u = node WHERE component = (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)), s AS MATERIALIZED (SELECT u AS a, v AS b, w FROM g UNION ALL SELECT v, u, w FROM g)"


def _iterated(start: str, step: str, rounds: int) -> str:
    out = f", x0 AS MATERIALIZED ({start})"
    for i in range(1, rounds + 1):
        out += f", x{i} AS MATERIALIZED ({step.replace('PREV', f'x{i - 1}')})"
    return out


_EIGEN = _EDGES + _components() + _GIANT + _iterated(
    "SELECT a AS node, 1::double AS x FROM s GROUP BY 1",
    "SELECT node, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT p.node, p.x + sum(s.w * q.x) AS x FROM PREV p JOIN s ON s.a = p.node JOIN PREV q ON q.node = s.b GROUP BY p.node, p.x)", 60,
)


_TRIANGLES = """, sd AS MATERIALIZED (SELECT u AS a, v AS b, w FROM {0} UNION ALL SELECT v, u, w FROM {0}), dg AS MATERIALIZED (SELECT a AS node, count(*) AS d FROM sd GROUP BY 1),
og AS MATERIALIZED (SELECT a, b, w FROM sd JOIN dg x ON x.node = a JOIN dg y ON y.node = b WHERE (x.d, a) < (y.d, b)),
tr AS MATERIALIZED (SELECT p.a AS n1, p.b AS n2, q.b AS n3, p.w AS w12, q.w AS w13, c.w AS w23 FROM og p JOIN og q ON p.a = q.a JOIN og c ON c.a = p.b AND c.b = q.b)"""
_PARTNERS = _EDGES + _TRIANGLES.format("edges") + """,
es AS (SELECT least(x, y) AS u, greatest(x, y) AS v, count(*) AS n FROM (SELECT n1 AS x, n2 AS y FROM tr UNION ALL SELECT n1, n3 FROM tr UNION ALL SELECT n2, n3 FROM tr) GROUP BY 1, 2),
ic AS MATERIALIZED (SELECT DISTINCT artist_id AS a, release_id AS r FROM credits SEMI JOIN edges_rb USING (release_id)), ks AS (SELECT r, count(*) AS k FROM ic GROUP BY 1),
wk AS MATERIALIZED (SELECT x.a AS u, y.a AS v, r FROM ic x JOIN ic y USING (r) WHERE x.a < y.a), ws AS (SELECT u, v, count(*) AS n_shared, max(k) AS largest_cast FROM wk JOIN ks USING (r) GROUP BY 1, 2),
xp AS (SELECT u, v, count(DISTINCT ic.a) AS n FROM wk JOIN ic USING (r) WHERE ic.a <> u AND ic.a <> v GROUP BY 1, 2),
esp AS MATERIALIZED (SELECT e.u, e.v, coalesce(es.n, 0) AS esp, coalesce(xp.n, 0) AS esp_explained, coalesce(n_shared, 0) AS n_shared, largest_cast, greatest(coalesce(largest_cast, 0) - 2, 0) AS ceiling,
  coalesce(es.n, 0) > greatest(coalesce(largest_cast, 0) - 2, 0) AS beyond FROM edges e LEFT JOIN es USING (u, v) LEFT JOIN ws USING (u, v) LEFT JOIN xp USING (u, v))"""


def _role_net(name: str, where: str) -> str:
    return f"""
{name}_s AS (SELECT artist_id, release_id, max(CASE scope WHEN 'main' THEN 70 ELSE 30 END) AS s FROM rc WHERE {where} GROUP BY 1, 2),
{name}_b AS (SELECT release_id FROM {name}_s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8),
{name} AS (SELECT '{name}' AS network, count(*) AS n_edges, coalesce(round(sum(w), 4), 0::double) AS weight FROM (SELECT a.artist_id, b.artist_id, sum(a.s * b.s)::double / 10000 AS w FROM {name}_s a JOIN {name}_s b USING (release_id) SEMI JOIN {name}_b USING (release_id) WHERE a.artist_id < b.artist_id GROUP BY 1, 2))"""


def _role_case() -> str:
    listed = lambda k: "list_has_any(l, [" + ", ".join("'" + x.lower() + "'" for x in T.ROLE_LISTS[k]) + "])"
    word = lambda k: r"regexp_matches(t, '\b(" + T.ROLE_WORDS[k] + r")\b', 'i')"
    return f"""CASE WHEN n = 0 THEN CASE WHEN scope = 'main' THEN 'performance' ELSE 'other' END WHEN {listed("creative")} THEN 'creative' WHEN {listed("performance")} THEN 'performance'
  WHEN {word("creative")} THEN 'creative' WHEN {word("performance")} THEN 'performance' WHEN {listed("technical")} OR {word("technical")} THEN 'technical' ELSE 'other' END"""


_R_OF = "round((trace - a2) / nullif(1 - a2, 0), 8)"


def _r_sql(edges: str, nodes: str, attr: str, w: str = "1") -> str:
    """SQL of one r as a scalar."""
    return f"""(SELECT {_R_OF} FROM (SELECT sum(CASE WHEN ci = cj THEN p ELSE 0 END) AS trace FROM m_), (SELECT sum(a * a) AS a2 FROM (SELECT sum(p) AS a FROM m_ GROUP BY ci)))""".replace(
        "m_", f"(SELECT ci, cj, sum(w)::double / sum(sum(w)) OVER () AS p FROM (SELECT x.{attr} AS ci, y.{attr} AS cj, {w}::double AS w FROM {edges} e JOIN {nodes} x ON e.u = x.artist_id JOIN {nodes} y ON e.v = y.artist_id UNION ALL SELECT y.{attr}, x.{attr}, {w}::double FROM {edges} e JOIN {nodes} x ON e.u = x.artist_id JOIN {nodes} y ON e.v = y.artist_id) GROUP BY 1, 2)"
    )


def _rx(p: str) -> str:
    """A pattern for SQL, whose classes of letters and ends of words are those of all scripts."""
    p = p.replace(r"\b(", r"(^|[^\pL\pN_])(").replace(r")\b", r")($|[^\pL\pN_])").replace(r"\w", r"[\pL\pN_]")
    return p.replace("'", "''")


SQL = {
    "GRF17_shared_partners_whole": _PARTNERS + " SELECT * FROM esp",
    "AGG27_esp_histogram_whole": _PARTNERS + " SELECT least(esp, 26)::bigint AS esp, count(*) AS n, round(avg(coalesce(esp_explained / nullif(esp, 0), 0)), 8) AS explained FROM esp GROUP BY 1",
    "GRF18_summary_whole": _PARTNERS + " SELECT count(*) AS n_edges, round(avg(esp), 8) AS esp_mean, count(*) FILTER (WHERE esp = 0) AS n_zero, count(*) FILTER (WHERE esp > 0 AND esp = esp_explained) AS n_explained, round(sum(esp_explained) / nullif(sum(esp), 0), 8) AS explained_share FROM esp",
    "AGG28_ceiling_whole": _PARTNERS + " SELECT beyond, count(*) AS n, round(avg(esp), 8) AS esp_mean, median(n_shared) AS shared_median, max(largest_cast) AS largest_cast FROM esp GROUP BY 1",
    "GRF19_histogram": _PARTNERS + " SELECT least(esp, 26)::bigint AS esp, esp > 25 AS overflow, count(*) AS n FROM esp GROUP BY 1, 2",
    "GRF14_clustering_whole": _EDGES + _components() + _GIANT + _TRIANGLES.format("g") + """, top AS (SELECT max(w) AS t FROM g),
pt AS (SELECT node, count(*) AS t, sum(gm) AS gm FROM (SELECT unnest([n1, n2, n3]) AS node, pow(w12 / t * (w13 / t) * (w23 / t), 1.0::double / 3) AS gm FROM tr, top) GROUP BY 1)
SELECT node, coalesce(t, 0) AS triangles, round(coalesce(t / nullif(d * (d - 1) / 2, 0), 0), 7) AS clustering, round(coalesce(gm / nullif(d * (d - 1) / 2, 0), 0), 7) AS weighted FROM dg LEFT JOIN pt USING (node)""",
    "JN8_exact_ids": """
WITH amb AS (SELECT artist_id FROM raw_rta GROUP BY 1 HAVING count(DISTINCT release_id) > 1), f AS (SELECT artist_id, min(release_id) AS release_id FROM raw_rta WHERE artist_id NOT IN (SELECT artist_id FROM amb) GROUP BY 1)
SELECT v.artist_id, v.gender, f.release_id FROM validation_sample v JOIN f USING (artist_id)""",
    "AGG24_replicas": "SELECT event_type, count(*) AS replicas, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM events GROUP BY 1",
    "SRC6_union": "SELECT DISTINCT artist_id, release_id FROM (SELECT artist_id, release_id FROM raw_ra UNION ALL SELECT artist_id, release_id FROM raw_rta)",
    "SRC12_accumulated": "SELECT doc_id, string_agg(DISTINCT subject, '|' ORDER BY subject) AS subjects FROM doc_subjects JOIN subject_areas USING (subject) GROUP BY 1",
    "FIL15_valid_ids": "SELECT DISTINCT release_id, sequence, n AS track_no FROM (SELECT release_id, sequence, CASE WHEN regexp_full_match(t, '\\s*[0-9]{1,18}\\s*') THEN try_cast(trim(t) AS BIGINT) END AS n FROM (SELECT *, substring(trim(track_id), 2, 30) AS t FROM raw_reltracks)) WHERE n BETWEEN 1 AND 2147483647",
    "FIL16_large_enough": _DATED + ", e AS (SELECT d.*, genre FROM dated d JOIN nodes ON u = artist_id), n AS (SELECT year, genre, count(*) AS n_nodes FROM (SELECT year, genre, u AS x FROM e UNION SELECT year, genre, v FROM e) GROUP BY 1, 2) SELECT year, genre, n_nodes, count(*) AS n_edges FROM e JOIN n USING (year, genre) WHERE n_nodes >= 100 GROUP BY 1, 2, 3 HAVING count(*) >= 200",
    "FIL13_marked": f"SELECT artist_id, CASE WHEN regexp_matches(trim(name), '{_rx(selection.PLACEHOLDER)}', 'i') THEN 'placeholder' ELSE 'marker' END AS reason FROM validation_sample WHERE regexp_matches(trim(name), '{_rx(selection.PLACEHOLDER)}', 'i') OR regexp_matches(trim(name), '{_rx(selection.NO_PERSON)}', 'i')",
    "STR8_years": "SELECT year(loaded_at)::int AS year, (year(loaded_at) // 10)::varchar || '0s' AS decade, count(*) AS n FROM raw_releases GROUP BY 1, 2",
    "STR9_uri_tail": "SELECT artist_id, artist_id::varchar AS tail FROM validation_sample",
    "STR11_codes": "SELECT CASE lower(trim(status)) WHEN 'accepted' THEN 'A' WHEN 'draft' THEN 'D' WHEN 'deleted' THEN 'X' ELSE 'other' END AS code, count(*) AS n FROM raw_releases GROUP BY 1",
    "STR12_suffixes": "SELECT nullif(regexp_extract('nodematch.' || label_source || '.' || gender, '\\.([A-Za-z]+)$', 1), '') AS category, count(*) AS n FROM validation_sample GROUP BY 1",
    "ARR1_lists": "SELECT len(l)::int AS n_values, list_contains(l, 'Vocals') AS vocals, count(*) AS n FROM (SELECT list_filter(list_transform(string_split(role, '|'), lambda x: trim(x)), lambda x: x <> '') AS l FROM raw_ra WHERE role LIKE '%|%') GROUP BY 1, 2",
    "AGG23_exploded": "SELECT x AS value, count(*) AS n FROM (SELECT trim(unnest(string_split(role, '|'))) AS x FROM raw_ra WHERE role LIKE '%|%') WHERE x <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 12",
    "HSH1_digests": "SELECT artist_id, md5(name) AS md5, sha256(name) AS sha256 FROM validation_sample",
    "JSN1_paths": "SELECT event_type, sum(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0))::bigint AS total, count(*) FILTER (WHERE json_extract_string(props, '$.missing.path') IS NULL) AS n_without FROM events GROUP BY 1",
    "MTH1_logs": _N._BASE.rstrip().rstrip(",") + " SELECT artist_id, round(ln(greatest(n_release, 1)), 8) AS log_n, round(ln(1 + n_release::double), 8) AS log_rank, CASE WHEN n_release > 0 THEN round(greatest(least(log2(n_release / 30::double), 0.5::double), -0.5::double), 8) END AS log2_ratio FROM nodes",
    "MTH3_percentiles": _DATED + " SELECT year, round(quantile_cont(n_shared::double, 0.025), 8) AS lo, round(quantile_cont(n_shared::double, 0.5), 8) AS mid, round(quantile_cont(n_shared::double, 0.975), 8) AS hi FROM dated GROUP BY 1",
    "MTH8_stable": _N._BASE.rstrip().rstrip(",") + ", z AS (SELECT artist_id, (n_release - 30)::double * 20 AS x FROM nodes) SELECT artist_id, round(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END, 8) AS expit, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 8) AS log1p_exp FROM z",
    "JN9_disagreements": f"""
WITH f AS (SELECT lower({music._FN.format("name_clean")}) AS fn, gender, human_gender FROM validation_sample WHERE NOT is_group),
a AS (SELECT fn, CASE WHEN count(*) FILTER (WHERE gender = 'M') >= count(*) FILTER (WHERE gender = 'F') THEN 'M' ELSE 'F' END AS label_a FROM f WHERE gender IN ('F', 'M') AND fn <> '' GROUP BY 1),
b AS (SELECT fn, CASE WHEN count(*) FILTER (WHERE human_gender = 'M') >= count(*) FILTER (WHERE human_gender = 'F') THEN 'M' ELSE 'F' END AS label_b FROM f WHERE human_gender IN ('F', 'M') AND fn <> '' GROUP BY 1)
SELECT fn, label_a, label_b FROM a JOIN b USING (fn) WHERE label_a <> label_b""",
    "JN12_series": _DATED + _N._mixing("dated", "gender", by="year", prefix="a") + _N._mixing("dated", "gender", by="year", nodes="known", prefix="b") + " SELECT year, a.r AS r_all, b.r AS r_known FROM afig a JOIN bfig b USING (year)",
    "JN17_via_master": f"WITH {_STATE} SELECT a.release_id, t.tag FROM state a JOIN (SELECT DISTINCT master_id, country AS tag FROM state WHERE master_id IS NOT NULL AND country IS NOT NULL) t USING (master_id)",
    "SET4_releases": _DATED + ", rs AS (SELECT artist_id, list(DISTINCT release_id) AS rs FROM credits GROUP BY 1) SELECT u, v, len(list_intersect(a.rs, b.rs))::int AS n_common, len(list_distinct(list_concat(a.rs, b.rs)))::int AS n_together FROM dated JOIN rs a ON a.artist_id = u JOIN rs b ON b.artist_id = v WHERE n_shared > 1",
    "AGG12_odds": _N._BASE.rstrip().rstrip(",") + ", n AS (SELECT genre, count(*) FILTER (WHERE gender = 'F') AS n_f, count(*) FILTER (WHERE gender = 'M') AS n_m FROM known GROUP BY 1), t AS (SELECT sum(n_f) AS tf, sum(n_m) AS tm FROM n) SELECT genre, n_f, n_m, round((n_f * (tm - n_m))::double / nullif(n_m * (tf - n_f), 0), 8) AS odds_ratio FROM n, t",
    "AGG13_components": _EDGES + _components() + ", z AS (SELECT component, count(*) AS n FROM comp GROUP BY 1) SELECT count(*) AS n_components, max(n) AS giant, sum(n)::bigint AS n_nodes, round(max(n)::double / sum(n), 8) AS giant_share FROM z",
    "GRF7_components": _EDGES + _components() + " SELECT node, component FROM comp",
    "GRF12_pagerank": _EDGES + _components() + _GIANT + ", l AS MATERIALIZED (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM s)"
    + _iterated("SELECT a AS node, 1::double / (SELECT count(DISTINCT a) FROM s) AS x FROM s GROUP BY 1", "SELECT b AS node, 0.15::double / (SELECT count(*) FROM x0) + 0.85::double * sum(x * p) AS x FROM l JOIN PREV ON PREV.node = a GROUP BY 1", 60)
    + " SELECT node, round(x, 9) AS pagerank FROM x60",
    "GRF11_eigenvector": _EIGEN + " SELECT node, round(x, 8) AS eigenvector FROM x60",
    "GRF16_localisation": _EIGEN + " SELECT round(sum(pow(x, 4)) / pow(sum(x * x), 2), 8) AS ipr, count(*) AS n, round(pow(sum(x * x), 2) / sum(pow(x, 4)), 3) AS effective FROM x60",
    "GRF13_non_backtracking": _EDGES + _components() + _GIANT
    + _iterated("SELECT a AS node, count(*) AS d, 1::double AS x, 0::double AS y FROM s GROUP BY 1", "SELECT node, d, x / sqrt(sum(x * x + y * y) OVER ()) AS x, y / sqrt(sum(x * x + y * y) OVER ()) AS y FROM (SELECT p.node, p.d, sum(q.x) + (1 - p.d) * p.y + p.x AS x, p.x + p.y AS y FROM PREV p JOIN s ON s.a = p.node JOIN PREV q ON q.node = s.b GROUP BY p.node, p.d, p.x, p.y)", 60)
    + " SELECT node, round(greatest(x, 0) / sqrt(sum(pow(greatest(x, 0), 2)) OVER ()), 8) AS nonbacktracking FROM x60",
    "GRF8_coreness": _EDGES + _components() + _GIANT
    + _iterated("SELECT a AS node, count(*) AS c FROM s GROUP BY 1", "SELECT node, least(c, h) AS c FROM (SELECT a, max(least(c, upto)) AS h FROM (SELECT a, c, sum(count(*)) OVER (PARTITION BY a ORDER BY c DESC) AS upto FROM s JOIN PREV ON PREV.node = b GROUP BY a, c) GROUP BY a) JOIN PREV ON node = a", 60)
    + " SELECT node, c::int AS coreness FROM x60",
    "AGG16_pivot": "SELECT (floor(debut_year / 10) * 10)::int AS decade, median(n_release) FILTER (WHERE gender = 'F') AS \"F\", median(n_release) FILTER (WHERE gender = 'M') AS \"M\", median(n_release) FILTER (WHERE gender = 'unknown') AS unknown FROM validation_sample WHERE debut_year IS NOT NULL GROUP BY 1",
    "AGG17_rounded": "SELECT floor(confidence * 20 + 0.5::double)::bigint AS step, count(*) AS n, round(count(*)::double / (SELECT count(confidence) FROM validation_sample), 8) AS share FROM validation_sample WHERE confidence IS NOT NULL GROUP BY 1",
    "AGG18_totals": "SELECT user_id, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1 ORDER BY total DESC, user_id LIMIT 20",
    "AGG21_by_bin": """
SELECT CASE WHEN confidence > 0 AND confidence <= 0.5::double THEN '0-0.5' WHEN confidence > 0.5::double AND confidence <= 0.75::double THEN '0.5-0.75'
  WHEN confidence > 0.75::double AND confidence <= 0.9::double THEN '0.75-0.9' WHEN confidence > 0.9::double AND confidence <= 1 THEN '0.9-1' END AS bin, count(*) AS n, round(avg((human_gender = gender)::int::double), 9) AS accuracy, round(avg(confidence), 6) AS mean_confidence
FROM validation_sample WHERE human_gender IS NOT NULL GROUP BY 1""",
    "ORD5_sizes": "WITH c AS (SELECT gender, label_source, count(*) AS k FROM validation_sample GROUP BY 1, 2), t AS (SELECT sum(k) AS total, count(*) AS g FROM c) SELECT gender, label_source, least(k, ceil(100 * k / total)::bigint + greatest(1, 200 // (2 * g)))::bigint AS n FROM c, t",
    "GRF4_role_networks": f"""
WITH x AS (SELECT artist_id, release_id, CASE WHEN extra = 0 THEN 'main' ELSE 'umbrella' END AS scope,
  list_filter(list_transform(string_split(regexp_replace(coalesce(role, ''), '\\[[^\\]]*\\]', '', 'g'), ','), lambda v: trim(v)), lambda v: v <> '') AS p FROM raw_ra WHERE artist_id IS NOT NULL),
y AS (SELECT artist_id, release_id, scope, list_transform(p, lambda v: lower(v)) AS l, array_to_string(p, ' ') AS t, len(p) AS n FROM x),
rc AS MATERIALIZED (SELECT artist_id, release_id, scope, {_role_case()} AS role_class FROM y),
{_role_net("all", "TRUE").replace("all_", "every_").replace("all AS (SELECT", "every AS (SELECT")}, {_role_net("creative", "role_class = 'creative'")}, {_role_net("performance", "role_class = 'performance'")}
SELECT * FROM every UNION ALL SELECT * FROM creative UNION ALL SELECT * FROM performance""",
    "GRF15_mean_clustering": _DATED
    + """, s AS MATERIALIZED (SELECT year, u AS a, v AS b FROM dated UNION ALL SELECT year, v, u FROM dated), d AS MATERIALIZED (SELECT year, a AS node, count(*) AS d FROM s GROUP BY 1, 2),
o AS MATERIALIZED (SELECT s.year, a, b FROM s JOIN d x ON x.year = s.year AND x.node = a JOIN d y ON y.year = s.year AND y.node = b WHERE (x.d, a) < (y.d, b)),
t AS (SELECT p.year, p.a AS n1, p.b AS n2, q.b AS n3 FROM o p JOIN o q ON p.year = q.year AND p.a = q.a JOIN o c ON c.year = p.year AND c.a = p.b AND c.b = q.b),
k AS (SELECT year, node, count(*) AS t FROM (SELECT year, unnest([n1, n2, n3]) AS node FROM t) GROUP BY 1, 2)
SELECT d.year, count(*) AS n_nodes, round(avg(coalesce(t / nullif(d * (d - 1) / 2, 0), 0)), 7) AS clustering FROM d LEFT JOIN k ON k.year = d.year AND k.node = d.node GROUP BY 1""",
    "GRF21_subnetworks": _EDGES
    + """, top AS (SELECT genre FROM nodes GROUP BY 1 ORDER BY count(*) DESC, genre LIMIT 5), sets AS MATERIALIZED (SELECT artist_id, 'genre:' || genre AS network FROM nodes JOIN top USING (genre)
  UNION ALL SELECT artist_id, CASE WHEN debut_year <= 1995 THEN 'era:early' ELSE 'era:late' END FROM nodes WHERE debut_year IS NOT NULL UNION ALL SELECT artist_id, 'whole' FROM nodes),
i AS MATERIALIZED (SELECT a.network, u, v FROM edges JOIN sets a ON a.artist_id = u JOIN sets b ON b.artist_id = v AND b.network = a.network), n AS (SELECT network, count(*) AS n_nodes FROM (SELECT network, u AS x FROM i UNION SELECT network, v FROM i) GROUP BY 1)
SELECT network, n_nodes, count(*) AS n_edges FROM i JOIN n USING (network) GROUP BY 1, 2""",
    "GRF22_node_export": _EDGES + " SELECT artist_id, coalesce(gender, 'unknown') AS gender, coalesce(genre, 'Unknown') AS genre, coalesce(debut_year, 1940)::int AS cohort, round(ln(greatest(n_release, 1)), 8) AS log_nrel FROM nodes WHERE artist_id IN (SELECT u FROM edges UNION ALL SELECT v FROM edges)",
    "GRF24_key_figures": _EDGES + _components() + f"""
SELECT n AS n_nodes, m AS n_edges, round(2 * m / (n * (n - 1))::double, 8) AS density, round(giant::double / n, 8) AS giant_share, {_r_sql("edges", "nodes", "gender")} AS r_gender, {_r_sql("edges", "known", "gender")} AS r_gender_known, {_r_sql("edges", "nodes", "gender", "w")} AS r_gender_weighted,
  {_r_sql("edges", "nodes", "genre")} AS r_genre, (SELECT round(avg((gender = 'F')::int::double), 8) FROM known) AS share_f, (SELECT round(median(w), 8) FROM edges) AS w_median
FROM (SELECT sum(k)::bigint AS n, max(k) AS giant FROM (SELECT count(*) AS k FROM comp GROUP BY component)), (SELECT count(*) AS m FROM edges)""",
    "NUL19_weak_genres": _DATED + f""", n1 AS MATERIALIZED (SELECT n.artist_id, n.genre, p_brand AS genre_2, p_size % 4 = 0 AS weak FROM nodes n JOIN part ON p_partkey = n.artist_id), n2 AS (SELECT artist_id, CASE WHEN weak AND genre_2 IS NOT NULL THEN genre_2 ELSE genre END AS genre FROM n1), n3 AS (SELECT * FROM n1 WHERE NOT weak)
SELECT 'top1' AS variant, {_r_sql("dated", "n1", "genre")} AS r, (SELECT count(*) FROM n1) AS n_artists, (SELECT count(DISTINCT genre) FROM n1) AS n_genres
UNION ALL SELECT 'top2', {_r_sql("dated", "n2", "genre")}, (SELECT count(*) FROM n2), (SELECT count(DISTINCT genre) FROM n2) UNION ALL SELECT 'exclude', {_r_sql("dated", "n3", "genre")}, (SELECT count(*) FROM n3), (SELECT count(DISTINCT genre) FROM n3)""",
    "NUL20_non_persons": f"""
WITH c AS (SELECT DISTINCT artist_id, release_id FROM raw_ra WHERE artist_id IS NOT NULL), b AS (SELECT release_id FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8),
edges AS MATERIALIZED (SELECT DISTINCT x.artist_id AS u, y.artist_id AS v FROM c x JOIN c y USING (release_id) SEMI JOIN b USING (release_id) WHERE x.artist_id < y.artist_id),
n1 AS MATERIALIZED (SELECT artist_id, name, gender FROM validation_sample WHERE gender IN ('F', 'M')), n2 AS (SELECT * FROM n1 WHERE NOT coalesce(regexp_matches(trim(name), '{_rx(selection.PLACEHOLDER)}', 'i') OR regexp_matches(trim(name), '{_rx(selection.NO_PERSON)}', 'i'), FALSE))
SELECT 'all' AS nodes, (SELECT count(*) FROM edges JOIN n1 x ON u = x.artist_id JOIN n1 y ON v = y.artist_id) AS n_edges, {_r_sql("edges", "n1", "gender")} AS r
UNION ALL SELECT 'persons', (SELECT count(*) FROM edges JOIN n2 x ON u = x.artist_id JOIN n2 y ON v = y.artist_id), {_r_sql("edges", "n2", "gender")}""",
    "NUL5_edges_used": _DATED + " SELECT year, count(*) AS n_edges, round(avg((x.gender IN ('F', 'M') AND y.gender IN ('F', 'M'))::int::double), 8) AS used FROM dated JOIN nodes x ON u = x.artist_id JOIN nodes y ON v = y.artist_id GROUP BY 1",
    "NUL6_genres": f"""SELECT genre, n_edges, oe_f, oe_m, share_f FROM (SELECT genre, max(ratio) FILTER (WHERE ci = 'F') AS oe_f, max(ratio) FILTER (WHERE ci = 'M') AS oe_m FROM ({_N.SQL["NUL6_within_genre"]}) WHERE ci = cj GROUP BY 1)
JOIN ({_N._DATED} SELECT x.genre, count(*) AS n_edges FROM dated JOIN known x ON u = x.artist_id JOIN known y ON v = y.artist_id WHERE x.genre = y.genre GROUP BY 1 HAVING count(*) >= 500) USING (genre)
JOIN ({_N._BASE.rstrip().rstrip(",")} SELECT genre, round(avg((gender = 'F')::int::double), 8) AS share_f FROM nodes GROUP BY 1) USING (genre)""",
    "NUL21_u_shape": """
WITH g AS (SELECT l_quantity::int % 12 AS value, count(*) AS obs, count(*) FILTER (WHERE l_returnflag = 'N') * 2.5::double AS mean, avg(l_discount) AS p FROM lineitem GROUP BY 1),
x AS (SELECT avg(obs / nullif(mean, 0)) FILTER (WHERE value = 0) AS low, avg(obs / nullif(mean, 0)) FILTER (WHERE value BETWEEN 1 AND 2) AS middle, avg(obs / nullif(mean, 0)) FILTER (WHERE value BETWEEN 6 AND 9) AS tail, count(*) FILTER (WHERE p < 0.05::double) AS bins_off, count(*) AS bins FROM g)
SELECT round(low, 7) AS low, round(middle, 7) AS middle, round(tail, 7) AS tail, round((coalesce(low, tail) + coalesce(tail, low)) / 2 / middle, 7) AS amplitude, bins_off, bins FROM x""",
    "PIP1_population": f"""
SELECT artist_id, n_it, n_all, n_release, debut_year, last_year, CASE WHEN d >= 1950 THEN d ELSE 1940 END AS cohort_decade, CASE WHEN debut_year < 2000 THEN 'early' WHEN debut_year >= 2000 THEN 'late' END AS era, coalesce(tag_1, 'Unknown') AS tag, coalesce(weak, TRUE) AS weak
FROM ({music.SQL["FIL1_population"]}) JOIN (SELECT *, (floor(debut_year / 10) * 10)::int AS d FROM ({music.SQL["AGG3_activity"]})) USING (artist_id) LEFT JOIN ({music.SQL["AGG4_top_tags"]}) USING (artist_id)""",
    "PIP5_series": f"SELECT a.year, a.category, a.observed, a.ratio AS ratio_uniform, a.z AS z_uniform, b.ratio AS ratio_degree, b.ratio_configuration, b.relative_degree FROM ({_N.SQL['NUL9_uniform_by_year']}) a JOIN ({_N.SQL['NUL10_degree_strata']}) b ON a.year = b.year AND a.category = b.category",
    "PIP7_heuristic": f"""
WITH {_STATE}, c AS (SELECT artist_id, count(*) FILTER (WHERE country = 'Italy')::double / count(*) AS share FROM raw_ra LEFT JOIN state USING (release_id) WHERE artist_id IS NOT NULL GROUP BY 1)
SELECT threshold, count(*) AS n, round(avg((lower(trim(profile_lang)) IN ('it', 'ita', 'italian'))::int::double), 8) AS precision FROM c JOIN validation_sample USING (artist_id) CROSS JOIN (SELECT unnest([0.5::double, 0.6::double, 0.7::double, 0.8::double]) AS threshold)
WHERE profile_lang IS NOT NULL AND share >= threshold GROUP BY 1""",
    "PIP10_numbers": f"""WITH n AS ({_N.SQL["AGG13_descriptives"]}), l AS (SELECT count(*) AS n, count(*) FILTER (WHERE gender = 'F') AS n_f FROM validation_sample)
{" UNION ALL ".join(f"SELECT 'network.{c}' AS key, round({c}::double, 8) AS value FROM n" for c in ("n_nodes", "degree_mean", "degree_median", "degree_max", "n_edges", "weight", "w_median", "density"))}
UNION ALL SELECT 'labels.n', n::double FROM l UNION ALL SELECT 'labels.n_f', n_f::double FROM l""",
}
