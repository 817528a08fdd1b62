"""Queries of text functions, population and labels over the music-credit tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditweave.functions import text as T
from creditweave.operators import metrics, population, project
from creditweave.sources import load

LABELS = ["F", "M", "mixed", "unknown"]


def _state(spark: SparkSession, base: str) -> DataFrame:
    """Latest row of each release."""
    r = load(spark, base, "raw_releases")
    last = F.max_by(F.struct("year", "country", "master_id"), F.struct("loaded_at", F.coalesce("status", F.lit("")), F.coalesce("country", F.lit("")), F.coalesce("year", F.lit(-1)), F.coalesce("master_id", F.lit(-1))))
    return r.groupBy("release_id").agg(last.alias("s")).select("release_id", "s.year", "s.country", "s.master_id")


def _credits(spark: SparkSession, base: str) -> DataFrame:
    ra = load(spark, base, "raw_ra")
    scope = F.when(F.col("extra") == 0, "main").otherwise("umbrella")
    return ra.select("row_id", "artist_id", "release_id", "role", "tracks", scope.alias("scope"))


def STR1_clean_name(spark, base):
    v = load(spark, base, "validation_sample")
    return v.select("artist_id", T.clean_name(F.col("name")).alias("clean"))


def STR2_norm(spark, base):
    return load(spark, base, "validation_sample").select("artist_id", T.norm(F.col("realname")).alias("key"))


def STR3_first_token(spark, base):
    return load(spark, base, "validation_sample").select("artist_id", T.first_token(F.col("name_clean")).alias("fn"))


def STR4_person(spark, base):
    return load(spark, base, "validation_sample").select("artist_id", T.looks_like_person(F.col("realname")).alias("person"))


def STR5_roles(spark, base):
    x = load(spark, base, "raw_ra").select(F.explode(T.split_roles(F.col("role"))).alias("role"))
    return x.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def STR6_role_class(spark, base):
    c = _credits(spark, base)
    return c.groupBy("scope", T.role_class(F.col("role"), F.col("scope")).alias("role_class")).agg(F.count(F.lit(1)).alias("n"))


def STR7_track_field(spark, base):
    p = load(spark, base, "raw_ra").select(F.explode(T.track_field(F.col("tracks"))).alias("p")).select("p.kind", "p.first", "p.last")
    return p.groupBy("kind", "first", "last").agg(F.count(F.lit(1)).alias("n"))


def STR10_track_key(spark, base):
    rta = load(spark, base, "raw_rta")
    k = T.track_key(T.blank_to_null(F.col("track_id")), F.col("release_id"), F.col("track_sequence"))
    return rta.groupBy(k.alias("track_key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("artist_id").alias("n_artists"))


def FIL1_population(spark, base):
    ra = load(spark, base, "raw_ra").select("artist_id", "release_id").where("artist_id is not null").join(_state(spark, base).select("release_id", "country"), "release_id", "left")
    counts = population.credit_counts(ra, F.col("country") == "Italy")
    return population.select_population(counts, load(spark, base, "validation_sample", "artist_id", "name"), 1, 2, 0.2).withColumn("share", F.round("share", 9))


def AGG3_activity(spark, base):
    c = load(spark, base, "raw_ra", "artist_id", "release_id").where("artist_id is not null")
    return population.activity(c, _state(spark, base).where("year between 1900 and 2026").select("release_id", "year", "country"), F.col("country") == "Italy")


def DAT1_cohorts(spark, base):
    v = load(spark, base, "validation_sample").withColumn("debut_year", F.col("debut_year").cast("int"))
    c = population.cohorts(v, 1950, 2000)
    return c.groupBy("cohort_decade", "era").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gender") == "F").alias("n_f"))


def AGG4_top_tags(spark, base):
    ra = load(spark, base, "raw_ra").where("role is not null and trim(role) <> ''").select("artist_id", F.col("role").alias("tag"))
    t = population.top_tags(ra, "artist_id", "tag")
    return t.withColumn("share", F.round("share", 9))


def JN10_positions(spark, base):
    credits = load(spark, base, "raw_ra", "row_id", "release_id", "tracks")
    tl = load(spark, base, "raw_reltracks").select("release_id", "sequence", "position", "track_id").distinct()
    tl = tl.select("release_id", "sequence", "position", T.track_key(T.blank_to_null(F.col("track_id")), F.col("release_id"), F.col("sequence")).alias("track_key"))
    return project.resolve_positions(credits, tl)


def GRF2_unified_credits(spark, base):
    """Track, positional, main and umbrella credits in one table, counted by source and scope."""
    rta = load(spark, base, "raw_rta")
    a = rta.select("artist_id", "release_id", T.track_key(T.blank_to_null(F.col("track_id")), F.col("release_id"), F.col("track_sequence")).alias("track_key"), F.lit("track").alias("scope"), F.lit("rta").alias("source"))
    ra = _credits(spark, base)
    tracks = T.blank_to_null(F.col("tracks"))
    b = ra.where(tracks.isNull()).select("artist_id", "release_id", F.lit(None).cast("string").alias("track_key"), "scope", F.concat(F.lit("ra_"), "scope").alias("source"))
    got = JN10_positions(spark, base)
    withtracks = ra.where(tracks.isNotNull())
    c = withtracks.select("row_id", "artist_id", "release_id").join(got.select("row_id", "track_key"), "row_id").select("artist_id", "release_id", "track_key", F.lit("track").alias("scope"), F.lit("ra_tracks").alias("source"))
    d = withtracks.join(got.select("row_id").distinct(), "row_id", "left_anti").select("artist_id", "release_id", F.lit(None).cast("string").alias("track_key"), F.lit("umbrella").alias("scope"), F.lit("ra_tracks_unresolved").alias("source"))
    every = a.unionByName(b).unionByName(c).unionByName(d)
    return every.groupBy("source", "scope").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("artist_id").alias("n_artists"), F.count("track_key").alias("n_keys"))


def JN7_unique_names(spark, base):
    v = load(spark, base, "validation_sample")
    a = v.select("artist_id", F.lower(T.clean_name(F.col("name"))).alias("k"))
    b = v.select(F.col("artist_id").alias("other_id"), F.lower(F.trim("realname")).alias("k"))
    return population.unique_name_join(a, b, "k").where("artist_id <> other_id").select("artist_id", "other_id")


def AGG9_name_dictionary(spark, base):
    v = load(spark, base, "validation_sample").where("gender in ('M', 'F') and not is_group")
    d = population.name_dictionary(v.select(F.lower(T.first_token(F.col("name_clean"))).alias("fn"), F.col("gender").alias("label")), 3, 0.9)
    return d.select("fn", "n_f", "n_m", "n", F.round("purity", 9).alias("purity"), "label")


def AGG10_group_labels(spark, base):
    v = load(spark, base, "validation_sample", "artist_id", "gender")
    m = load(spark, base, "raw_ra", "release_id", "artist_id").distinct().join(v, "artist_id").select(F.col("release_id").alias("group_id"), F.col("gender").alias("label"))
    return population.group_composition(m).select("group_id", "n_known", "n_f", "n_members", "label")


def PIP2_cascade(spark, base):
    """Labels of the hand-checked, then of learned first names, then of groups' members, first hit wins."""
    v = load(spark, base, "validation_sample")
    l1 = v.where("label_source in ('wikidata_id', 'hand_checked')").select("artist_id", F.col("gender").alias("label"), F.lit("checked").alias("source"), F.lit(0.98).alias("confidence"))
    d = AGG9_name_dictionary(spark, base).select("fn", F.col("label").alias("label"), "purity")
    fn = v.where("not is_group").select("artist_id", F.lower(T.first_token(F.coalesce(T.blank_to_null(F.col("realname")), F.col("name")))).alias("fn"))
    l2 = fn.join(d, "fn").select("artist_id", "label", F.lit("first_name").alias("source"), (F.col("purity") - 0.1).alias("confidence")).where("confidence >= 0.7")
    l3 = v.where("is_group").select("artist_id", F.col("human_gender").alias("label"), F.lit("members").alias("source"), F.lit(0.85).alias("confidence")).where("label is not null")
    won = population.first_by_priority([l1, l2, l3], "artist_id").drop("level")
    out = v.select("artist_id").join(won, "artist_id", "left")
    return out.select("artist_id", F.coalesce("label", F.lit("unknown")).alias("label"), F.coalesce("source", F.lit("none")).alias("source"), F.round(F.coalesce("confidence", F.lit(0.0)), 9).alias("confidence"))


def AGG8_ambiguous(spark, base):
    v = load(spark, base, "validation_sample")
    return v.groupBy(F.lower("name").alias("k")).agg(F.count_distinct("gender").alias("n_labels"), F.count(F.lit(1)).alias("n")).where("n_labels > 1")


def AGG19_confusion(spark, base):
    v = load(spark, base, "validation_sample").where("human_gender is not null")
    return metrics.confusion(v, "human_gender", "gender", LABELS)


def AGG20_prf(spark, base):
    out = metrics.precision_recall(AGG19_confusion(spark, base))
    return out.select("label", "support", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def AGG21_accuracy(spark, base):
    v = load(spark, base, "validation_sample")
    return metrics.accuracy_by(v, "human_gender", "gender", "label_source").select("label_source", "n", F.round("accuracy", 9).alias("accuracy"), F.round("mean_confidence", 6).alias("mean_confidence"))


def AGG22_thresholds(spark, base):
    v = load(spark, base, "validation_sample").where("human_gender is not null and confidence is not null")
    t = spark.createDataFrame([(x / 100,) for x in range(50, 100, 10)], "threshold double")
    x = v.crossJoin(F.broadcast(t)).where("confidence >= threshold").groupBy("threshold")
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("human_gender") == F.col("gender")).cast("double")), 9).alias("precision"))


def WIN5_confidence_bins(spark, base):
    v = load(spark, base, "validation_sample")
    return v.groupBy(metrics.bins(F.col("confidence"), [0, 0.5, 0.75, 0.9, 1]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def WIN4_quintiles(spark, base):
    v = load(spark, base, "validation_sample", "artist_id", "n_release", "musical_genre")
    return population.rank_quintile(v, "n_release", "artist_id", by=["musical_genre"]).select("artist_id", "musical_genre", "quintile")


def WIN6_ordinals(spark, base):
    t = load(spark, base, "raw_reltracks").select("release_id", "sequence", "position").distinct()
    return t.select("release_id", "sequence", "position", (F.row_number().over(Window.partitionBy("release_id").orderBy("sequence", F.col("position").asc_nulls_last())) - 1).alias("ordinal"))


def ORD2_top_roles(spark, base):
    x = load(spark, base, "raw_ra").select(F.explode(T.split_roles(F.col("role"))).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    return x.orderBy(F.desc("n"), "role").limit(12)


def SET2_known_ids(spark, base):
    a = load(spark, base, "raw_ra", "artist_id").union(load(spark, base, "raw_rta", "artist_id")).distinct()
    return a.where("artist_id is not null")


def SET3_without_profile(spark, base):
    return SET2_known_ids(spark, base).join(load(spark, base, "validation_sample", "artist_id"), "artist_id", "left_anti")


def AGG25_countries(spark, base):
    r = _state(spark, base).where("year between 1900 and 2026")
    d = (F.floor(F.col("year") / 10) * 10).cast("int")
    return r.groupBy(d.alias("decade")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("country") == c).alias(c.lower()) for c in ("Italy", "France", "Germany", "US", "UK")])


def AGG2_cast_sizes(spark, base):
    ra = load(spark, base, "raw_ra")
    return ra.groupBy("release_id").agg(F.count_distinct("artist_id").alias("n_credited"), F.count_distinct(F.when(F.col("extra") == 0, F.col("artist_id"))).alias("n_main"))


def FIL5_filter_credits(spark, base):
    c = _credits(spark, base).withColumn("track_key", F.lit(None).cast("string"))
    sizes = AGG2_cast_sizes(spark, base)
    various = _state(spark, base).where("country is null").select("release_id")
    return project.filter_credits(c, sizes, various, exclude_compilations=True).select("row_id", "artist_id", "release_id", "scope")


def FIL13_non_persons(spark, base):
    v = load(spark, base, "validation_sample")
    place = F.col("name").rlike(r"(?i)^(unknown|various|no) ")
    group = F.col("name").rlike(r"(?i)(^|[^\pL\pN_])(band|quartet|ensemble|orchestra|coro|gruppo)($|[^\pL\pN_])")
    return v.select("artist_id", F.when(place, "placeholder").when(group, "group").otherwise("person").alias("kind"))


def REG10_pooled(spark, base):
    from creditweave.operators.regress import pool_rare

    v = load(spark, base, "validation_sample", "artist_id", "musical_genre")
    return pool_rare(v, "musical_genre", 50, "Altro").groupBy("musical_genre").agg(F.count(F.lit(1)).alias("n"))


def AGG29_sources(spark, base):
    v = load(spark, base, "validation_sample").groupBy("label_source").agg(F.count(F.lit(1)).alias("n"))
    return v.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 9))


def ORD5_stratified_sample(spark, base):
    from creditweave.operators.resample import stratified_sample

    return stratified_sample(load(spark, base, "validation_sample", "artist_id", "gender", "label_source"), "artist_id", ["gender", "label_source"], 200)


QUERIES = {k: f for k, f in globals().items() if callable(f) and k.split("_")[0].rstrip("0123456789") in {"STR", "FIL", "AGG", "DAT", "JN", "GRF", "PIP", "WIN", "ORD", "SET", "REG"}}

_STATE = """
state AS (SELECT release_id, s.year AS year, s.country AS country FROM (
  SELECT release_id, arg_max(struct_pack(year := year, country := country),
    struct_pack(a := loaded_at, b := coalesce(status, ''), c := coalesce(country, ''), d := coalesce(year, -1), e := coalesce(master_id, -1))) AS s
  FROM raw_releases GROUP BY 1))"""
_ROLES = "SELECT trim(x) AS role FROM (SELECT unnest(string_split(regexp_replace(role, '\\[[^\\]]*\\]', '', 'g'), ',')) AS x FROM raw_ra WHERE role IS NOT NULL) WHERE trim(x) <> ''"
_FN = "coalesce(list_filter(regexp_split_to_array(regexp_replace(trim({0}), '^(dr|prof|maestro|mr|mrs|ms|sig|don)\\.?\\s+', '', 'i'), '[\\s.]+'), lambda x: x <> '')[1], '')"
_DICT = f"""
dict AS (SELECT fn, count(*) FILTER (WHERE gender = 'F') AS n_f, count(*) FILTER (WHERE gender = 'M') AS n_m FROM
  (SELECT lower({_FN.format("name_clean")}) AS fn, gender FROM validation_sample WHERE gender IN ('M', 'F') AND NOT is_group) WHERE fn <> '' GROUP BY 1),
named AS (SELECT fn, n_f, n_m, n_f + n_m AS n, round(greatest(n_f, n_m)::double / (n_f + n_m), 9) AS purity, CASE WHEN n_m >= n_f THEN 'M' ELSE 'F' END AS label
  FROM dict WHERE n_f + n_m >= 3 AND greatest(n_f, n_m)::double / (n_f + n_m) >= 0.9::double)"""
_GRID = """
lab AS (SELECT unnest(['F', 'M', 'mixed', 'unknown']) AS l),
conf AS (SELECT a.l AS truth, b.l AS guess, count(v.artist_id) AS n FROM lab a CROSS JOIN lab b
  LEFT JOIN validation_sample v ON v.human_gender = a.l AND v.gender = b.l GROUP BY 1, 2)"""

_PARTS = r"""
tf AS (SELECT row_id, release_id, s, list_filter(list_transform(regexp_split_to_array(s, '\s*(?:,|&|;|/)\s*'), lambda x: trim(x)), lambda x: x <> '') AS parts
  FROM (SELECT row_id, release_id, trim(coalesce(tracks, '')) AS s FROM raw_ra)
  WHERE s <> '' AND NOT (regexp_matches(s, '[A-Za-z]{3,}') AND NOT regexp_full_match(s, '[A-Za-z0-9 ,;&/\-–—]+'))
    AND NOT regexp_matches(s, '\b(all|except|exept|tracks?|tutti|tutte|various|unknown)\b', 'i')),
ends AS (SELECT row_id, release_id, nr, x, regexp_split_to_array(x, '(?i)\s+(?:to|a|-|–|—)\s+') AS e
  FROM (SELECT row_id, release_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS nr FROM tf)),
spec AS (SELECT row_id, release_id, nr, CASE WHEN len(e) = 2 THEN 'RANGE' ELSE 'ONE' END AS kind,
  CASE WHEN len(e) = 2 THEN upper(trim(e[1])) ELSE upper(x) END AS first, CASE WHEN len(e) = 2 THEN upper(trim(e[2])) END AS last FROM ends)"""


def _role_sql() -> str:
    def listed(k: str) -> str:
        return "list_has_any(l, [" + ", ".join("'" + x.lower() + "'" for x in T.ROLE_LISTS[k]) + "])"

    def word(k: str) -> str:
        return r"regexp_matches(t, '\b(" + T.ROLE_WORDS[k] + r")\b', 'i')"

    return f"""
WITH x AS (SELECT CASE WHEN extra = 0 THEN 'main' ELSE 'umbrella' END AS scope,
  list_filter(list_transform(string_split(regexp_replace(coalesce(role, ''), '\\[[^\\]]*\\]', '', 'g'), ','), lambda v: trim(v)), lambda v: v <> '') AS p FROM raw_ra),
y AS (SELECT scope, list_transform(p, lambda v: lower(v)) AS l, array_to_string(p, ' ') AS t, len(p) AS n FROM x)
SELECT scope, CASE WHEN n = 0 THEN CASE WHEN scope = 'main' THEN 'performance' ELSE 'other' END WHEN {listed("creative")} THEN 'creative' WHEN {listed("performance")} THEN 'performance'
  WHEN {word("creative")} THEN 'creative' WHEN {word("performance")} THEN 'performance' WHEN {listed("technical")} OR {word("technical")} THEN 'technical' ELSE 'other' END AS role_class, count(*) AS n FROM y GROUP BY 1, 2"""


_RESOLVED = f"""
WITH {_PARTS},
tk AS (SELECT release_id, sequence, position, coalesce(nullif(trim(track_id), ''), 'S' || release_id::varchar || '_' || sequence::varchar) AS track_key FROM (SELECT DISTINCT release_id, sequence, position, track_id FROM raw_reltracks)),
o AS (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY sequence, track_key) - 1 AS ordinal FROM tk),
posn AS (SELECT release_id, upper(trim(position)) AS position, max(ordinal) AS ordinal FROM o WHERE trim(position) <> '' GROUP BY 1, 2),
got AS (SELECT s.row_id, s.release_id, a.ordinal AS lo, CASE WHEN kind = 'ONE' THEN a.ordinal ELSE b.ordinal END AS hi FROM spec s
  LEFT JOIN posn a ON a.release_id = s.release_id AND a.position = s.first LEFT JOIN posn b ON b.release_id = s.release_id AND b.position = s.last),
ok AS (SELECT row_id FROM got GROUP BY 1 HAVING bool_and(lo IS NOT NULL AND hi IS NOT NULL AND coalesce(lo <= hi, FALSE))),
res AS (SELECT DISTINCT g.row_id, g.release_id, o.track_key FROM got g SEMI JOIN ok USING (row_id) JOIN o ON o.release_id = g.release_id AND o.ordinal BETWEEN g.lo AND g.hi)"""

SQL = {
    "STR6_role_class": _role_sql(),
    "STR7_track_field": f"WITH {_PARTS} SELECT kind, first, last, count(*) AS n FROM spec GROUP BY 1, 2, 3",
    "JN10_positions": _RESOLVED + " SELECT row_id, release_id, track_key FROM res",
    "GRF2_unified_credits": _RESOLVED + """,
every AS (
  SELECT 'rta' AS source, 'track' AS scope, artist_id, coalesce(nullif(trim(track_id), ''), 'S' || release_id::varchar || '_' || coalesce(track_sequence, '?')) AS track_key FROM raw_rta
  UNION ALL SELECT CASE WHEN extra = 0 THEN 'ra_main' ELSE 'ra_umbrella' END, CASE WHEN extra = 0 THEN 'main' ELSE 'umbrella' END, artist_id, NULL FROM raw_ra WHERE tracks IS NULL OR trim(tracks) = ''
  UNION ALL SELECT 'ra_tracks', 'track', artist_id, res.track_key FROM raw_ra JOIN res USING (row_id) WHERE trim(tracks) <> ''
  UNION ALL SELECT 'ra_tracks_unresolved', 'umbrella', artist_id, NULL FROM raw_ra WHERE trim(tracks) <> '' AND row_id NOT IN (SELECT row_id FROM res))
SELECT source, scope, count(*) AS n, count(DISTINCT artist_id) AS n_artists, count(track_key) AS n_keys FROM every GROUP BY 1, 2""",
    "STR1_clean_name": "SELECT artist_id, trim(regexp_replace(name, '\\s*\\(\\d+\\)\\s*$', '')) AS clean FROM validation_sample",
    "STR2_norm": "SELECT artist_id, coalesce(regexp_replace(lower(strip_accents(realname)), '[^a-z0-9]+', '', 'g'), '') AS key FROM validation_sample",
    "STR3_first_token": f"SELECT artist_id, {_FN.format('name_clean')} AS fn FROM validation_sample",
    "STR4_person": r"""
SELECT artist_id, len(w) BETWEEN 2 AND 4 AND len(list_filter(w[1:2], lambda x: length(x) < 2)) = 0
  AND NOT regexp_matches(coalesce(realname, ''), '\b(orchestra|ensemble|quartet|quartetto|trio|quintet|coro|choir|band|gruppo|studio|records|edizioni|orchestre|the |i |gli |le )\b', 'i') AS person
FROM (SELECT artist_id, realname, list_filter(regexp_split_to_array(trim(coalesce(realname, '')), '\s+'), lambda x: x <> '') AS w FROM validation_sample)""",
    "STR5_roles": f"SELECT role, count(*) AS n FROM ({_ROLES}) GROUP BY 1",
    "STR10_track_key": """
SELECT coalesce(nullif(trim(track_id), ''), 'S' || release_id::varchar || '_' || coalesce(track_sequence, '?')) AS track_key, count(*) AS n, count(DISTINCT artist_id) AS n_artists FROM raw_rta GROUP BY 1""",
    "FIL1_population": f"""
WITH {_STATE},
c AS (SELECT artist_id, count(*) FILTER (WHERE country = 'Italy') AS n_it, count(*) AS n_all FROM raw_ra LEFT JOIN state USING (release_id) WHERE artist_id IS NOT NULL GROUP BY 1)
SELECT artist_id, n_it, n_all, round(n_it::double / n_all, 9) AS share FROM c
WHERE n_it >= 1 AND n_all >= 2 AND n_it::double / n_all >= 0.2::double
AND artist_id IN (SELECT artist_id FROM validation_sample WHERE NOT regexp_matches(name, '^various( artists?)?( \\(\\d+\\))?$|^unknown artist|^no artist|^traditional$', 'i'))""",
    "AGG3_activity": f"""
WITH {_STATE}, o AS (SELECT DISTINCT artist_id, release_id FROM raw_ra WHERE artist_id IS NOT NULL),
j AS (SELECT artist_id, s.year, s.country FROM o LEFT JOIN (SELECT * FROM state WHERE year BETWEEN 1900 AND 2026) s USING (release_id))
SELECT artist_id, count(*) AS n_release, count(*) FILTER (WHERE country = 'Italy') AS n_inside, min(year) AS debut_year, max(year) AS last_year, median(year) AS median_year FROM j GROUP BY 1""",
    "DAT1_cohorts": """
SELECT CASE WHEN d >= 1950 THEN d ELSE 1940 END AS cohort_decade, CASE WHEN y < 2000 THEN 'early' WHEN y >= 2000 THEN 'late' END AS era, count(*) AS n, count(*) FILTER (WHERE gender = 'F') AS n_f
FROM (SELECT *, debut_year::int AS y, (floor(debut_year::int / 10) * 10)::int AS d FROM validation_sample) GROUP BY 1, 2""",
    "AGG4_top_tags": """
WITH n AS (SELECT artist_id, role AS tag, count(*) AS n FROM raw_ra WHERE role IS NOT NULL AND trim(role) <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY n DESC, tag) AS rk, sum(n) OVER (PARTITION BY artist_id) AS total FROM n)
SELECT artist_id, max(tag) FILTER (WHERE rk = 1) AS tag_1, max(tag) FILTER (WHERE rk = 2) AS tag_2, round(max(n::double / total) FILTER (WHERE rk = 1), 9) AS share, max(total)::bigint AS n_tags,
  max(n::double / total) FILTER (WHERE rk = 1) < 0.4::double AS weak FROM r WHERE rk <= 2 GROUP BY 1""",
    "JN7_unique_names": r"""
WITH a AS (SELECT artist_id, lower(trim(regexp_replace(name, '\s*\(\d+\)\s*$', ''))) AS k FROM validation_sample),
b AS (SELECT artist_id AS other_id, lower(trim(realname)) AS k FROM validation_sample)
SELECT a.artist_id, b.other_id FROM a JOIN b USING (k) WHERE k <> '' AND a.artist_id <> b.other_id
AND k IN (SELECT k FROM a GROUP BY 1 HAVING count(*) = 1) AND k IN (SELECT k FROM b GROUP BY 1 HAVING count(*) = 1)""",
    "AGG9_name_dictionary": f"WITH {_DICT} SELECT * FROM named",
    "AGG10_group_labels": """
WITH m AS (SELECT DISTINCT release_id, artist_id FROM raw_ra), g AS (SELECT release_id AS group_id, gender AS label FROM m JOIN validation_sample USING (artist_id)),
c AS (SELECT group_id, count(*) FILTER (WHERE label IN ('M', 'F')) AS n_known, count(*) FILTER (WHERE label = 'F') AS n_f, count(*) AS n_members FROM g GROUP BY 1)
SELECT *, CASE WHEN n_known < 2 THEN 'unknown' WHEN n_f > 0 AND n_f < n_known THEN 'mixed' WHEN n_f > 0 THEN 'F' ELSE 'M' END AS label FROM c""",
    "PIP2_cascade": f"""
WITH {_DICT},
lv AS (SELECT artist_id, gender AS label, 'checked' AS source, 0.98::double AS confidence, 0 AS level FROM validation_sample WHERE label_source IN ('wikidata_id', 'hand_checked')
  UNION ALL SELECT artist_id, label, 'first_name', purity - 0.1::double, 1 FROM (SELECT artist_id, lower({_FN.format("coalesce(nullif(trim(realname), ''), name)")}) AS fn FROM validation_sample WHERE NOT is_group) JOIN named USING (fn) WHERE purity - 0.1::double >= 0.7::double
  UNION ALL SELECT artist_id, human_gender, 'members', 0.85::double, 2 FROM validation_sample WHERE is_group AND human_gender IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY level, label) AS rk FROM lv)
SELECT v.artist_id, coalesce(w.label, 'unknown') AS label, coalesce(source, 'none') AS source, round(coalesce(w.confidence, 0::double), 9) AS confidence
FROM validation_sample v LEFT JOIN (SELECT * FROM w WHERE rk = 1) w USING (artist_id)""",
    "AGG8_ambiguous": "SELECT lower(name) AS k, count(DISTINCT gender) AS n_labels, count(*) AS n FROM validation_sample GROUP BY 1 HAVING count(DISTINCT gender) > 1",
    "AGG19_confusion": f"WITH {_GRID} SELECT * FROM conf",
    "AGG20_prf": f"""
WITH {_GRID},
c AS (SELECT l AS label, sum(n) FILTER (WHERE truth = l AND guess = l)::bigint AS tp, sum(n) FILTER (WHERE truth <> l AND guess = l)::bigint AS fp, sum(n) FILTER (WHERE truth = l AND guess <> l)::bigint AS fn FROM lab CROSS JOIN conf GROUP BY 1),
p AS (SELECT label, tp + fn AS support, tp, fp, fn, tp::double / nullif(tp + fp, 0) AS precision, tp::double / nullif(tp + fn, 0) AS recall FROM c),
f AS (SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM p)
SELECT label, support, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f
UNION ALL SELECT 'weighted', sum(support)::bigint, sum(tp)::bigint, sum(fp)::bigint, sum(fn)::bigint, round(sum(coalesce(precision, 0) * support) / sum(support), 9), round(sum(coalesce(recall, 0) * support) / sum(support), 9), round(sum(coalesce(f1, 0) * support) / sum(support), 9) FROM f""",
    "AGG21_accuracy": "SELECT label_source, count(*) AS n, round(avg((human_gender = gender)::int::double), 9) AS accuracy, round(avg(confidence), 6) AS mean_confidence FROM validation_sample WHERE human_gender IS NOT NULL GROUP BY 1",
    "AGG22_thresholds": """
SELECT threshold, count(*) AS n, round(avg((human_gender = gender)::int::double), 9) AS precision FROM validation_sample
CROSS JOIN (SELECT unnest([0.5::double, 0.6::double, 0.7::double, 0.8::double, 0.9::double]) AS threshold) WHERE human_gender IS NOT NULL AND confidence >= threshold GROUP BY 1""",
    "WIN5_confidence_bins": """
SELECT CASE WHEN confidence > 0 AND confidence <= 0.5::double THEN '0-0.5' WHEN confidence > 0.5::double AND confidence <= 0.75::double THEN '0.5-0.75'
  WHEN confidence > 0.75::double AND confidence <= 0.9::double THEN '0.75-0.9' WHEN confidence > 0.9::double AND confidence <= 1 THEN '0.9-1' END AS bin, count(*) AS n FROM validation_sample GROUP BY 1""",
    "WIN4_quintiles": """
SELECT artist_id, musical_genre, greatest(ceil((r - 1) * 5 / greatest(n - 1, 1)), 1)::int AS quintile FROM (
  SELECT artist_id, musical_genre, row_number() OVER (PARTITION BY musical_genre ORDER BY n_release, artist_id) AS r, count(*) OVER (PARTITION BY musical_genre) AS n FROM validation_sample)""",
    "WIN6_ordinals": "SELECT release_id, sequence, position, (row_number() OVER (PARTITION BY release_id ORDER BY sequence, position NULLS LAST) - 1)::int AS ordinal FROM (SELECT DISTINCT release_id, sequence, position FROM raw_reltracks)",
    "ORD2_top_roles": f"SELECT role, count(*) AS n FROM ({_ROLES}) GROUP BY 1 ORDER BY n DESC, role LIMIT 12",
    "SET2_known_ids": "SELECT artist_id FROM raw_ra WHERE artist_id IS NOT NULL UNION SELECT artist_id FROM raw_rta WHERE artist_id IS NOT NULL",
    "SET3_without_profile": "(SELECT artist_id FROM raw_ra WHERE artist_id IS NOT NULL UNION SELECT artist_id FROM raw_rta WHERE artist_id IS NOT NULL) EXCEPT SELECT artist_id FROM validation_sample",
    "AGG25_countries": f"""
WITH {_STATE} SELECT (floor(year / 10) * 10)::int AS decade, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE country = '{c}') AS {c.lower()}" for c in ("Italy", "France", "Germany", "US", "UK"))}
FROM state WHERE year BETWEEN 1900 AND 2026 GROUP BY 1""",
    "AGG2_cast_sizes": "SELECT release_id, count(DISTINCT artist_id) AS n_credited, count(DISTINCT artist_id) FILTER (WHERE extra = 0) AS n_main FROM raw_ra GROUP BY 1",
    "FIL5_filter_credits": f"""
WITH {_STATE}, z AS (SELECT release_id, count(DISTINCT artist_id) AS k, count(DISTINCT artist_id) FILTER (WHERE extra = 0) AS m FROM raw_ra GROUP BY 1)
SELECT row_id, artist_id, release_id, CASE WHEN extra = 0 THEN 'main' ELSE 'umbrella' END AS scope FROM raw_ra JOIN z USING (release_id)
WHERE k <= 8 AND m <= 1 AND release_id NOT IN (SELECT release_id FROM state WHERE country IS NULL)""",
    "FIL13_non_persons": r"""
SELECT artist_id, CASE WHEN regexp_matches(name, '^(unknown|various|no) ', 'i') THEN 'placeholder' WHEN regexp_matches(name, '(^|[^\pL\pN_])(band|quartet|ensemble|orchestra|coro|gruppo)($|[^\pL\pN_])', 'i') THEN 'group' ELSE 'person' END AS kind FROM validation_sample""",
    "REG10_pooled": "SELECT CASE WHEN n >= 50 THEN musical_genre ELSE 'Altro' END AS musical_genre, sum(n)::bigint AS n FROM (SELECT musical_genre, count(*) AS n FROM validation_sample GROUP BY 1) GROUP BY 1",
    "AGG29_sources": "SELECT label_source, count(*) AS n, round(count(*)::double / (SELECT count(*) FROM validation_sample), 9) AS share FROM validation_sample GROUP BY 1",
}
