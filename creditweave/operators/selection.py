"""Entries that are no persons, guards of size, and unions of sources that may be absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and beginnings of names that stand for groups and firms.
NO_PERSON = (
    r"\b(orchestr\w*|orquesta\w*|orchester\w*|orkester|philharmoni\w*|filarm\w*|symphon\w*|sinfon\w*|ensemble|band|banda\s+(?:de|di|del|della|dei|municipal)|trio|quartet\w*|cuarteto|quatuor|"
    r"kvartett|quintet\w*|sextet\w*|sestetto|coro|corale|choir|chor|choeur|chœur|kör|singers|cantori|brothers|bröderna|fratelli|hermanos|frères|gebrüder|"
    r"sisters|sorelle|hermanas|schwestern|records|recordings|discos|disques|schallplatten|edizioni|ediciones|éditions|editions|verlag|förlag|studios?|"
    r"design|productions?|produzioni|producciones|crew|collective|collettivo|company|complesso|conjunto|gruppo|grupo|groupe|gruppe|group)\b"
    r"|\b(e la sua|e il suo|y su|et son|et ses|und sein|und ihr|and his|and her|& his|& her|och hans|och hennes)\b"
    r"|^(the|i|gli|los|las|les|die)\s"
)
# Names that stand in for several artists.
PLACEHOLDER = (
    r"^(aa\.?\s?vv\.?|a\.\s?a\.\s?v\.\s?v\.?|autori vari|artisti vari|vari|varios(\s+artistas)?|various(\s+artists)?|divers(\s+artistes)?|"
    r"verschiedene(\s+interpreten)?|diverse(\s+artister)?|v\.\s?a\.?)(\s*\(\d+\))?$"
)


def _whole_words(pattern: str) -> str:
    """A pattern whose words end at anything but a letter, digit or underscore of any script; joiners and other hidden signs end them too."""
    return "(?iu)" + pattern.replace(r"\b(", r"(?<![\pL\pN_])(").replace(r")\b", r")(?![\pL\pN_])").replace(r"\w", r"[\pL\pN_]")


def no_person(name: Column) -> Column:
    """``placeholder`` or ``marker`` for names of no person, null for others and for null."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return F.when(n.rlike(_whole_words(PLACEHOLDER)), "placeholder").when(n.rlike(_whole_words(NO_PERSON)), "marker")


def large_enough(edges: DataFrame, by: list[str], least_nodes: int = 100, least_edges: int = 200) -> DataFrame:
    """``by, n_nodes, n_edges`` of the parts of ``edges(u, v)`` that have enough of both to be estimated."""
    e = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("n_edges"))
    n = edges.select(*by, F.explode(F.array("u", "v")).alias("node")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.join(e, by).where((F.col("n_nodes") >= least_nodes) & (F.col("n_edges") >= least_edges)).select(*by, "n_nodes", "n_edges")


def union_sources(first: DataFrame, others: list[DataFrame], key: list[str]) -> DataFrame:
    """All rows of the sources, columns that one lacks null, one row per ``key``: of equal keys any."""
    out = first
    for o in others:
        out = out.unionByName(o, allowMissingColumns=True)
    return out.dropDuplicates(key)


def accumulated(rows: DataFrame, key: str, value: str, sign: str = "|") -> DataFrame:
    """``key, values``: the distinct values of each key in order, joined by a sign."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(value)), sign).alias("values"))
