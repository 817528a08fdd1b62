"""Newline-JSON entity dumps: cheap text filter, parse, flatten; whole or in steps that go on where they ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLAIM = "array<struct<mainsnak: struct<datavalue: struct<value: string>>>>"
_ENTITY = f"id string, labels map<string, struct<value: string>>, aliases map<string, array<struct<value: string>>>, claims map<string, {_CLAIM}>"


def _flat(lines: DataFrame, wanted: list[str], properties: dict[str, str], languages: tuple[str, ...]) -> DataFrame:
    keep = F.lit(not wanted)
    for w in wanted:
        keep = keep | F.col("value").contains(w)
    lines = lines.where(F.length("value") > 2).where(keep)
    parsed = lines.select(F.from_json(F.regexp_replace("value", r",\s*$", ""), _ENTITY).alias("e")).where("e.id is not null")

    def joined(values: Column) -> Column:
        return F.array_join(values, "|")

    claims = [joined(F.transform(F.coalesce(F.try_element_at("e.claims", F.lit(p)), F.array().cast(_CLAIM)), lambda c: c["mainsnak"]["datavalue"]["value"])).alias(name) for name, p in properties.items()]
    label = F.coalesce(*[F.col("e.labels")[k]["value"] for k in languages])
    names = F.flatten(F.array(*[F.coalesce(F.transform(F.try_element_at("e.aliases", F.lit(k)), lambda a: a["value"]), F.array().cast("array<string>")) for k in languages]))
    return parsed.select(F.col("e.id").alias("id"), label.alias("label"), joined(F.array_distinct(names)).alias("aliases"), *claims)


def entity_rows(spark: SparkSession, path: str, wanted: list[str], properties: dict[str, str], languages: tuple[str, ...] = ("it", "en")) -> DataFrame:
    """``id, label, aliases`` and a column per property of the entities of a dump of one JSON object a line (commas at line ends allowed), compressed or not.

    Only lines that contain one of ``wanted`` are parsed.  The label is that of the first of
    ``languages`` that has one; aliases of all of them, and all values of a property (``properties`` maps a
    column to it), are joined by "|".  Lines that are no JSON are left out.
    """
    return _flat(spark.read.text(path), wanted, properties, languages)


def ingest_entities(spark: SparkSession, folder: str, target: str, checkpoint: str, wanted: list[str], properties: dict[str, str], languages: tuple[str, ...] = ("it", "en")) -> None:
    """Appends the entities of the files of ``folder`` that no earlier call has read to the table ``target``; progress is kept in ``checkpoint``."""
    out = _flat(spark.readStream.text(folder), wanted, properties, languages)
    out.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start().awaitTermination()
