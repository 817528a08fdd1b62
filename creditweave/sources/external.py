"""Tables from databases, CSV files and SQLite files, and the settings of a run."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Database:
    """Where a database is and how its sessions begin; the password comes from the environment variable ``secret``."""

    url: str
    driver: str | None = None
    user: str | None = None
    secret: str | None = None
    statement: str | None = None
    fetch: int = 10_000

    def options(self) -> dict[str, str]:
        known = {"url": self.url, "driver": self.driver, "user": self.user, "password": os.environ.get(self.secret) if self.secret else None, "sessionInitStatement": self.statement, "fetchsize": str(self.fetch)}
        return {k: v for k, v in known.items() if v}


def read_query(spark: SparkSession, db: Database, query: str) -> DataFrame:
    """The result of a query that the database runs."""
    return spark.read.format("jdbc").options(**db.options()).option("query", query).load()


def read_ranges(spark: SparkSession, db: Database, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A table in ``parts`` ranges of a numeric key, read side by side; keys outside low and high belong to the outer ranges."""
    return spark.read.format("jdbc").options(**db.options()).options(dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None) -> DataFrame:
    """Columns of CSV files with a header, by a declared schema; rows that do not fit it stop the read."""
    df = spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False).csv(path)
    return df.select(*columns) if columns else df


def write_query(df: DataFrame, path: str) -> None:
    """A result as CSV files with a header, each task writing its part."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, filled: list[str] | None = None, parts: int = 8) -> DataFrame:
    """A table of a SQLite file that all executors can open, in ranges of its row numbers; rows whose ``filled`` columns are blank stay in the file."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    cols = ", ".join(f'"{c}"' for c in names)
    cond = "".join(f""" and trim(coalesce("{c}", '')) <> ''""" for c in filled or [])
    with sqlite3.connect(path) as con:
        low, high = con.execute(f'select min(rowid), max(rowid) from "{table}"').fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    step = -(-(high - low + 1) // parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(path) as con:
            for b in batches:
                for i in b["id"]:
                    at = low + int(i) * step
                    yield from pd.read_sql_query(f'select {cols} from "{table}" where rowid >= {at} and rowid < {at + step}{cond}', con, chunksize=50_000)

    return spark.range(parts).repartition(parts).mapInPandas(run, schema)


@dataclass(frozen=True)
class Settings:
    """Parameters of a run, in the one place that operators are given them from."""

    population: dict = field(default_factory=lambda: {"least_in": 2, "least_all": 3, "least_share": 0.5})
    network: dict = field(default_factory=lambda: {"most": 8, "per_track": 1.0, "per_release": 1.0})
    nulls: dict = field(default_factory=lambda: {"least": 30, "replicas": 1000})


def load_settings(path: str) -> Settings:
    """Settings of a JSON or YAML file over the defaults; unknown groups are refused."""
    with open(path, encoding="utf8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            got = yaml.safe_load(f) or {}
        else:
            got = json.load(f)
    known = Settings()
    if unknown := set(got) - set(vars(known)):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**{k: {**v, **got.get(k, {})} for k, v in vars(known).items()})
