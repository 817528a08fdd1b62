"""Loading of the named Parquet tables of one directory.

A table is a single Parquet file or a directory of part files; both are read lazily and
Catalyst prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def path_of(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """Scan of one table, restricted to ``columns`` if any are given."""
    df = spark.read.parquet(path_of(base, name))
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, asked of the file system that serves it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty one of the same schema if it is absent."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
