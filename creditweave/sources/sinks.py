"""Writing: checkpointed tables, tables for papers, status and timings, export packages with manifest and checksums."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweave.sources.tables import exists

#: Bytes of a table's Parquet files from which its CSV is compressed; rows likewise.
GZIP_BYTES, GZIP_ROWS = 20_000_000, 1_000_000


def save_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``; made and written only if it is not there whole, or if forced."""
    if force or not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON texts, for formats without them."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def export(tables: dict[str, DataFrame], base: str, gzip_rows: int = GZIP_ROWS, gzip_bytes: int = GZIP_BYTES) -> DataFrame:
    """Each table as Parquet and CSV below ``base``; returns ``table, rows, columns``.

    CSV is compressed if the table has ``gzip_rows`` rows or its Parquet files ``gzip_bytes`` bytes.
    """
    spark = next(iter(tables.values())).sparkSession
    stats = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/parquet/{name}")
        back = spark.read.parquet(f"{base}/parquet/{name}")
        n, size = back.count(), _bytes(spark, f"{base}/parquet/{name}")
        flat(back).write.mode("overwrite").option("header", True).option("compression", "gzip" if n >= gzip_rows or size >= gzip_bytes else "none").csv(f"{base}/csv/{name}")
        stats.append((name, n, len(back.columns)))
    return spark.createDataFrame(stats, "table string, rows long, columns int")


def _bytes(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def with_bytes(stats: DataFrame, base: str) -> DataFrame:
    """What ``export`` returned, with the bytes of each table's Parquet and CSV files."""
    spark = stats.sparkSession
    rows = [(*r, _bytes(spark, f"{base}/parquet/{r['table']}"), _bytes(spark, f"{base}/csv/{r['table']}")) for r in stats.collect()]  # a row per table
    return spark.createDataFrame(rows, "table string, rows long, columns int, parquet_bytes long, csv_bytes long")


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """``path, bytes, sha256`` of the files below ``base``; each file is read whole in one task, so part files should stay below 2 GB."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def column_dictionary(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """Table, column and type of every column."""
    return [(t, c, k) for t, df in tables.items() for c, k in df.dtypes]


def write_manifest(stats: DataFrame, columns: list[tuple[str, str, str]], files: DataFrame, folder: str) -> None:
    """``manifest.csv``, ``MANIFEST.md`` and ``checksums.sha256`` of an export in a local folder: a row per table, column and file."""
    os.makedirs(folder, exist_ok=True)
    rows = stats.orderBy("table").collect()  # a row per table
    with open(f"{folder}/manifest.csv", "w", encoding="utf8", newline="") as f:
        out = csv.writer(f)
        out.writerow(stats.columns)
        out.writerows(rows)
    with open(f"{folder}/MANIFEST.md", "w", encoding="utf8") as f:
        f.write("| " + " | ".join(stats.columns) + " |\n" + "|-" * len(stats.columns) + "|\n")
        f.writelines("| " + " | ".join(map(str, r)) + " |\n" for r in rows)
        f.write("\n| table | column | type |\n|-|-|-|\n")
        f.writelines(f"| {t} | {c} | {k} |\n" for t, c, k in columns)
    with open(f"{folder}/checksums.sha256", "w", encoding="utf8") as f:
        f.writelines(f"{r['sha256']}  {r['path']}\n" for r in files.orderBy("path").toLocalIterator())


_LATEX = str.maketrans({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"})


def save_table(df: DataFrame, path: str, caption: str, most_rows: int = 10_000, digits: int = 4) -> None:
    """A small table as ``path.csv`` and ``path.tex``; larger ones than ``most_rows`` are refused."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows; use export")
    text = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    with open(f"{path}.csv", "w", encoding="utf8", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(["" if v is None else v for v in r] for r in rows)
    kinds = "".join("r" if t in ("int", "bigint", "double") else "l" for _, t in df.dtypes)
    with open(f"{path}.tex", "w", encoding="utf8") as f:
        f.write("\\begin{table}\n\\caption{" + caption.translate(_LATEX) + "}\n\\begin{tabular}{" + kinds + "}\n\\hline\n")
        for r in [df.columns, *rows]:
            f.write(" & ".join(text(v).translate(_LATEX) for v in r) + " \\\\\n" + ("\\hline\n" if r is df.columns else ""))
        f.write("\\hline\n\\end{tabular}\n\\end{table}\n")


def write_status(path: str, status: dict) -> None:
    """A status as JSON, replaced as a whole."""
    with open(f"{path}.new", "w", encoding="utf8") as f:
        json.dump(status, f, ensure_ascii=False, indent=1, default=str)
    os.replace(f"{path}.new", path)


def read_status(path: str) -> dict:
    """The status at ``path``; empty if there is none."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf8") as f:
        return json.load(f)


def log_timings(path: str, timings: dict[str, float]) -> None:
    """Appends steps and seconds to a CSV log."""
    new = not os.path.exists(path)
    with open(path, "a", encoding="utf8", newline="") as f:
        out = csv.writer(f)
        if new:
            out.writerow(["step", "seconds"])
        out.writerows([k, round(v, 3)] for k, v in timings.items())
