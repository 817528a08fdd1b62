"""Report figures: one key-value table from many small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def figures(parts: dict[str, DataFrame]) -> DataFrame:
    """``key, value``: every number of one-row results, keys prefixed by the name of the part."""
    out = None
    for name, df in parts.items():
        numbers = [c for c, t in df.dtypes if t in ("int", "bigint", "double")]
        stack = F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("key"), F.col(c).cast("double").alias("value")) for c in numbers]))
        one = df.select(stack.alias("x")).select("x.key", "x.value")
        out = one if out is None else out.unionByName(one)
    return out
