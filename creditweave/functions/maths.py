"""Numeric and coding functions over columns."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def log_count(n: Column) -> Column:
    """Log of a count of at least 1."""
    return F.ln(F.greatest(n, F.lit(1)))


def log_rank(x: Column, scale: float = 1e6) -> Column:
    """Log of a small share, 0 at 0."""
    return F.log1p(x * scale)


def log2_clipped(a: Column, b: Column, most: float = 3.0) -> Column:
    """log2 of a / b within +-most; null where either is not positive."""
    return F.when((a > 0) & (b > 0), F.greatest(F.least(F.log2(a / b), F.lit(most)), F.lit(-most)))


def expit(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log1p_exp(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


@F.arrow_udf(DoubleType())
def normal_p(z: pa.Array) -> pa.Array:
    """Two-sided p-value of a normal statistic; null for null."""
    return pa.array([None if x is None else math.erfc(abs(x) / math.sqrt(2)) for x in z.to_pylist()], pa.float64())


def coded(c: Column, codes: dict[str, str], other: str = "other") -> Column:
    """What stands for a code, blanks and case ignored; ``other`` for null and unknown codes."""
    out = F.lit(other)
    key = F.lower(F.trim(c))
    for k, v in codes.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def suffix_of(term: Column) -> Column:
    """Letters after the last point of a term's name; null without."""
    return F.nullif(F.regexp_extract(term, r"\.([A-Za-z]+)$", 1), F.lit(""))


def valid_id(c: Column, most: int = 2**31 - 1) -> Column:
    """A text of digits as a number from 1 to ``most``; null for anything else."""
    n = F.when(c.rlike(r"^\s*[0-9]{1,18}\s*$"), F.trim(c).try_cast("long"))
    return F.when(n.between(1, most), n)


def listed(c: Column, sign: str = "|") -> Column:
    """Values of a delimited list without blanks at their ends, empty ones dropped; null for null."""
    return F.filter(F.transform(F.split(c, rf"\{sign}"), lambda x: F.trim(x)), lambda x: x != "")
