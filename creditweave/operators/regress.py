"""Linear regression by sufficient statistics, with HC3 errors, and tests without a statistics library."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.functions.maths import normal_p as p_of
from creditweave.operators.rank import group_rank
from creditweave.session import cut


def normal_p(z: float) -> float:
    """Two-sided p-value of a normal statistic."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_p(x: float, k: int) -> float:
    """Upper tail of chi-square with k degrees of freedom, by the incomplete gamma function."""
    a, y = k / 2, x / 2
    if y <= 0:
        return 1.0
    scale = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= y / n
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - scale * total)
    b, c, d = y + 1 - a, 1e300, 1 / (y + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b if abs(an * d + b) > 1e-300 else 1e-300)
        c = b + an / c if abs(b + an / c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def pool_rare(df: DataFrame, column: str, least: int, other: str = "Other") -> DataFrame:
    """Levels of fewer than ``least`` rows become ``other``."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(n, column, "left").withColumn(column, F.when(F.col("__n") >= least, F.col(column)).otherwise(other)).drop("__n")


def dummies(df: DataFrame, column: str, reference: str | None = None, most_levels: int = 200) -> tuple[DataFrame, list[str]]:
    """0/1 columns of all levels but the reference, the smallest one by default; more than ``most_levels`` are refused, pool rare ones first."""
    levels = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most_levels + 1).collect())
    if len(levels) > most_levels:
        raise ValueError(f"{column} has more than {most_levels} levels")
    base = reference if reference in levels else levels[0] if levels else None
    names = []
    for v in levels:
        if v != base:
            df = df.withColumn(f"{column}[{v}]", (F.col(column) == v).cast("double"))
            names.append(f"{column}[{v}]")
    return df, names


def ols(df: DataFrame, y: str, terms: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], int]:
    """Coefficients and HC3 covariance of y on an intercept and ``terms``.

    X'X and X'y are one aggregate; leverages and the meat of the covariance a second one.
    Only matrices of the size of the model come to the driver.
    """
    names = ["intercept", *terms]
    k = len(names)
    x = cut(df.select(F.array(F.lit(1.0), *[F.col(f"`{t}`").cast("double") for t in terms]).alias("x"), F.col(y).cast("double").alias("y")).where("y is not null and not exists(x, v -> v is null)"))

    def gram(batches):
        import pandas as pd

        total, n = np.zeros((k, k + 1)), 0
        for pdf in batches:
            m = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, k))
            total += m.T @ np.column_stack([m, pdf["y"].to_numpy()]) if len(pdf) else 0
            n += len(pdf)
        yield pd.DataFrame({"g": [total.ravel().tolist()], "n": [n]})

    parts = x.mapInPandas(gram, "g array<double>, n long").collect()  # a matrix per task
    n = sum(r["n"] for r in parts)
    g = sum((np.array(r["g"]).reshape(k, k + 1) for r in parts), np.zeros((k, k + 1)))
    inv = np.linalg.pinv(g[:, :k])
    beta = inv @ g[:, k]

    def meat(batches):
        import pandas as pd

        total = np.zeros((k, k))
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["x"].to_numpy())
                e = pdf["y"].to_numpy() - m @ beta
                lever = np.einsum("ij,jk,ik->i", m, inv, m)
                s = e / np.maximum(1 - lever, 1e-12)
                total += (m * (s * s)[:, None]).T @ m
        yield pd.DataFrame({"g": [total.ravel().tolist()]})

    middle = sum((np.array(r["g"]).reshape(k, k) for r in x.mapInPandas(meat, "g array<double>").collect()), np.zeros((k, k)))
    return beta, inv @ middle @ inv, names, n


def ols_table(df: DataFrame, y: str, terms: list[str]) -> DataFrame:
    """``term, coef, se, z, p, lo, hi, n`` of a regression with HC3 errors."""
    beta, cov, names, n = ols(df, y, terms)
    rows = []
    for i, t in enumerate(names):
        s = math.sqrt(max(cov[i, i], 0.0))
        z = float(beta[i] / s) if s > 0 else None
        rows.append((t, float(beta[i]), s, z, normal_p(z) if z is not None else None, float(beta[i] - 1.96 * s), float(beta[i] + 1.96 * s), n))
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, p double, lo double, hi double, n long")


def wald(beta: np.ndarray, cov: np.ndarray, which: list[int]) -> tuple[float, int, float]:
    """Joint test that the coefficients ``which`` are 0: statistic, degrees of freedom, p-value."""
    b, v = beta[which], cov[np.ix_(which, which)]
    stat = float(b @ np.linalg.pinv(v) @ b)
    return stat, len(which), chi2_p(stat, len(which))


def stratified_shuffle(df: DataFrame, key: str, label: str, by: list[str], seed: int) -> DataFrame:
    """``label`` of the rows dealt out anew within each stratum, by hash of key and seed; counts of each stratum stay."""
    a = group_rank(df, by, [key], "__at", "__n").drop("__n", label)
    b = group_rank(df.select(*by, key, label), by, [F.xxhash64(F.lit(seed), key), key], "__j", "__n")
    names = [f"__b{k}" for k in range(len(by))]
    b = b.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(label), "__j")
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)]
    return a.join(b, [F.col("__at") == F.col("__j"), *on]).drop("__at", "__j", *names)


def permuted_coefficient(df: DataFrame, y: str, x: str, terms: list[str], strata: list[str], binned: str, key: str, permutations: int = 2000, bins: int = 5, seed: int = 31, most_rows: int = 2_000_000) -> DataFrame:
    """``coef, p, n, n_strata, permutations``: coefficient of ``x`` beside ``terms`` and its two-sided p when x is permuted within strata.

    Strata are ``strata`` and the quintile of ``binned``.  Once y and x are freed of the other terms, a
    permuted coefficient needs the sums of permuted x with y's residual and with the terms
    only, and these are sums over strata; so strata are permuted side by side, and of each a
    table of ``permutations`` x terms comes back.  ``most_rows`` bounds a stratum, which one task holds.
    """
    from creditweave.operators.population import rank_quintile

    names = [*terms]
    d = cut(rank_quintile(df, binned, key, bins).select(F.array(F.lit(1.0), *[F.col(f"`{t}`").cast("double") for t in names]).alias("z"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), F.concat_ws("|", *strata, "quintile").alias("stratum")).where("y is not null and x is not null and not exists(z, v -> v is null)"))
    if (big := d.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > most_rows:
        raise ValueError(f"a stratum of {big} rows; refine the strata")
    k = len(names) + 1

    def gram(batches):
        import pandas as pd

        total, n = np.zeros((k, k + 2)), 0
        for pdf in batches:
            if len(pdf):
                z = np.stack(pdf["z"].to_numpy())
                total += z.T @ np.column_stack([z, pdf["y"].to_numpy(), pdf["x"].to_numpy()])
                n += len(pdf)
        yield pd.DataFrame({"g": [total.ravel().tolist()], "n": [n]})

    parts = d.mapInPandas(gram, "g array<double>, n long").collect()  # a matrix per task
    g = sum((np.array(r["g"]).reshape(k, k + 2) for r in parts), np.zeros((k, k + 2)))
    n = sum(r["n"] for r in parts)
    inv = np.linalg.pinv(g[:, :k])
    fit = inv @ g[:, k]

    def permute(pdf):
        import hashlib

        import pandas as pd

        pdf = pdf.assign(__h=[tuple(v) for v in pdf["z"]]).sort_values(["__h", "y", "x"])  # an order that does not depend on tasks
        z, v = np.stack(pdf["z"].to_numpy()), pdf["x"].to_numpy()
        rest = np.column_stack([pdf["y"].to_numpy() - z @ fit, z])
        rng = np.random.default_rng((seed, int(hashlib.blake2b(str(pdf["stratum"].iloc[0]).encode(), digest_size=7).hexdigest(), 16)))
        sums = np.stack([v @ rest, *(rng.permutation(v) @ rest for _ in range(permutations))])
        return pd.DataFrame({"s": [sums.ravel().tolist()], "q": [float(v @ v)]})

    got = d.groupBy("stratum").applyInPandas(permute, "s array<double>, q double")
    total = got.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy().reshape(permutations + 1, k + 1) if n else np.zeros((1, k + 1))  # permutations x terms
    strata_n, q = got.agg(F.count(F.lit(1)), F.coalesce(F.sum("q"), F.lit(0.0))).first()
    free = q - np.einsum("ij,jk,ik->i", total[:, 1:], inv, total[:, 1:])
    coef = np.where(free > 1e-12, total[:, 0] / np.where(free > 1e-12, free, 1), np.nan)
    drawn = coef[1:]
    p = float((1 + np.sum(np.abs(drawn - np.nanmean(drawn)) >= abs(coef[0] - np.nanmean(drawn)))) / (permutations + 1)) if n else None
    return df.sparkSession.createDataFrame([(float(coef[0]) if n else None, p, n, strata_n, permutations)], "coef double, p double, n long, n_strata long, permutations int")


def difference_test(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """z and two-sided p of the difference of coefficients of two fits, term by term."""
    x = a.select(*on, F.col("coef").alias("c1"), F.col("se").alias("s1")).join(b.select(*on, F.col("coef").alias("c2"), F.col("se").alias("s2")), on)
    z = F.try_divide(F.col("c2") - F.col("c1"), F.sqrt(F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2")))

    return x.withColumn("z", z).withColumn("p", p_of("z"))
