"""A sample whose shares of several fields follow target proportions.

The rows are counted by the joint category of the fields.  Weights of the joint
categories are fitted to the targets of each field (iterative proportional fitting) and
turned into integer quotas by largest remainder, never more than there are rows; quotas
are then moved between joint categories that differ in one field only, until no such move
brings a field nearer to its own quotas, and fields whose categories miss their minimum get
the missing rows added.  In each joint category the rows with the smallest random keys are
taken.  A target is missed for one of two reasons: the rows are not there, which the
allocation of the field finds at its caps, or the fields exclude each other, which shows in
what was drawn.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHER = "\0other"  # rows whose category has no target
BUCKETS = 1024
ROUNDS = 60


def allocate(weights: np.ndarray, floors: np.ndarray, caps: np.ndarray, total: int) -> np.ndarray:
    """Integer quotas in proportion to ``weights``, at least ``floors`` and at most ``caps``, that sum to ``total`` if the caps allow.

    Quotas at a bound are fixed and the rest is shared again; remainders go to the largest
    fractions, ties to the earlier entry.
    """
    floors = np.minimum(floors, caps)
    quota, free = floors.astype(np.int64), np.ones(len(weights), bool)
    share = np.zeros(len(weights))
    for _ in range(len(weights) + 1):
        left = total - quota[~free].sum()
        w = np.where(free, weights, 0.0)
        if left <= 0 or w.sum() <= 0:
            share = np.where(free, floors, quota).astype(float)
            break
        share = np.where(free, w / w.sum() * left, quota)
        low, high = free & (share < floors), free & (share > caps)
        # fix the side that is violated more, so that the other may come right by itself
        if (share - caps)[high].sum() >= (floors - share)[low].sum() and high.any():
            quota[high], free[high] = caps[high], False
        elif low.any():
            quota[low], free[low] = floors[low], False
        else:
            break
    whole = np.floor(share + 1e-9).astype(np.int64)
    rest = int(total - whole.sum())
    order = np.argsort(-(share - whole), kind="stable")
    for i in order:
        if rest <= 0:
            break
        if whole[i] < caps[i] and free[i]:
            whole[i] += 1
            rest -= 1
    return whole


def refused(asked: np.ndarray, least: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """What the allocation is asked for beyond its caps: the larger of what each entry is to get, not rounded, and its minimum, less what there is."""
    return np.maximum(np.maximum(asked, least) - caps, 0.0)


def settle(cells: pd.DataFrame, fields: list[str], quota: np.ndarray, have: np.ndarray, wanted: dict[str, dict[str, int]]) -> np.ndarray:
    """Moves quotas between joint categories that differ in one field only, from a category above its quota to one below it; the other fields keep their sums."""
    quota = quota.copy()
    moved = True
    while moved:  # each move lowers the distance from the quotas, so this ends
        moved = False
        for f in fields:
            others = [x for x in fields if x != f]
            over = {c: int(quota[cells[f] == c].sum()) - wanted[f].get(c, 0) for c in set(cells[f])}
            for _, at in cells.groupby(others, sort=True).indices.items() if others else [((), np.arange(len(cells)))]:
                kind = cells[f].to_numpy()
                for i in at:
                    for j in at:
                        n = min(over[kind[i]], -over[kind[j]], int(quota[i]), int(have[j] - quota[j]))
                        if n > 0:
                            quota[i] -= n
                            quota[j] += n
                            over[kind[i]] -= n
                            over[kind[j]] += n
                            moved = True
    return quota


def fit_cells(cells: pd.DataFrame, fields: list[str], targets: pd.DataFrame, n: int) -> np.ndarray:
    """Quotas of the joint categories ``cells(<fields>, n)``; ``targets(field_name, category, quota)`` per field."""
    have = cells["n"].to_numpy(float)
    w = have * (n / max(1.0, have.sum()))
    wanted = {f: dict(zip(t["category"], t["quota"])) for f, t in targets.groupby("field_name")}
    index = {f: {c: np.flatnonzero(cells[f].to_numpy() == c) for c in set(cells[f])} for f in fields}
    for _ in range(ROUNDS):
        for f in fields:
            for c, at in index[f].items():
                goal, now = float(wanted.get(f, {}).get(c, 0.0)), w[at].sum()
                if now > 0:
                    w[at] *= goal / now
        w = np.minimum(w, have)
    quota = allocate(w, np.zeros(len(w), np.int64), cells["n"].to_numpy(np.int64), int(min(n, have[w > 0].sum())))
    quota = settle(cells, fields, quota, have, wanted)
    # rows that a rare category still lacks
    for f in fields:
        for c, at in index[f].items():
            lack = int(dict(zip(targets.loc[targets.field_name == f, "category"], targets.loc[targets.field_name == f, "floor"])).get(c, 0)) - quota[at].sum()
            for i in at[np.argsort(-(have[at] - quota[at]), kind="stable")]:
                if lack <= 0:
                    break
                add = int(min(lack, have[i] - quota[i]))
                quota[i] += add
                lack -= add
    return quota


def category_targets(df: DataFrame, targets: DataFrame, fields: list[str], n: int) -> pd.DataFrame:
    """Targets with the rows that there are and the quota of each, one row per row of ``targets``."""
    t = targets.where(F.col("field_name").isin(fields)).toPandas()  # a fixed table of categories
    t["available"] = 0
    for f in fields:
        listed = [c for c in t.loc[t.field_name == f, "category"]]
        got = df.where(F.col(f).isin(listed)).groupBy(f).count().collect()
        have = {r[0]: r[1] for r in got}
        at = t.field_name == f
        t.loc[at, "available"] = [have.get(c, 0) for c in t.loc[at, "category"]]
    t["wanted"] = t["target_share"] * n
    t["floor"] = np.minimum(t["min_rows"], t["available"]).astype(np.int64)
    t["quota"], t["unavailable"] = 0, 0.0
    for f in fields:
        at = (t.field_name == f).to_numpy()
        x = t[at]
        share, caps = x["target_share"].to_numpy(float), x["available"].to_numpy(np.int64)
        t.loc[at, "quota"] = allocate(share, x["floor"].to_numpy(np.int64), caps, n)
        t.loc[at, "unavailable"] = refused(share * n, x["min_rows"].to_numpy(float), caps)
    return t


def sample_size(df: DataFrame, share: float) -> int:
    return int(df.count() * share)


def quota_sample(df: DataFrame, key: str, fields: list[str], targets: DataFrame, share: float = 0.1, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The sample ``(key, *fields)`` and its report, one row per target category.

    ``share`` of the rows is drawn.  Rows with a null category, or one without target, in
    any field belong to no target; they are drawn only if a minimum asks for it.  The
    report has, for each category, the rows available and drawn, ``missing``, the whole rows
    drawn below target or minimum, ``shortfall`` (there are some) and ``reason``: ``not available`` if the
    category has fewer rows than target or minimum (``unavailable`` of them, not rounded),
    else ``fields exclude each other``.  An empty table gives an empty sample and full shortfalls.
    Repeated keys are rows of their own.  The random key of a row depends on ``key`` and
    ``seed`` only; equal keys are drawn in any order.
    """
    spark = df.sparkSession
    n = sample_size(df, share)
    t = category_targets(df, targets, fields, n)
    known = {f: sorted(set(t.loc[t.field_name == f, "category"])) for f in fields}
    cell = [F.when(F.col(f).isin(known[f]), F.col(f)).otherwise(F.lit(OTHER)).alias(f"__{f}") for f in fields]
    rows = df.select(F.col(key), *fields, *cell, F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("__rand"))
    by = [f"__{f}" for f in fields]
    # joint categories are as many as the product of the targets allows
    cells = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(by).reset_index(drop=True)
    cells.columns = [*fields, "n"]
    quota = fit_cells(cells, fields, t, n) if len(cells) else np.zeros(0, np.int64)

    # the bucket of random keys in which a quota ends, so that only rows of that bucket are ranked
    bucket = F.shiftrightunsigned(F.col("__rand"), 64 - BUCKETS.bit_length() + 1).cast("int").alias("__bucket")
    rows = rows.withColumn("__bucket", bucket)
    schema = ", ".join(f"`__{f}` string" for f in fields) + ", __quota long"
    quotas = spark.createDataFrame([(*map(str, c), int(q)) for c, q in zip(cells[fields].itertuples(index=False), quota) if q > 0], schema)
    hist = rows.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__bucket")) - F.col("__n")
    plan = hist.withColumn("__before", before).join(F.broadcast(quotas), by).where("__before < __quota")
    plan = plan.select(*by, "__bucket", (F.col("__quota") - F.col("__before")).alias("__left"), (F.col("__before") + F.col("__n") <= F.col("__quota")).alias("__all"))
    kept = rows.join(F.broadcast(plan), [*by, "__bucket"])  # at most BUCKETS rows per joint category
    rank = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__rand", key))
    edge = kept.where("not __all").withColumn("__rank", rank).where("__rank <= __left").drop("__rank")
    sample = kept.where("__all").unionByName(edge).select(key, *fields)

    got = None
    for f in fields:
        one = sample.groupBy(F.lit(f).alias("field_name"), F.col(f).alias("category")).agg(F.count(F.lit(1)).alias("n_drawn"))
        got = one if got is None else got.unionByName(one)
    base = spark.createDataFrame(
        [(r.field_name, r.category, float(r.target_share), int(r.min_rows), int(r.available), int(r.quota), float(r.unavailable)) for r in t.itertuples()],
        "field_name string, category string, target_share double, min_rows long, available long, quota long, unavailable double",
    )
    drawn = F.coalesce("n_drawn", F.lit(0))
    # a target that is no whole number is met by the whole number below it, a quota of the allocation
    wanted = F.greatest(F.floor(F.col("target_share") * n + 1e-9), F.col("min_rows"))
    missing = F.greatest(F.when(F.col("unavailable") > 0, F.ceil(F.greatest(F.col("target_share") * n, F.col("min_rows").cast("double")) - 1e-9)).otherwise(wanted) - drawn, F.lit(0))
    report = base.join(got, ["field_name", "category"], "left").select(
        *base.columns, drawn.alias("n_drawn"), (drawn / F.lit(max(1, n))).alias("drawn_share"), missing.alias("missing")
    )
    short = (F.col("missing") > 0) | (F.col("unavailable") > 0)
    reason = F.when(F.col("unavailable") > 0, "not available").when(F.col("missing") > 0, "fields exclude each other")
    return sample, report.select("*", short.alias("shortfall"), reason.alias("reason"))
