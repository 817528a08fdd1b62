"""Mixing sources to target weights.

Each source gets a number of copies per document, ``target_share x T / tokens of the
source`` and at most ``max_repeats``, with T the tokens of all documents.  The whole part
is copied; the rest is a probability per document that is rounded to 0 or 1 by pivotal
rounding: two documents trade probability until one of them is decided, so the number of
copies (and, as neighbours in a block are of like size, the tokens) of a source stay where
they should be.  Blocks of documents are rounded in parallel; each leaves at most one
undecided document, and these are rounded together block by block in further levels until
one is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.session import cut

#: Documents of a block, at the first and at each further level.
BLOCK = 20_000


def capacities(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: tokens there are, tokens wanted, copies per document and whether the target is out of reach.

    ``docs(source, n_tokens)``; ``targets(source, target_share, max_repeats)``.  T counts all
    documents, those of null or unlisted sources too.  A source without documents has 0.
    """
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    per = cut(per)  # one row per source; the token counts behind it are made once
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    have = F.coalesce("tokens", F.lit(0))
    wanted = F.col("target_share") * F.col("total")
    copies = F.when(have > 0, F.least(wanted / have, F.col("max_repeats").cast("double"))).otherwise(0.0)
    return (
        targets.select("source", "target_share", "max_repeats")
        .join(per, "source", "left")
        .crossJoin(F.broadcast(total))
        .select("source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), have.alias("tokens"), "total", wanted.alias("wanted"), copies.alias("copies"))
        .withColumn("short", F.col("tokens") * F.col("max_repeats") < F.col("wanted"))
    )


def pivotal(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds probabilities in order; all become 0 or 1 but at most one, whose value is what is left over.

    Each step takes the undecided entry and the next one: with sum s < 1 one of them gets
    all of it, else one becomes 1 and the other s - 1, with chances that keep the mean.
    """
    out = p.astype(float).copy()
    draws = rng.random(len(p))
    at = -1
    eps = 1e-12
    for i in range(len(out)):
        b = out[i]
        if b <= eps or b >= 1 - eps:
            out[i] = round(b)
            continue
        if at < 0:
            at = i
            continue
        a = out[at]
        s = a + b
        if s < 1 - eps:
            if draws[i] * s < a:
                out[at], out[i] = s, 0.0
            else:
                out[at], out[i] = 0.0, s
                at = i
        elif s > 1 + eps:
            if draws[i] * (2 - s) < 1 - b:
                out[at], out[i] = 1.0, s - 1
                at = i
            else:
                out[at], out[i] = s - 1, 1.0
        else:
            first = draws[i] < a
            out[at], out[i] = (1.0, 0.0) if first else (0.0, 1.0)
            at = -1
    return out


def _round_block(seed: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "id"], kind="stable").reset_index(drop=True)
        key = f"{seed}|{rows['source'].iloc[0]}|{rows['block'].iloc[0]}|{len(rows)}".encode()
        rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big"))
        p = pivotal(rows["p"].to_numpy(float), rng)
        if last:  # what is left over of a source is drawn once
            p = np.where((p > 0) & (p < 1), (rng.random(len(p)) < p).astype(float), p)
        return rows.assign(p=p)

    return run


_ROW = "id long, source string, n_tokens long, whole int, p double, block long"


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = 29, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(id_col, source, n_tokens, copies)`` of the documents used, and the report per source.

    ``docs(id_col, source, n_tokens)``.  Documents whose source is null or has no target, and
    documents without tokens, are not used.  No document gets more than ``max_repeats`` copies.
    Where the source is too small, each of its documents is used ``max_repeats`` times and
    the report says by how much the target is missed.  The others keep their amounts, so the
    mix is smaller than the corpus: ``share_of_mix`` is what a source has in the mix,
    ``reached_share`` its taken tokens over the tokens of all documents.  Repeated ids are documents of their own.
    """
    docs = docs.select(F.col(id_col).alias("id"), "source", "n_tokens")
    caps = capacities(docs, targets)
    use = docs.where("n_tokens > 0").join(F.broadcast(caps.select("source", "copies")), "source")  # one row per target source
    whole = F.floor(F.col("copies") + 1e-9).cast("int")
    use = use.select("id", "source", "n_tokens", whole.alias("whole"), F.greatest(F.col("copies") - whole, F.lit(0.0)).alias("p"))
    most = caps.agg(F.max("n_docs")).first()[0] or 0
    blocks = max(1, -(-most // block))
    done = use.where("p <= 1e-12").withColumn("p", F.lit(0.0))
    open_ = use.where("p > 1e-12").withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)))
    while True:
        last = blocks == 1
        rounded = cut(open_.groupBy("source", "block").applyInPandas(_round_block(seed, last), _ROW))
        done = done.unionByName(rounded.where("p < 1e-12 or p > 1 - 1e-12").drop("block"))
        if last:
            break
        # a block leaves one document at most, so the next level has a block for each BLOCK blocks
        blocks = -(-blocks // block)
        open_ = rounded.where("p >= 1e-12 and p <= 1 - 1e-12").withColumn("block", F.pmod(F.xxhash64("block", F.lit(seed + 1)), F.lit(blocks)))
    copies = (F.col("whole") + F.round("p").cast("int")).alias("copies")
    used = done.select(F.col("id").alias(id_col), "source", "n_tokens", copies).where("copies > 0")
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most_copies"))
    got = cut(got)  # one row per source
    mixed = got.agg(F.coalesce(F.sum("taken"), F.lit(0)).alias("mixed"))
    report = caps.join(got, "source", "left").crossJoin(F.broadcast(mixed)).select(
        "source",
        "target_share",
        "max_repeats",
        "n_docs",
        "tokens",
        "short",
        F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.try_divide(F.coalesce("taken", F.lit(0)), F.col("mixed")), F.lit(0.0)).alias("share_of_mix"),
        F.coalesce(F.try_divide(F.coalesce("taken", F.lit(0)), F.col("total")), F.lit(0.0)).alias("reached_share"),
    )
    return used, report
