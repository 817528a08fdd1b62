"""Per-key results over keys of which a few hold most of the rows.

Every input split keeps dense accumulator arrays of its own: keys are encoded as
(block, offset) by a dictionary of the key blocks met in the split, and
``numpy.bincount`` adds each row into the array slot of its key.  A split therefore sends
one array (or, where few slots of a block are used, one list of slots) per block and never
a row per record; blocks of the same range are then added up by a distributed reduction.
The work of a task depends on the size of its split, not on how often a key occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys per block: 2**BLOCK_BITS array slots.
BLOCK_BITS = 10
HELD_BLOCKS = 4096  # blocks that a split holds before it sends them on; bounds its memory where keys are scattered
SCATTERED = 64  # array slots per row of a batch beyond which the batch is counted by its distinct keys, which the split adds up too
HELD_KEYS = 500_000  # distinct scattered keys that a split holds before it sends them on
SPARSE_BELOW = 4  # a block with fewer used slots than 1/SPARSE_BELOW is sent as a slot list

_PARTIAL = "field_name string, block long, slots binary, sums binary"


def _accumulate(fields: list[str], measures: list[str]):
    width = 1 << BLOCK_BITS
    n = 1 + len(measures)

    def emit(state: dict[str, dict[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for f in fields:
            for b, arr in state[f].items():
                used = np.flatnonzero(arr[0])
                if len(used) * SPARSE_BELOW < width:
                    out.append((f, b, used.astype(np.uint16).tobytes(), np.ascontiguousarray(arr[:, used]).tobytes()))
                else:
                    out.append((f, b, b"", arr.tobytes()))
                if len(out) >= 2000:
                    yield _partial(out)
                    out = []
            state[f] = {}
        if out:
            yield _partial(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, dict[int, np.ndarray]] = {f: {} for f in fields}
        apart: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {f: [] for f in fields}
        for batch in batches:
            got = {m: batch.column(batch.schema.get_field_index(m)).fill_null(0).to_numpy(zero_copy_only=False) for m in measures}
            for f in fields:
                col = batch.column(batch.schema.get_field_index(f))
                keys = col.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                if not len(keys):
                    continue
                there = col.is_valid().to_numpy(zero_copy_only=False) if col.null_count else None
                blocks, code = np.unique(keys >> BLOCK_BITS, return_inverse=True)  # the split's dictionary
                if len(blocks) * width > SCATTERED * len(keys):
                    apart[f].append(_distinct(keys, [got[m] if there is None else got[m][there] for m in measures]))
                    if sum(len(k) for k, _ in apart[f]) > HELD_KEYS:
                        apart[f] = [_added(apart[f])]
                        if len(apart[f][0][0]) > HELD_KEYS // 2:
                            yield _scattered(f, *apart[f].pop())
                    continue
                slot = code * width + (keys & (width - 1))
                size = len(blocks) * width
                sums = np.empty((n, size), np.int64)
                sums[0] = np.bincount(slot, minlength=size)
                for i, m in enumerate(measures, 1):
                    w = got[m] if there is None else got[m][there]
                    sums[i] = np.rint(np.bincount(slot, weights=w, minlength=size)).astype(np.int64)
                sums = sums.reshape(n, len(blocks), width)
                known = state[f]
                for j, b in enumerate(blocks.tolist()):
                    if b in known:
                        known[b] += sums[:, j]
                    else:
                        known[b] = sums[:, j].copy()
            if sum(map(len, state.values())) > HELD_BLOCKS:
                yield from emit(state)
        yield from emit(state)
        for f in fields:
            if apart[f]:
                yield _scattered(f, *_added(apart[f]))

    return run


def _distinct(keys: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their rows and weights added up."""
    own, code = np.unique(keys, return_inverse=True)
    return own, np.stack([np.bincount(code), *(np.rint(np.bincount(code, weights=w)) for w in weights)]).astype(np.int64)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    own, code = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    sums = np.zeros((parts[0][1].shape[0], len(own)), np.int64)
    np.add.at(sums, (slice(None), code), np.concatenate([s for _, s in parts], axis=1))
    return own, sums


def _scattered(field: str, own: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Keys that lie too far apart for arrays, as slot lists."""
    blocks, first = np.unique(own >> BLOCK_BITS, return_index=True)
    ends = [*first[1:].tolist(), len(own)]
    slots = (own & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
    return _partial([(field, b, slots[i:j].tobytes(), np.ascontiguousarray(sums[:, i:j]).tobytes()) for b, i, j in zip(blocks.tolist(), first.tolist(), ends)])


def _partial(rows: list[tuple]) -> pa.RecordBatch:
    names = ["field_name", "block", "slots", "sums"]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _reduce(n: int, names: list[str]):
    """Adds up the parts of each block; a partition is sorted by block, so one block is held at a time."""
    width = 1 << BLOCK_BITS

    def rows(key: tuple[str, int], acc: np.ndarray) -> list[pa.Array]:
        used = np.flatnonzero(acc[0])
        return [pa.array([key[0]] * len(used), pa.string()), pa.array((key[1] << BLOCK_BITS) + used, pa.int64()), *(pa.array(acc[i, used]) for i in range(n))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, acc = None, np.zeros((n, width), np.int64)
        done: list[list[pa.Array]] = []
        for batch in batches:
            for f, b, slots, sums in zip(*(c.to_pylist() for c in batch.columns)):
                if (f, b) != now:
                    if now is not None:
                        done.append(rows(now, acc))
                        acc[:] = 0
                    now = (f, b)
                    if len(done) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*done)], names)
                        done = []
                if slots:
                    used = np.frombuffer(slots, np.uint16)
                    acc[:, used] += np.frombuffer(sums, np.int64).reshape(n, len(used))
                else:
                    acc += np.frombuffer(sums, np.int64).reshape(n, width)
        if now is not None:
            done.append(rows(now, acc))
        if done:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*done)], names)

    return run


def keyed_counts(rows: DataFrame, fields: list[str], measures: dict[str, F.Column] | None = None) -> DataFrame:
    """One row per field and key: ``field_name, key_id, n_rows`` and a sum for each measure.

    ``fields`` are integer columns of ``rows``; each is counted on its own in the same pass.
    ``measures`` are integer expressions whose sums stay below 2**53.
    Rows whose key is null belong to no key and are left out of that field; null measures
    count as 0; an empty table gives no rows; repeated rows count as often as they occur.
    Other columns are never read.
    """
    measures = measures or {}
    marks = [f"__m{i}" for i in range(len(measures))]
    narrow = rows.select(*[F.col(f).cast("long").alias(f) for f in fields], *[e.cast("double").alias(m) for m, e in zip(marks, measures.values())])
    parts = narrow.mapInArrow(_accumulate(fields, marks), _PARTIAL)
    names = ["field_name", "key_id", "n_rows", *measures]
    schema = "field_name string, key_id long, " + ", ".join(f"`{c}` long" for c in names[2:])
    blocks = parts.repartition("field_name", "block").sortWithinPartitions("field_name", "block")
    return blocks.mapInArrow(_reduce(1 + len(marks), names), schema)


def heavy_keys(rows: DataFrame, fields: list[str], share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows of the table (rows with null keys included in the total)."""
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    counts = keyed_counts(rows, fields)
    return counts.join(F.broadcast(total), F.col("n_rows") >= F.lit(share) * F.col("__total")).select("field_name", "key_id", "n_rows")
