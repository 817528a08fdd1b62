"""References to records that do not exist, by bitmap difference.

Keys are divided by hash into ranges of bounded size.  Each split of the references encodes
the keys that it holds of a range as integers, by a dictionary of its own, and sets one bit
per key and period, so a key that holds a third of the rows is one bit of each split and
period.  What is shuffled is one block per split and range: the compressed dictionary and
the compressed bitmaps.  In a range the dictionaries are united and the bitmaps added by OR;
the parents of the range give one bitmap per period, of the keys present before the period
began.  ``reference AND NOT parent`` leaves the keys to report.  Surviving bits are decoded.

The rows behind them are found by a bitmap of fixed size over the hashes of the surviving
(key, period): what it lets through, the rows to report and a few others, is joined with
the decoded keys, where a parent that arrives within the period itself is compared by time
stamp.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.session import cut

#: References per range of keys, on average; rows that a split holds before it sends blocks; bits of the row filter (8 MB).
RANGE_ROWS, HELD_ROWS, FILTER_BITS = 200_000, 1_000_000, 1 << 26
_SURVIVOR = "key {kind}, period int, first_seen timestamp_ntz"
_BLOCK = "rng int, n_keys int, keys binary, periods binary, bits binary"
NEVER, ALWAYS = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def pack_keys(keys: pa.Array) -> bytes:
    """Compressed dictionary: differences of sorted integers, or lengths and bytes of sorted texts."""
    if pa.types.is_integer(keys.type):
        return zlib.compress(np.diff(keys.to_numpy(), prepend=0).astype(np.int64).tobytes(), 1)
    size = pc.binary_length(keys).to_numpy().astype(np.uint32)
    return zlib.compress(size.tobytes() + b"".join(keys.cast(pa.binary()).to_pylist()), 1)


def unpack_keys(blob: bytes, n: int, text: bool) -> pa.Array:
    raw = zlib.decompress(blob)
    if not text:
        return pa.array(np.cumsum(np.frombuffer(raw, np.int64)))
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint32, n))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[4 * n :])])


def pack_bits(codes: np.ndarray, rows: np.ndarray, shape: tuple[int, int]) -> bytes:
    """Compressed bitmaps, one per period: bit ``codes[i]`` of bitmap ``rows[i]`` is set."""
    bits = np.zeros(shape, bool)
    bits[rows, codes] = True
    return zlib.compress(np.packbits(bits, axis=1).tobytes(), 1)


def unpack_bits(blob: bytes, shape: tuple[int, int]) -> np.ndarray:
    packed = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(shape[0], -1)
    return np.unpackbits(packed, axis=1, count=shape[1]).astype(bool)


def _blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    rng, period = t.column("rng").to_numpy(), t.column("period").to_numpy()
    coded = t.column("key").combine_chunks().dictionary_encode()
    code, keys = coded.indices.to_numpy(), coded.dictionary
    of = np.empty(len(keys), np.int32)
    of[code] = rng
    periods, p = np.unique(period, return_inverse=True)
    code, p = np.divmod(np.unique(code.astype(np.int64) * len(periods) + p), len(periods))
    # the dictionary of each range in order
    order = pc.sort_indices(pa.table({"r": of, "k": keys}), sort_keys=[("r", "ascending"), ("k", "ascending")]).to_numpy()
    keys, of = keys.take(pa.array(order)), of[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[code]
    by = np.argsort(at, kind="stable")
    at, p = at[by], p[by]
    ranges, first = np.unique(of, return_index=True)
    ends = [*first[1:].tolist(), len(of)]
    out: list[list] = [[], [], [], [], []]
    for r, i, j in zip(ranges.tolist(), first.tolist(), ends):
        lo, hi = np.searchsorted(at, [i, j])
        mine, row = np.unique(p[lo:hi], return_inverse=True)
        block = (r, j - i, pack_keys(keys.slice(i, j - i)), periods[mine].astype(np.int32).tobytes(), pack_bits(at[lo:hi] - i, row, (len(mine), j - i)))
        for c, x in zip(out, block):
            c.append(x)
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["rng", "n_keys", "keys", "periods", "bits"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= HELD_ROWS:
            yield _blocks(held)
            held, n = [], 0
    if n:
        yield _blocks(held)


def _difference(text: bool):
    def run(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
        kind = object if text else np.int64
        if not len(refs):
            return pd.DataFrame({"key": np.array([], kind), "period": np.array([], np.int32), "first_seen": pd.Series([], dtype="datetime64[us]")})
        own = [unpack_keys(k, n, text) for k, n in zip(refs["keys"], refs["n_keys"])]
        united = pa.chunked_array(own).combine_chunks().dictionary_encode()
        keys, size = united.dictionary, len(united.dictionary)
        when = [np.frombuffer(p, np.int32) for p in refs["periods"]]
        periods = np.unique(np.concatenate(when))
        referred = np.zeros((len(periods), size), bool)
        start, codes = 0, united.indices.to_numpy()
        for k, p, b in zip(own, when, refs["bits"]):
            at = codes[start : start + len(k)]
            start += len(k)
            referred[np.ix_(np.searchsorted(periods, p), at)] |= unpack_bits(b, (len(p), len(k)))
        # parents by the same dictionary; others are never referred to
        at = pc.index_in(pa.array(parents["key"], keys.type), value_set=keys).fill_null(-1).to_numpy() if len(parents) else np.array([], int)
        met = at >= 0
        since, seen = np.full(size, NEVER, np.int64), np.full(size, NEVER, np.int64)
        np.minimum.at(since, at[met], parents["since"].to_numpy(np.int64)[met])
        stamp = parents["first_seen"].to_numpy("datetime64[us]")
        np.minimum.at(seen, at[met], np.where(np.isnat(stamp), ALWAYS, stamp.astype(np.int64))[met])
        present = np.packbits(since[None, :] < periods[:, None], axis=1)
        left = np.packbits(referred, axis=1) & ~present
        row, bit = np.nonzero(np.unpackbits(left, axis=1, count=size))
        stamp = np.where((seen == NEVER) | (seen == ALWAYS), np.datetime64("NaT"), seen.astype("datetime64[us]"))
        return pd.DataFrame({"key": np.asarray(keys.take(pa.array(bit)).to_pylist(), kind), "period": periods[row].astype(np.int32), "first_seen": stamp[bit]})

    return run


def month_number(ts: F.Column) -> F.Column:
    """Months since year 0; null for null."""
    return F.year(ts) * 12 + F.month(ts) - 1


def orphan_rows(refs: DataFrame, parents: DataFrame, ref_table: str, ranges: int | None = None) -> DataFrame:
    """Rows of ``refs(row_id, key, loaded_at)`` whose key leads nowhere at the time of the row.

    ``parents(key, first_seen)`` has the keys that exist: a deleted parent is left out of it
    by the caller; of several rows of a key the earliest counts.  A reference is an orphan if
    its key is not there or if ``first_seen`` is after the row's ``loaded_at``.  Result:
    ``ref_table, load_month (yyyy-MM), row_id``.  Keys are long integers or texts.

    Null keys refer to nothing and give no row.  A row without ``loaded_at`` has no
    period: it is reported with a null month only if its key is not there at all.  A parent
    without ``first_seen`` counts as always there.  Repeated rows are judged one by one.
    """
    ranges = ranges or max(refs.sparkSession.sparkContext.defaultParallelism, -(-refs.count() // RANGE_ROWS))
    kind = dict(refs.dtypes)["key"]
    of = F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int")
    r = refs.select("row_id", "key", F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at")).where(F.col("key").isNotNull())
    # no period: after every parent
    r = r.withColumn("period", F.coalesce(month_number(F.col("loaded_at")), F.lit(2_000_000)).cast("int"))
    blocks = r.select(of.alias("rng"), "key", "period").mapInArrow(_encode, _BLOCK)
    # a key is surely there in all periods after the one it came in
    p = parents.where(F.col("key").isNotNull()).select(
        of.alias("rng"), "key", F.coalesce(month_number(F.col("first_seen")), F.lit(-1)).cast("long").alias("since"), F.col("first_seen").cast("timestamp_ntz").alias("first_seen")
    )
    left = cut(blocks.groupBy("rng").cogroup(p.groupBy("rng")).applyInPandas(_difference(kind == "string"), _SURVIVOR.format(kind=kind)))
    place = F.pmod(F.xxhash64("key", "period"), F.lit(FILTER_BITS)) + 1
    bits = left.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    r = r.withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("at", F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    r = r.join(F.broadcast(bits), "bucket").where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1)  # FILTER_BITS bits at most
    left = left.withColumnRenamed("key", "__key").withColumnRenamed("period", "__period")
    hit = r.join(left, (F.col("key") == F.col("__key")) & (F.col("period") == F.col("__period")))
    hit = hit.where(F.col("first_seen").isNull() | (F.col("first_seen") > F.col("loaded_at")))
    return hit.select(F.lit(ref_table).alias("ref_table"), F.date_format("loaded_at", "yyyy-MM").alias("load_month"), "row_id")


def current_releases(releases: DataFrame) -> DataFrame:
    """``key, first_seen`` of the releases whose latest row is not deleted (blanks and case ignored)."""
    last = F.max_by(F.coalesce(F.upper(F.trim("status")), F.lit("")), F.struct("loaded_at", "status"))
    one = releases.groupBy(F.col("release_id").alias("key")).agg(F.min("loaded_at").alias("first_seen"), last.alias("status"))
    return one.where(F.col("status") != "DELETED").select("key", "first_seen")


def track_key(col: str) -> F.Column:
    """Track id without blanks at the ends and without case; null if nothing is left."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""))), F.lit(""))


def known_tracks(reltracks: DataFrame) -> DataFrame:
    """``key, first_seen`` of the track ids of the track lists, a row per listing."""
    return reltracks.select(track_key("track_id").alias("key"), F.col("loaded_at").alias("first_seen")).where("key is not null")
