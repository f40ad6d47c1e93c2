"""Packing rows into model requests, and putting the answers back.

``pack`` assigns ``(bucket, batch_no, item_id)`` to every row.

* ``mode='bucketed'`` (default, for scale): rows are hashed by key into
  ``n_buckets`` buckets and numbered by key inside each bucket.  One shuffle;
  buckets are balanced because keys are unique row keys; at most one short pack
  per bucket; the same pending rows always give the same packs.
* ``mode='ordered'``: consecutive runs of the global key order, as the original
  tool does. Computed without a single-partition window: the keys alone are
  range-partitioned, sorted and landed once (so the boundaries are fixed), the rows
  counted per partition give each partition its offset, and the rank, offset + position,
  is joined back by key.  Keys must be unique.

``collect_packs`` then groups each pack into one request row. Its grouping
keys contain the bucket, so it reuses the window's hash partitioning (no
second shuffle).  Groups are bounded by ``size``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


BATCH_SHIFT = 1 << 32


def bucket_expr(key: str, n_buckets: int, dtype: T.DataType, how: str = "hash", width: int = 64) -> Column:
    """Bucket of a row key.

    ``how='hash'`` (default): ``pmod(xxhash64(key), n)`` - even for patterned keys.
    ``how='div'``: ``key div width`` for integral keys, which plain SQL can recompute
    (used where an independent SQL check must know each pack's members); it grows with the keys.
    """
    if how == "div" and isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.pmod(F.expr(f"`{key}` div {width}"), F.lit((1 << 31) - 1)).cast("int")
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n_buckets)).cast("int")


#: Input bytes for a bucket, and for a partition of the ordered mode; a source of unknown size counts as so much.
BUCKET_BYTES, RANGE_BYTES, UNKNOWN_BYTES = 1 << 20, 32 << 20, 1 << 30


def input_bytes(df: DataFrame) -> int:
    """Size of the sources that ``df`` reads, as the planner knows it; nothing is run.

    It follows from the files alone: the same rows give the same packs in any session."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(s if s < 1 << 60 else UNKNOWN_BYTES for s in sizes)


def default_buckets(df: DataFrame, each: int = BUCKET_BYTES) -> int:
    """A bucket for every MB of input. Each bucket may end in one short pack: tying the count to
    the input keeps packs full on small inputs, and gives a large input as many small window tasks as it needs."""
    return max(1, min(-(-input_bytes(df) // each), 1 << 30))


def pack(df: DataFrame, key: str, size: int, mode: str = "bucketed", n_buckets: int | None = None,
         split_by: str | None = None, bucket_fn: str = "hash", bucket_width: int = 64) -> DataFrame:
    """Add ``bucket`` (int), ``batch_no`` (bigint), ``batch_id`` (bigint) and ``item_id`` (int, 1-based).

    ``split_by`` names a boolean column; rows of each value are packed separately
    (used to keep rows with nothing to send out of real packs without a second scan).
    """
    if size < 1:
        raise ValueError("pack size must be >= 1")
    if mode == "bucketed":
        n = n_buckets or (1 if bucket_fn == "div" else default_buckets(df))
        b = df.withColumn("bucket", bucket_expr(key, n, df.schema[key].dataType, bucket_fn, bucket_width))
        parts = ["bucket"] + ([split_by] if split_by else [])
        rn = F.row_number().over(Window.partitionBy(*parts).orderBy(F.col(key))) - 1
        out = b.withColumn("_rank", rn.cast("long"))
    elif mode == "ordered":
        out = _global_rank(df, key, split_by=split_by).withColumn("bucket", F.lit(0))
    else:
        raise ValueError(f"unknown pack mode {mode!r}")
    return (
        out.withColumn("batch_no", F.floor(F.col("_rank") / F.lit(size)).cast("long"))
        .withColumn("item_id", (F.col("_rank") % F.lit(size) + 1).cast("int"))
        .withColumn("batch_id", (F.col("bucket").cast("long") * F.lit(BATCH_SHIFT) + F.col("batch_no")).cast("long"))
        .drop("_rank")
    )


def _global_rank(df: DataFrame, key: str, n_parts: int | None = None, split_by: str | None = None) -> DataFrame:
    """0-based rank by ``key`` over the whole frame (within each ``split_by`` value), computed partition-parallel."""
    from .inference import land

    grp = F.coalesce(F.col(split_by).cast("int"), F.lit(0)) if split_by else F.lit(0)
    keys = df.select(F.col(key).alias("_key"), grp.alias("_grp"))
    ranged = keys.repartitionByRange(n_parts or default_buckets(df, RANGE_BYTES), "_grp", "_key").sortWithinPartitions("_grp", "_key")
    # range partitioning samples: landed, so that a recomputation can't move rows
    ranged = land(ranged.select("_key", "_grp", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_at")), "ranked-keys")
    counts = ranged.groupBy("_grp", "_pid").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.sum("n").over(Window.partitionBy("_grp").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_grp", "_pid", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    ranks = ranged.join(offsets, ["_grp", "_pid"]).select("_key", (F.col("_before") + F.col("_at") - F.col("_first")).cast("long").alias("_rank"))
    return df.join(ranks, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def collect_packs(packed: DataFrame, payload: Sequence[str | Column], carry: Sequence[str] | None = None,
                  by: Sequence[str] = ("bucket", "batch_no")) -> DataFrame:
    """One row per pack: ``<by>, batch_id, n_items, items`` with
    ``items = array<struct<item_id, <payload fields>, row: struct<carry...>>>`` sorted by item_id."""
    fields = [F.col("item_id")] + [F.col(p) if isinstance(p, str) else p for p in payload]
    if carry:
        fields.append(F.struct(*[F.col(c) for c in carry]).alias("row"))
    return (
        packed.groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
        .withColumn("batch_id", (F.col("bucket").cast("long") * F.lit(BATCH_SHIFT) + F.col("batch_no")).cast("long"))
        .withColumn("n_items", F.size("items").cast("int"))
    )


def chunk(df: DataFrame, key: str, size: int = 100, mode: str = "ordered", n_buckets: int | None = None,
          bucket_fn: str = "hash", bucket_width: int = 64) -> DataFrame:
    """``chunk_id``: runs of ``size`` rows (the checkpoint unit of the original tool)."""
    p = pack(df, key, size, mode=mode, n_buckets=n_buckets, bucket_fn=bucket_fn, bucket_width=bucket_width)
    return p.withColumnRenamed("batch_id", "chunk_id").drop("item_id", "batch_no", "bucket")
