"""Extendible hashing as DataFrame operations: the directory, and the lookup of a row's bucket.

The directory is indexed by the leading bits of a 32-bit hash.  It begins as one bucket; a bucket over its
limit splits on the next bit, and the others stay as they are.  A bucket is therefore the shortest prefix
of the hash under which all rows fit the limit.  The prefixes are taken in rounds of at most 12 bits: a
round sums its up to 4096 cells under each open bucket for all its depths at once, and only the rows of
buckets that are still too full enter the next round.  No round holds more than 4096 rows for a key.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.shared import land

BITS = 32
ROUNDS = ((0, 12), (12, 24), (24, 32))


def hash32(hex_digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")


@dataclass
class Directory:
    """One landed table per round that was needed: cell, depth (null: passed on to the next round)."""

    cells: list[tuple[int, DataFrame]]

    def assign(self, df: DataFrame, h: str) -> DataFrame:
        """``df`` with ``bucket_prefix``, ``bucket_depth`` and ``bucket_fits``."""
        depth = F.lit(None).cast("int")
        for i, (bits, cells) in enumerate(self.cells):
            c = cells.select(F.col("cell").alias(f"_cell{i}"), F.col("depth").alias(f"_depth{i}"))
            df = df.withColumn(f"_cell{i}", F.shiftright(F.col(h), BITS - bits)).join(c, f"_cell{i}", "left")
            depth = F.coalesce(depth, F.col(f"_depth{i}"))
        fits = depth.isNotNull()
        depth = F.coalesce(depth, F.lit(BITS))
        df = df.withColumns({"bucket_depth": depth, "bucket_fits": fits})
        df = df.withColumn("bucket_prefix", F.expr(f"shiftright({h}, {BITS} - bucket_depth)"))
        return df.drop(*[f"_{x}{i}" for i in range(len(self.cells)) for x in ("cell", "depth")])


def build(entries: DataFrame, h: str, size: str, limit: int) -> Directory:
    """The directory over ``entries`` (hash and byte size per row) for buckets of at most ``limit`` bytes.

    A bucket that is still too full at 32 bits holds rows of one hash value; it stays as it is and is marked
    by ``bucket_fits`` = false, for the caller to chain.
    """
    live, out = entries.select(F.col(h).alias("h"), F.col(size).alias("size")), []
    for low, high in ROUNDS:
        sums = live.groupBy(F.shiftright("h", BITS - high).alias("cell")).agg(F.sum("size").alias("size"))
        levels = sums.select("cell", "size", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        held = F.sum("size").over(W.partitionBy("depth", "prefix"))
        first = F.min(F.when(F.col("held") <= limit, F.col("depth")))
        cells = land(levels.withColumn("held", held).groupBy("cell").agg(first.cast("int").alias("depth")), "directory")
        out.append((high, cells))
        full = cells.where("depth is null")
        if high == BITS or full.isEmpty():
            break
        live = live.withColumn("cell", F.shiftright("h", BITS - high)).join(full.select("cell"), "cell", "left_semi").drop("cell")
    return Directory(out)
