"""Operator 4: exact deduplication over an extendible-hash index on shared files (DataFrame functions only)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm import extendible
from weft.llm.shared import land, normalised, table

#: Bytes of distinct texts that the owner of a bucket compares, and the parts in which copies are combined before that.
BUCKET_BYTES, SALTS = 2 << 20, 8


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, key_hex: int = 16) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Two texts are equal when they are the same bytes once each run of ASCII spaces is one blank; a null text
    counts as empty.  The smallest doc_id of a group stays; null ids come last.  Repeated rows (same id and
    text) count in ``group_size`` and are all marked as kept, since nothing tells them apart; ``drop_copies``
    leaves one of them.  An empty table has no rows.

    The rows' keys (id, digest, size) are landed once, and the extendible directory is built over the distinct digests: a
    bucket is split until its texts fit ``bucket_bytes``.  Copies are combined by key and text in ``SALTS`` parts, so that a text
    that a third of all rows hold arrives as that many rows; these are dealt to the owners of their buckets.  An owner
    chains the texts of one key in their order and compares each with the one before it, byte by byte: equal ones are one
    link, which is a group.  The links are landed as the index, and each row looks up its own.  ``key_hex`` shortens the
    hash key, for tests of the chaining.
    """
    norm = normalised(F.col(text))
    rows = df.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"))
    entries = rows.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").cast("long").alias("size"))
    entries = land(entries, "dedup-entries")
    distinct = entries.groupBy("sha").agg(F.max("size").alias("size"))
    directory = extendible.build(distinct.select(extendible.hash32(F.hex("sha")).alias("h"), "size"), "h", "size", bucket_bytes)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    held = rows.groupBy(salt, F.sha2("norm", 256).alias("hex"), "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    held = directory.assign(held.withColumn("h", extendible.hash32(F.col("hex"))), "h").withColumn("key", F.substring("hex", 1, key_hex))
    owned = held.select("bucket_prefix", "bucket_depth", "key", "hex", "norm", "keep_id", "group_size").repartition("bucket_prefix", "bucket_depth")
    chain = W.partitionBy("bucket_prefix", "bucket_depth", "key").orderBy("norm")
    owned = owned.withColumn("differs", F.coalesce(F.col("norm") != F.lag("norm").over(chain), F.lit(True)).cast("int"))
    owned = owned.withColumn("link", F.sum("differs").over(chain.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("norm")
    groups = owned.groupBy("bucket_prefix", "bucket_depth", "key", "link").agg(F.unhex(F.first("hex")).alias("sha"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    index = land(groups.select("sha", "keep_id", "group_size", F.expr("if(bucket_depth = 0, '', lpad(bin(bucket_prefix), bucket_depth, '0'))").alias("bucket")), "dedup-index")
    return entries.join(index, "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket")


def drop_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row per group of equal texts, in its own columns."""
    kept = exact_groups(df, doc_id, text).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    own = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.col(doc_id).alias("_own"), F.sha2(normalised(F.col(text)), 256).alias("_own_sha"))
    both = own.join(kept, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_sha") == F.col("_sha")))
    one = both.withColumn("_n", F.row_number().over(W.partitionBy("_own", "_own_sha").orderBy(F.xxhash64("_row"))))
    return one.where("_n = 1").select("_row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("bucket")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
