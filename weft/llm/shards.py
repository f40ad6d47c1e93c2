"""Operator 1: sharding by extendible hashing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm import extendible
from weft.llm.shared import land, table

SHARD_BYTES = 256 << 10


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES, carry: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id (the key), size (UTF-8 bytes of the text), shard, depth, shard_rows, shard_bytes,
    and with ``carry`` the whole row as the struct ``row``.

    The shard is the shortest prefix of the bits of md5(key) whose rows fit ``limit`` bytes, written as bits
    (the empty string when all rows fit one shard).  Null texts have size 0 and a null key hashes as the
    empty string.  Repeated rows share a hash, so splitting can't part them: when such rows alone exceed the
    limit, their bucket is chained, ``<bits>.<input partition>.<n>``, each link holding at most ``limit`` bytes.
    A single text over the limit is a shard by itself.  An empty table has no rows.
    """
    rows = df.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("size"),
        extendible.hash32(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("h"),
        F.spark_partition_id().alias("part"),
        *[F.struct(*[F.col(c) for c in df.columns]).alias("row")] * carry,
    )
    rows = land(rows, "shard-rows")
    out = ["doc_id", "size", "shard", "depth", *["row"] * carry]
    placed = extendible.build(rows, "h", "size", limit).assign(rows, "h").withColumnRenamed("bucket_depth", "depth")
    placed = placed.withColumn("shard", F.expr("if(depth = 0, '', lpad(bin(bucket_prefix), depth, '0'))"))
    placed = land(placed, "shard-placed")  # looked up once, and read by the sums, the chains and the result
    # Links of a chain: rows over half the limit stand alone; the others are cut wherever their running sum
    # passes a multiple of half the limit, so that a link holds less than half plus one row.
    half = max(limit // 2, 1)
    alone = F.col("size") > half
    w = W.partitionBy("shard", "part").orderBy("doc_id", "size")
    run = F.sum(F.when(alone, 0).otherwise(F.col("size"))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    link = F.when(alone, F.concat(F.lit("x"), F.row_number().over(w).cast("string"))).otherwise(F.floor(run / half).cast("string"))
    over = placed.where("not bucket_fits").withColumn("link", link)
    over = over.withColumn("shard", F.concat_ws(".", "shard", F.col("part").cast("string"), "link"))
    every = placed.where("bucket_fits").select(*out).unionByName(over.select(*out))
    sums = every.groupBy("shard").agg(F.count("*").alias("shard_rows"), F.sum("size").alias("shard_bytes"))
    return every.join(sums, "shard").select(*out, "shard_rows", "shard_bytes")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> None:
    """Write ``df`` as Parquet, one folder ``_shard=s<bits>`` per shard."""
    found = assign_shards(df, key, text, limit, carry=True).select("row.*", F.concat(F.lit("s"), "shard").alias("_shard"))
    found.repartition("_shard").write.partitionBy("_shard").parquet(path)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def shards_sql(limit: int = SHARD_BYTES) -> str:
    """The buckets by definition: for each row the shortest prefix whose rows fit (no chains: unique keys, and no text over the limit)."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
levels AS (SELECT g AS depth, h >> (32 - g) AS prefix, sum(size)::BIGINT AS held, count(*) AS n
           FROM d, range(0, 33) r(g) GROUP BY ALL),
leaf AS (SELECT doc_id, size, min(l.depth) AS depth, h FROM d JOIN levels l ON l.prefix = (h >> (32 - l.depth))
         WHERE held <= {limit} GROUP BY doc_id, size, h)
SELECT doc_id, size, CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(bin(h >> (32 - leaf.depth)), leaf.depth::INT, '0') END AS shard,
       leaf.depth::INT AS depth, n AS shard_rows, held AS shard_bytes
FROM leaf JOIN levels l ON l.depth = leaf.depth AND l.prefix = (h >> (32 - leaf.depth))
"""
