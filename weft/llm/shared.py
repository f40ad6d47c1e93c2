"""Tables that the operators of this subpackage land in the shared folder, and small helpers."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.session import checkpoint_dir

#: The six ASCII spaces, as a character class for Spark's and DuckDB's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: this cuts the lineage, so that a
    lost executor costs a re-read and not a recomputation.  The folder goes when the session ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/weft-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalised(text: Column) -> Column:
    """Every run of ASCII spaces as one blank; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def in_order(df: DataFrame, *order: Column | str, sums: tuple[str, ...] = (), name: str = "in-order") -> DataFrame:
    """``df``, landed in this order, with ``position`` (from 0) and for each column of ``sums`` (whole numbers) the sum
    ``before_<column>`` over all rows before.

    Rows are range-partitioned by the order and then by a number of their own, so that rows that are alike don't meet
    in one task.  No task sees more than its range, but for a window over one row per partition.
    """
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    rows = land(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    held = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0)).cast("long")
    held = held.select("_part", before("_n").alias("_b_n"), *[before(f"_s_{c}").alias(f"_b_{c}") for c in sums])
    rows = rows.withColumn("_part", part)
    if sums:
        run = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumns({f"_r_{c}": F.coalesce(F.sum(c).over(run), F.lit(0)) for c in sums})
    both = rows.join(held, "_part")
    return both.select(*df.columns, (F.col("_b_n") + inside).alias("position"), *[(F.col(f"_b_{c}") + F.col(f"_r_{c}")).alias(f"before_{c}") for c in sums])


_KEPT: dict[str, object] = {}


def kept(key: str, build: Callable[[], object] = dict):
    """What a Python worker keeps from one task to the next: one thing only, so that when operators follow each
    other in a session their tables don't add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]
