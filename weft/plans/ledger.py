"""A ledger of paid answers: a request that was answered once, in any run or table, is not sent again.

The ledger is an external Parquet table of requests (a hash of the model's name and the prompt) with their answers, bucketed
and sorted by the request, so that looking requests up moves them and never the ledger; each file has Parquet's Bloom filter
of its requests.  Answers are appended by the task that asked, as it ends: a run that is killed keeps what it paid for.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inference import RESPONSE_T, call_model
from ..streaming.incremental import PER_TASK
from .enrich import EnrichSpec, read_answers, with_prompts

_FIELDS = tuple(f.split()[0] for f in RESPONSE_T.split(", "))


@dataclass(frozen=True)
class Ledger:
    """``buckets`` is fixed when the ledger is first written; ``model`` names whose answers these are."""

    path: str
    model: str = "default"
    buckets: int = 64

    def table(self, spark: SparkSession) -> str:
        """The name under which this session knows the ledger's files."""
        name = f"weft_ledger_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"
        options = PER_TASK | {"parquet.bloom.filter.enabled#request": "true"}
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} (request string, {RESPONSE_T}) USING parquet
            OPTIONS ({", ".join(f"'{k}' '{v}'" for k, v in options.items())})
            CLUSTERED BY (request) SORTED BY (request) INTO {self.buckets} BUCKETS LOCATION '{self.path}'""")
        spark.catalog.refreshTable(name)
        return name

    def request(self, prompt: str = "_prompt"):
        return F.sha2(F.concat_ws("\n", F.lit(self.model), F.col(prompt)), 256)

    def answers(self, spark: SparkSession) -> DataFrame:
        """(request, answer): one row per request that was ever sent; an answer is kept before any error, then the latest."""
        rows = spark.table(self.table(spark)).select("request", F.struct(*_FIELDS).alias("answer"))
        return rows.groupBy("request").agg(F.max_by("answer", F.struct(F.col("answer.text").isNotNull(), "answer.called_at")).alias("answer"))


def unpaid(asked: DataFrame, ledger: Ledger) -> DataFrame:
    """(request, _prompt): the distinct requests of ``asked`` that the ledger has no answer to, dealt as its buckets are."""
    wanted = asked.where(F.col("_prompt").isNotNull()).select(ledger.request().alias("request"), "_prompt")
    wanted = wanted.repartition(ledger.buckets, "request").dropDuplicates(["request"])
    paid = ledger.answers(asked.sparkSession).where(F.col("answer.text").isNotNull()).select("request")
    return wanted.join(paid, "request", "left_anti")


def enrich_with_ledger(df: DataFrame, spec: EnrichSpec, ledger: Ledger) -> DataFrame:
    """``enrich`` for requests of a row each: only what the ledger has no answer to is sent, each distinct request once.

    Failed requests are noted with their errors and are sent again by the next run.  Use only with a backend whose answers may
    stand for any equal request."""
    if spec.pack_size > 1:
        raise ValueError("the ledger keeps requests of a row each: pack_size must be 1")
    spark, cols = df.sparkSession, df.columns
    asked = with_prompts(df, spec)
    calls = call_model(unpaid(asked, ledger), spec.backend, "_prompt", policy=spec.policy, out="_resp")
    # the insert is the single action over the calls; a task writes the buckets that it was dealt
    calls.select("request", "_resp.*").write.insertInto(ledger.table(spark))
    keyed = asked.withColumn("_request", F.when(F.col("_prompt").isNotNull(), ledger.request()))
    known = ledger.answers(spark).select(F.col("request").alias("_request"), F.col("answer").alias("_resp"))
    answered = keyed.join(known, "_request", "left").select(*cols, "_resp", F.col("_prompt").isNotNull().alias("_sent"))
    return read_answers(answered, spec, cols)
