"""One enrichment run from a file to a file: the programmatic entry point.

load -> drop rows already answered (state, or the table's own results) -> enrich, each task's answers appended to the state
as the task ends -> ask error rows again -> write the whole input with the merged answers -> report.  A run that
breaks off is started again: it asks only for what the state lacks, and its output holds every row of the input.
What is an error is told by the status, and by words in the text only for results that came with the table.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import pending
from ..operators.columns import require_columns
from ..operators.quality import is_error
from ..session import state_path as named_state
from ..sources.readers import load
from ..sources.sinks import write_result
from ..streaming.incremental import _asked, check_keys, finalize_state, latest_status, load_state, resume, save_state
from .enrich import EnrichSpec, enrich


@dataclass(frozen=True)
class EnrichJob:
    input_path: str
    output_path: str
    spec: EnrichSpec
    state_path: str | None = None     # without one, the answers are kept in the checkpoint folder under a new name
    output_format: str = "parquet"
    retry_errors: bool = True
    run_id: str = "run"
    commit_rows: int = 1000           # rows of a task, about: what a crash can lose of each task under way


_RESULTS = (fixed.RESULT_COLUMN, "result")


def _own_answer(data: DataFrame) -> Column:
    """The answer that a row came with: not empty, and without an error marker; else null."""
    if fixed.RESULT_COLUMN not in data.columns:
        return F.lit(None).cast("string")
    return F.when(~pending(fixed.RESULT_COLUMN) & ~is_error(fixed.RESULT_COLUMN, "retry"), F.col(fixed.RESULT_COLUMN))


def pending_rows(spark: SparkSession, job: EnrichJob, data: DataFrame, path: str) -> DataFrame:
    """Rows of the input that neither the table nor the state has an answer for."""
    return resume(data.filter(_own_answer(data).isNull()).drop(*_RESULTS), latest_status(spark, path), job.spec.key)


def ask_rows(spark: SparkSession, job: EnrichJob, todo: DataFrame, path: str, run_id: str | None = None) -> None:
    """Ask for the pending rows, in one job of tasks of about ``commit_rows`` rows; every task that ends has its answers in the state."""
    spec = job.spec
    asked = _asked(todo, spec)
    tasks = max(1, -(-asked.count() // job.commit_rows))
    save_state(enrich(asked, replace(spec, land=False, call_partitions=spec.call_partitions or tasks)), spec.key, path, run_id or job.run_id)


def retry_rows(spark: SparkSession, job: EnrichJob, source: DataFrame, path: str) -> None:
    """Ask, one row per call, for rows whose latest status is an error; up to ROW_RETRY_ATTEMPTS times."""
    spec = job.spec
    single = replace(spec, pack_size=1, land=False, policy=replace(spec.policy, max_attempts=1))
    for attempt in range(fixed.ROW_RETRY_ATTEMPTS):
        errors = load_state(spark, path).filter("status = 'ERROR'").select(F.col("row_key").alias("_key"), F.col("ai_result").alias("_old"))
        bad = _asked(source, spec).join(errors, F.col(spec.key).cast("string") == F.col("_key")).drop("_key")
        if bad.isEmpty():
            return
        asked = enrich(bad, single)
        old = F.regexp_replace("_old", f"^{fixed.RETRY_FAILED_PREFIX}", "")
        text = F.when(F.col("result.status") == "ERROR", F.concat(F.lit(fixed.RETRY_FAILED_PREFIX), old)).otherwise(F.col(fixed.RESULT_COLUMN))
        save_state(asked.withColumn(fixed.RESULT_COLUMN, text), spec.key, path, f"{job.run_id}-retry{attempt}")


def merged(spark: SparkSession, job: EnrichJob, data: DataFrame, path: str) -> DataFrame:
    """Every row of the input with ``result`` and the text column, from the state or the table's own results."""
    key = F.col(job.spec.key).cast("string")
    state = load_state(spark, path)
    rows = data.withColumn("_own", _own_answer(data)).drop(*_RESULTS)
    columns = [c for c in rows.columns if c != "_own"]
    both = rows.join(state.select(F.col("row_key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("status", "value", "error", "raw", "attempts", "ai_result")]), key == F.col("_key"), "left")
    kept = F.col("_own").isNotNull()
    pick = lambda mine, theirs: F.when(kept, mine).otherwise(theirs)
    result = F.struct(pick(F.lit("OK"), F.col("_status")).alias("status"), pick(F.col("_own"), F.col("_value")).alias("value"),
                      pick(F.lit(None), F.col("_error")).alias("error"), pick(F.lit(None), F.col("_raw")).alias("raw"),
                      pick(F.lit(0), F.col("_attempts")).alias("attempts"))
    return both.select(*columns, result.alias("result"), pick(F.col("_own"), F.col("_ai_result")).alias(fixed.RESULT_COLUMN))


def _sums() -> list[Column]:
    s = F.col("result.status")
    return [F.count(F.lit(1)).alias("total"), F.count_if(s.isin("OK", "NO_DATA")).alias("processed"), F.count_if(s == "ERROR").alias("errors"), F.count_if(s.isNull()).alias("remaining")]


def report_frame(out: DataFrame) -> DataFrame:
    """One row from a merged output: total, processed, errors, remaining, success_rate (percent)."""
    return out.agg(*_sums()).withColumn("success_rate", F.when(F.col("total") > 0, F.col("processed") / F.col("total") * 100).otherwise(F.lit(0.0)))


def written(out: DataFrame, write: Callable[[DataFrame], None]) -> dict:
    """The report of an output, observed while ``write`` writes it: the output is not read again."""
    seen = Observation()
    write(out.observe(seen, *_sums()))
    counts = seen.get
    return counts | {"success_rate": counts["processed"] / counts["total"] * 100 if counts["total"] else 0.0}


def check_free(spark: SparkSession, path: str) -> None:
    """Fail before anything is paid for when the output is there already."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileExistsError(f"the output {path} exists")


def run(spark: SparkSession, job: EnrichJob, df: DataFrame | None = None) -> dict:
    """Run the job; returns the report (total, processed, errors, remaining, success_rate, keep_state)."""
    spec = job.spec
    data = df if df is not None else load(spark, job.input_path)
    require_columns(data, list(spec.columns) + [spec.key])
    check_keys(data, spec.key)
    check_free(spark, job.output_path)
    path = job.state_path or named_state(spark, f"job-{uuid.uuid4().hex}")
    todo = pending_rows(spark, job, data, path)
    ask_rows(spark, job, todo, path)
    if job.retry_errors:
        retry_rows(spark, job, data.drop(*_RESULTS), path)
    out = merged(spark, job, data, path)
    counts = written(out, lambda seen: write_result(seen, job.output_path, job.output_format))
    return counts | {"keep_state": not finalize_state(counts)}
