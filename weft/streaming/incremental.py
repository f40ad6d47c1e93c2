"""Durable state, resume and the streaming run.

State is an append-only Parquet table of ``(row_key, status, value, error, raw, attempts,
ai_result, written_at, run_id)`` rows under the shared checkpoint folder.  Reading it keeps the
latest row per key (``max_by`` aggregate: partial aggregation, so a key written many
times cannot make a hot task); ``compact_state`` spares readers the history.  A resume is a ``left_anti`` join of the current
input with the keys already answered: new input rows are kept (the original
tool would have lost them by reloading its checkpoint file instead of the input).
What is done is told by keys, never by a run's name: a run that broke off half-way
has its written answers kept and the others asked.
"""
from __future__ import annotations

import os
import time
import uuid
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..plans.enrich import EnrichSpec, enrich
from . import generations

DONE = ("OK", "NO_DATA")
#: The committer moves a task's output to its place as the task commits.
PER_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
STATE_SCHEMA = ("row_key string, status string, value string, error string, raw string, attempts int, ai_result string, "
                "written_at timestamp, run_id string")


def check_keys(df: DataFrame, key: str) -> None:
    """Fail on null or repeated keys (answers are kept by key); one aggregate over the key column."""
    bad = df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"column {key!r} must be unique and not null to keep answers by it; found {bad[0][0]!r} {bad[0]['n']} times "
                         "(with_row_key adds a stable key)")


def state_rows(result: DataFrame, key: str, run_id: str | int, asked: Column | None = None) -> DataFrame:
    """The state columns of an enriched frame (the key is kept as text), and ``asked`` where it is given."""
    return result.select(
        *([] if asked is None else [asked.alias("asked")]),
        F.col(key).cast("string").alias("row_key"), F.col("result.status").alias("status"), F.col("result.value").alias("value"),
        F.col("result.error").alias("error"), F.col("result.raw").alias("raw"), F.col("result.attempts").alias("attempts"),
        F.col(fixed.RESULT_COLUMN).alias("ai_result"), F.lit(str(run_id)).alias("run_id"), F.current_timestamp().alias("written_at"),
    )


def save_state(result: DataFrame, key: str, path: str, run_id: str | int, asked: Column | None = None) -> None:
    """Append this run's answers under ``run_id=<id>/``; never rewrite earlier ones.  ``asked`` tells ``retries.retry_stream`` what to ask again.

    A task's files are put in place when the task ends (PER_TASK), not when the whole job does: of a run that is killed after
    some of its tasks, their answers are in the state, and a resume asks for the others'.  Rows that a broken
    commit left twice are one row to the readers, which keep the latest by key."""
    state_rows(result, key, run_id, asked).write.options(**PER_TASK).mode("append").partitionBy("run_id").parquet(path)


def _read_state(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(STATE_SCHEMA).parquet(path)
    except AnalysisException as e:  # no state yet; any other trouble must not buy everything again
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """What one run has written, from its own folder; None where it has none."""
    return _read_state(spark, f"{path.rstrip('/')}/run_id={run_id}")


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """Latest row per key (by write time), or None when no state exists yet."""
    raw = _read_state(spark, path)
    if raw is None:
        return None
    return generations.latest(raw, path)


def latest_status(spark: SparkSession, path: str) -> DataFrame | None:
    """(row_key, status) of the latest row per key, without the answers' texts."""
    raw = _read_state(spark, path)
    if raw is None:
        return None
    return generations.latest(raw, path, ("row_key", "status"))


def latest_attempts(spark: SparkSession, path: str) -> DataFrame:
    """(row_key, status, attempts) of the latest row per key of a state that exists, without the answers' texts."""
    return generations.latest(_read_state(spark, path), path, ("row_key", "status", "attempts"))


def compact_state(spark: SparkSession, path: str, slice_rows: int = 1_000_000) -> generations.Snapshot | None:
    """Fold what was written since the last time into a new generation, so that reading the state need not go through its history."""
    raw = _read_state(spark, path)
    return None if raw is None else generations.compact(raw, path, slice_rows)


def resume(df: DataFrame, state: DataFrame | None, key: str) -> DataFrame:
    """Rows of ``df`` that still need an answer: not in state, or in state with an error."""
    if state is None:
        return df
    done = state.filter(F.col("status").isin(*DONE)).select(F.col("row_key").alias("_done"))
    return df.join(done, F.col(key).cast("string") == F.col("_done"), how="left_anti")


def asked_settings(spec: EnrichSpec) -> list[str]:
    """The names that the spec has for a template and whether it applies: columns, or a template itself."""
    return [c for c in (spec.template, spec.requires_context) if isinstance(c, str)]


def _asked(df: DataFrame, spec: EnrichSpec) -> DataFrame:
    """Only the key and what is sent: other columns stay out of shuffles and state."""
    more = [c for c in asked_settings(spec) if c in df.columns]
    return df.select(*dict.fromkeys([spec.key, *spec.columns, *more]))


def _asked_text(sent: DataFrame, spec: EnrichSpec) -> Column:
    """What a failed row was asked about, as a JSON object of texts; null for other rows."""
    names = [c for c in sent.columns if c in (*spec.columns, *asked_settings(spec))]
    return F.when(F.col("result.status") == "ERROR", F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in names])))


def finalize_state(stats: dict) -> bool:
    """Whether the state has served its purpose: nothing failed and nothing is left.  It is never removed here."""
    return stats.get("errors", 0) + stats.get("remaining", 0) == 0


def run_incremental(df: DataFrame, spec: EnrichSpec, state_path: str, run_id: str | int | None = None) -> DataFrame:
    """resume -> enrich -> append state; returns the merged latest state."""
    spark = df.sparkSession
    check_keys(df, spec.key)
    run_id = run_id if run_id is not None else int(time.time() * 1000)
    todo = resume(df, latest_status(spark, state_path), spec.key)
    # the state append is the single action over the answers: it is the landing (one call per row)
    save_state(enrich(_asked(todo, spec), replace(spec, land=False)), spec.key, state_path, run_id)
    return load_state(spark, state_path)


def enrich_stream(spark: SparkSession, source_path: str, schema, spec: EnrichSpec, state_path: str, checkpoint: str,
                  max_files_per_trigger: int | None = None, available_now: bool = True, skip_answered_keys: bool = False,
                  keep_asked: bool = False):
    """Structured Streaming run: new files under ``source_path`` are enriched micro-batch by micro-batch.

    The streaming checkpoint records which files were done, so each file is read
    once and a second run over the same files asks nothing. A micro-batch that is
    run again after a failure asks only for the keys that it has not itself written:
    its rows are found by the stream's and the batch's number, so streams that share a state
    don't take each other's batches for their own. With ``skip_answered_keys`` each
    micro-batch also drops keys answered by other runs (a join with the whole state: only
    for inputs that re-deliver rows). A batch with null or repeated keys fails. With ``keep_asked``
    failed rows are written with what they were asked about, for ``retries.retry_stream``.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_path)

    once = replace(spec, land=False)  # the state append is the one action per micro-batch
    name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex[:12]

    def per_batch(batch: DataFrame, epoch: int) -> None:
        run = f"stream-{name}-{epoch}"
        check_keys(batch, spec.key)
        if skip_answered_keys:
            todo = resume(batch, latest_status(batch.sparkSession, state_path), spec.key)
        else:
            raw = _read_state(batch.sparkSession, state_path)
            todo = resume(batch, raw.filter(F.col("run_id") == run) if raw is not None else None, spec.key)
        sent = _asked(todo, spec)
        save_state(enrich(sent, once), spec.key, state_path, run, _asked_text(sent, spec) if keep_asked else None)

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def fresh_path(base: str, name: str) -> str:
    """A new sub-folder name under ``base`` for one run's state (tests and bench)."""
    return os.path.join(base, f"{name}-{int(time.time() * 1e6)}")
