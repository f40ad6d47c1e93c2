"""Failed rows asked again when their wait is over, by a stream of their own.

``enrich_stream(..., keep_asked=True)`` writes what a failed row was asked about beside its error.  ``retry_stream`` follows the
state's files as they are written: a stateful operator, keyed by row, holds each failed row under a processing-time timer that ends
``RetryPolicy.delay`` after the failure, and lets it go when the timer fires.  What is due is asked in the same micro-batch, a
row per call, and appended to the state; a row that fails again comes back to the operator by the same files, until it has had
``max_attempts`` calls.  Only failed rows pass through Python and the state store; answered ones never do.

A micro-batch that runs again after a crash lets the same rows go and asks only for those it has not written.  The waits
survive in the stream's checkpoint.
"""
from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed
from ..operators.inference import RetryPolicy, is_rate_limited
from ..plans.enrich import EnrichSpec, enrich
from ..session import ship_package
from . import incremental as INC

_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_DUE = "row_key string, asked string, old string, attempts int"


class Waiting(StatefulProcessor):
    """One failed row's wait: its state is (asked, old text, attempts), and a timer at the time when it is due."""

    def __init__(self, policy: RetryPolicy):
        self.policy = policy

    def init(self, handle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "asked string, old string, attempts int")

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.row.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: (r.attempts, r.failed_ms))
        held = self.row.get()
        if held is not None:
            if held[2] >= last.attempts:
                return  # a copy of a failure that is waited for
            self._forget()
        due = last.failed_ms + int(1000 * self.policy.delay(max(last.attempts, 1) - 1, is_rate_limited(last.error)))
        if due <= timerValues.getCurrentProcessingTimeInMs():
            yield Row(row_key=key[0], asked=last.asked, old=last.old, attempts=last.attempts)
        else:
            self.row.update((last.asked, last.old, last.attempts))
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.row.get()
        if held is not None:
            asked, old, attempts = held
            self.row.clear()
            yield Row(row_key=key[0], asked=asked, old=old, attempts=attempts)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _store_with_timers(spark: SparkSession) -> Iterator[None]:
    """A query takes the session's settings when it starts: the store that keeps timers is set for that long."""
    name, provider = _STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def due_rows(failures: DataFrame, policy: RetryPolicy) -> DataFrame:
    """(row_key, asked, old, attempts) of a stream of failed state rows, each when its wait is over."""
    ship_package(failures.sparkSession)
    told = failures.select("row_key", "asked", F.col("ai_result").alias("old"), "attempts", "error", F.unix_millis("written_at").alias("failed_ms"))
    return told.groupBy("row_key").transformWithState(Waiting(policy), _DUE, "append", "ProcessingTime")


def ask_due(due: DataFrame, spec: EnrichSpec, settings: tuple[str, ...] = ()) -> DataFrame:
    """``due`` rows asked by one call each: an enriched frame whose attempts go on from the earlier ones'.

    ``settings`` names the spec's template columns, if its template is a column and no text."""
    names = list(dict.fromkeys([*spec.columns, *settings]))
    told = F.from_json("asked", StructType([StructField(n, StringType()) for n in names]))
    columns = [told[n].cast("boolean").alias(n) if n == spec.requires_context else told[n].alias(n) for n in names]
    rows = due.select("row_key", *columns, F.col("asked").alias("_asked"), F.col("old").alias("_old"), F.col("attempts").alias("_attempts"))
    out = enrich(rows, replace(spec, key="row_key", pack_size=1, land=False, call_partitions=None, policy=replace(spec.policy, max_attempts=1)))
    failed = F.col("result.status") == "ERROR"
    old = F.concat(F.lit(fixed.RETRY_FAILED_PREFIX), F.regexp_replace("_old", f"^{fixed.RETRY_FAILED_PREFIX}", ""))
    return out.withColumns({"result": F.col("result").withField("attempts", F.col("_attempts") + 1),
                            fixed.RESULT_COLUMN: F.when(failed, old).otherwise(F.col(fixed.RESULT_COLUMN)),
                            "_asked": F.when(failed, F.col("_asked"))})


def retry_stream(spark: SparkSession, state_path: str, spec: EnrichSpec, checkpoint: str, max_attempts: int = fixed.MAX_RETRIES,
                 settings: tuple[str, ...] = (), trigger: str = "30 seconds"):
    """Start the stream that asks failed rows of the state again, until each is answered or has had ``max_attempts`` calls.

    ``spec.policy`` gives the waits, ``settings`` the template columns (``ask_due``); ``spec.key`` and the packing don't matter.  The state's folder must exist.  Runs until it is
    stopped; errors written without what was asked are left to a resume."""
    log = spark.readStream.schema(INC.STATE_SCHEMA + ", asked string").parquet(state_path)
    again = (F.col("status") == "ERROR") & F.col("asked").isNotNull() & (F.col("attempts") < max_attempts)
    name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex[:12]

    def per_batch(due: DataFrame, epoch: int) -> None:
        run = f"retry-{name}-{epoch}"
        written = INC.read_run(due.sparkSession, state_path, run)
        if written is not None:
            due = due.join(written.select("row_key"), "row_key", "left_anti")
        # one action: the stateful operator runs once in a batch
        INC.save_state(ask_due(due, spec, settings), "row_key", state_path, run, F.col("_asked"))

    with _store_with_timers(spark):
        return (due_rows(log.where(again), spec.policy).writeStream.foreachBatch(per_batch).outputMode("append")
                .option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start())


def unsettled(spark: SparkSession, state_path: str, max_attempts: int = fixed.MAX_RETRIES) -> DataFrame:
    """(row_key, status, attempts) of failed rows that have calls left; no text of the state is read."""
    last = INC.latest_attempts(spark, state_path)
    return last.where((F.col("status") == "ERROR") & (F.col("attempts") < max_attempts))


def stop_when_settled(query, spark: SparkSession, state_path: str, max_attempts: int = fixed.MAX_RETRIES, timeout_s: float = 600.0) -> bool:
    """Stop a retry stream between two of its batches, once every row of the state is answered or has had its calls; False when for
    ``timeout_s`` the calls that are left are the same number.  An error of the stream is raised.

    Looking takes a fifth of the time at most, so that it does not hold up the stream."""
    settled, left, took = False, None, 0.0
    end = time.monotonic() + timeout_s
    try:
        while not settled and time.monotonic() < end and query.isActive:
            time.sleep(max(1.0, 4 * took))
            began = time.monotonic()
            now = unsettled(spark, state_path, max_attempts).agg(F.sum(max_attempts - F.col("attempts"))).first()[0] or 0
            took = time.monotonic() - began
            if now != left:
                left, end = now, time.monotonic() + timeout_s + 4 * took
            settled = now == 0
        if query.exception() is not None:
            raise query.exception()
        while query.status["isTriggerActive"] and (settled or time.monotonic() < end):
            time.sleep(0.05)
    finally:
        query.stop()
    return settled
