"""Statistics and error classification: single-pass aggregates over result tables and run logs.

Two ways to tell an error:

* status-based (``result.status``) for tables this package wrote;
* marker-based (``is_error``) for result text written by the original tool or
  imported from elsewhere, where the error is only visible as words in the value.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import _col


def marker_regex(markers: list[str]) -> str:
    return "(?iu)(" + "|".join(re.escape(m) for m in markers) + ")"


def is_error(c: str | Column, kind: str = "stats") -> Column:
    """Case-insensitive marker match; ``kind='stats'`` uses the 6 report markers, ``'retry'`` all 12.
    NULL is never an error."""
    markers = fixed.STATS_ERROR_MARKERS if kind == "stats" else fixed.RETRY_ERROR_MARKERS
    return F.coalesce(_col(c).rlike(marker_regex(markers)), F.lit(False))


# error classes reported per category (first match wins)
ERROR_CLASSES = [
    ("rate_limit", ["429", "rate limit", "rate_limit", "quota", "too many requests"]),
    ("timeout", ["timeout"]),
    ("connection", ["connection"]),
    ("batch", ["batch error", "failed after"]),
    ("api", ["api error", "request failed", "error:"]),
    ("exception", ["exception"]),
]


def error_category(c: str | Column) -> Column:
    low = F.lower(_col(c))
    out = None
    for name, words in ERROR_CLASSES:
        cond = low.rlike("|".join(re.escape(w) for w in words))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("other"))


def processing_stats(df: DataFrame, result_col: str = fixed.RESULT_COLUMN) -> DataFrame:
    """One row: total, processed (value and no error marker), remaining (NULL/empty), errors (marker)."""
    if result_col not in df.columns:
        return df.agg(F.count(F.lit(1)).alias("total")).select(
            "total", F.lit(0).cast("long").alias("processed"), F.col("total").alias("remaining"), F.lit(0).cast("long").alias("errors"))
    r = F.col(result_col)
    has = r.isNotNull() & (r != "")
    err = is_error(r, "stats")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(has & ~err).alias("processed"),
        (F.count(F.lit(1)) - F.count_if(has)).alias("remaining"),
        F.count_if(err).alias("errors"),
    )


def status_stats(df: DataFrame, result: str = "result") -> DataFrame:
    """One row from the result struct: total, ok, no_data, errors."""
    s = F.col(f"{result}.status")
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "OK").alias("ok"),
                  F.count_if(s == "NO_DATA").alias("no_data"), F.count_if(s == "ERROR").alias("errors"))


def final_report(stats: DataFrame, elapsed_s: float | None = None) -> DataFrame:
    """Stats + success rate in percent (0 for an empty table); with the run time also hours and rows/hour."""
    rate = F.when(F.col("total") > 0, F.col("processed").cast("double") / F.col("total") * 100).otherwise(F.lit(0.0))
    out = stats.withColumn("success_rate", rate)
    if elapsed_s is not None:
        hours = float(elapsed_s) / 3600
        out = out.withColumn("elapsed_h", F.lit(hours)).withColumn(
            "rows_per_hour", F.when(F.lit(hours) > 0, F.col("processed") / F.lit(hours)))
    return out


def retry_stats(df: DataFrame, outcome: str = "retry_outcome") -> DataFrame:
    """One row: total_errors, retry_attempted, retry_success, retry_failed, success_rate (percent, 0 when none)."""
    o = F.col(outcome)
    agg = df.agg(F.count_if(o.isNotNull()).alias("total_errors"), F.count_if(o.isNotNull()).alias("retry_attempted"),
                 F.count_if(o == "success").alias("retry_success"), F.count_if(o == "failed").alias("retry_failed"))
    rate = F.when(F.col("retry_attempted") > 0, F.col("retry_success").cast("double") / F.col("retry_attempted") * 100).otherwise(F.lit(0.0))
    return agg.withColumn("success_rate", rate)


def chunk_summary(log: DataFrame, chunk_col: str, success: Column, processing_cents: Column, retries: Column) -> DataFrame:
    """Per chunk: rows, successes, mean processing time (from integer hundredths, exact), total retries."""
    return log.groupBy(chunk_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(success).alias("success_count"),
        (F.sum(processing_cents).cast("double") / F.count(F.lit(1)) / 100).alias("avg_processing_time"),
        F.sum(retries).cast("long").alias("total_retries"),
    )


def progress(log: DataFrame, ts: str, done: Column) -> DataFrame:
    """One row: total, processed, pct_done, elapsed_s, rows_per_s, eta (NULL when nothing is done yet)."""
    agg = log.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("processed"), F.min(ts).alias("started"),
                  F.max(ts).alias("last"))
    out = agg.withColumn("elapsed_s", F.expr("timestampdiff(MICROSECOND, started, last)") / F.lit(1_000_000))
    out = out.withColumn("pct_done", F.col("processed").cast("double") / F.col("total") * 100)
    out = out.withColumn("rows_per_s", F.when(F.col("elapsed_s") > 0, F.col("processed") / F.col("elapsed_s")))
    eta = F.expr("timestampadd(MICROSECOND, floor((total - processed) / rows_per_s * 1000000), last)")
    out = out.withColumn("eta", F.when((F.col("processed") > 0) & (F.col("rows_per_s") > 0), eta))
    out = out.withColumn("eta_text", F.coalesce(F.concat(F.lit(fixed.ETA_PREFIX), F.date_format("eta", "HH:mm:ss dd/MM/yyyy")),
                                                F.lit(fixed.ETA_UNKNOWN)))
    out = out.withColumn("elapsed_h", F.col("elapsed_s") / 3600)
    return out.select("total", "processed", "pct_done", "elapsed_s", "elapsed_h", "rows_per_s", "eta", "eta_text")


def pack_quality(results: DataFrame, batch_col: str = "batch_id", threshold: float = 0.3) -> DataFrame:
    """Per pack: items, OK items, and a flag when fewer than ``threshold`` of them are usable."""
    ok = F.col("result.status") == "OK"
    g = results.filter(F.col(batch_col).isNotNull()).groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(ok).alias("n_ok"))
    return g.withColumn("low_quality", F.col("n_ok") < F.col("n_items") * F.lit(threshold))


def request_log(results: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """One row per model request of an enrichment run (a pack counts once):
    ``called_at, task, success, error, processing_time (s), retry_count``.

    Feed it to ``progress``, ``chunk_summary``, ``streaming.runlog.rate_audit`` or
    ``breaker_trips`` to audit a run with the same queries as any request log.
    """
    r = F.col("result")
    sent = results.filter(r["called_at"].isNotNull())
    if batch_col in results.columns:
        # all items of a pack share one call: keep one row per pack
        sent = sent.groupBy(batch_col).agg(F.any_value("result").alias("result"))
    return sent.select(
        F.col("result.called_at").alias("called_at"), F.col("result.task").alias("task"),
        F.col("result.call_ok").alias("success"),
        F.when(~F.col("result.call_ok"), F.col("result.error")).alias("error"),
        (F.col("result.latency_ms") / 1000).alias("processing_time"),
        (F.col("result.attempts") - 1).alias("retry_count"),
    )
