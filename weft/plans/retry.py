"""Second passes over a result table: row-by-row fallback for failed packs, and the retry of error rows.

Both are ``filter -> enrich -> unionByName`` over a landed table: the rows that
do not need work are never joined or re-read by key, and only the failed rows
are paid for again.
"""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import has_any_data, has_data
from ..operators.quality import is_error
from .enrich import EnrichSpec, enrich


def enrich_with_fallback(df: DataFrame, spec: EnrichSpec) -> DataFrame:
    """Packed enrichment; rows without an answer of their own, because the pack's call failed or its answer left
    them out, are asked again one row per call.

    Adds ``via`` = 'pack' | 'row'.  Answers are landed, so that none is paid for twice.
    """
    first = enrich(df, replace(spec, land=True))
    failed = F.col("result.status") == "ERROR"
    kept = first.filter(~failed).withColumn("via", F.lit("pack"))
    redo_in = first.filter(failed).select(*df.columns, "batch_id", "item_id")
    redo = enrich(redo_in, replace(spec, pack_size=1, land=True)).withColumn("via", F.lit("row"))
    return kept.unionByName(redo)


def retry_failed(df: DataFrame, spec: EnrichSpec, result_col: str = fixed.RESULT_COLUMN,
                 max_attempts: int = fixed.ROW_RETRY_ATTEMPTS) -> DataFrame:
    """Re-ask rows whose result text carries an error marker (12-marker set), up to ``max_attempts`` times.

    For tables without a result struct, where an error shows only in the text.  A row with nothing to send
    resolves to the no-data sentinel (a success); an answer is accepted when it is non-empty and carries no
    error marker, else it is asked again; in the end the row keeps ``'Retry failed: ' + old``.
    Adds ``retry_outcome`` = 'success' | 'failed' | NULL (row was not an error).
    """
    err = is_error(result_col, "retry")
    ok_rows = df.filter(~err).withColumn("retry_outcome", F.lit(None).cast("string"))
    bad = df.filter(err).withColumn("_old", F.col(result_col))
    has = has_any_data(spec.columns) if spec.multi else has_data(spec.columns[0])
    no_data = bad.filter(~has).withColumn(result_col, F.lit(fixed.NO_DATA)).withColumn("retry_outcome", F.lit("success"))
    out = ok_rows.unionByName(no_data.drop("_old"))
    left = bad.filter(has).drop(result_col)
    once = replace(spec, pack_size=1, land=True, policy=replace(spec.policy, max_attempts=1))
    accepted = (F.col("result.status") == "OK") & (F.col(fixed.RESULT_COLUMN) != "") & ~is_error(fixed.RESULT_COLUMN, "retry")
    for attempt in range(max_attempts):
        asked = enrich(left, once)
        good = asked.filter(accepted).withColumn("retry_outcome", F.lit("success"))
        out = out.unionByName(good.select(*[F.col(fixed.RESULT_COLUMN).alias(result_col) if c == result_col else c for c in ok_rows.columns]))
        left = asked.filter(~accepted).select(*left.columns)
        if attempt + 1 < max_attempts and left.isEmpty():
            return out
    lost = left.withColumn(result_col, F.concat(F.lit(fixed.RETRY_FAILED_PREFIX), F.col("_old"))).withColumn("retry_outcome", F.lit("failed"))
    return out.unionByName(lost.select(*ok_rows.columns))
