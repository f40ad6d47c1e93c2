"""Writers: result tables, request files, and output naming."""
from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.prompts import payload_gemini, payload_openai


def write_result(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Write the enriched table. CSV: header row, RFC-4180 quoting (no BOM: Spark writes plain UTF-8)."""
    out = df
    if "result" in df.columns and fmt == "csv":
        out = df.drop("result")  # CSV has no nested types; AI_RESULT carries the text
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(header=True, quote='"', escape='"').csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unsupported output format {fmt!r}")


def result_path(input_path: str, fmt: str = "csv", when: datetime | None = None) -> str:
    """``{stem}_ai_result_{YYYYmmdd_HHMMSS}.{ext}`` next to the input; the extension is the format."""
    stamp = (when or datetime.now()).strftime("%Y%m%d_%H%M%S")
    folder, name = os.path.split(input_path)
    stem = os.path.splitext(name)[0]
    return os.path.join(folder, fixed.RESULT_FILE_PATTERN.format(stem=stem, stamp=stamp, ext=fmt))


def state_file_path(input_path: str, fmt: str = "csv") -> str:
    """``{stem}_checkpoint.{ext}`` next to the input."""
    folder, name = os.path.split(input_path)
    stem = os.path.splitext(name)[0]
    return os.path.join(folder, fixed.STATE_FILE_PATTERN.format(stem=stem, ext=fmt))


def request_bodies(df: DataFrame, prompt: str, provider: str = "gemini", model: str | None = None, key: str | None = None) -> DataFrame:
    """One JSON line per request: ``{"request_id": .., "body": {..}}`` for offline/bulk endpoints."""
    body = payload_gemini(prompt) if provider == "gemini" else payload_openai(model or "", prompt)
    rid = F.col(key).cast("string") if key else F.sha2(F.col(prompt), 256)
    return df.select(F.concat(F.lit('{"request_id": '), F.to_json(F.array(rid)).substr(F.lit(2), F.length(F.to_json(F.array(rid))) - 2),
                              F.lit(', "body": '), body, F.lit("}")).alias("value"))


def write_requests(df: DataFrame, path: str, prompt: str, provider: str = "gemini", model: str | None = None, key: str | None = None) -> None:
    request_bodies(df, prompt, provider, model, key).write.mode("errorifexists").text(path)
