"""Readers: delimited text with encoding detection, workbooks, prompt files, the model registry, response files.

Every reader returns an ordinary DataFrame; nothing is loaded on the driver
except per-file facts (one small row per file) such as a detected encoding.
"""
from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Sequence
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.parsing import response_text
from ..functions.prompts import validate_prompt
from ..functions.text import py_strip
from ..operators.inference import land

DEFAULT_NA_VALUES = fixed.PANDAS_MISSING


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


LATIN = "ISO-8859-1"


def _file_facts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Per file: ``latin`` (some line is no UTF-8) and ``spans`` (some record goes over several lines).

    All lines are read (splittable).  A record spans lines just where a line has an odd number of quotes."""
    lines = spark.read.text(_paths(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    return lines.groupBy("file").agg(F.max(~F.is_valid_utf8("value")).alias("latin"), F.max(odd).alias("spans"))


def detect_encoding(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, str]:
    """Per file (empty ones aside): 'UTF-8' when every line decodes as UTF-8, else 'ISO-8859-1' (which always decodes)."""
    return {unquote(r["file"]): (LATIN if r["latin"] else "UTF-8") for r in _file_facts(spark, paths).collect()}


def apply_na_values(df: DataFrame, na_values: Sequence[str] | None) -> DataFrame:
    """Turn the given markers into NULL in every string column."""
    if not na_values:
        return df
    vals = list(na_values)
    return df.select(*[F.when(F.col(f.name).isin(vals), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def read_csv(spark: SparkSession, paths: str | Sequence[str], na_values: Sequence[str] | None = None,
             encoding: str | None = None, schema: T.StructType | str | None = None, multi_line: bool | None = None) -> DataFrame:
    """Delimited files with a header row, RFC-4180 quoting (doubled quotes, quoted newlines), BOM tolerated.

    Without ``encoding`` or ``multi_line`` a pass over all lines tells which files are no UTF-8 and in which a quoted
    field spans lines; only the latter are read one task per file, all others are split.  Files of one kind are
    read together and the kinds unioned by name.  Columns stay strings unless a schema is given.  Files that
    are all empty give an empty frame of that schema, or of no columns.
    """
    if encoding and multi_line is not None:
        groups: dict[tuple[str, bool], list[str]] = {(encoding, multi_line): _paths(paths)}
    else:
        facts = _file_facts(spark, paths)
        kinds = {(r["latin"], r["spans"]): r["n"] for r in facts.groupBy("latin", "spans").agg(F.count("*").alias("n")).collect()}
        if len(kinds) == 1:
            found = {next(iter(kinds)): _paths(paths)}  # of one kind all: their names aren't needed
        else:
            found = {}
            for r in facts.collect():
                found.setdefault((r["latin"], r["spans"]), []).append(unquote(r["file"]))
        groups = {}
        for (latin, spans), files in found.items():
            kind = (encoding or (LATIN if latin else "UTF-8"), spans if multi_line is None else multi_line)
            groups.setdefault(kind, []).extend(files)
    frames = []
    for (enc, many), files in sorted(groups.items()):
        r = spark.read.options(header=True, multiLine=many, quote='"', escape='"', encoding=enc)
        if schema is not None:
            r = r.schema(schema)
        df = r.csv(files)
        # a UTF-8 byte order mark stays glued to the first header name; drop it
        df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
        frames.append(df)
    if not frames:
        return spark.createDataFrame([], schema or T.StructType([]))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return apply_na_values(out, na_values)


def sample_schema(spark: SparkSession, paths: str | Sequence[str], ratio: float = 1.0) -> T.StructType:
    """Column types inferred from all rows, or a share of them (for text-column detection on all-string CSV input).

    Files are split among tasks unless a quoted field of some file spans lines."""
    spans = _file_facts(spark, paths).agg(F.max("spans")).first()[0]
    return (spark.read.options(header=True, multiLine=bool(spans), quote='"', escape='"', inferSchema=True, samplingRatio=ratio)
            .csv(_paths(paths)).schema)


def read_prompts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Prompt files: one prompt per file, stripped and validated (name, prompt, ok, message); UTF-8, or else Latin-1."""
    files = spark.read.format("binaryFile").load(_paths(paths))
    utf8 = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), utf8).otherwise(F.decode("content", LATIN))
    # paths are URIs; a plus sign in them is no blank
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    df = files.select(path.alias("path"), py_strip(text).alias("prompt"))
    v = validate_prompt("prompt")
    return df.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), "prompt", v["ok"].alias("ok"), v["message"].alias("message"))


REGISTRY_T = ("map<string,struct<model_id:string,display_name:string,training_date:string,requires_context:boolean,"
              "prompt_context:struct<template:string>>>")


def read_model_registry(spark: SparkSession, path: str) -> DataFrame:
    """Tuned-model registry file -> rows (name, model_id, display_name, training_date, requires_context, template).

    A missing file is an empty registry.
    """
    schema = "name string, model_id string, display_name string, training_date string, requires_context boolean, template string"
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    m = raw.select(F.from_json(F.get_json_object("value", "$.fine_tuned_models"), REGISTRY_T).alias("m"))
    e = m.select(F.explode("m").alias("name", "v"))
    return e.select("name", "v.model_id", "v.display_name", "v.training_date", F.coalesce("v.requires_context", F.lit(False)).alias("requires_context"),
                    F.col("v.prompt_context.template").alias("template"))


def read_responses(spark: SparkSession, paths: str | Sequence[str], provider: str = "gemini", body_col: str = "body") -> DataFrame:
    """JSON-lines response files (one object per line with a ``body`` string or the body itself) -> text, error."""
    lines = spark.read.text(_paths(paths))
    body = F.coalesce(F.get_json_object("value", f"$.{body_col}"), F.col("value"))
    r = response_text(body, provider)
    return lines.select(F.get_json_object("value", "$.request_id").alias("request_id"), r["text"].alias("text"), r["error"].alias("error"))


def validate_file_path(spark: SparkSession, path: str | None) -> tuple[bool, str]:
    """(ok, message): non-empty path, present on the (possibly distributed) file system, supported suffix."""
    if not path:
        return False, fixed.PATH_EMPTY
    try:
        # resolving the path lists it on its file system (local, HDFS, object store); no content is read
        spark.read.format("binaryFile").load(path).schema
    except AnalysisException as e:  # any other trouble than a missing path is the caller's to see
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False, fixed.PATH_MISSING.format(path=path)
    if os.path.splitext(path.rstrip("/"))[1].lower() not in fixed.SUPPORTED_SUFFIXES:
        return False, fixed.PATH_UNSUPPORTED.format(formats=", ".join(fixed.SUPPORTED_SUFFIXES))
    return True, fixed.PATH_OK


def load(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Dispatch on the lower-cased suffix: .csv, .parquet, .json/.jsonl, .txt, .xlsx (folder of workbooks)."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        kw.setdefault("na_values", DEFAULT_NA_VALUES)  # the same blanks a pandas read would give
        return read_csv(spark, path, **kw)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix in (".json", ".jsonl"):
        return spark.read.json(path)
    if suffix == ".txt":
        return read_prompts(spark, path)
    if suffix == ".xlsx":
        return read_workbooks(spark, path)
    if suffix == ".xls":
        raise ValueError("legacy .xls workbooks are not supported; save as .xlsx or .csv")
    raise ValueError(f"unsupported file type {suffix!r}; supported: {', '.join(fixed.SUPPORTED_SUFFIXES)}, .parquet, .json")


# ---------------------------------------------------------------------------
# workbooks: one task per file, decoded with the standard library (zip + XML)
# ---------------------------------------------------------------------------
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + (ord(ch.upper()) - 64)
        else:
            break
    return n - 1


def _first_sheet(z: zipfile.ZipFile) -> str | None:
    """The part that holds the first worksheet in the workbook's own order; by the parts' numbers where it tells none."""
    parts = sorted((n for n in z.namelist() if n.startswith("xl/worksheets/sheet") and n.endswith(".xml")), key=lambda n: (len(n), n))
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(z.namelist()):
        targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS):
            target = targets.get(sheet.get(_REL_ID), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part in parts:
                return part
    return parts[0] if parts else None


def distinct_names(header: list[str | None]) -> list[str]:
    """Column names of a header row: ``col<i>`` where it is blank, and ``.1``, ``.2`` ... behind a name that came before."""
    out: list[str] = []
    for i, name in enumerate(header):
        name = own = name if name is not None else f"col{i}"
        n = 0
        while own in out:
            n += 1
            own = f"{name}.{n}"
        out.append(own)
    return out


def decode_first_sheet(data: bytes) -> list[list[str | None]]:
    """Rows of the first worksheet as text (shared strings, inline strings, numbers, booleans)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
        for si in root.findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    sheet = _first_sheet(z)
    if sheet is None:
        return []
    root = ET.fromstring(z.read(sheet))
    rows = []
    for row in root.iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", _NS):
            idx = _col_index(c.get("r", "A"))
            typ = c.get("t")
            v = c.find("m:v", _NS)
            if typ == "s" and v is not None:
                cells[idx] = shared[int(v.text)]
            elif typ == "inlineStr":
                cells[idx] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif typ == "b" and v is not None:
                cells[idx] = "True" if v.text == "1" else "False"
            elif v is not None:
                txt = v.text
                cells[idx] = txt[:-2] if txt and txt.endswith(".0") else txt
        width = max(cells) + 1 if cells else 0
        rows.append([cells.get(i) for i in range(width)])
    return rows


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of .xlsx workbooks -> one DataFrame (header from each file's first row, all columns text).

    The files are decoded once, into the shared folder; repeated names of a header are told apart (``distinct_names``)."""
    from ..session import ship_package

    ship_package(spark)  # the decoder runs in executor Python workers
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder)

    def decode(batches):
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                rows = decode_first_sheet(bytes(content))
                if not rows:
                    continue
                header = distinct_names(rows[0])
                for r_i, r in enumerate(rows[1:], 1):
                    vals = (r + [None] * len(header))[: len(header)]
                    out.append((path, r_i, header, vals))
            yield pd.DataFrame(out, columns=["path", "row_idx", "header", "cells"])

    long = files.select("path", "content").mapInPandas(decode, "path string, row_idx long, header array<string>, cells array<string>")
    long = land(long, "workbooks")
    # a file's cells are named by its own header; the frame has the columns of all files
    seen = long.select("header").distinct().select(F.posexplode("header").alias("at", "name"))
    names = [r["name"] for r in seen.groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]
    return long.select("path", "row_idx", *[F.get("cells", F.array_position("header", F.lit(n)).cast("int") - 1).alias(n) for n in names])
