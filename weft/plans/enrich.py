"""The enrichment dataflow: select -> clean -> prompt -> (pack) -> model -> parse -> reconcile.

``enrich(df, spec)`` returns ``df`` plus

* ``result``: struct<status, value, error, attempts, method, raw, ...> with status one of
  ``OK``, ``NO_DATA``, ``ERROR``; ``error`` is the real cause, and ``raw`` keeps a paid
  answer that could not be read;
* ``AI_RESULT``: the projected text column (answer, or the sentinel text the
  original tool would have written).

Plan shape: single-row mode is scan -> project -> Arrow UDF -> project (no
shuffle).  Pack mode adds exactly one hash exchange (bucket window + pack
grouping share it) and no join: each pack carries its rows, and answers are
matched to items by item number inside the pack row.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import parsing as P
from ..functions import prompts as PR
from ..functions.text import as_item, clean_text, has_any_data, has_data
from ..operators.backends import Backend
from ..operators.inference import RetryPolicy, call_model, land
from ..operators.packing import collect_packs, pack

@dataclass(frozen=True)
class EnrichSpec:
    """What to ask, of which columns, and how to send it."""

    prompt: str
    columns: tuple[str, ...]
    key: str
    backend: Backend
    pack_size: int = 1
    pack_format: str = "indexed"        # 'indexed' ([n] blocks), 'items' (Item n:), 'json' (array with item_id)
    pack_mode: str = "bucketed"         # or 'ordered'
    n_buckets: int | None = None
    bucket_fn: str = "hash"             # 'hash' (xxhash64 of the key) or 'div' (key div bucket_width, SQL-reproducible)
    bucket_width: int = 64
    use_json: bool = False
    json_fields: tuple[str, ...] = tuple(fixed.RESULT_FIELDS)
    accept_cut: bool = False            # read JSON answers that the token limit cut off (method 'json_cut'), rather than leave them unread
    template: str | None = None         # a tuned model's prompt: a column with the template, or the template itself
    requires_context: str | bool = True  # whether the template applies: a boolean column, or a constant
    multi_style: str = "sync"           # multi-column single-row prompt: 'sync' (definitions, cleaned) or 'async'
    policy: RetryPolicy = field(default_factory=RetryPolicy)
    land: bool = True
    call_partitions: int | None = None  # round-robin the requests over this many tasks before the model call
                                        # (evens out long texts; sets global concurrency = tasks x backend threads)

    def __post_init__(self):
        if not self.columns:
            raise ValueError("select at least one column")
        if isinstance(self.columns, str):
            raise ValueError("columns must be a sequence of names, e.g. ('MESSAGE',)")
        checks = {"pack_format": (self.pack_format, ("indexed", "items", "json")), "pack_mode": (self.pack_mode, ("bucketed", "ordered")),
                  "bucket_fn": (self.bucket_fn, ("hash", "div")), "multi_style": (self.multi_style, ("sync", "async"))}
        for name, (value, allowed) in checks.items():
            if value not in allowed:
                raise ValueError(f"{name}={value!r}; expected one of {', '.join(allowed)}")
        if self.pack_size < 1:
            raise ValueError("pack_size must be >= 1")

    @property
    def multi(self) -> bool:
        return len(self.columns) > 1


def _has(spec: EnrichSpec) -> Column:
    return has_any_data(spec.columns) if spec.multi else has_data(spec.columns[0])


def _single_prompt(spec: EnrichSpec, columns: list[str]) -> Column:
    if not spec.multi and spec.template is not None:
        tpl = F.col(spec.template) if spec.template in columns else F.lit(spec.template)
        needs = F.col(spec.requires_context) if isinstance(spec.requires_context, str) else F.lit(spec.requires_context)
        return PR.prompt_with_registry(tpl, needs, clean_text(spec.columns[0]), spec.prompt)
    if not spec.multi:
        return PR.prompt_single(spec.prompt, clean_text(spec.columns[0]))
    if spec.multi_style == "async":
        return PR.prompt_multi(spec.prompt, spec.columns)
    return PR.prompt_multi_sync(spec.prompt, spec.columns)


def _projected(result: Column, message: Column) -> Column:
    """The text column: the answer, or the fixed text for why there is none."""
    return (
        F.when(result["status"] == "OK", result["value"])
        .when(result["status"] == "NO_DATA", F.lit(fixed.NO_DATA))
        .otherwise(message)
    )


def _unread(parsed: Column) -> Column:
    """An answer that came but holds nothing readable."""
    return F.coalesce(parsed["method"].isin("failed", "empty"), F.lit(False))


def enrich(df: DataFrame, spec: EnrichSpec) -> DataFrame:
    """Ask the backend about every row of ``df`` (callers pass only pending rows; see ``streaming.incremental.resume``)."""
    missing = [c for c in list(spec.columns) + [spec.key] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    # an earlier result (e.g. the original tool's output file) is replaced, not duplicated
    df = df.drop(*[c for c in ("result", fixed.RESULT_COLUMN) if c in df.columns and c not in spec.columns])
    if spec.pack_size <= 1:
        return _enrich_single(df, spec)
    return _enrich_packed(df, spec)


def with_prompts(df: DataFrame, spec: EnrichSpec) -> DataFrame:
    """``df`` with ``_prompt``, the request of each row by itself; null where there is nothing to send."""
    return df.withColumn("_prompt", F.when(_has(spec), _single_prompt(spec, df.columns)))


def _enrich_single(df: DataFrame, spec: EnrichSpec) -> DataFrame:
    cols = df.columns
    asked = with_prompts(df, spec)
    if spec.call_partitions:
        asked = asked.repartition(spec.call_partitions)
    answered = call_model(asked, spec.backend, "_prompt", policy=spec.policy, out="_resp")
    # land the answers with the input columns only (the rendered prompt is not kept)
    answered = answered.select(*cols, "_resp", F.col("_prompt").isNotNull().alias("_sent"))
    if spec.land:
        answered = land(answered)
    return read_answers(answered, spec, cols)


def read_answers(answered: DataFrame, spec: EnrichSpec, cols: list[str]) -> DataFrame:
    """``cols``, ``result`` and the text column from rows with ``_resp`` (an answer struct) and ``_sent``."""
    r = F.col("_resp")
    answered = P.with_parsed_response(answered, r["text"], "_val", spec.use_json, spec.json_fields, spec.accept_cut)
    parsed = F.col("_val")
    failed = r["error"].isNotNull()
    status = F.when(~F.col("_sent"), F.lit("NO_DATA")).when(failed | _unread(parsed), F.lit("ERROR")).otherwise(F.lit("OK"))
    after = fixed.ERROR_AFTER_RETRIES.split("{n}")
    message = F.when(failed, F.concat(F.lit(after[0]), r["attempts"].cast("string"), F.lit(after[1]))).otherwise(parsed["value"])
    result = _result(status, parsed["value"], F.when(failed, r["error"]).otherwise(parsed["value"]), parsed["method"], r["text"], r)
    out = answered.withColumn("result", result)
    return out.select(*cols, "result", _projected(F.col("result"), message).alias(fixed.RESULT_COLUMN))


def _result(status: Column, value: Column, error: Column, method: Column, raw: Column, r: Column) -> Column:
    return F.struct(
        status.alias("status"),
        F.when(status == "OK", value).alias("value"),
        F.when(status == "ERROR", error).alias("error"),
        F.coalesce(r["attempts"], F.lit(0)).alias("attempts"),
        F.when(status == "OK", method).alias("method"),
        F.when(status == "ERROR", raw).alias("raw"),
        F.timestamp_seconds(r["called_at"]).alias("called_at"),
        r["latency_ms"].alias("latency_ms"),
        r["task"].alias("task"),
        F.when(r["called_at"].isNotNull(), r["error"].isNull()).alias("call_ok"),
    )


def _pack_prompt(spec: EnrichSpec, items: Column) -> Column:
    if spec.pack_format == "indexed":
        return PR.prompt_pack_indexed_multi(spec.prompt, items, spec.columns) if spec.multi else PR.prompt_pack_indexed(spec.prompt, items)
    return PR.prompt_pack_items(spec.prompt, items, as_json=spec.pack_format == "json", multi=spec.multi)


def item_text(spec: EnrichSpec, row: Column | None = None) -> Column:
    """What one item says: the cleaned text, or ``name: value`` lines of the selected columns
    (read from the ``row`` struct when given)."""
    get = (lambda c: row[c]) if row is not None else F.col
    if not spec.multi:
        return clean_text(get(spec.columns[0]))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), clean_text(F.coalesce(get(c).cast("string"), F.lit(fixed.MISSING_VALUE))))
                               for c in spec.columns])


def pack_requests(df: DataFrame, spec: EnrichSpec) -> DataFrame:
    """One row per pack: ``bucket, _has, batch_no, batch_id, n_items, items, _prompt, _item_texts``.

    Only ``(item_id, row)`` crosses the shuffle; the item text (and, for several
    columns, the name/value list) is derived from the row after it, so the text
    moves once.
    """
    cols = df.columns
    base = df.withColumn("_has", _has(spec))
    # rows with nothing to send sit in their own (never sent) packs: same scan, same exchange
    packed = pack(base, spec.key, spec.pack_size, mode=spec.pack_mode, n_buckets=spec.n_buckets, split_by="_has",
                  bucket_fn=spec.bucket_fn, bucket_width=spec.bucket_width)
    # groups are bounded by the pack size; the grouping keys contain the window's partition keys (no new exchange)
    reqs = collect_packs(packed, [], carry=cols, by=["bucket", "_has", "batch_no"])

    def enrich_item(x):
        fields = [F.lit("item_id"), x["item_id"], F.lit("text"), item_text(spec, x["row"])]
        if spec.multi:
            fields += [F.lit("values"), as_item(spec.columns, x["row"])]
        return F.named_struct(*fields, F.lit("row"), x["row"])

    reqs = reqs.withColumn("items", F.transform("items", enrich_item))
    reqs = reqs.withColumn("_prompt", F.when(F.col("_has"), _pack_prompt(spec, F.col("items"))))
    return reqs.withColumn("_item_texts", F.transform("items", lambda x: x["text"]))


def _enrich_packed(df: DataFrame, spec: EnrichSpec) -> DataFrame:
    cols = df.columns
    reqs = pack_requests(df, spec)
    if spec.call_partitions:
        reqs = reqs.repartition(spec.call_partitions)
    # item texts travel to Python only for backends that read them (the deterministic test model)
    items = "_item_texts" if spec.backend.needs_items else None
    answered = call_model(reqs, spec.backend, "_prompt", items, policy=spec.policy, out="_resp")
    # land the answers with the packed rows only (no prompt, no second copy of the item text)
    answered = answered.select("_has", "batch_id", "n_items", "_resp",
                               F.transform("items", lambda x: F.named_struct(F.lit("item_id"), x["item_id"], F.lit("row"), x["row"])).alias("items"))
    if spec.land:
        answered = land(answered)
    r = F.col("_resp")
    style = "indexed" if spec.pack_format == "indexed" else "auto"
    parsed = P.with_pack_answers(answered, r["text"], "n_items", out="_parsed", style=style)
    exploded = parsed.select(
        F.col("_has"), F.col("batch_id"), F.col("_resp"), F.col("_parsed.method").alias("_method"),
        F.inline(F.transform("items", lambda x: F.named_struct(
            F.lit("item_id"), x["item_id"], F.lit("_row"), x["row"],
            F.lit("_answer"), P.answer_for(F.col("_parsed.answers"), x["item_id"]))))
    )
    if spec.use_json:
        exploded = P.with_parsed_response(exploded, "_answer", "_val", True, spec.json_fields, spec.accept_cut)
    ans = F.col("_answer")
    value = F.col("_val.value") if spec.use_json else ans
    failed = r["error"].isNotNull()
    unread = _unread(F.col("_val")) if spec.use_json else F.lit(False)
    status = (
        F.when(~F.col("_has"), F.lit("NO_DATA"))
        .when(failed | ans.isNull() | unread, F.lit("ERROR"))
        .otherwise(F.lit("OK"))
    )
    missing = F.when(ans.isNull(), P.pack_missing_message(F.col("_method"), style)).otherwise(value)
    message = F.when(failed, F.concat(F.lit(fixed.BATCH_ERROR_PREFIX), r["error"])).otherwise(missing)
    # of an item whose answer is missing, the whole pack's answer is kept
    raw = F.when(ans.isNull(), r["text"]).otherwise(ans)
    out = exploded.withColumn("result", _result(status, value, F.when(failed, r["error"]).otherwise(missing), F.col("_method"), raw, r))
    out = out.withColumn("_message", message)
    return out.select(
        *[F.col("_row")[c].alias(c) for c in cols],
        F.when(F.col("_has"), F.col("batch_id")).alias("batch_id"),
        F.when(F.col("_has"), F.col("item_id")).alias("item_id"),
        "result",
        _projected(F.col("result"), F.col("_message")).alias(fixed.RESULT_COLUMN),
    )


def enrich_distinct(df: DataFrame, spec: EnrichSpec) -> DataFrame:
    """Ask once per distinct item: identical rows share one answer (and one paid call).

    Items are keyed by ``sha2`` of their cleaned content; ``dropDuplicates`` is a
    partial aggregate, so a value repeated in a third of all rows collapses before
    the shuffle. Answers are joined back on the content key; a hot key is a skewed
    join that AQE splits (the answer side holds one row per key). Use only with a
    deterministic backend: with sampling, identical rows would otherwise differ.
    """
    from dataclasses import replace

    content = item_text(spec)
    keyed = df.withColumn("_ck", F.sha2(content, 256))
    distinct = keyed.select("_ck", *spec.columns).dropDuplicates(["_ck"])
    answers = enrich(distinct, replace(spec, key="_ck"))
    ans = answers.select("_ck", "result", F.col(fixed.RESULT_COLUMN).alias("_ai"))
    out = keyed.join(ans, on="_ck", how="left")
    return out.select(*df.columns, "result", F.col("_ai").alias(fixed.RESULT_COLUMN))


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """A stable key for Parquet input without one: ``file path : row index`` from the file metadata
    (the same for every run over the same files, unlike ``monotonically_increasing_id``)."""
    return df.withColumn(name, F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")))
