"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

Every query reads the driver's tables (or data Spark derives from them) in
full.  Where the fixture text cannot exercise an operator (the documents
contain no JSON, no tabs, no error words), a response/result column is
derived from ``doc_id`` by a SQL fragment that Spark and DuckDB evaluate
identically (``derived.py``); the oracle then states the expected answer.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.backends import FingerprintBackend
from ..operators.inference import RetryPolicy
from . import derived as D
from . import sql as S
from .enrich import EnrichSpec, enrich

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PROMPT = fixed.TEMPLATES["summarize"]
NO_SLEEP = RetryPolicy(sleep=False)


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def twins(spark: SparkSession, sf_dir: str, other: str, more: dict[str, str] | None = None) -> DataFrame:
    """Every document, untouched, under the id ``2 * doc_id``, and beside it a row with the text ``other`` under ``2 * doc_id + 1``;
    ``more``: further columns, by expressions over the document."""
    d = table(spark, sf_dir, "documents")
    extra = [F.expr(v).alias(k) for k, v in (more or {}).items()]
    own = d.select((F.col("doc_id") * 2).alias("doc_id"), "text", *extra)
    return own.unionByName(d.select((F.col("doc_id") * 2 + 1).alias("doc_id"), F.expr(other).alias("text"), *extra))


def _twins_sql(other: str, more: dict[str, str] | None = None) -> str:
    extra = "".join(f", {v} AS {k}" for k, v in (more or {}).items())
    return f"(SELECT doc_id * 2 AS doc_id, text{extra} FROM documents UNION ALL SELECT doc_id * 2 + 1, {other}{extra} FROM documents)"


def with_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and as many rows with nothing to send."""
    return twins(spark, sf_dir, D.BLANK_TEXT)


_DOCS = _twins_sql(D.BLANK_TEXT)


# ---------------------------------------------------------------------------
# flagship: documents -> clean -> prompt -> model (one row per call) -> result
# ---------------------------------------------------------------------------

def _has_sql(col: str) -> str:
    return f"({col} IS NOT NULL AND {S.clean(col)} <> '')"


@register(
    "enrich_single",
    f"""SELECT doc_id,
  CASE WHEN {_has_sql('text')} THEN 'OK' ELSE 'NO_DATA' END AS status,
  CASE WHEN {_has_sql('text')} THEN md5({S.prompt_single(PROMPT, S.clean('text'))}) ELSE {S.lit(fixed.NO_DATA)} END AS ai_result
FROM {_DOCS}""",
)
def enrich_single(spark, sf_dir):
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), policy=NO_SLEEP)
    out = enrich(with_blanks(spark, sf_dir), spec)
    return out.select("doc_id", F.col("result.status").alias("status"), F.col(fixed.RESULT_COLUMN).alias("ai_result"))


# ---------------------------------------------------------------------------
# packs: documents -> bucketed packs of 5 -> one request per pack -> keyed answers
# ---------------------------------------------------------------------------
#: Keys of a bucket where SQL must know each pack's members; the buckets grow with the keys.
BUCKET_WIDTH = 64
PACK = 5


def _pack_cte(src: str, key: str, text_sql: str, size: int = PACK, width: int | str | None = BUCKET_WIDTH, has_sql: str | None = None) -> str:
    """Oracle CTEs ``b`` (bucket, has), ``p`` (rank, batch_no, item_id, batch_id) for a packed table."""
    has = has_sql or f"({text_sql} IS NOT NULL AND {S.clean(text_sql)} <> '')"
    bucket = f"CAST({key} // {width} AS INTEGER)" if width else "0"
    return f"""b AS (SELECT *, {bucket} AS bucket, {has} AS has FROM {src}),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket, has ORDER BY {key}) - 1 AS rk FROM b),
p AS (SELECT *, rk // {size} AS batch_no, CAST(rk % {size} + 1 AS INTEGER) AS item_id,
             CAST(bucket AS BIGINT) * 4294967296 + rk // {size} AS batch_id FROM r)"""


def _packed_spec(fmt: str, **kw) -> EnrichSpec:
    backend = FingerprintBackend(response_format=fmt, omit_prefixes=kw.pop("omit", "f"), **kw.pop("backend_kw", {}))
    # bucket by key div width so the SQL check can recompute every pack's members
    return EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=backend, pack_size=PACK,
                      pack_format=fmt, bucket_width=BUCKET_WIDTH, bucket_fn="div", policy=NO_SLEEP, **kw)


def _packed_query(fmt: str):
    def q(spark, sf_dir):
        out = enrich(with_blanks(spark, sf_dir), _packed_spec(fmt))
        return out.select("doc_id", "batch_id", "item_id", F.col("result.status").alias("status"),
                          F.col(fixed.RESULT_COLUMN).alias("ai_result"))
    return q


def _packed_oracle(fmt: str) -> str:
    h = f"md5({S.clean('text')})"
    missing = {"indexed": fixed.PACK_PARSE_MISSING_SYNC, "items": fixed.PACK_PARSE_MISSING_ASYNC,
               "json": fixed.JSON_OBJECT_MISSING}[fmt]
    answer = f"""'{{"answer":"' || {h} || '"}}'""" if fmt == "json" else h
    return f"""WITH {_pack_cte(_DOCS, 'doc_id', 'text')},
q AS (SELECT *, count(*) OVER (PARTITION BY bucket, has, batch_no) AS n_items,
             count(*) FILTER (WHERE {h} NOT LIKE 'f%') OVER (PARTITION BY bucket, has, batch_no) AS n_present FROM p)
SELECT doc_id,
  CASE WHEN has THEN batch_id END AS batch_id,
  CASE WHEN has THEN item_id END AS item_id,
  CASE WHEN NOT has THEN 'NO_DATA' WHEN n_present = 0 OR {h} LIKE 'f%' THEN 'ERROR' ELSE 'OK' END AS status,
  CASE WHEN NOT has THEN {S.lit(fixed.NO_DATA)}
       WHEN n_present = 0 THEN {S.lit(fixed.BATCH_ERROR_PREFIX + fixed.EMPTY_RESPONSE)}
       WHEN {h} LIKE 'f%' THEN {S.lit(missing)}
       ELSE {answer} END AS ai_result
FROM q"""


for _fmt in ("indexed", "items", "json"):
    register(f"enrich_packed_{_fmt}", _packed_oracle(_fmt))(_packed_query(_fmt))


# ---------------------------------------------------------------------------
# projections, filters, predicates (PRJ / FLT)
# ---------------------------------------------------------------------------
from ..functions import prompts as PR  # noqa: E402
from ..functions import text as TX  # noqa: E402
from .enrich import pack_requests  # noqa: E402


def _messy(spark, sf_dir):
    return twins(spark, sf_dir, D.MESSY_TEXT).withColumnRenamed("text", "t")


_MESSY_SQL = f"(SELECT doc_id, text AS t FROM {_twins_sql(D.MESSY_TEXT)})"


@register("clean_text", f"""SELECT doc_id, md5({S.clean('t')}) AS clean_md5, CAST(length({S.clean('t')}) AS BIGINT) AS clean_len
FROM {_MESSY_SQL}""")
def q_clean_text(spark, sf_dir):
    c = TX.clean_text("t")
    return _messy(spark, sf_dir).select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("long").alias("clean_len"))


@register("tag_no_data", f"""SELECT doc_id, {_has_sql('t')} AS has_data,
  CASE WHEN {_has_sql('t')} THEN 'PENDING' ELSE 'NO_DATA' END AS status FROM {_MESSY_SQL}""")
def q_tag_no_data(spark, sf_dir):
    h = TX.has_data("t")
    return _messy(spark, sf_dir).select("doc_id", h.alias("has_data"), F.coalesce(TX.tag_no_data(h), F.lit("PENDING")).alias("status"))


_LEGACY_SQL = f"(SELECT doc_id, text, lang, source, {D.LEGACY_RESULT} AS ai_result FROM documents)"


def _legacy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.expr(D.LEGACY_RESULT).alias("ai_result"))


@register("pending_rows", f"SELECT doc_id FROM {_LEGACY_SQL} WHERE ai_result IS NULL OR ai_result = ''")
def q_pending(spark, sf_dir):
    return _legacy(spark, sf_dir).filter(TX.pending("ai_result")).select("doc_id")


_MESSY_ROLE = "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE role END"
_MESSY_TURN = "CASE WHEN turn % 3 = 0 THEN chr(9) || chr(10) WHEN turn % 3 = 1 THEN NULL ELSE text END"
_CONV_MESSY = f"""(SELECT conv_id * 2 AS conv_id, turn, role, text FROM conversations
  UNION ALL SELECT conv_id * 2 + 1, turn, {_MESSY_ROLE}, {_MESSY_TURN} FROM conversations)"""


def _conv_messy(spark, sf_dir):
    """Every turn, untouched, and beside it (in a conversation of its own) one with columns left out or blank."""
    c = table(spark, sf_dir, "conversations")
    own = c.select((F.col("conv_id") * 2).alias("conv_id"), "turn", "role", "text")
    return own.unionByName(c.select((F.col("conv_id") * 2 + 1).alias("conv_id"), "turn", F.expr(_MESSY_ROLE).alias("role"), F.expr(_MESSY_TURN).alias("text")))


@register("has_any_data", f"""SELECT conv_id, turn,
  ((role IS NOT NULL AND {S.strip('role')} <> '') OR (text IS NOT NULL AND {S.strip('text')} <> '')) AS has_any
FROM {_CONV_MESSY}""")
def q_has_any(spark, sf_dir):
    return _conv_messy(spark, sf_dir).select("conv_id", "turn", TX.has_any_data(["role", "text"]).alias("has_any"))


@register("preview_text", """SELECT doc_id, substr(text, 1, 100) || '...' AS prompt_preview,
  CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS sample FROM documents""")
def q_preview(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.preview("text", 100).alias("prompt_preview"), TX.preview("text", 50, always_ellipsis=False).alias("sample"))


@register("as_item", f"""SELECT conv_id, turn, md5('role=' || coalesce(role, 'N/A') || '|text=' || coalesce(text, 'N/A')) AS item_md5
FROM {_CONV_MESSY}""")
def q_as_item(spark, sf_dir):
    item = TX.as_item(["role", "text"])
    rendered = F.array_join(F.transform(item, lambda x: F.concat(x["name"], F.lit("="), x["value"])), "|")
    return _conv_messy(spark, sf_dir).select("conv_id", "turn", F.md5(rendered).alias("item_md5"))


_PROFILE_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _profile_sql() -> str:
    parts = []
    for c in _PROFILE_COLS:
        v = f"CAST(arg_min({c}, c_custkey) FILTER (WHERE {c} IS NOT NULL) AS VARCHAR)"
        parts.append(f"""SELECT '{c}' AS column_name, count(*) AS n_rows,
  coalesce(CASE WHEN length({v}) > 50 THEN substr({v}, 1, 50) || '...' ELSE {v} END, 'N/A') AS sample FROM customer""")
    return "\nUNION ALL\n".join(parts)


@register("profile_columns", _profile_sql())
def q_profile(spark, sf_dir):
    from ..operators.columns import profile_columns

    return profile_columns(table(spark, sf_dir, "customer"), "c_custkey", _PROFILE_COLS)


# ---------------------------------------------------------------------------
# prompts (PRM)
# ---------------------------------------------------------------------------
_TEMPLATE_NAMES = list(fixed.TEMPLATES)


def _template_case_sql(key: str) -> str:
    whens = " ".join(f"WHEN {key} % {len(_TEMPLATE_NAMES)} = {i} THEN {S.lit(fixed.TEMPLATES[n])}" for i, n in enumerate(_TEMPLATE_NAMES))
    return f"(CASE {whens} END)"


_ODD_PROMPT = "CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN chr(32) || chr(9) WHEN doc_id % 4 = 2 THEN lang || ' ok' ELSE source || ' long enough' END"


@register("validate_prompt", f"""WITH c AS (SELECT doc_id, text AS p FROM {_twins_sql(_ODD_PROMPT)})
SELECT doc_id, CASE WHEN {S.strip('p')} = '' THEN false WHEN length({S.strip('p')}) < 10 THEN false ELSE true END AS ok,
  CASE WHEN {S.strip('p')} = '' THEN {S.lit(fixed.PROMPT_EMPTY)} WHEN length({S.strip('p')}) < 10 THEN {S.lit(fixed.PROMPT_TOO_SHORT)}
  ELSE {S.lit(fixed.PROMPT_OK)} END AS message FROM c""")
def q_validate_prompt(spark, sf_dir):
    d = twins(spark, sf_dir, _ODD_PROMPT).withColumnRenamed("text", "p")
    v = PR.validate_prompt("p")
    return d.select("doc_id", v["ok"].alias("ok"), v["message"].alias("message"))


@register("prompt_single", f"""SELECT doc_id, md5({_template_case_sql('doc_id')} || {S.lit(chr(10) * 2 + fixed.CONTENT_HEADER + chr(10))}
  || {S.clean('text')} || {S.lit(chr(10) * 2 + fixed.RESULT_FOOTER)}) AS prompt_md5 FROM documents""")
def q_prompt_single(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(PR.template(n)) for n in _TEMPLATE_NAMES])
    tpl = F.element_at(names, (F.pmod(F.col("doc_id"), F.lit(len(_TEMPLATE_NAMES))) + 1).cast("int"))
    return d.select("doc_id", F.md5(PR.prompt_single(tpl, TX.clean_text("text"))).alias("prompt_md5"))


_MULTI_COLS = ["role", "turn", "text"]
_MPROMPT = fixed.TEMPLATES["custom"]


def _defs_sql(cols) -> str:
    return chr(10).join(f"- {fixed.COLUMN_WORD} {i} ({c}): {c}" for i, c in enumerate(cols, 1))


def _multi_sync_sql(double: bool) -> str:
    data = " || chr(10) || ".join(f"'{i}. {c}: ' || {S.clean(f'coalesce(CAST({c} AS VARCHAR), {S.lit(fixed.MISSING_VALUE)})')}"
                                  for i, c in enumerate(_MULTI_COLS, 1))
    head = S.lit(chr(10) + _MPROMPT + chr(10) * 2 + fixed.COLUMNS_HEADER + chr(10) + _defs_sql(_MULTI_COLS) + chr(10) * 2 + fixed.DATA_HEADER + chr(10))
    full = f"{head} || {data} || {S.lit(chr(10) * 2 + fixed.RESULT_FOOTER)}"
    if double:
        full = f"{full} || {S.lit(chr(10) * 2 + fixed.CONTENT_HEADER + chr(10) + chr(10) * 2 + fixed.RESULT_FOOTER)}"
    return f"SELECT conv_id, turn, md5({full}) AS prompt_md5 FROM {_CONV_MESSY}"


@register("prompt_multi_sync", _multi_sync_sql(False))
def q_prompt_multi_sync(spark, sf_dir):
    return _conv_messy(spark, sf_dir).select("conv_id", "turn", F.md5(PR.prompt_multi_sync(_MPROMPT, _MULTI_COLS)).alias("prompt_md5"))


@register("prompt_multi_sync_legacy", _multi_sync_sql(True))
def q_prompt_multi_sync_legacy(spark, sf_dir):
    p = PR.prompt_multi_sync(_MPROMPT, _MULTI_COLS, legacy_double_wrap=True)
    return _conv_messy(spark, sf_dir).select("conv_id", "turn", F.md5(p).alias("prompt_md5"))


def _multi_async_sql() -> str:
    data = " || chr(10) || ".join(f"'{i}. {c}: ' || coalesce(CAST({c} AS VARCHAR), {S.lit(fixed.MISSING_VALUE)})" for i, c in enumerate(_MULTI_COLS, 1))
    full = f"{S.lit(_MPROMPT + chr(10) * 2 + fixed.DATA_HEADER + chr(10))} || {data} || {S.lit(chr(10) * 2 + fixed.RESULT_FOOTER)}"
    return f"SELECT conv_id, turn, md5({full}) AS prompt_md5 FROM {_CONV_MESSY}"


@register("prompt_multi", _multi_async_sql())
def q_prompt_multi(spark, sf_dir):
    return _conv_messy(spark, sf_dir).select("conv_id", "turn", F.md5(PR.prompt_multi(_MPROMPT, _MULTI_COLS)).alias("prompt_md5"))


# pack prompts ------------------------------------------------------------------


def _pack_prompt_query(fmt: str, multi: bool):
    def q(spark, sf_dir):
        if multi:
            src, width = _conv_keyed(spark, sf_dir)
            spec = EnrichSpec(prompt=_MPROMPT, columns=tuple(_MULTI_COLS), key="row_key", backend=FingerprintBackend(),
                              pack_size=PACK, pack_format=fmt, bucket_width=width, bucket_fn="div")
        else:
            src = table(spark, sf_dir, "documents").select("doc_id", "text")
            spec = _packed_spec(fmt)
        reqs = pack_requests(src, spec).filter("_has")
        return reqs.select("batch_id", "n_items", F.md5("_prompt").alias("prompt_md5"))
    return q


def _conv_keyed(spark, sf_dir):
    """The turns with a key of their own: there is room for every turn of a conversation.  A bucket holds 16 conversations."""
    turns = (table(spark, sf_dir, "conversations").agg(F.max("turn")).first()[0] or 0) + 1
    return _conv_messy(spark, sf_dir).withColumn("row_key", F.col("conv_id") * turns + F.col("turn")), 16 * turns


_TURNS = "(SELECT max(turn) + 1 FROM conversations)"
_CONV_WIDTH = f"(16 * {_TURNS})"
_CONV_KEYED_SQL = f"(SELECT *, conv_id * {_TURNS} + turn AS row_key FROM {_CONV_MESSY})"


def _fill_sql(text: str, n: str = "CAST(count(*) AS VARCHAR)") -> str:
    parts = text.replace("{{", "{").replace("}}", "}").split("{n}")
    out = [S.lit(parts[0])]
    for p in parts[1:]:
        out += [n, S.lit(p)]
    return " || ".join(out)


def _pack_prompt_oracle(fmt: str, multi: bool) -> str:
    nl2 = f"{S.NL} || {S.NL}"
    if multi:
        cols = _MULTI_COLS
        vals_clean = " || chr(10) || ".join(
            f"'  {j}. {c}: ' || {S.clean(f'coalesce(CAST({c} AS VARCHAR), {S.lit(fixed.MISSING_VALUE)})')}" for j, c in enumerate(cols, 1))
        vals_raw = " || chr(10) || ".join(f"'  {c}: ' || coalesce(CAST({c} AS VARCHAR), {S.lit(fixed.MISSING_VALUE)})" for c in cols)
        has = "(" + " OR ".join(f"({c} IS NOT NULL AND {S.strip(f'CAST({c} AS VARCHAR)')} <> '')" for c in cols) + ")"
        cte = _pack_cte(_CONV_KEYED_SQL, "row_key", "text", width=_CONV_WIDTH, has_sql=has)
        block_idx = f"'[' || item_id || ']' || chr(10) || {vals_clean}"
        block_items = f"'Item ' || item_id || ':' || chr(10) || {vals_raw}"
        prompt = _MPROMPT
    else:
        cte = _pack_cte("documents", "doc_id", "text")
        # pack items are cleaned when rows are picked and again while rendering (as the original does)
        block_idx = f"'[' || item_id || '] ' || {S.clean(S.clean('text'))}"
        block_items = f"'Item ' || item_id || ': ' || {S.clean('text')}"
        prompt = PROMPT
    if fmt == "indexed":
        head = S.lit(prompt + chr(10) * 2 + (fixed.COLUMNS_HEADER + chr(10) + _defs_sql(_MULTI_COLS) + chr(10) * 2 if multi else "")
                     + fixed.BATCH_GUIDE_HEADER + chr(10))
        guide = _fill_sql(fixed.BATCH_GUIDE_COUNT + chr(10))
        if multi:
            guide += " || " + S.lit(fixed.BATCH_GUIDE_COLUMNS.replace("{c}", str(len(_MULTI_COLS))) + chr(10))
        guide += " || " + S.lit(fixed.BATCH_GUIDE_ORDER + chr(10) + fixed.BATCH_GUIDE_FORMAT + chr(10) * 2 + fixed.DATA_HEADER + chr(10))
        body = f"string_agg({block_idx}, {nl2} ORDER BY item_id)"
        full = f"{head} || {guide} || {body} || {S.lit(chr(10) * 2 + fixed.RESULT_FOOTER_UPPER)}"
    else:
        head = f"{S.lit(prompt + chr(10) * 2)} || {_fill_sql(fixed.ITEMS_HEADER + chr(10))}"
        body = f"string_agg({block_items}, {nl2} ORDER BY item_id)"
        if fmt == "json":
            tail = _fill_sql(fixed.ITEMS_JSON_INSTRUCTION)
        else:
            tail = f"{_fill_sql(fixed.ITEMS_TEXT_INSTRUCTION)} || {S.lit(chr(10) * 2 + fixed.RESULT_FOOTER)}"
        full = f"{head} || {body} || {S.lit(chr(10) * 2)} || {tail}"
    return f"""WITH {cte}
SELECT batch_id, CAST(count(*) AS INTEGER) AS n_items, md5({full}) AS prompt_md5 FROM p WHERE has GROUP BY batch_id"""


for _fmt, _multi, _name in [("indexed", False, "prompt_pack_indexed"), ("indexed", True, "prompt_pack_indexed_multi"),
                            ("items", False, "prompt_pack_items"), ("json", False, "prompt_pack_items_json"),
                            ("items", True, "prompt_pack_items_multi")]:
    register(_name, _pack_prompt_oracle(_fmt, _multi))(_pack_prompt_query(_fmt, _multi))


# request bodies ------------------------------------------------------------------


@register("payload_gemini", f"""SELECT doc_id, md5({S.prompt_single(PROMPT, S.clean('text'))}) AS text_md5, '40' AS top_k,
  '0.8' AS top_p, '30000' AS max_tokens, 'BLOCK_NONE' AS last_threshold FROM documents""")
def q_payload_gemini(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    body = PR.payload_gemini(PR.prompt_single(PROMPT, TX.clean_text("text")))
    g = lambda p: F.get_json_object(body, p)
    return d.select("doc_id", F.md5(g("$.contents[0].parts[0].text")).alias("text_md5"), g("$.generationConfig.topK").alias("top_k"),
                    g("$.generationConfig.topP").alias("top_p"), g("$.generationConfig.maxOutputTokens").alias("max_tokens"),
                    g("$.safetySettings[3].threshold").alias("last_threshold"))


@register("payload_openai", f"""SELECT doc_id, md5({S.prompt_single(PROMPT, S.clean('text'))}) AS content_md5, 'gpt-4.1-mini' AS model,
  'user' AS role, '0.3' AS temperature, '10000' AS max_tokens FROM documents""")
def q_payload_openai(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    body = PR.payload_openai("gpt-4.1-mini", PR.prompt_single(PROMPT, TX.clean_text("text")))
    g = lambda p: F.get_json_object(body, p)
    return d.select("doc_id", F.md5(g("$.messages[0].content")).alias("content_md5"), g("$.model").alias("model"),
                    g("$.messages[0].role").alias("role"), g("$.temperature").alias("temperature"), g("$.max_tokens").alias("max_tokens"))


# fine-tuned context templates (registry rows derived per document)
_CTX_TEMPLATE = "(CASE WHEN doc_id % 3 = 0 THEN 'Input: {input_text}' || chr(10) || 'Ctx: {context_info}' " \
                "WHEN doc_id % 3 = 1 THEN '{message} / {metadata} / {content} / {input_data} / {additional_context} / {context_data}' ELSE '' END)"
_CTX_REQUIRES = "(doc_id % 4 <> 3)"


def _ctx_sql() -> str:
    out = _CTX_TEMPLATE
    t = S.clean("text")
    for name in fixed.TEXT_PLACEHOLDERS:
        out = f"replace({out}, '{{{name}}}', {t})"
    for name in fixed.PROMPT_PLACEHOLDERS:
        out = f"replace({out}, '{{{name}}}', {S.lit(PROMPT)})"
    return out


@register("prompt_from_context", f"""SELECT doc_id, md5(CASE WHEN {_CTX_REQUIRES} AND {_CTX_TEMPLATE} <> '' THEN {_ctx_sql()}
  ELSE {S.prompt_single(PROMPT, S.clean('text'))} END) AS prompt_md5 FROM documents""")
def q_prompt_from_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_CTX_TEMPLATE).alias("tpl"), F.expr(_CTX_REQUIRES).alias("req"))
    p = PR.prompt_with_registry("tpl", "req", TX.clean_text("text"), PROMPT)
    return d.select("doc_id", F.md5(p).alias("prompt_md5"))


# ---------------------------------------------------------------------------
# response parsing (PAR) and provider bodies (INF6)
# ---------------------------------------------------------------------------
from ..functions import parsing as PA  # noqa: E402


def _derived(spark, sf_dir, frag: str, name: str = "r"):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.expr(frag).alias(name))


def _by_case(n: int, values: list[str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN doc_id % {n} = {i} THEN {v}" for i, v in enumerate(values))
    return f"(CASE {whens} ELSE {default} END)"


_A, _B, _C = "md5(text)", "lang", "source"


def _answers3(ans):
    return [PA.answer_for(ans, F.lit(i)).alias(f"a{i}") for i in (1, 2, 3)]


@register("parse_indexed", f"""SELECT doc_id,
  {_by_case(5, [_A, f"{_A} || ' more [x] note'", _A])} AS a1,
  {_by_case(5, [_B, 'NULL', _B, _B])} AS a2,
  {_by_case(5, [_C, _C, 'NULL', _C])} AS a3 FROM documents""")
def q_parse_indexed(spark, sf_dir):
    d = _derived(spark, sf_dir, D.INDEXED_RESPONSE)
    return d.select("doc_id", *_answers3(PA.parse_indexed("r")))


@register("parse_numbered", f"""SELECT doc_id,
  {_by_case(5, [_A, _A, _A, f"{_A} || chr(10) || 'more'"])} AS a1,
  {_by_case(5, [_B, _B, _B, _B])} AS a2,
  {_by_case(5, [_C, _C, _C, _C])} AS a3 FROM documents""")
def q_parse_numbered(spark, sf_dir):
    d = _derived(spark, sf_dir, D.NUMBERED_RESPONSE)
    return d.select("doc_id", *_answers3(PA.parse_numbered("r", 3)))


def _jans(x):
    return f"""'{{"answer":"' || {x} || '"}}'"""


_PACK_METHODS = ["json_array", "json_objects", "numbered", "delimited", "sentences", "empty", "empty_api", "numbered", "delimited", "json_objects",
                 "json_array", "json_array", "unparsed"]
_PACK_A = [_jans(_A), _jans(_A), _A, f"'first answer ' || {_A}", f"'Alpha ' || {_A} || '.'", "NULL", "NULL", "NULL", _A, "NULL", _jans(_A), "NULL", "NULL"]
_PACK_B = [_jans(_B), "NULL", _B, f"'second answer ' || {_B}", f"'Beta ' || {_B} || '.'", "NULL", "NULL", "NULL", "'No'", "NULL", _jans(_B), "NULL", "NULL"]
_PACK_C = [_jans(_C), _jans(_C), _C, f"'third answer ' || {_C}", f"'Gamma ' || {_C}", "NULL", "NULL", _C, _C, _jans(_C), _jans(_C), "NULL", "NULL"]
_PACK_N = len(_PACK_METHODS) + 1


@register("parse_pack", f"""SELECT doc_id,
  {_by_case(_PACK_N, [S.lit(m) for m in _PACK_METHODS], S.lit('unparsed'))} AS method,
  {_by_case(_PACK_N, _PACK_A)} AS a1, {_by_case(_PACK_N, _PACK_B)} AS a2, {_by_case(_PACK_N, _PACK_C)} AS a3 FROM documents""")
def q_parse_pack(spark, sf_dir):
    d = PA.with_pack_answers(_derived(spark, sf_dir, D.PACK_RESPONSE), "r", 3, out="p")
    return d.select("doc_id", F.col("p.method").alias("method"), *_answers3(F.col("p.answers")))


def _reconcile_sql() -> str:
    msg = {"empty": fixed.EMPTY_PACK_RESPONSE, "empty_api": fixed.EMPTY_PACK_API, "json_objects": fixed.JSON_OBJECT_MISSING,
           "json_array": fixed.JSON_OBJECT_MISSING, "unparsed": "UNPARSED"}
    miss = _by_case(_PACK_N, [S.lit(msg.get(m, fixed.PACK_PARSE_MISSING_ASYNC)) for m in _PACK_METHODS], S.lit("UNPARSED"))
    parts = []
    for i, vals in ((1, _PACK_A), (2, _PACK_B), (3, _PACK_C)):
        v = _by_case(_PACK_N, vals)
        parts.append(f"""SELECT doc_id, CAST({i} AS INTEGER) AS item_id, CASE WHEN {v} IS NULL THEN 'ERROR' ELSE 'OK' END AS status,
  coalesce({v}, {miss}) AS ai_result FROM documents""")
    return "\nUNION ALL\n".join(parts)


@register("reconcile_pack", _reconcile_sql())
def q_reconcile(spark, sf_dir):
    d = PA.with_pack_answers(_derived(spark, sf_dir, D.PACK_RESPONSE), "r", 3, out="p")
    p = d.select("doc_id", "p", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("item_id"))
    ans = PA.answer_for(F.col("p.answers"), F.col("item_id"))
    return p.select("doc_id", F.col("item_id").cast("int").alias("item_id"),
                    F.when(ans.isNull(), "ERROR").otherwise("OK").alias("status"),
                    F.coalesce(ans, PA.pack_missing_message(F.col("p.method"), "auto")).alias("ai_result"))


def _gem_err():
    return [S.lit(x) for x in ["NULL", fixed.API_MISSING_CANDIDATES, fixed.API_EMPTY_CANDIDATES, fixed.API_MISSING_CONTENT,
                               fixed.API_MISSING_PARTS, fixed.API_EMPTY_PARTS]]


@register("response_text_gemini", f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(text) END AS text_out,
  {_by_case(7, ['NULL'] + _gem_err()[1:], S.lit(fixed.EMPTY_RESPONSE))} AS error FROM documents""")
def q_response_gemini(spark, sf_dir):
    d = _derived(spark, sf_dir, D.GEMINI_BODY)
    r = PA.response_text("r", "gemini")
    return d.select("doc_id", r["text"].alias("text_out"), r["error"].alias("error"))


@register("response_text_openai", f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) END AS text_out,
  CASE WHEN doc_id % 3 = 1 THEN {S.lit(fixed.EMPTY_RESPONSE)} WHEN doc_id % 3 = 2 THEN 'Parse error: ''choices''' END AS error
FROM documents""")
def q_response_openai(spark, sf_dir):
    d = _derived(spark, sf_dir, D.OPENAI_BODY)
    r = PA.response_text("r", "openai")
    return d.select("doc_id", r["text"].alias("text_out"), r["error"].alias("error"))


# single JSON answers -----------------------------------------------------------
_J_OBJ = [D.J_OK, D.J_PROSE, D.J_BARE, "NULL", D.J_FENCED, D.J_TRAILING, D.J_OTHER, "NULL", "NULL"]


@register("extract_json", f"SELECT doc_id, {_by_case(10, _J_OBJ, D.J_NUMBER)} AS json_text FROM documents")
def q_extract_json(spark, sf_dir):
    return _derived(spark, sf_dir, D.JSON_RESPONSE).select("doc_id", PA.extract_json("r").alias("json_text"))


@register("brace_span", f"""SELECT doc_id, {_by_case(5, [f"'{{\"a\": {{\"b\": \"' || lang || '\"}}}}'", "'{\"a\": \"}'", D.BRACE_TEXT, 'NULL'], D.BRACE_TEXT)}
  AS span FROM documents""")
def q_brace_span(spark, sf_dir):
    return _derived(spark, sf_dir, D.BRACE_TEXT).select("doc_id", PA.brace_span("r").alias("span"))


_REPAIRED = [
    """'{"k":"' || lang || '"}'""",
    """'{"k":"' || lang || '","n":null,"b":true,"c":false}'""",
    """'{"k":"' || lang || '","m":1}'""",
    """'{"url":"http://' || source || '","at":"12:30"}'""",
    """'{"k":"' || lang || '","list":[1,2]}'""",
    """'{"k":"it' || chr(39) || 's ' || lang || ', None: True /* kept */","v":null}'""",
    "NULL",
]


@register("repair_json", f"""SELECT doc_id, {_by_case(8, _REPAIRED, "'{\"k\":null,\"v\":null}'")} AS repaired FROM documents""")
def q_repair_json(spark, sf_dir):
    return _derived(spark, sf_dir, D.REPAIR_TEXT).select("doc_id", PA.repair_json("r").alias("repaired"))


_CLOSED = [
    f"""'{{"k": "' || lang || '", "h": "' || {D.H} || '"}}'""",
    f"""'{{"k": {{"h": "a }} b ' || {D.H} || '"}}}}'""",
    """'{"k": [{"h": [' || CAST(doc_id AS STRING) || ']}]}'""",
    """'{"k": "' || lang || '"}'""",
    """'{"k": "' || lang || '"}'""",
    """'{"k":"' || lang || '","n":null}'""",
    """'{"k":"' || lang || '","l":[1,2]}'""",
    """'{"k": "' || lang || '"}'""",
    "NULL",
]


_CLOSED_DEEP = f"""repeat('{{"k":[', CAST(1 + doc_id % 20 AS INTEGER)) || '"' || {D.H} || '"' || repeat(']}}', CAST(1 + doc_id % 20 AS INTEGER))"""


@register("repair_cut", f"SELECT doc_id, {_by_case(10, _CLOSED, _CLOSED_DEEP)} AS repaired, doc_id % 10 NOT IN (7, 8) AS cut FROM documents")
def q_repair_cut(spark, sf_dir):
    return PA.with_json_object(_derived(spark, sf_dir, D.CUT_TEXT), "r", "repaired", "cut").select("doc_id", "repaired", "cut")


_REQ = "; ".join(f"'{f}' is a required property" for f in fixed.RESULT_FIELDS)


@register("json_schema_check", f"""SELECT doc_id,
  {_by_case(10, ['true', 'true', 'true', 'false', 'true', 'true', 'false', 'false', 'false'], 'true')} AS applies,
  {_by_case(10, ["''", "''", "''", 'NULL', "''", "''", S.lit(_REQ.replace('; ', ';')), 'NULL', 'NULL'],
            S.lit("'note_1' is not of type 'string', 'null'"))} AS violations FROM documents""")
def q_json_schema_check(spark, sf_dir):
    d = PA.with_json_object(_derived(spark, sf_dir, D.JSON_RESPONSE), "r", "obj")
    return d.select("doc_id", F.coalesce(PA.schema_applies("obj"), F.lit(False)).alias("applies"),
                    F.when(F.col("obj").isNotNull(), F.array_join(PA.schema_violations("obj"), ";")).alias("violations"))


_PIPED = [
    "lang || '|' || source || '|Review|t' || CAST(doc_id AS STRING) || '|2'",
    "lang || '|null|delivery|it is 12:30|ok'",
    "lang || '|' || source || '|at 9:45|x|null'",
    "NULL",
    "lang || '|p|s|null|null'",
    "lang || '|p|s|t|n'",
    """'{"AI_SACTHAI":"' || lang || '","AI_TOPICS":["a","b"]}'""",
    "NULL",
    "NULL",
]
_J_NUMBER_OUT = """'{"category":"' || lang || '","product":"p","service":"s","tag":"t","note_1":2}'"""


@register("json_to_text", f"SELECT doc_id, {_by_case(10, _PIPED, _J_NUMBER_OUT)} AS result_text FROM documents")
def q_json_to_text(spark, sf_dir):
    d = PA.with_json_text(PA.with_json_object(_derived(spark, sf_dir, D.JSON_RESPONSE), "r", "obj"), "obj", "result_text")
    return d.select("doc_id", "result_text")


_MEANINGFUL = [D.J_OK, f"'The record below was read twice.' || chr(10) || {D.J_PROSE} || chr(10) || '-- end of record'", D.J_BARE, D.J_PIPE, D.J_FENCED,
               D.J_TRAILING, D.J_OTHER, "NULL", "NULL"]


@register("meaningful_text", f"SELECT doc_id, {_by_case(10, _MEANINGFUL, D.J_NUMBER)} AS text_out FROM documents")
def q_meaningful_text(spark, sf_dir):
    return _derived(spark, sf_dir, D.JSON_RESPONSE).select("doc_id", PA.meaningful_text("r").alias("text_out"))


_PARSED = list(_PIPED)
_PARSED[3] = D.J_PIPE
_PARSED[7] = S.lit(fixed.NO_RESPONSE)
_PARSED[8] = f"{S.lit(fixed.JSON_PARSE_FAILED_PREFIX)} || '```json' || chr(10) || '```'"
_PARSE_METHOD = ["'json'", "'json'", "'json'", "'text_fallback'", "'json'", "'json'", "'json'", "'empty'", "'failed'"]


@register("parse_response_json", f"""SELECT doc_id, {_by_case(10, _PARSED, _J_NUMBER_OUT)} AS ai_result,
  {_by_case(10, _PARSE_METHOD, "'json'")} AS method FROM documents""")
def q_parse_response_json(spark, sf_dir):
    d = PA.with_parsed_response(_derived(spark, sf_dir, D.JSON_RESPONSE), "r", "p", use_json=True)
    return d.select("doc_id", F.col("p.value").alias("ai_result"), F.col("p.method").alias("method"))


@register("parse_response_text", f"""SELECT doc_id, CASE WHEN r = '' THEN {S.lit(fixed.NO_RESPONSE)} ELSE {S.strip('r')} END AS ai_result
FROM (SELECT doc_id, {D.JSON_RESPONSE} AS r FROM documents)""")
def q_parse_response_text(spark, sf_dir):
    p = PA.parse_text("r")
    return _derived(spark, sf_dir, D.JSON_RESPONSE).select("doc_id", p["value"].alias("ai_result"))


_PIPE_RESULT = "CASE WHEN doc_id % 2 = 0 THEN lang || '|' || source ELSE lang || '|' || source || '|Review|tag|' || CAST(doc_id AS STRING) END"


@register("split_fields", """SELECT doc_id, lang AS category, source AS product,
  CASE WHEN doc_id % 2 = 1 THEN 'Review' END AS service, CASE WHEN doc_id % 2 = 1 THEN 'tag' END AS tag,
  CASE WHEN doc_id % 2 = 1 THEN CAST(doc_id AS VARCHAR) END AS note_1 FROM documents""")
def q_split_fields(spark, sf_dir):
    d = _derived(spark, sf_dir, _PIPE_RESULT)
    s = PA.split_fields("r", fixed.RESULT_FIELDS)
    return d.select("doc_id", *[s[f].alias(f) for f in fixed.RESULT_FIELDS])


_LABELLED = "'Sentiment: Tích cực | Chủ đề: Review | Tóm tắt: ' || lang || ': ' || source || ' | Sentiment: twice | Ghi chú: ' || CAST(doc_id AS STRING)"


@register("parse_labelled", """SELECT doc_id, 'Tích cực' AS sentiment, 'Review' AS topic, lang || ': ' || source AS summary,
  CAST(doc_id AS VARCHAR) AS note FROM documents""")
def q_parse_labelled(spark, sf_dir):
    m = PA.parse_labelled("r")
    d = _derived(spark, sf_dir, _LABELLED)
    return d.select("doc_id", m["Sentiment"].alias("sentiment"), m["Chủ đề"].alias("topic"), m["Tóm tắt"].alias("summary"),
                    m["Ghi chú"].alias("note"))


# ---------------------------------------------------------------------------
# packing, chunking, pack quality (BAT)
# ---------------------------------------------------------------------------
from ..operators import packing as PK  # noqa: E402
from ..operators import quality as QU  # noqa: E402
from ..streaming import incremental as INC  # noqa: E402
from ..streaming import runlog as RL  # noqa: E402
from ..session import checkpoint_dir  # noqa: E402
from .retry import enrich_with_fallback, retry_failed  # noqa: E402


@register("pack_bucketed", f"""WITH {_pack_cte('documents', 'doc_id', 'text', has_sql='true')}
SELECT doc_id, bucket, batch_id, item_id FROM p""")
def q_pack_bucketed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return PK.pack(d, "doc_id", PACK, bucket_width=BUCKET_WIDTH, bucket_fn="div").select("doc_id", "bucket", "batch_id", "item_id")


@register("pack_ordered", f"""WITH {_pack_cte('documents', 'doc_id', 'text', width=None, has_sql='true')}
SELECT doc_id, batch_id, item_id FROM p""")
def q_pack_ordered(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return PK.pack(d, "doc_id", PACK, mode="ordered").select("doc_id", "batch_id", "item_id")


@register("chunk_rows", """SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS chunk_id FROM events""")
def q_chunk_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return PK.chunk(e, "event_id", fixed.CHUNK_SIZE).select("event_id", "chunk_id")


_OMIT_HALF = "01234567"


@register("pack_quality", f"""WITH {_pack_cte('documents', 'doc_id', 'text')}
SELECT batch_id, count(*) AS n_items,
  count(*) FILTER (WHERE substr(md5({S.clean('text')}), 1, 1) NOT IN ('0','1','2','3','4','5','6','7')) AS n_ok,
  count(*) FILTER (WHERE substr(md5({S.clean('text')}), 1, 1) NOT IN ('0','1','2','3','4','5','6','7')) < count(*) * CAST(0.3 AS DOUBLE) AS low_quality
FROM p WHERE has GROUP BY batch_id""")
def q_pack_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = enrich(docs, _packed_spec("indexed", omit=_OMIT_HALF))
    return QU.pack_quality(out)


# ---------------------------------------------------------------------------
# model application: retries in the task, outcome record, row fallback (INF)
# ---------------------------------------------------------------------------
_PMD5 = f"md5({S.prompt_single(PROMPT, S.clean('text'))})"


@register("enrich_retry", f"""SELECT doc_id,
  CASE WHEN {_PMD5} LIKE '2%' THEN 'ERROR' ELSE 'OK' END AS status,
  CAST(CASE WHEN {_PMD5} LIKE '2%' THEN 3 WHEN {_PMD5} LIKE '0%' OR {_PMD5} LIKE '1%' THEN 2 ELSE 1 END AS INTEGER) AS attempts,
  {_PMD5} NOT LIKE '2%' AS success,
  CAST(CASE WHEN {_PMD5} LIKE '2%' THEN 2 WHEN {_PMD5} LIKE '0%' OR {_PMD5} LIKE '1%' THEN 1 ELSE 0 END AS INTEGER) AS retry_count,
  CASE WHEN {_PMD5} LIKE '2%' THEN {S.lit(fixed.ERROR_AFTER_RETRIES.format(n=3))} ELSE {_PMD5} END AS ai_result
FROM documents""")
def q_enrich_retry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    backend = FingerprintBackend(fail_prefixes="01", fail_attempts=1, dead_prefixes="2")
    out = enrich(docs, EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=backend, policy=NO_SLEEP))
    return out.select("doc_id", F.col("result.status").alias("status"), F.col("result.attempts").alias("attempts"),
                      (F.col("result.status") == "OK").alias("success"), (F.col("result.attempts") - 1).alias("retry_count"),
                      F.col(fixed.RESULT_COLUMN).alias("ai_result"))


@register("enrich_fallback", f"""WITH {_pack_cte('documents', 'doc_id', 'text')},
q AS (SELECT *, bool_or(md5({S.clean('text')}) LIKE 'e%') OVER (PARTITION BY bucket, has, batch_no) AS poisoned FROM p)
SELECT doc_id, CASE WHEN has AND poisoned THEN 'row' ELSE 'pack' END AS via,
  CASE WHEN NOT has THEN 'NO_DATA' ELSE 'OK' END AS status,
  CASE WHEN NOT has THEN {S.lit(fixed.NO_DATA)} WHEN poisoned THEN {_PMD5} ELSE md5({S.clean('text')}) END AS ai_result FROM q""")
def q_enrich_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spec = _packed_spec("indexed", omit="", backend_kw={"poison_item_prefixes": "e"})
    out = enrich_with_fallback(docs, spec)
    return out.select("doc_id", "via", F.col("result.status").alias("status"), F.col(fixed.RESULT_COLUMN).alias("ai_result"))


# ---------------------------------------------------------------------------
# statistics and error markers (AGG)
# ---------------------------------------------------------------------------

def _markers_sql(markers) -> str:
    return "|".join(m.lower() for m in markers)


_ERR_STATS = f"coalesce(regexp_matches(lower(ai_result), '{_markers_sql(fixed.STATS_ERROR_MARKERS)}'), false)"
_ERR_RETRY = f"coalesce(regexp_matches(lower(ai_result), '{_markers_sql(fixed.RETRY_ERROR_MARKERS)}'), false)"


@register("is_error", f"SELECT doc_id, {_ERR_STATS} AS error_stats, {_ERR_RETRY} AS error_retry FROM {_LEGACY_SQL}")
def q_is_error(spark, sf_dir):
    d = _legacy(spark, sf_dir)
    return d.select("doc_id", QU.is_error("ai_result", "stats").alias("error_stats"), QU.is_error("ai_result", "retry").alias("error_retry"))


def _category_sql() -> str:
    whens = " ".join(f"WHEN regexp_matches(lower(ai_result), '{'|'.join(ws)}') THEN '{n}'" for n, ws in QU.ERROR_CLASSES)
    return f"CASE {whens} ELSE 'other' END"


@register("error_category", f"SELECT {_category_sql()} AS category, count(*) AS n FROM {_LEGACY_SQL} WHERE {_ERR_RETRY} GROUP BY 1")
def q_error_category(spark, sf_dir):
    d = _legacy(spark, sf_dir).filter(QU.is_error("ai_result", "retry"))
    return d.groupBy(QU.error_category("ai_result").alias("category")).agg(F.count(F.lit(1)).alias("n"))


_STATS_SQL = f"""SELECT count(*) AS total,
  count(*) FILTER (WHERE ai_result IS NOT NULL AND ai_result <> '' AND NOT {_ERR_STATS}) AS processed,
  count(*) - count(*) FILTER (WHERE ai_result IS NOT NULL AND ai_result <> '') AS remaining,
  count(*) FILTER (WHERE {_ERR_STATS}) AS errors FROM {_LEGACY_SQL}"""


@register("processing_stats", _STATS_SQL)
def q_processing_stats(spark, sf_dir):
    return QU.processing_stats(_legacy(spark, sf_dir), "ai_result")


@register("final_report", f"""SELECT *, CASE WHEN total > 0 THEN CAST(processed AS DOUBLE) / total * 100 ELSE 0.0 END AS success_rate
FROM ({_STATS_SQL})""")
def q_final_report(spark, sf_dir):
    return QU.final_report(QU.processing_stats(_legacy(spark, sf_dir), "ai_result"))


_RETRY_SRC = _twins_sql(D.BLANK_TEXT, {"ai_result": D.LEGACY_RESULT})
_RMD5 = f"md5({S.prompt_single(PROMPT, S.clean('text'))})"
_RETRY_SQL = f"""SELECT doc_id,
  CASE WHEN NOT {_ERR_RETRY} THEN ai_result WHEN NOT {_has_sql('text')} THEN {S.lit(fixed.NO_DATA)}
       WHEN {_RMD5} LIKE 'a%' THEN {S.lit(fixed.RETRY_FAILED_PREFIX)} || ai_result ELSE {_RMD5} END AS ai_result,
  CASE WHEN NOT {_ERR_RETRY} THEN NULL WHEN NOT {_has_sql('text')} OR {_RMD5} NOT LIKE 'a%' THEN 'success' ELSE 'failed' END AS retry_outcome
FROM {_RETRY_SRC}"""


def _retry_run(spark, sf_dir):
    d = twins(spark, sf_dir, D.BLANK_TEXT, {"ai_result": D.LEGACY_RESULT})
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(dead_prefixes="a"), policy=NO_SLEEP)
    return retry_failed(d, spec, "ai_result")


@register("retry_failed", _RETRY_SQL)
def q_retry_failed(spark, sf_dir):
    return _retry_run(spark, sf_dir).select("doc_id", "ai_result", "retry_outcome")


@register("retry_stats", f"""SELECT count(retry_outcome) AS total_errors, count(retry_outcome) AS retry_attempted,
  count(*) FILTER (WHERE retry_outcome = 'success') AS retry_success, count(*) FILTER (WHERE retry_outcome = 'failed') AS retry_failed,
  CASE WHEN count(retry_outcome) > 0 THEN CAST(count(*) FILTER (WHERE retry_outcome = 'success') AS DOUBLE) / count(retry_outcome) * 100
       ELSE 0.0 END AS success_rate FROM ({_RETRY_SQL})""")
def q_retry_stats(spark, sf_dir):
    return QU.retry_stats(_retry_run(spark, sf_dir))


@register("chunk_summary", """WITH r AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS chunk_id FROM events)
SELECT chunk_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS success_count,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS avg_processing_time,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT) % 4) AS BIGINT) AS total_retries FROM r GROUP BY chunk_id""")
def q_chunk_summary(spark, sf_dir):
    e = PK.chunk(table(spark, sf_dir, "events"), "event_id", fixed.CHUNK_SIZE)
    return QU.chunk_summary(e, "chunk_id", F.col("event_type") != "error", F.round(F.col("value") * 100).cast("long"),
                            F.get_json_object("props", "$.k").cast("long") % 4)


@register("progress", """WITH a AS (SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS processed,
  min(ts) AS started, max(ts) AS last FROM events),
b AS (SELECT *, date_diff('microsecond', started, last) / 1000000 AS elapsed_s FROM a),
c AS (SELECT *, CASE WHEN elapsed_s > 0 THEN processed / elapsed_s END AS rows_per_s FROM b),
d AS (SELECT *, CASE WHEN processed > 0 AND rows_per_s > 0
  THEN last + to_microseconds(CAST(floor((total - processed) / rows_per_s * 1000000) AS BIGINT)) END AS eta FROM c)
SELECT total, processed, CAST(processed AS DOUBLE) / total * 100 AS pct_done, elapsed_s, elapsed_s / 3600 AS elapsed_h, rows_per_s, eta,
  coalesce('""" + fixed.ETA_PREFIX + """' || strftime(eta, '%H:%M:%S %d/%m/%Y'), '""" + fixed.ETA_UNKNOWN + """') AS eta_text
FROM d""")
def q_progress(spark, sf_dir):
    return QU.progress(table(spark, sf_dir, "events"), "ts", F.col("event_type") != "error")


# ---------------------------------------------------------------------------
# state, resume, streaming (STR1/STR2, SNK3, SRC8) and run-log audits (STR3-5)
# ---------------------------------------------------------------------------


@register("resume_run", f"""SELECT doc_id, 'OK' AS status, {_PMD5} AS ai_result,
  CASE WHEN {_PMD5} LIKE 'a%' THEN '2' ELSE '1' END AS run_id FROM documents""")
def q_resume_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = INC.fresh_path(checkpoint_dir(spark), "resume-state")
    flaky = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(dead_prefixes="a"), policy=NO_SLEEP)
    INC.run_incremental(docs, flaky, path, run_id=1)
    healthy = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), policy=NO_SLEEP)
    state = INC.run_incremental(docs, healthy, path, run_id=2)
    return state.select(F.col("row_key").cast("long").alias("doc_id"), "status", "ai_result", "run_id")


@register("resume_compacted", f"""SELECT doc_id, 'OK' AS status, {_PMD5} AS ai_result,
  CASE WHEN {_PMD5} LIKE 'a%' THEN '2' ELSE '1' END AS run_id, true AS later_slices_kept FROM documents""")
def q_resume_compacted(spark, sf_dir):
    """The state is compacted between runs and once more in the end, and then read without its log; the second run's answers touch
    slices all over, a third run's one row touches one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = INC.fresh_path(checkpoint_dir(spark), "compacted-state")
    flaky = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(dead_prefixes="a"), policy=NO_SLEEP)
    healthy = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), policy=NO_SLEEP)
    INC.run_incremental(docs, flaky, path, run_id=1)
    INC.compact_state(spark, path, slice_rows=100)
    INC.run_incremental(docs, healthy, path, run_id=2)
    second = INC.compact_state(spark, path, slice_rows=100)
    extra = docs.agg(F.lit(-1).cast("long").alias("doc_id"), F.max("text").alias("text"))
    INC.run_incremental(extra, healthy, path, run_id=3)
    third = INC.compact_state(spark, path, slice_rows=100)
    kept = set(second.slices[1:]) <= set(third.slices)
    state = INC.load_state(spark, path).where(F.col("row_key") != "-1")
    return state.select(F.col("row_key").cast("long").alias("doc_id"), "status", "ai_result", "run_id", F.lit(kept).alias("later_slices_kept"))


@register("enrich_stream", f"SELECT doc_id, 'OK' AS status, {_PMD5} AS ai_result FROM documents")
def q_enrich_stream(spark, sf_dir):
    base = checkpoint_dir(spark)
    # the input arrives as files in a landing folder: here the documents table, written by Spark in four parts
    src = INC.fresh_path(base, "stream-input")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.repartition(4, "doc_id").write.parquet(src)
    state = INC.fresh_path(base, "stream-state")
    ckpt = INC.fresh_path(base, "stream-checkpoint")
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), policy=NO_SLEEP)
    q = INC.enrich_stream(spark, src, docs.schema, spec, state, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    # a second start over the same checkpoint finds nothing new and asks nothing
    INC.enrich_stream(spark, src, docs.schema, spec, state, ckpt, max_files_per_trigger=1).awaitTermination()
    return INC.load_state(spark, state).select(F.col("row_key").cast("long").alias("doc_id"), "status", "ai_result")


@register("stream_retry", f"""SELECT doc_id, CASE WHEN {_PMD5} LIKE 'aa%' THEN 'ERROR' ELSE 'OK' END AS status,
  CASE WHEN {_PMD5} LIKE 'aa%' THEN {S.lit(fixed.RETRY_FAILED_PREFIX + fixed.ERROR_AFTER_RETRIES.format(n=1))} ELSE {_PMD5} END AS ai_result,
  CASE WHEN {_PMD5} LIKE 'aa%' THEN 3 WHEN {_PMD5} LIKE 'a%' THEN 2 ELSE 1 END AS attempts FROM documents""")
def q_stream_retry(spark, sf_dir):
    """A stream whose model fails for some documents; a second stream asks those again when their wait is over, of a model that
    still fails for a few."""
    from ..streaming.retries import retry_stream, stop_when_settled

    base = checkpoint_dir(spark)
    src, state = INC.fresh_path(base, "retry-input"), INC.fresh_path(base, "retry-state")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.write.parquet(src)
    once = RetryPolicy(max_attempts=1, kind="exponential", base_delay=0.5)
    ask = lambda dead: EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(dead_prefixes=dead), policy=once)
    INC.enrich_stream(spark, src, docs.schema, ask(["a"]), state, INC.fresh_path(base, "retry-ckpt1"), keep_asked=True).awaitTermination()
    again = retry_stream(spark, state, ask(["aa"]), INC.fresh_path(base, "retry-ckpt2"), max_attempts=3, trigger="4 seconds")
    if not stop_when_settled(again, spark, state, 3):
        raise TimeoutError("failed rows were left unasked")
    return INC.load_state(spark, state).select(F.col("row_key").cast("long").alias("doc_id"), "status", "ai_result", "attempts")


@register("rate_audit", """WITH g AS (SELECT ts, date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) / 1000000 AS gap,
  count(*) OVER (ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 59999999 MICROSECONDS FOLLOWING) AS held FROM events)
SELECT date_trunc('minute', ts) AS minute, count(*) AS n_requests,
  CASE WHEN count(*) > 1 THEN date_diff('microsecond', min(ts), max(ts)) / 1000000 / (count(*) - 1) END AS mean_gap_s,
  max(held) AS worst_window, max(held) > 1 AS window_over_limit,
  min(gap) AS min_gap_s, count(*) > 1 AS over_limit, coalesce(min(gap) < 60, false) AS too_close FROM g GROUP BY 1""")
def q_rate_audit(spark, sf_dir):
    return RL.rate_audit(table(spark, sf_dir, "events"), "ts", rpm=1)


@register("breaker_trips", """WITH f AS (SELECT user_id, ts, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error')
SELECT user_id, count(*) AS n_failures, max(CASE WHEN k = 3 THEN ts END) AS opened_at FROM f GROUP BY user_id""")
def q_breaker_trips(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return RL.breaker_trips(e, "user_id", "ts", F.col("event_type") == "error", "event_id")


def _backoff_sql() -> str:
    parts = []
    for k in range(fixed.MAX_RETRIES):
        row = 0 if k == 0 else (k + 1) * fixed.ROW_RETRY_DELAY_S
        exp = fixed.RETRY_DELAY_EXP_BASE_S * 2 ** k
        parts.append(f"""SELECT event_id, CAST({k} AS INTEGER) AS k, CAST({(k + 1) * fixed.RETRY_DELAY_LINEAR_S} AS INTEGER) AS wait_linear_s,
  CAST({exp} AS INTEGER) AS wait_exp_s, CAST({row} AS INTEGER) AS wait_row_s, ts + to_seconds({exp}) AS retry_at
FROM events WHERE event_type = 'error'""")
    return "\nUNION ALL\n".join(parts)


@register("backoff_schedule", _backoff_sql())
def q_backoff(spark, sf_dir):
    f = table(spark, sf_dir, "events").filter(F.col("event_type") == "error").select("event_id", "ts")
    return RL.backoff_schedule(f, "ts").select("event_id", "k", "wait_linear_s", "wait_exp_s", "wait_row_s", "retry_at")


# ---------------------------------------------------------------------------
# tasks (TSK): template + backend, and native baselines
# ---------------------------------------------------------------------------
from ..operators import phrases as PH  # noqa: E402
from ..operators import tasks as TK  # noqa: E402
from ..sources import readers as RD  # noqa: E402
from ..sources import sinks as SK  # noqa: E402

_WORDS_SQL = r"regexp_extract_all(lower(text), '\p{L}+')"


def _hits_sql(words: list[str]) -> str:
    arr = "[" + ", ".join(S.lit(w) for w in words) + "]"
    return f"len(list_filter({_WORDS_SQL}, lambda x: list_contains({arr}, x)))"


def _classify_sql() -> str:
    cats = sorted(TK.LANGUAGE_KEYWORDS.items())
    hits = {c: _hits_sql(ws) for c, ws in cats}
    best = "greatest(" + ", ".join(hits.values()) + ")"
    whens = " ".join(f"WHEN {hits[c]} = {best} THEN '{c}'" for c, _ in cats)
    return f"CASE WHEN {best} = 0 THEN 'other' {whens} END"


@register("task_classify", f"SELECT doc_id, {_classify_sql()} AS category FROM documents")
def q_task_classify(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", TK.classify_by_keywords("text").alias("category"))


def _sentiment_sql() -> str:
    score = f"({_hits_sql(TK.SENTIMENT_LEXICON['positive'])} - {_hits_sql(TK.SENTIMENT_LEXICON['negative'])})"
    return f"CASE WHEN {score} > 0 THEN 'positive' WHEN {score} < 0 THEN 'negative' ELSE 'neutral' END"


@register("task_sentiment", f"SELECT doc_id, {_sentiment_sql()} AS sentiment FROM documents")
def q_task_sentiment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", TK.sentiment_by_lexicon("text").alias("sentiment"))


@register("task_keywords", rf"""WITH t AS (SELECT doc_id, unnest({_WORDS_SQL}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
dq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT doc_id, term, tf * ln(CAST((SELECT count(*) FROM documents) AS DOUBLE) / df) AS score FROM tf JOIN dq USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rk FROM s)
SELECT doc_id, CAST(rk AS INTEGER) AS rank, term FROM r WHERE rk <= 3""")
def q_task_keywords(spark, sf_dir):
    return TK.keywords_tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", k=3)


@register("task_summarize", rf"""WITH s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM
  (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l
   FROM documents)),
sc AS (SELECT doc_id, s, pos, len(list_distinct(list_filter(regexp_extract_all(lower(s), '\p{{L}}+'), lambda w: length(w) >= 4))) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rk FROM sc)
SELECT doc_id, string_agg(s, ' ' ORDER BY pos) AS summary FROM r WHERE rk <= 2 GROUP BY doc_id""")
def q_task_summarize(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", TK.summarize_extractive("text", k=2).alias("summary"))


@register("task_summarize_frequency", rf"""WITH s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM
  (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l
   FROM documents)),
w AS (SELECT doc_id, pos, unnest(list_distinct(list_filter(regexp_extract_all(lower(s), '\p{{L}}+'), lambda w: length(w) >= 4))) AS term FROM s),
dq AS (SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY term),
sc AS (SELECT doc_id, pos, sum(df) AS score FROM w JOIN dq USING (term) GROUP BY doc_id, pos),
r AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(score, 0) DESC, s.pos) AS rk FROM s LEFT JOIN sc ON s.doc_id = sc.doc_id AND s.pos = sc.pos)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(s, ' ' ORDER BY pos), '') END AS summary
FROM documents d LEFT JOIN (SELECT * FROM r WHERE rk <= 2) r ON d.doc_id = r.doc_id GROUP BY d.doc_id, d.text""")
def q_task_summarize_frequency(spark, sf_dir):
    return TK.summarize_by_frequency(table(spark, sf_dir, "documents"), "doc_id", "text", k=2)


# a dictionary that grows with the tables: every run of two and of four words of the benchmark's items
_RUNS = "flatten([list_transform(range(1, CAST(len(w) AS BIGINT) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) for n in [2, 4]])"
_PHRASES_SQL = f"""b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
ph AS (SELECT DISTINCT unnest({_RUNS}) AS run, 'g' || (item_id % 5) AS category, item_id % 3 - 1 AS weight FROM b),
d AS (SELECT doc_id, unnest({_RUNS}) AS run FROM (SELECT doc_id, {_WORDS_SQL} AS w FROM documents)),
tf AS (SELECT doc_id, run, count(*) AS tf FROM d GROUP BY ALL)"""


def _benchmark_phrases(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    runs = F.explode(PH.word_runs(TK.words("text"), [2, 4])).alias("phrase")
    return b.select(runs, F.concat(F.lit("g"), (F.col("item_id") % 5).cast("string")).alias("category"), (F.col("item_id") % 3 - 1).alias("weight"))


@register("task_classify_phrases", f"""WITH {_PHRASES_SQL},
h AS (SELECT doc_id, category, CAST(sum(tf) AS BIGINT) AS hits FROM tf JOIN (SELECT DISTINCT run, category FROM ph) USING (run) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, category) AS rk FROM h)
SELECT d.doc_id, coalesce(category, 'other') AS category, coalesce(hits, 0) AS hits FROM documents d LEFT JOIN (SELECT * FROM r WHERE rk = 1) r ON d.doc_id = r.doc_id""")
def q_task_classify_phrases(spark, sf_dir):
    return PH.classify_by_phrases(table(spark, sf_dir, "documents"), "doc_id", "text", _benchmark_phrases(spark, sf_dir))


@register("task_sentiment_phrases", f"""WITH {_PHRASES_SQL},
h AS (SELECT doc_id, CAST(sum(tf * weight) AS BIGINT) AS score FROM tf JOIN (SELECT DISTINCT run, weight FROM ph) USING (run) GROUP BY doc_id)
SELECT d.doc_id, coalesce(score, 0) AS score, CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative' ELSE 'neutral' END AS sentiment
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id""")
def q_task_sentiment_phrases(spark, sf_dir):
    return PH.sentiment_by_phrases(table(spark, sf_dir, "documents"), "doc_id", "text", _benchmark_phrases(spark, sf_dir))


@register("task_json_classify", f"""SELECT doc_id, {_classify_sql()} || '|' || source || '|null|' || lang || '|null' AS ai_result FROM documents""")
def q_task_json_classify(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    obj = F.to_json(F.struct(TK.classify_by_keywords("text").alias("category"), F.col("source").alias("product"),
                             F.lit(None).cast("string").alias("service"), F.col("lang").alias("tag"),
                             F.lit(None).cast("string").alias("note_1")), {"ignoreNullFields": "false"})
    out = PA.with_parsed_response(d.withColumn("answer", obj), "answer", "p", use_json=True)
    return out.select("doc_id", F.col("p.value").alias("ai_result"))


def _task_enrich(template_name: str):
    def q(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        spec = EnrichSpec(prompt=PR.template(template_name), columns=("text",), key="doc_id", backend=FingerprintBackend(), policy=NO_SLEEP)
        return enrich(docs, spec).select("doc_id", F.col(fixed.RESULT_COLUMN).alias("ai_result"))
    return q


for _t in ("translate", "custom"):
    register(f"task_{_t}", f"SELECT doc_id, md5({S.prompt_single(fixed.TEMPLATES[_t], S.clean('text'))}) AS ai_result FROM documents")(_task_enrich(_t))


# ---------------------------------------------------------------------------
# sources and sinks (SRC / SNK): round trips through files Spark writes from the tables
# ---------------------------------------------------------------------------


@register("csv_roundtrip", "SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def q_csv_roundtrip(spark, sf_dir):
    path = INC.fresh_path(checkpoint_dir(spark), "csv out, dữ liệu 1")
    SK.write_result(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, "csv")
    back = RD.read_csv(spark, path, na_values=RD.DEFAULT_NA_VALUES)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), "lang")


@register("csv_encodings", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def q_csv_encodings(spark, sf_dir):
    base = INC.fresh_path(checkpoint_dir(spark), "csv-enc")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    latin = F.decode(F.encode("text", "ISO-8859-1"), "ISO-8859-1") == F.col("text")
    pick = latin & (F.pmod("doc_id", F.lit(2)) == 0)
    d.filter(pick).write.options(header=True, quote='"', escape='"', encoding="ISO-8859-1").csv(f"{base}/latin1")
    d.filter(~pick).write.options(header=True, quote='"', escape='"').csv(f"{base}/utf8")
    back = RD.read_csv(spark, [f"{base}/latin1", f"{base}/utf8"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


@register("requests_roundtrip", f"SELECT CAST(doc_id AS VARCHAR) AS request_id, md5({S.prompt_single(PROMPT, S.clean('text'))}) AS content_md5 FROM documents")
def q_requests_roundtrip(spark, sf_dir):
    path = INC.fresh_path(checkpoint_dir(spark), "requests")
    d = table(spark, sf_dir, "documents").withColumn("prompt", PR.prompt_single(PROMPT, TX.clean_text("text")))
    SK.write_requests(d, path, "prompt", provider="openai", model="gpt-4.1-mini", key="doc_id")
    back = spark.read.text(path)
    return back.select(F.get_json_object("value", "$.request_id").alias("request_id"),
                       F.md5(F.get_json_object("value", "$.body.messages[0].content")).alias("content_md5"))


@register("responses_roundtrip", f"""SELECT CAST(doc_id AS VARCHAR) AS request_id, CASE WHEN doc_id % 7 = 0 THEN md5(text) END AS text_out,
  {_by_case(7, ['NULL'] + _gem_err()[1:], S.lit(fixed.EMPTY_RESPONSE))} AS error FROM documents""")
def q_responses_roundtrip(spark, sf_dir):
    path = INC.fresh_path(checkpoint_dir(spark), "responses")
    d = _derived(spark, sf_dir, D.GEMINI_BODY)
    d.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("request_id"), F.col("r").alias("body"))).alias("value")).write.text(path)
    return RD.read_responses(spark, path, "gemini").select("request_id", F.col("text").alias("text_out"), "error")


# production defaults: hash buckets, bucket count from the session, packs of 5 -----------------


@register("enrich_packed", f"""SELECT doc_id, CASE WHEN {_has_sql('text')} THEN 'OK' ELSE 'NO_DATA' END AS status,
  CASE WHEN {_has_sql('text')} THEN md5({S.clean('text')}) ELSE {S.lit(fixed.NO_DATA)} END AS ai_result FROM {_DOCS}""")
def q_enrich_packed(spark, sf_dir):
    docs = with_blanks(spark, sf_dir)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(),
                      pack_size=fixed.ASYNC_PACK_SIZE, policy=NO_SLEEP)
    return enrich(docs, spec).select("doc_id", F.col("result.status").alias("status"), F.col(fixed.RESULT_COLUMN).alias("ai_result"))


# multi-column enrichment: several columns per row, one row per call and packs --------------------


def _multi_item_sql() -> str:
    parts = [f"'{c}: ' || {S.clean(f'coalesce(CAST({c} AS VARCHAR), {S.lit(fixed.MISSING_VALUE)})')}" for c in _MULTI_COLS]
    return " || chr(10) || ".join(parts)


def _multi_sync_prompt_sql() -> str:
    data = " || chr(10) || ".join(f"'{i}. {c}: ' || {S.clean(f'coalesce(CAST({c} AS VARCHAR), {S.lit(fixed.MISSING_VALUE)})')}"
                                  for i, c in enumerate(_MULTI_COLS, 1))
    head = S.lit(chr(10) + _MPROMPT + chr(10) * 2 + fixed.COLUMNS_HEADER + chr(10) + _defs_sql(_MULTI_COLS) + chr(10) * 2 + fixed.DATA_HEADER + chr(10))
    return f"{head} || {data} || {S.lit(chr(10) * 2 + fixed.RESULT_FOOTER)}"


@register("enrich_multi", f"SELECT conv_id, turn, 'OK' AS status, md5({_multi_sync_prompt_sql()}) AS ai_result FROM {_CONV_MESSY}")
def q_enrich_multi(spark, sf_dir):
    src, _ = _conv_keyed(spark, sf_dir)
    spec = EnrichSpec(prompt=_MPROMPT, columns=tuple(_MULTI_COLS), key="row_key", backend=FingerprintBackend(), policy=NO_SLEEP)
    out = enrich(src, spec)
    return out.select("conv_id", "turn", F.col("result.status").alias("status"), F.col(fixed.RESULT_COLUMN).alias("ai_result"))


def _multi_packed_oracle() -> str:
    h = f"md5({_multi_item_sql()})"
    return f"""WITH {_pack_cte(_CONV_KEYED_SQL, 'row_key', 'text', width=_CONV_WIDTH, has_sql='true')},
q AS (SELECT *, count(*) OVER (PARTITION BY bucket, has, batch_no) AS n_items,
             count(*) FILTER (WHERE {h} NOT LIKE 'f%') OVER (PARTITION BY bucket, has, batch_no) AS n_present FROM p)
SELECT conv_id, turn, batch_id, item_id,
  CASE WHEN n_present = 0 OR {h} LIKE 'f%' THEN 'ERROR' ELSE 'OK' END AS status,
  CASE WHEN n_present = 0 THEN {S.lit(fixed.BATCH_ERROR_PREFIX + fixed.EMPTY_RESPONSE)}
       WHEN {h} LIKE 'f%' THEN {S.lit(fixed.PACK_PARSE_MISSING_ASYNC)} ELSE {h} END AS ai_result
FROM q"""


@register("enrich_multi_packed", _multi_packed_oracle())
def q_enrich_multi_packed(spark, sf_dir):
    src, width = _conv_keyed(spark, sf_dir)
    spec = EnrichSpec(prompt=_MPROMPT, columns=tuple(_MULTI_COLS), key="row_key", pack_size=PACK, pack_format="items",
                      bucket_width=width, bucket_fn="div", policy=NO_SLEEP, backend=FingerprintBackend(response_format="items", omit_prefixes="f"))
    out = enrich(src, spec)
    return out.select("conv_id", "turn", "batch_id", "item_id", F.col("result.status").alias("status"),
                      F.col(fixed.RESULT_COLUMN).alias("ai_result"))


# JSON-mode answers parsed inside the pipeline (INF1 + PAR15) -------------------------------------


@register("enrich_json", f"""SELECT doc_id, CASE WHEN NOT {_has_sql('text')} THEN 'NO_DATA' WHEN {_PMD5} LIKE 'b%' OR {_PMD5} LIKE 'c%' THEN 'ERROR' ELSE 'OK' END AS status,
  CASE WHEN {_has_sql('text')} AND {_PMD5} NOT LIKE 'b%' AND {_PMD5} NOT LIKE 'c%' THEN 'json' END AS method,
  CASE WHEN {_has_sql('text')} AND {_PMD5} LIKE 'b%' THEN '```json' || chr(10) || '```' END AS raw,
  CASE WHEN {_has_sql('text')} AND {_PMD5} LIKE 'c%' THEN 'RuntimeError: Connection error: service unavailable'
       WHEN {_has_sql('text')} AND {_PMD5} LIKE 'b%' THEN {S.lit(fixed.JSON_PARSE_FAILED_PREFIX)} || '```json' || chr(10) || '```' END AS error,
  CASE WHEN NOT {_has_sql('text')} THEN {S.lit(fixed.NO_DATA)} WHEN {_PMD5} LIKE 'c%' THEN {S.lit(fixed.ERROR_AFTER_RETRIES.format(n=3))}
       WHEN {_PMD5} LIKE 'b%' THEN {S.lit(fixed.JSON_PARSE_FAILED_PREFIX)} || '```json' || chr(10) || '```'
       ELSE substr({_PMD5}, 1, 8) || '|null|' || substr({_PMD5}, 9, 8) || '|null|' || {_PMD5} END AS ai_result FROM {_DOCS}""")
def q_enrich_json(spark, sf_dir):
    docs = with_blanks(spark, sf_dir)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", use_json=True, policy=NO_SLEEP,
                      backend=FingerprintBackend(single_format="json", unreadable_prefixes="b", dead_prefixes="c"))
    out = enrich(docs, spec)
    return out.select("doc_id", F.col("result.status").alias("status"), F.col("result.method").alias("method"), F.col("result.raw").alias("raw"),
                      F.col("result.error").alias("error"), F.col(fixed.RESULT_COLUMN).alias("ai_result"))


# status-based statistics of an enrichment run (AGG1 on the result struct) -----------------------


@register("result_stats", f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'OK') AS ok,
  count(*) FILTER (WHERE status = 'NO_DATA') AS no_data, count(*) FILTER (WHERE status = 'ERROR') AS errors
FROM ({_packed_oracle('items')})""")
def q_result_stats(spark, sf_dir):
    return QU.status_stats(enrich(with_blanks(spark, sf_dir), _packed_spec("items")))


# raw web pages: markup and newlines through cleaning and prompting -----------------------------


@register("enrich_pages", f"""SELECT page_id, CASE WHEN {_has_sql('html')} THEN 'OK' ELSE 'NO_DATA' END AS status,
  CASE WHEN {_has_sql('html')} THEN md5({S.prompt_single(PROMPT, S.clean('html'))}) ELSE {S.lit(fixed.NO_DATA)} END AS ai_result
FROM pages""")
def q_enrich_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    spec = EnrichSpec(prompt=PROMPT, columns=("html",), key="page_id", backend=FingerprintBackend(), policy=NO_SLEEP)
    out = enrich(pages, spec)
    return out.select("page_id", F.col("result.status").alias("status"), F.col(fixed.RESULT_COLUMN).alias("ai_result"))


# the keyword classifier against the known language of each document --------------------------


@register("task_classify_eval", f"SELECT lang, {_classify_sql()} AS category, count(*) AS n FROM documents GROUP BY 1, 2")
def q_task_classify_eval(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang", TK.classify_by_keywords("text").alias("category")).agg(F.count(F.lit(1)).alias("n"))


# one call per distinct item (identical rows share the answer) ----------------------------------


@register("enrich_distinct", f"""SELECT doc_id, CASE WHEN {_has_sql('text')} THEN 'OK' ELSE 'NO_DATA' END AS status,
  CASE WHEN {_has_sql('text')} THEN md5({S.clean('text')}) ELSE {S.lit(fixed.NO_DATA)} END AS ai_result FROM {_DOCS}""")
def q_enrich_distinct(spark, sf_dir):
    from .enrich import enrich_distinct

    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), pack_size=fixed.ASYNC_PACK_SIZE,
                      policy=NO_SLEEP)
    return enrich_distinct(with_blanks(spark, sf_dir), spec).select("doc_id", F.col("result.status").alias("status"), F.col(fixed.RESULT_COLUMN).alias("ai_result"))


@register("breaker_streaks", """WITH e AS (SELECT user_id, event_type = 'error' AS f,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
  - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS grp FROM events),
runs AS (SELECT user_id, grp, count(*) AS len FROM e WHERE f GROUP BY user_id, grp)
SELECT CAST(user_id AS VARCHAR) AS user_id, max(len) AS max_streak, count(*) FILTER (WHERE len >= 3) AS n_trips
FROM runs GROUP BY user_id""")
def q_breaker_streaks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return RL.breaker_streaks(e, "user_id", "ts", F.col("event_type") == "error", "event_id")


# the whole run: load -> enrich in packs -> retry error rows -> write -> report --------------------


_JOB_AI = "CASE WHEN doc_id % 5 = 0 THEN 'came with it' WHEN doc_id % 5 = 1 THEN 'Connection error: reset' ELSE '' END"
_JOB_SRC = f"(SELECT doc_id, text, {_JOB_AI} AS ai FROM {_DOCS})"
_JOB_DEAD = "substr(md5(" + S.prompt_single(PROMPT, S.clean("text")) + "), 1, 1) = 'a'"
_JOB_SQL = f"""SELECT doc_id, CASE WHEN ai = 'came with it' THEN 'OK' WHEN NOT {_has_sql('text')} THEN 'NO_DATA' WHEN {_JOB_DEAD} THEN 'ERROR' ELSE 'OK' END AS status,
  CASE WHEN ai = 'came with it' THEN ai WHEN NOT {_has_sql('text')} THEN {S.lit(fixed.NO_DATA)}
       WHEN {_JOB_DEAD} THEN {S.lit(fixed.RETRY_FAILED_PREFIX + fixed.ERROR_AFTER_RETRIES.format(n=3))} ELSE {_PMD5} END AS ai_result FROM {_JOB_SRC}"""


def _job_out(spark, sf_dir):
    """A job over a table with results of its own, of which some are errors: of the first run only some tasks ended, in
    which many calls failed, and it is run again."""
    from . import job as JOB

    base = checkpoint_dir(spark)
    docs = with_blanks(spark, sf_dir).withColumn(fixed.RESULT_COLUMN, F.expr(_JOB_AI))
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", policy=NO_SLEEP, backend=FingerprintBackend(dead_prefixes="ab"))
    first = JOB.EnrichJob(input_path="", output_path=INC.fresh_path(base, "job-out"), spec=spec, state_path=INC.fresh_path(base, "job-state"), run_id="broken")
    todo = JOB.pending_rows(spark, first, docs, first.state_path)
    JOB.ask_rows(spark, first, todo.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), first.state_path)
    again = JOB.EnrichJob(input_path="", output_path=first.output_path, state_path=first.state_path, run_id="again", spec=EnrichSpec(
        prompt=PROMPT, columns=("text",), key="doc_id", policy=NO_SLEEP, backend=FingerprintBackend(dead_prefixes="a")))
    JOB.run(spark, again, df=docs)
    return spark.read.parquet(again.output_path)


@register("job_resume", _JOB_SQL)
def q_job_resume(spark, sf_dir):
    return _job_out(spark, sf_dir).select("doc_id", F.col("result.status").alias("status"), F.col(fixed.RESULT_COLUMN).alias("ai_result"))


@register("job_report", f"""SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'ERROR') AS processed, count(*) FILTER (WHERE status = 'ERROR') AS errors,
  CAST(0 AS BIGINT) AS remaining, CAST(count(*) FILTER (WHERE status <> 'ERROR') AS DOUBLE) / count(*) * 100 AS success_rate FROM ({_JOB_SQL})""")
def q_job_report(spark, sf_dir):
    from .job import report_frame

    return report_frame(_job_out(spark, sf_dir))


@register("stream_shared_state", f"""SELECT doc_id, CASE WHEN {_has_sql('text')} THEN 'OK' ELSE 'NO_DATA' END AS status, CASE WHEN {_has_sql('text')} THEN {_PMD5}
  ELSE {S.lit(fixed.NO_DATA)} END AS ai_result, CASE WHEN doc_id // 2 % 2 = 0 THEN 'even' ELSE 'odd' END AS stream FROM {_DOCS}""")
def q_stream_shared_state(spark, sf_dir):
    """Two streams, each with its own checkpoint, into one state; the second finds a part of its first batch written."""
    import uuid

    base = checkpoint_dir(spark)
    docs = with_blanks(spark, sf_dir)
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), policy=NO_SLEEP)
    state, names = INC.fresh_path(base, "shared-state"), {}
    for name, rest in (("even", 0), ("odd", 1)):
        src, ckpt = INC.fresh_path(base, f"in-{name}"), INC.fresh_path(base, f"ckpt-{name}")
        docs.filter(F.expr("doc_id div 2 % 2") == rest).write.parquet(src)
        names[name] = uuid.uuid5(uuid.NAMESPACE_URL, ckpt).hex[:12]
        if name == "odd":
            part = docs.filter(F.expr("doc_id div 2 % 6") == 1)
            INC.save_state(enrich(part, spec), "doc_id", state, f"stream-{names[name]}-0")
        INC.enrich_stream(spark, src, docs.schema, spec, state, ckpt).awaitTermination()
    own = F.when(F.col("run_id").startswith(f"stream-{names['even']}-"), "even").when(F.col("run_id").startswith(f"stream-{names['odd']}-"), "odd")
    return INC.load_state(spark, state).select(F.col("row_key").cast("long").alias("doc_id"), "status", "ai_result", own.alias("stream"))


# tuned-model registry: a registry file derived from the data, read back and joined per document ----------
_REG_TEMPLATE = "'Ctx ' || source || ': {context_info}' || chr(10) || '{input_text}'"
_REG_REQUIRES = "(CAST(regexp_extract(source, '[0-9]+', 0) AS INT) % 2 = 0)"


def _registry_prompt_sql() -> str:
    t = S.clean("text")
    out = "('Ctx ' || source || ': {context_info}' || chr(10) || '{input_text}')"
    for name in fixed.TEXT_PLACEHOLDERS:
        out = f"replace({out}, '{{{name}}}', {t})"
    for name in fixed.PROMPT_PLACEHOLDERS:
        out = f"replace({out}, '{{{name}}}', {S.lit(PROMPT)})"
    requires = "(CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 2 = 0)"
    return f"CASE WHEN {requires} THEN {out} ELSE {S.prompt_single(PROMPT, t)} END"


@register("prompt_from_registry", f"""SELECT doc_id, 'tuned-' || source AS model_id, md5({_registry_prompt_sql()}) AS prompt_md5 FROM documents""")
def q_prompt_from_registry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # one registry document: a model per source (the registry is a dimension: one entry per model)
    models = docs.select("source").distinct().select(
        F.col("source").alias("name"),
        F.struct(F.concat(F.lit("tuned-"), F.col("source")).alias("model_id"), F.col("source").alias("display_name"),
                 F.lit("2025-01-01").alias("training_date"), F.expr(_REG_REQUIRES).alias("requires_context"),
                 F.struct(F.expr(_REG_TEMPLATE).alias("template")).alias("prompt_context")).alias("m"))
    # a registry file holds a map of models: here a file for each
    reg_json = models.select("name", F.to_json(F.struct(F.create_map("name", "m").alias("fine_tuned_models"))).alias("value"))
    path = INC.fresh_path(checkpoint_dir(spark), "registry")
    reg_json.write.partitionBy("name").text(path)
    registry = RD.read_model_registry(spark, path)
    joined = docs.join(registry, docs["source"] == registry["name"], "left")
    p = PR.prompt_with_registry("template", "requires_context", TX.clean_text("text"), PROMPT)
    return joined.select("doc_id", "model_id", F.md5(p).alias("prompt_md5"))


# columns chosen by name, number and type (PRJ1, PRJ2, PRJ4, PRJ5) ----------------------------------------


@register("choose_columns", "SELECT doc_id, lang, md5(text) AS text_md5, '' AS ai_result, 'text' AS text_column FROM documents")
def q_choose_columns(spark, sf_dir):
    from ..operators.columns import detect_text_column, require_columns, select_columns, with_result_column

    d = table(spark, sf_dir, "documents")
    require_columns(d, ["doc_id", "text"])
    name = detect_text_column(d)
    numbers = ",".join(str(d.columns.index(x) + 1) for x in ("lang", "doc_id", name))
    chosen = with_result_column(d.select(*select_columns(d, numbers)))
    return chosen.select("doc_id", "lang", F.md5(name).alias("text_md5"), F.col(fixed.RESULT_COLUMN).alias("ai_result"), F.lit(name).alias("text_column"))


# a prompt file for every source, written by Spark and read back (SRC5) --------------------------------------
_PROMPT_FILE = "CASE WHEN source LIKE '%1' THEN chr(32) || source || chr(10) ELSE chr(9) || 'Tóm tắt: ' || source || ', ' || lang || chr(10) END"


@register("prompt_files", f"""WITH f AS (SELECT source, {S.strip("CASE WHEN source LIKE '%1' THEN source ELSE 'Tóm tắt: ' || source || ', ' || min(lang) END")} AS prompt
  FROM documents GROUP BY source)
SELECT prompt, length(prompt) >= 10 AS ok, CASE WHEN length(prompt) < 10 THEN {S.lit(fixed.PROMPT_TOO_SHORT)} ELSE {S.lit(fixed.PROMPT_OK)} END AS message FROM f""")
def q_prompt_files(spark, sf_dir):
    path = INC.fresh_path(checkpoint_dir(spark), "prompt files")
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("lang").alias("lang"))
    per.select("source", F.expr(_PROMPT_FILE).alias("value")).write.partitionBy("source").text(path)
    return RD.read_prompts(spark, f"{path}/source=*/").select("prompt", "ok", "message")


# a tuned model's template within the run (PRM12) ------------------------------------------------------------


@register("enrich_template", f"""SELECT doc_id, 'OK' AS status, md5(CASE WHEN {_CTX_REQUIRES} AND {_CTX_TEMPLATE} <> '' THEN {_ctx_sql()}
  ELSE {S.prompt_single(PROMPT, S.clean('text'))} END) AS ai_result FROM documents""")
def q_enrich_template(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_CTX_TEMPLATE).alias("tpl"), F.expr(_CTX_REQUIRES).alias("req"))
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), policy=NO_SLEEP, template="tpl", requires_context="req")
    return enrich(d, spec).select("doc_id", F.col("result.status").alias("status"), F.col(fixed.RESULT_COLUMN).alias("ai_result"))


# answers that were paid for in another run (the ledger of requests) -------------------------------------------


@register("enrich_ledger", f"""SELECT doc_id, CASE WHEN {_has_sql('text')} THEN 'OK' ELSE 'NO_DATA' END AS status,
  CASE WHEN {_has_sql('text')} THEN {_PMD5} ELSE {S.lit(fixed.NO_DATA)} END AS ai_result FROM {_DOCS}""")
def q_enrich_ledger(spark, sf_dir):
    """The documents are asked about under one key; then again, with blank rows and under other keys, by a model that is down:
    every answer is the ledger's."""
    from .ledger import Ledger, enrich_with_ledger

    ledger = Ledger(INC.fresh_path(checkpoint_dir(spark), "ledger"))
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), policy=NO_SLEEP)
    enrich_with_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"), spec, ledger)
    down = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(dead_prefixes="0123456789abcdef"), policy=NO_SLEEP)
    out = enrich_with_ledger(with_blanks(spark, sf_dir), down, ledger)
    return out.select("doc_id", F.col("result.status").alias("status"), F.col(fixed.RESULT_COLUMN).alias("ai_result"))


# one rate for all tasks (INF7), seen in the run's own log ------------------------------------------------------


@register("enrich_paced", f"""SELECT count(*) AS n_requests, count(DISTINCT {_PMD5}) AS n_answers, true AS within_rate FROM documents""")
def q_enrich_paced(spark, sf_dir):
    """The documents asked about at a fixed rate, by all tasks at once; the log of calls is audited for its worst minute."""
    rpm = 60_000
    spec = EnrichSpec(prompt=PROMPT, columns=("text",), key="doc_id", backend=FingerprintBackend(), policy=RetryPolicy(rpm=rpm))
    out = enrich(table(spark, sf_dir, "documents").select("doc_id", "text"), spec)
    log = out.select(F.col("result.called_at").alias("ts"), F.col("result.value").alias("answer"))
    worst = RL.rate_audit(log, "ts", rpm=rpm).agg(F.max("worst_window").alias("worst"))
    return log.agg(F.count("ts").alias("n_requests"), F.countDistinct("answer").alias("n_answers")).join(worst).select(
        "n_requests", "n_answers", (F.col("worst") <= rpm + 1).alias("within_rate"))
