"""Prompt builders as column expressions.

Single-row builders take text columns; pack builders take an
``array<struct<item_id:int, ...>>`` column sorted by ``item_id`` (see
``operators.packing.collect_packs``) and render it with ``transform`` +
``array_join`` so a pack prompt is still one JVM expression.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import _col, clean_text, py_strip, render_value

NL = "\n"


def template(name: str) -> str:
    """Instruction text of a built-in task template."""
    if name not in fixed.TEMPLATES:
        raise KeyError(f"unknown template {name!r}; known: {', '.join(fixed.TEMPLATES)}")
    return fixed.TEMPLATES[name]


def templates_frame(spark):
    """The template registry as a (small, fixed-size) DataFrame: name, prompt."""
    return spark.createDataFrame(list(fixed.TEMPLATES.items()), "name string, prompt string")


def validate_prompt(prompt: str | Column) -> Column:
    """struct<ok boolean, message string>: non-blank and at least 10 characters after strip."""
    p = _col(prompt)
    stripped = py_strip(F.coalesce(p, F.lit("")))
    ok = F.when(stripped == "", F.lit(False)).when(F.length(stripped) < fixed.MIN_PROMPT_CHARS, F.lit(False)).otherwise(True)
    msg = (
        F.when(stripped == "", F.lit(fixed.PROMPT_EMPTY))
        .when(F.length(stripped) < fixed.MIN_PROMPT_CHARS, F.lit(fixed.PROMPT_TOO_SHORT))
        .otherwise(F.lit(fixed.PROMPT_OK))
    )
    return F.struct(ok.alias("ok"), msg.alias("message"))


def _p(prompt: str | Column) -> Column:
    return F.lit(prompt) if isinstance(prompt, str) else prompt


def prompt_single(prompt: str | Column, text: str | Column) -> Column:
    """``{prompt}\\n\\nNội dung cần xử lý:\\n{text}\\n\\nKết quả:`` (text already cleaned)."""
    return F.concat(_p(prompt), F.lit(f"{NL}{NL}{fixed.CONTENT_HEADER}{NL}"), _col(text), F.lit(f"{NL}{NL}{fixed.RESULT_FOOTER}"))


def _column_definitions(cols: Sequence[str]) -> str:
    return NL.join(f"- {fixed.COLUMN_WORD} {i} ({c}): {c}" for i, c in enumerate(cols, 1))


def prompt_multi_sync(prompt: str | Column, cols: Sequence[str], legacy_double_wrap: bool = False) -> Column:
    """Multi-column prompt of the blocking path: column definitions + cleaned values."""
    data = F.concat_ws(NL, *[F.concat(F.lit(f"{i}. {c}: "), clean_text(render_value(c))) for i, c in enumerate(cols, 1)])
    full = F.concat(
        F.lit(NL),
        _p(prompt),
        F.lit(f"{NL}{NL}{fixed.COLUMNS_HEADER}{NL}{_column_definitions(cols)}{NL}{NL}{fixed.DATA_HEADER}{NL}"),
        data,
        F.lit(f"{NL}{NL}{fixed.RESULT_FOOTER}"),
    )
    if legacy_double_wrap:
        # the original then wraps this again as a single-row prompt with empty text
        return prompt_single(full, F.lit(""))
    return full


def prompt_multi(prompt: str | Column, cols: Sequence[str]) -> Column:
    """Multi-column prompt of the concurrent path: no definitions, values as-is."""
    data = F.concat_ws(NL, *[F.concat(F.lit(f"{i}. {c}: "), render_value(c)) for i, c in enumerate(cols, 1)])
    return F.concat(_p(prompt), F.lit(f"{NL}{NL}{fixed.DATA_HEADER}{NL}"), data, F.lit(f"{NL}{NL}{fixed.RESULT_FOOTER}"))


# ---------------------------------------------------------------------------
# pack prompts: items = array<struct<item_id int, text string>> (single column)
#               or array<struct<item_id int, values array<struct<name,value>>>> (multi)
# ---------------------------------------------------------------------------

def _n(items: Column) -> Column:
    return F.size(items).cast("string")


def _fill(text: str, n: Column) -> Column:
    """A fixed text with every ``{n}`` replaced by the pack size column (``{{``/``}}`` are literal braces)."""
    parts = text.replace("{{", "{").replace("}}", "}").split("{n}")
    out = [F.lit(parts[0])]
    for p in parts[1:]:
        out += [n, F.lit(p)]
    return F.concat(*out)


def prompt_pack_indexed(prompt: str | Column, items: str | Column) -> Column:
    """``[i] text`` blocks + batch guide (blocking pack path, single column)."""
    items = _col(items)
    blocks = F.array_join(
        F.transform(items, lambda x: F.concat(F.lit("["), x["item_id"].cast("string"), F.lit("] "), clean_text(x["text"]))),
        NL + NL,
    )
    return F.concat(
        _p(prompt),
        F.lit(f"{NL}{NL}{fixed.BATCH_GUIDE_HEADER}{NL}"),
        _fill(fixed.BATCH_GUIDE_COUNT + NL, _n(items)),
        F.lit(f"{fixed.BATCH_GUIDE_ORDER}{NL}{fixed.BATCH_GUIDE_FORMAT}{NL}{NL}{fixed.DATA_HEADER}{NL}"),
        blocks,
        F.lit(f"{NL}{NL}{fixed.RESULT_FOOTER_UPPER}"),
    )


def prompt_pack_indexed_multi(prompt: str | Column, items: str | Column, cols: Sequence[str]) -> Column:
    """``[i]\\n  j. col: value`` blocks + column definitions + batch guide (multi column)."""
    items = _col(items)

    def block(x):
        lines = F.array_join(
            F.transform(
                x["values"],
                lambda v, j: F.concat(F.lit("  "), (j + 1).cast("string"), F.lit(". "), v["name"], F.lit(": "), clean_text(v["value"])),
            ),
            NL,
        )
        return F.concat(F.lit("["), x["item_id"].cast("string"), F.lit("]" + NL), lines)

    blocks = F.array_join(F.transform(items, block), NL + NL)
    return F.concat(
        _p(prompt),
        F.lit(f"{NL}{NL}{fixed.COLUMNS_HEADER}{NL}{_column_definitions(cols)}{NL}{NL}{fixed.BATCH_GUIDE_HEADER}{NL}"),
        _fill(fixed.BATCH_GUIDE_COUNT + NL, _n(items)),
        F.lit(fixed.BATCH_GUIDE_COLUMNS.replace("{c}", str(len(cols))) + NL),
        F.lit(f"{fixed.BATCH_GUIDE_ORDER}{NL}{fixed.BATCH_GUIDE_FORMAT}{NL}{NL}{fixed.DATA_HEADER}{NL}"),
        blocks,
        F.lit(f"{NL}{NL}{fixed.RESULT_FOOTER_UPPER}"),
    )


def _item_blocks(items: Column, multi: bool) -> Column:
    if multi:
        def block(x):
            lines = F.array_join(F.transform(x["values"], lambda v: F.concat(F.lit("  "), v["name"], F.lit(": "), v["value"])), NL)
            return F.concat(F.lit("Item "), x["item_id"].cast("string"), F.lit(":" + NL), lines)
    else:
        def block(x):
            return F.concat(F.lit("Item "), x["item_id"].cast("string"), F.lit(": "), x["text"])
    return F.array_join(F.transform(items, block), NL + NL)


def prompt_pack_items(prompt: str | Column, items: str | Column, as_json: bool = False, multi: bool = False) -> Column:
    """``Item i: text`` blocks + either the text-format or the JSON-array instructions."""
    items = _col(items)
    n = _n(items)
    head = F.concat(_p(prompt), F.lit(NL + NL), _fill(fixed.ITEMS_HEADER + NL, n), _item_blocks(items, multi), F.lit(NL + NL))
    if as_json:
        tail = _fill(fixed.ITEMS_JSON_INSTRUCTION, n)
    else:
        tail = F.concat(_fill(fixed.ITEMS_TEXT_INSTRUCTION, n), F.lit(NL + NL + fixed.RESULT_FOOTER))
    return F.concat(head, tail)


# ---------------------------------------------------------------------------
# request bodies
# ---------------------------------------------------------------------------

def payload_gemini(prompt: str | Column) -> Column:
    """JSON request body for a generateContent-style endpoint."""
    g = fixed.GEMINI_GENERATION
    body = F.struct(
        F.array(F.struct(F.array(F.struct(_col(prompt).alias("text"))).alias("parts"))).alias("contents"),
        F.struct(
            F.lit(g["temperature"]).alias("temperature"),
            F.lit(g["topP"]).alias("topP"),
            F.lit(g["topK"]).alias("topK"),
            F.lit(g["maxOutputTokens"]).alias("maxOutputTokens"),
            F.lit(g["candidateCount"]).alias("candidateCount"),
        ).alias("generationConfig"),
        F.array(*[F.struct(F.lit(c).alias("category"), F.lit(fixed.GEMINI_SAFETY_THRESHOLD).alias("threshold"))
                  for c in fixed.GEMINI_SAFETY_CATEGORIES]).alias("safetySettings"),
    )
    return F.to_json(body)


def payload_openai(model: str | Column, prompt: str | Column) -> Column:
    """JSON request body for a chat-completions-style endpoint."""
    body = F.struct(
        _p(model).alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), _col(prompt).alias("content"))).alias("messages"),
        F.lit(fixed.OPENAI_TEMPERATURE).alias("temperature"),
        F.lit(fixed.OPENAI_MAX_TOKENS).alias("max_tokens"),
    )
    return F.to_json(body)


def prompt_from_context(template_col: str | Column, text: str | Column, prompt: str | Column) -> Column:
    """Fine-tuned context template: placeholders replaced one after another, text first."""
    out = _col(template_col)
    for name in fixed.TEXT_PLACEHOLDERS:
        out = F.replace(out, F.lit("{" + name + "}"), _col(text))
    for name in fixed.PROMPT_PLACEHOLDERS:
        out = F.replace(out, F.lit("{" + name + "}"), _p(prompt))
    return out


def prompt_with_registry(template_col: str | Column, requires_context: str | Column, text: str | Column, prompt: str | Column) -> Column:
    """Use the model's context template when it requires one and has one, else the single-row prompt."""
    t = _col(template_col)
    use = _col(requires_context).eqNullSafe(F.lit(True)) & t.isNotNull() & (t != F.lit(""))
    return F.when(use, prompt_from_context(t, text, prompt)).otherwise(prompt_single(prompt, text))
