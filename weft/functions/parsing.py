"""Response parsing as column expressions.

Pack parsers return ``array<struct<n:int, t:string>>``: the answer text ``t``
for item ``n``.  Answers are matched to rows by ``n`` (a key), never by
position, so a missing or repeated block cannot shift later rows.  Answers
without numbers are read only when there are exactly as many as were asked for;
otherwise the pack is unparsed.  No answer is dropped for its length.

Where a sub-expression is used more than once it is staged as a column of a frame
(``with_...``), so that it is evaluated once per row.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import _col, py_strip

ANSWER_T = "array<struct<n:int,t:string>>"


def _ns(*pairs) -> Column:
    """A struct with explicit field names (aliases inside lambdas can be trimmed by the analyzer)."""
    args = []
    for name, c in pairs:
        args += [F.lit(name), c]
    return F.named_struct(*args)


def _once_of(value: Column, fn) -> Column:
    """``fn(value)`` with the value bound to a variable, so that it is evaluated once."""
    return F.get(F.transform(F.array(value), fn), 0)


def _empty_answers() -> Column:
    return F.expr(f"cast(array() as {ANSWER_T})")


def _nonempty_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda l: py_strip(l)), lambda l: l != F.lit(""))


def _exactly(parts: Column, expected: Column) -> Column:
    """Parts without numbers as answers 1..expected, only if there are exactly as many."""
    keyed = F.transform(parts, lambda p, i: _ns(("n", (i + 1).cast("int")), ("t", p)))
    return F.when(F.size(parts) == expected, keyed).otherwise(_empty_answers())


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: py_strip(p)), lambda p: p != F.lit(""))


def _lit_or_col(x) -> Column:
    return F.lit(x) if isinstance(x, int) else _col(x)


# ---------------------------------------------------------------------------
# PAR1  [n] blocks
# ---------------------------------------------------------------------------
INDEXED_HEADER = r"^\[\s*([+-]?\d+)\s*\]"


def parse_indexed(text: str | Column) -> Column:
    """``[n] answer`` blocks; lines after a header (and non-numeric ``[x]`` lines) continue it."""
    joined = F.array_join(_nonempty_lines(F.coalesce(_col(text), F.lit(""))), "\n")
    blocks = F.split(joined, r"\n(?=\[\s*[+-]?\d+\s*\])")
    parsed = F.transform(
        F.filter(blocks, lambda b: b.rlike(INDEXED_HEADER)),
        lambda b: _ns(
            ("n", F.regexp_extract(b, INDEXED_HEADER, 1).try_cast("int")),
            ("t", py_strip(F.replace(F.regexp_replace(b, r"^\[[^\]]*\]", ""), F.lit("\n"), F.lit(" ")))),
        ),
    )
    return F.filter(parsed, lambda x: (x["n"] > 0) & (x["t"] != F.lit("")))


# ---------------------------------------------------------------------------
# PAR4  "Item n: answer" / "n. answer"
# ---------------------------------------------------------------------------
_PREFIX_RE = "(?iu)^(" + "|".join(fixed.ANSWER_PREFIXES) + r"):\s*"


def _numbered(text: Column, split_re: str, header_re: str) -> Column:
    blocks = F.split(text, split_re)
    parsed = F.transform(
        F.filter(blocks, lambda b: b.rlike(header_re)),
        lambda b: _ns(
            ("n", F.regexp_extract(b, header_re, 1).try_cast("int")),
            ("t", py_strip(F.regexp_replace(py_strip(F.regexp_replace(b, header_re, "")), _PREFIX_RE, ""))),
        ),
    )
    return F.filter(parsed, lambda x: x["n"].isNotNull() & (x["t"] != F.lit("")))


#: Header styles of numbered answers: how blocks are split, and what their first line says.
_ITEM_HEADER = r"(?isU)^\s*Item\s*(\d+)\s*[:\-]\s*"
NUMBER_STYLES = {
    "lines": (r"(?iU)\n(?=\s*Item\s*\d+\s*[:\-])", _ITEM_HEADER),
    "inline": (r"(?iU)(?=Item\s*\d+\s*[:\-])", _ITEM_HEADER),
    "list": (r"\n(?=\s*\d+\.)", r"(?sU)^\s*(\d+)\.\s*"),
}


def parse_numbered(text: str | Column, expected: str | Column | int) -> Column:
    """Answers headed ``Item n:`` (on lines of their own, or inline) or ``n.``, of the style that gives the most."""
    t, exp = py_strip(F.coalesce(_col(text), F.lit(""))), _lit_or_col(expected)
    found = [F.filter(_numbered(t, *style), lambda x: x["n"].between(1, exp)) for style in NUMBER_STYLES.values()]
    most = F.greatest(*[F.size(f) for f in found])
    return F.coalesce(*[F.when(F.size(f) == most, f) for f in found])


# ---------------------------------------------------------------------------
# PAR2 / PAR3  JSON array with item_id, or loose JSON objects
# ---------------------------------------------------------------------------

def _without_id(obj_json: Column) -> Column:
    return F.to_json(F.map_filter(F.from_json(obj_json, "map<string,variant>"), lambda k, v: k != F.lit("item_id")))


def keyed_objects(objs: Column, expected: Column) -> Column:
    """JSON objects as answers: by their item_id; when none has one, in their order if they are as many as expected."""
    found = F.transform(objs, lambda o: _ns(("n", F.get_json_object(o, "$.item_id").try_cast("int")), ("t", F.coalesce(_without_id(o), o))))
    keyed = F.filter(found, lambda x: x["n"].between(1, expected))
    return F.when(F.exists(found, lambda x: x["n"].isNotNull()), keyed).otherwise(_exactly(F.transform(found, lambda x: x["t"]), expected))


def _json_valid(s: Column) -> Column:
    """Strict single JSON value: parses, and nothing trails it."""
    return F.try_parse_json(s).isNotNull() & (F.json_array_length(F.concat(F.lit("["), s, F.lit("]"))) == F.lit(1))


# ---------------------------------------------------------------------------
# PAR5 / PAR6  paragraphs, bullets, lines, sentences: as many as were asked for
# ---------------------------------------------------------------------------
#: Ways to cut an answer without numbers, the coarsest first.
CUTS = (r"\n\s*\n", r"(?:^|\n)\s*-{3,}\s*(?:\n|$)", r"(?:^|\n)\s*[-*\u2022]\s+", r"\n")


def parse_delimited(text: str | Column, expected: str | Column | int) -> Column:
    """Paragraphs, ruled sections, bullets or lines, whichever first gives exactly the expected number.

    A first part that ends in a colon is a heading: it doesn't count if the others are as many as expected."""
    t, exp = py_strip(F.coalesce(_col(text), F.lit(""))), _lit_or_col(expected)
    out = _empty_answers()
    for cut in reversed(CUTS):
        parts = _trimmed(F.split(t, cut))
        headed = (F.size(parts) == exp + 1) & F.get(parts, 0).endswith(":")
        parts = F.when(headed, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
        out = F.when(F.size(parts) == exp, _exactly(parts, exp)).otherwise(out)
    return out


def parse_sentences(text: str | Column, expected: str | Column | int) -> Column:
    """Sentences (ended by . ! or ? before a capital letter), if there are exactly as many as expected."""
    t = py_strip(F.regexp_replace(F.coalesce(_col(text), F.lit("")), _PREFIX_RE, ""))
    return _exactly(_trimmed(F.split(t, r"(?<=[.!?])\s+(?=\p{Lu})")), _lit_or_col(expected))


# ---------------------------------------------------------------------------
# PAR7  cascade for pack answers
# ---------------------------------------------------------------------------

def with_pack_answers(df, text: str | Column, expected, out: str = "_parsed", style: str = "auto"):
    """Add ``out`` = struct<method string, answers array<struct<n,t>>>.

    ``style='indexed'`` reads ``[n]`` blocks only (blocking pack path).  ``style='auto'`` tries a JSON array, JSON
    objects, numbered items, parts and sentences; each reader runs only for what those before it could not read.
    """
    exp = _lit_or_col(expected)
    df = df.withColumn("_pk_t", py_strip(F.coalesce(_col(text), F.lit(""))))
    t = F.col("_pk_t")
    if style == "indexed":
        found = _ns(("method", F.when(t == "", F.lit("empty")).otherwise(F.lit("indexed"))), ("answers", parse_indexed(t)))
        return df.withColumn(out, found).drop("_pk_t")
    readers: list[tuple[str, Column]] = []
    left = ~(F.lower(t).isin("", "empty response"))
    # a whole answer in brackets is an array, also an empty one; else the first span of objects that reads as one
    spans = F.transform(F.regexp_extract_all(t, F.lit(r"(?s)\[\s*\{.*?\}\s*\]"), 0), lambda x: F.from_json(x, "array<string>"))
    df = df.withColumn("_pk_array", F.when(left, F.coalesce(F.when(t.startswith("["), F.from_json(t, "array<string>")), F.get(F.filter(spans, lambda x: x.isNotNull()), 0))))
    readers.append(("json_array", F.when(F.col("_pk_array").isNotNull(), keyed_objects(F.col("_pk_array"), exp))))
    left = left & F.col("_pk_array").isNull()
    # objects with at most one level inside, mended where they are no JSON
    df = df.withColumn("_pk_spans", F.when(left, F.regexp_extract_all(t, F.lit(r"\{(?:[^{}]|\{[^{}]*\})*+\}"), 0)))
    objects = F.filter(F.transform("_pk_spans", lambda x: F.when(_json_valid(x), x).otherwise(repair_json(x))), lambda x: x.isNotNull())
    df = df.withColumn("_pk_objects", objects)
    readers.append(("json_objects", F.when(F.size("_pk_objects") > 0, keyed_objects(F.col("_pk_objects"), exp))))
    left = left & ~F.coalesce(F.size("_pk_objects") > 0, F.lit(False))
    for name, reader in (("numbered", parse_numbered), ("delimited", parse_delimited), ("sentences", parse_sentences)):
        df = df.withColumn(f"_pk_{name}", F.when(left, reader(t, exp)))
        some = F.coalesce(F.size(f"_pk_{name}") > 0, F.lit(False))
        readers.append((name, F.when(some, F.col(f"_pk_{name}"))))
        left = left & ~some
    found = F.coalesce(*[F.when(a.isNotNull(), _ns(("method", F.lit(name)), ("answers", a))) for name, a in readers])
    none = lambda name: _ns(("method", F.lit(name)), ("answers", _empty_answers()))
    res = F.when(t == "", none("empty")).when(F.lower(t) == "empty response", none("empty_api")).otherwise(F.coalesce(found, none("unparsed")))
    return df.withColumn(out, res).drop("_pk_t", "_pk_array", "_pk_spans", "_pk_objects", "_pk_numbered", "_pk_delimited", "_pk_sentences")


def answer_for(answers: Column, item_id: Column) -> Column:
    """The first answer keyed ``item_id`` (NULL when the model left it out)."""
    return F.get(F.filter(answers, lambda a: a["n"] == item_id), 0)["t"]


def pack_missing_message(method: Column, style: str) -> Column:
    """Error text for an item without an answer, by how the pack was read."""
    if style == "indexed":
        return F.lit(fixed.PACK_PARSE_MISSING_SYNC)
    return (
        F.when(method == "empty", F.lit(fixed.EMPTY_PACK_RESPONSE))
        .when(method == "empty_api", F.lit(fixed.EMPTY_PACK_API))
        .when(method.isin("json_array", "json_objects"), F.lit(fixed.JSON_OBJECT_MISSING))
        .when(method == "unparsed", F.lit("UNPARSED"))
        .otherwise(F.lit(fixed.PACK_PARSE_MISSING_ASYNC))
    )


# ---------------------------------------------------------------------------
# PAR8-PAR15  single JSON answers
# ---------------------------------------------------------------------------

def brace_span(text: str | Column) -> Column:
    """From the first '{' to the '}' that balances it (string literals not respected); unbalanced -> to the end.

    Folds over brace tokens (the text split before and after every brace), so the
    fold has about two steps per brace instead of one per character.
    """
    t = _col(text)
    start = F.instr(t, "{")
    s = F.substr(t, start)
    tokens = F.split(s, r"(?=[{}])|(?<=[{}])")
    acc0 = _ns(("d", F.lit(0)), ("n", F.lit(0)), ("e", F.lit(0)))
    folded = F.aggregate(
        tokens,
        acc0,
        lambda acc, tok: F.when(acc["e"] > 0, acc).otherwise(
            F.when(tok == "{", _ns(("d", acc["d"] + 1), ("n", acc["n"] + 1), ("e", F.lit(0))))
            .when(tok == "}", _ns(("d", acc["d"] - 1), ("n", acc["n"] + 1),
                                  ("e", F.when(acc["d"] - 1 == 0, acc["n"] + 1).otherwise(F.lit(0)))))
            .otherwise(_ns(("d", acc["d"]), ("n", acc["n"] + F.length(tok)), ("e", F.lit(0))))
        ),
    )
    end = folded["e"]
    span = F.when(end > 0, F.substr(s, F.lit(1), end)).otherwise(s)
    return F.when(start > 0, py_strip(span))


_FENCES = [r"(?isU)```json\s*(.*?)\s*```", r"(?isU)```\s*(.*?)\s*```", r"(?isU)`(.*?)`"]


def extract_json(text: str | Column) -> Column:
    """JSON object text inside a fenced block (```json, ```, `), else anywhere in the text; NULL if none."""
    t = py_strip(F.coalesce(_col(text), F.lit("")))
    cands = []
    for pat in _FENCES:
        ms = F.filter(F.transform(F.regexp_extract_all(t, F.lit(pat), 1), lambda m: py_strip(m)), lambda m: F.instr(m, "{") > 0)
        cands.append(F.get(ms, 0))
    first = F.coalesce(*cands, F.when(F.instr(t, "{") > 0, t))
    return brace_span(first)


#: Tokens of loose JSON: comments, quoted strings, and what is neither.
_LOOSE = r"""//[^\n]*+|/\*(?s:.*?)\*/|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|[^"'/]++|."""
_READ_LOOSELY = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def repair_json(text: str | Column) -> Column:
    """A JSON object that a model wrote loosely, as compact JSON; NULL when it can't be read.

    Bare names and single quotes are left to the JSON reader's own options.  Comments, commas before a closing
    bracket and other languages' words for null, true and false are mended outside quoted strings only, so a
    URL, a time or an apostrophe in a value stays as it is.
    """
    tokens = lambda c: F.regexp_extract_all(c, F.lit(_LOOSE), F.lit(0))
    plain = F.array_join(F.filter(tokens(py_strip(_col(text))), lambda k: ~(k.startswith("//") | k.startswith("/*"))), "")

    def mend(k: Column) -> Column:
        out = F.regexp_replace(k, r",(?=\s*[}\]])", "")
        for word, value in (("(?i:null)|None|undefined", "null"), ("True|TRUE", "true"), ("False|FALSE", "false")):
            out = F.regexp_replace(out, rf"(?<![\w$])(?:{word})(?![\w$])(?!\s*:)", value)
        return F.when(k.startswith('"') | k.startswith("'"), k).otherwise(out)

    mended = F.array_join(F.transform(tokens(plain), mend), "")
    read = F.from_json(F.concat(F.lit('{"o":'), mended, F.lit("}")), "o map<string,variant>", _READ_LOOSELY)
    whole = (F.json_array_length(F.concat(F.lit("["), F.to_json(read["o"]), F.lit("]"))) == 1) & mended.rlike(r"(?s)^\{.*\}$")
    return F.when(whole, F.to_json(read["o"]))


#: Tokens of a JSON text that may stop anywhere: comments, strings (the last may be open), white space, punctuation, bare words.
_CUT = r"""//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|"(?s:[^"\\]|\\.)*+(?:"|\\?\z)|'(?s:[^'\\]|\\.)*+(?:'|\\?\z)|\s++|[{}\[\],:]|[^\s{}\[\],:"'/]++|/"""
_OPEN_STRING = r"""(?s)^(["'](?:[^\\]|\\u[0-9a-fA-F]{4}|\\u(?![0-9a-fA-F]{0,3}\z)|\\[^u])*+).*$"""


def close_cut(text: str | Column) -> Column:
    """struct<text, cut>: a JSON text that a token limit cut off, closed; ``cut`` tells whether it had to be.

    A fold over the tokens keeps the stack of brackets that are open and the last place at which the text could end
    soundly.  A string value that was being written is closed and kept; a name without its value, and a number or
    word that the cut may have shortened, go.  What follows a closed object stays as it is.  Text whose brackets
    don't match, or without a bracket at its start, is given back unchanged.
    """
    t = _col(text)
    acc0 = _ns(("n", F.lit(0)), ("open", F.lit("")), ("want", F.lit("value")), ("safe", F.lit(0)), ("close", F.lit("")),
               ("tail", F.lit("")), ("end", F.lit("")))

    def step(a: Column, k: Column) -> Column:
        first, n = F.substring(k, 1, 1), a["n"] + F.length(k)
        name, value = a["want"] == "name", a["want"] == "value"
        top = F.substring(a["open"], 1, 1)

        def state(**new: Column) -> Column:
            return _ns(*[(f, new.get(f, a[f])) for f in ("n", "open", "want", "safe", "close", "tail", "end")])

        def sound(at: Column, stack: Column, want, tail: Column | None = None) -> Column:
            return state(n=n, open=stack, want=F.lit(want) if isinstance(want, str) else want, safe=at, close=stack, tail=F.lit("") if tail is None else tail)

        blank = first.rlike(r"\s") | k.startswith("//") | k.startswith("/*")
        whole = k.rlike(r"""(?s)^"(?:[^"\\]|\\.)*+"$|^'(?:[^'\\]|\\.)*+'$""")
        bad = state(end=F.lit("bad"))
        closed = F.substr(a["open"], F.lit(2))
        return (
            F.when(a["end"] != "", a)
            # a bare word is known to be whole once something follows it
            .when(blank, F.when(a["want"] == "more", sound(a["n"], a["open"], "done")).otherwise(state(n=n)))
            .when(first.isin("{", "["), F.when(~value, bad).otherwise(_once_of(F.concat(F.when(first == "{", F.lit("}")).otherwise(F.lit("]")), a["open"]), lambda st: sound(
                n, st, F.when(first == "{", F.lit("name")).otherwise(F.lit("value"))))))
            .when(first.isin("}", "]"), F.when(top != first, bad).when(closed == "", state(end=F.lit("whole"))).otherwise(sound(n, closed, "done")))
            .when(first == ",", F.when(top == "", bad).when(a["want"].isin("more", "done"), sound(
                a["n"], a["open"], F.when(top == "}", F.lit("name")).otherwise(F.lit("value")))).otherwise(state(n=n)))
            .when(first == ":", F.when(a["want"] == "colon", state(n=n, want=F.lit("value"))).otherwise(bad))
            .when(top == "", bad)
            .when(name, state(n=n, want=F.lit("colon")))
            .when(~value, bad)
            .when(~first.isin('"', "'"), F.when(k.isin("true", "false", "null"), sound(n, a["open"], "done")).otherwise(state(n=n, want=F.lit("more"))))
            .when(whole, sound(n, a["open"], "done"))
            .otherwise(sound(a["n"], a["open"], "done", F.concat(F.regexp_replace(k, _OPEN_STRING, "$1"), first)))
        )

    done = F.aggregate(F.regexp_extract_all(t, F.lit(_CUT), F.lit(0)), acc0, step)

    def result(a: Column) -> Column:
        cut = (a["end"] == "") & (a["close"] != "")
        return _ns(("text", F.when(cut, F.concat(F.substr(t, F.lit(1), a["safe"]), a["tail"], a["close"])).otherwise(t)), ("cut", F.coalesce(cut, F.lit(False))))

    return _once_of(done, result)


def schema_applies(obj_json: str | Column, fields=tuple(fixed.RESULT_FIELDS)) -> Column:
    """Any of the result keys present and none of the other schema's keys."""
    keys = F.map_keys(F.from_json(_col(obj_json), "map<string,string>"))
    return F.arrays_overlap(keys, F.array(*map(F.lit, fields))) & ~F.arrays_overlap(keys, F.array(*map(F.lit, fixed.OTHER_SCHEMA_FIELDS)))


def schema_violations(obj_json: str | Column, fields=tuple(fixed.RESULT_FIELDS)) -> Column:
    """array<string>: missing required keys and non-string, non-null values of the result fields."""
    v = F.try_parse_json(_col(obj_json))
    out = []
    for f in fields:
        fv = F.try_variant_get(v, f"$.{f}", "variant")
        typ = F.schema_of_variant(fv)
        out.append(
            F.when(fv.isNull() & ~F.map_contains_key(F.from_json(_col(obj_json), "map<string,string>"), F.lit(f)), F.lit(f"'{f}' is a required property"))
            .when(fv.isNotNull() & ~F.is_variant_null(fv) & (typ != "STRING"), F.lit(f"'{f}' is not of type 'string', 'null'"))
        )
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _truthy(fv: Column) -> Column:
    """Python truthiness of a JSON value held in a variant."""
    typ = F.schema_of_variant(fv)
    s = F.try_variant_get(fv, "$", "string")
    return (
        F.when(fv.isNull() | F.is_variant_null(fv), F.lit(False))
        .when(typ == "STRING", s != "")
        .when(typ == "BOOLEAN", s == "true")
        .when(typ.startswith("ARRAY"), F.to_json(fv) != "[]")
        .when(typ.startswith("OBJECT"), F.to_json(fv) != "{}")
        .otherwise(F.try_variant_get(fv, "$", "double") != 0)
    )


def meaningful_text(text: str | Column) -> Column:
    """What is left of an answer without code marks and blank lines; NULL if that is nothing, or the word json alone."""
    bare = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"`++(?:(?i:json)\b)?", "")
    left = F.array_join(_nonempty_lines(bare), "\n")
    return F.when((left != "") & (F.lower(left) != "json"), left)


# ---------------------------------------------------------------------------
# PAR16 / PAR17  documented result shapes
# ---------------------------------------------------------------------------

def split_fields(result: str | Column, names: list[str], delimiter: str = fixed.RESULT_DELIMITER) -> Column:
    """``a|b|c`` -> struct of named fields (missing trailing fields are NULL)."""
    parts = F.split(_col(result), re.escape(delimiter))
    return _ns(*[(n, F.get(parts, i)) for i, n in enumerate(names)])


def parse_labelled(result: str | Column) -> Column:
    """``Label: value | Label: value`` -> map<label, value>; of a repeated label the first value stays."""
    pairs = F.transform(F.split(_col(result), r" \| "), lambda p: F.struct(F.split_part(p, F.lit(": "), F.lit(1)).alias("key"), F.when(
        F.instr(p, ": ") > 0, F.substr(p, F.instr(p, ": ") + 2)).alias("value")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(first)


# ---------------------------------------------------------------------------
# INF6  provider response bodies
# ---------------------------------------------------------------------------

def response_text(body: str | Column, provider: str = "gemini") -> Column:
    """struct<text string, error string> from a provider response body."""
    b = _col(body)
    if provider == "openai":
        txt = F.get_json_object(b, "$.choices[0].message.content")
        err = F.when(txt.isNull(), F.lit("Parse error: 'choices'")).when(py_strip(txt) == "", F.lit(fixed.EMPTY_RESPONSE))
        return _ns(("text", F.when(err.isNull(), txt)), ("error", err))
    cands = F.get_json_object(b, "$.candidates")
    content = F.get_json_object(b, "$.candidates[0].content")
    parts = F.get_json_object(b, "$.candidates[0].content.parts")
    txt = F.get_json_object(b, "$.candidates[0].content.parts[0].text")
    err = (
        F.when(cands.isNull(), F.lit(fixed.API_MISSING_CANDIDATES))
        .when(cands == "[]", F.lit(fixed.API_EMPTY_CANDIDATES))
        .when(content.isNull(), F.lit(fixed.API_MISSING_CONTENT))
        .when(parts.isNull(), F.lit(fixed.API_MISSING_PARTS))
        .when(parts == "[]", F.lit(fixed.API_EMPTY_PARTS))
        .when(txt.isNull(), F.lit("Parse error: 'text'"))
        .when(py_strip(txt) == "", F.lit(fixed.EMPTY_RESPONSE))
    )
    return _ns(("text", F.when(err.isNull(), txt)), ("error", err))


# ---------------------------------------------------------------------------
# PAR10 / PAR13 / PAR15  one JSON or text answer, staged
# ---------------------------------------------------------------------------

def with_json_object(df, text: str | Column, out: str = "_obj", cut: str | None = None):
    """Add ``out``: the JSON object text found in ``text`` (as it is if valid, else mended), or NULL.

    With ``cut`` an object that the token limit cut off is closed first (``close_cut``), and that column tells so.
    """
    df = df.withColumn("_js_span", extract_json(text))
    if cut:
        # the fold is for the texts that need it: what is valid as it stands was not cut; braces in an open string end no span
        df = df.withColumn("_js_closed", F.when(~_json_valid(F.col("_js_span")), close_cut(F.substr(_col(text), F.instr(_col(text), "{")))))
        df = df.withColumn(cut, F.coalesce(F.col("_js_closed.cut"), F.lit(False)))
        df = df.withColumn("_js_span", F.when(F.col(cut), F.col("_js_closed.text")).otherwise(F.col("_js_span"))).drop("_js_closed")
    df = df.withColumn(out, F.when(_json_valid(F.col("_js_span")), F.col("_js_span")).otherwise(repair_json("_js_span")))
    return df.drop("_js_span")


def with_json_text(df, obj: str, out: str, delimiter: str = fixed.RESULT_DELIMITER, fields=tuple(fixed.RESULT_FIELDS)):
    """Add ``out``: an object with all the fields as ``a|b|c`` (falsy -> 'null'); anything else as compact JSON."""
    df = df.withColumn("_jt_v", F.try_parse_json(F.col(obj))).withColumn("_jt_m", F.from_json(F.col(obj), "map<string,string>"))
    n = len(fields)
    for i, f in enumerate(fields):
        df = df.withColumn(f"_jt_f{i}", F.try_variant_get(F.col("_jt_v"), f"$.{f}", "variant"))
    for i in range(n):
        fv = F.col(f"_jt_f{i}")
        df = df.withColumn(f"_jt_y{i}", _truthy(fv)).withColumn(f"_jt_s{i}", F.schema_of_variant(fv) == "STRING")
    all_present = F.forall(F.array(*map(F.lit, fields)), lambda k: F.map_contains_key(F.col("_jt_m"), k))
    # a truthy value that is no string can't be joined: the whole object is given as JSON
    bad = F.exists(F.array(*[F.col(f"_jt_y{i}") & ~F.coalesce(F.col(f"_jt_s{i}"), F.lit(False)) for i in range(n)]), lambda b: b)
    piped = F.concat_ws(delimiter, *[F.when(F.col(f"_jt_y{i}"), F.try_variant_get(F.col(f"_jt_f{i}"), "$", "string")).otherwise(F.lit("null"))
                                     for i in range(n)])
    # anything else is written back as compact JSON with its keys in their original order
    as_json = F.to_json(F.from_json(F.col(obj), "map<string,variant>"))
    df = df.withColumn(out, F.when(F.col(obj).isNull(), F.lit(None).cast("string")).when(all_present & ~bad, piped).otherwise(as_json))
    return df.drop("_jt_v", "_jt_m", *[f"_jt_{k}{i}" for k in "fys" for i in range(n)])


def parse_text(text: str | Column) -> Column:
    """struct<value, method> of an answer in text mode."""
    empty = F.coalesce(_col(text), F.lit("")) == ""
    return _ns(("value", F.when(empty, F.lit(fixed.NO_RESPONSE)).otherwise(py_strip(_col(text)))), ("method", F.when(empty, F.lit("empty")).otherwise(F.lit("text"))))


def with_parsed_response(df, text: str | Column, out: str = "_parsed", use_json: bool = False, fields=tuple(fixed.RESULT_FIELDS), accept_cut: bool = False):
    """Add ``out`` = struct<value, method>.

    In JSON mode the object's text, else the meaningful text.  Methods ``empty`` and ``failed`` are no answers:
    their value says why, with the whole answer that couldn't be read.  With ``accept_cut`` an object that the token
    limit cut off is closed and read; its method is ``json_cut``.
    """
    if not use_json:
        return df.withColumn(out, parse_text(text))
    df = df.withColumn("_pr_raw", _col(text))
    df = with_json_object(df, "_pr_raw", "_pr_obj", "_pr_cut" if accept_cut else None)
    read = F.when(F.col("_pr_cut"), F.lit("json_cut")).otherwise(F.lit("json")) if accept_cut else F.lit("json")
    df = df.withColumn("_pr_usable", F.col("_pr_obj").isNotNull() & (F.to_json(F.try_parse_json("_pr_obj")) != F.lit("{}")))
    df = with_json_text(df, "_pr_obj", "_pr_jt", fields=fields)
    df = df.withColumn("_pr_mt", meaningful_text(F.col("_pr_raw")))
    raw, mt = F.col("_pr_raw"), F.col("_pr_mt")
    res = (
        F.when(F.coalesce(raw, F.lit("")) == "", _ns(("value", F.lit(fixed.NO_RESPONSE)), ("method", F.lit("empty"))))
        .when(F.col("_pr_usable"), _ns(("value", F.col("_pr_jt")), ("method", read)))
        .when(mt.isNotNull(), _ns(("value", mt), ("method", F.lit("text_fallback"))))
        .otherwise(_ns(("value", F.concat(F.lit(fixed.JSON_PARSE_FAILED_PREFIX), raw)), ("method", F.lit("failed"))))
    )
    return df.withColumn(out, res).drop("_pr_raw", "_pr_obj", "_pr_cut", "_pr_usable", "_pr_jt", "_pr_mt")
