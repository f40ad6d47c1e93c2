"""Golden rows and quirks of the response parsers."""
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import one_col
from weft.functions import fixed
from weft.functions import parsing as PA
from weft.operators.backends import render_pack_answer

GOLDEN = [
    ('{"category": "tea", "product": "Oolong", "service": "tasting", "tag": "fresh", "note_1": "7"}', "tea|Oolong|tasting|fresh|7"),
    ('See the record.\n{"category": "tea", "product": null, "service": "at 12:30", "tag": "", "note_1": "7"}\nThat was it.', "tea|null|at 12:30|null|7"),
    ("{category: 'tea', product: 'Earl\\'s', service: 'http://a.b', tag: 'x', note_1: None,}", "tea|Earl's|http://a.b|x|null"),
    ("tea / Oolong / nothing more", "tea / Oolong / nothing more"),
    ("2", "2"),
    ("Có", "Có"),
]


def test_parse_response_golden(spark):
    df = one_col(spark, [g[0] for g in GOLDEN])
    out = PA.with_parsed_response(df, "t", "p", use_json=True).select("p.value").collect()
    assert [r.value for r in out] == [g[1] for g in GOLDEN]


def test_parse_response_empty_and_failed(spark):
    broken = "```json\n" + "`" * 300 + "\n```"
    df = one_col(spark, ["", broken, "   plain answer  ", None])
    js = PA.with_parsed_response(df, "t", "p", use_json=True).select("p.*").collect()
    assert [r.method for r in js] == ["empty", "failed", "text_fallback", "empty"]
    assert js[0].value == fixed.NO_RESPONSE and js[1].value == fixed.JSON_PARSE_FAILED_PREFIX + broken
    assert df.select(PA.parse_text("t")["value"].alias("v")).collect()[2].v == "plain answer"


def test_repair_leaves_strings_alone(spark):
    loose = ["{url: 'http://x', at: '12:30', who: \"it's // me, True\",}", "{'a': True, 'b': None, \"c\": [1, 2,], /* x, ' */ d: undefined}", "{a: 1} trailing", "no object", "{a 1}", None,
             "{\"Null\": NULL, \"deep\": {\"x\": [FALSE, {\"y\": 1,}]}}"]
    got = [r.r for r in one_col(spark, loose).select(PA.repair_json("t").alias("r")).collect()]
    assert json.loads(got[0]) == {"url": "http://x", "at": "12:30", "who": "it's // me, True"}
    assert json.loads(got[1]) == {"a": True, "b": None, "c": [1, 2], "d": None}
    assert got[2:6] == [None] * 4 and json.loads(got[6]) == {"Null": None, "deep": {"x": [False, {"y": 1}]}}


def _within(part, whole):
    """Whether a closed object holds nothing but what the whole one holds, in its place; strings may be shorter."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and _within(v, whole[k]) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and len(part) <= len(whole) and all(_within(p, w) for p, w in zip(part, whole))
    return whole.startswith(part) if isinstance(part, str) else part == whole


def test_cut_answers_are_closed_at_every_place(spark):
    whole = '{"a": {"b": [1, {"t": "x, \\"y\\" {z}\\u00e9\\n"}, true, -2.5e3], "c": null}, "url": "http://a//b", "d": [[], {"e": "end"}]}'
    df = spark.createDataFrame([(i, whole[:i]) for i in range(1, len(whole) + 1)], "i int, t string")
    sizes = []
    for r in df.select("i", PA.close_cut("t").alias("c")).select("i", "c.*").orderBy("i").collect():
        got = json.loads(r.text)
        assert _within(got, json.loads(whole)) and r.cut == (r.i < len(whole)), r
        sizes.append(len(json.dumps(got)))
    assert sizes == sorted(sizes) and got == json.loads(whole)  # no prefix reads less than a shorter one


def test_cut_loose_answers(spark):
    cases = [("{a: 'it", '{"a":"it"}', True), ("{'a': True, // note\n 'b': [1, 2, {x: 'y", '{"a":true,"b":[1,2,{"x":"y"}]}', True),
             ('{"a": 1]', None, False), ("no", None, False), ("", None, False), (None, None, False), ('{"a": "b\\', '{"a": "b"}', True),
             ('so: {"a": "b } c', '{"a": "b } c"}', True), ('{"a": 12', "{}", True), ('{"a": [1, 2', '{"a": [1]}', True), ('{"k": "v"} and {"z": ', '{"k": "v"}', False)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = PA.with_json_object(df, "t", "o", "cut").orderBy("i").collect()
    assert [(r.o, r.cut) for r in got] == [c[1:] for c in cases]
    read = PA.with_parsed_response(df, "t", "p", use_json=True, accept_cut=True).orderBy("i").select("p.method").collect()
    assert [r.method for r in read][:3] == ["json_cut", "json_cut", "text_fallback"] and read[8].method == "text_fallback"
    long = '{"a": "' + "x y, " * 50_000
    r = one_col(spark, [long]).select(PA.close_cut("t").alias("c")).first().c
    assert r.cut and r.text == long + '"}'


def _answers(spark, text, n):
    df = PA.with_pack_answers(one_col(spark, [text]), "t", n, out="p")
    row = df.select("p.method", *[PA.answer_for(F.col("p.answers"), F.lit(i)).alias(f"a{i}") for i in range(1, n + 1)]).first()
    return row[0], list(row)[1:]


def test_pack_answers_never_shift_and_none_is_lost(spark):
    assert _answers(spark, "Item 2: b\nItem 5: e", 5) == ("numbered", [None, "b", None, None, "e"])
    assert _answers(spark, "Yes\n\nNo\n\n7", 3) == ("delimited", ["Yes", "No", "7"])
    assert _answers(spark, "Yes\n\nNo", 3) == ("unparsed", [None] * 3)
    assert _answers(spark, "One is here. Two is here. Three. Four.", 3) == ("unparsed", [None] * 3)
    assert _answers(spark, '{"a": 1} {"item_id": 3, "a": 3}', 3) == ("json_objects", [None, None, '{"a":3}'])
    assert _answers(spark, '[{"a": 1}, {"a": 2}]', 2) == ("json_array", ['{"a":1}', '{"a":2}'])
    assert _answers(spark, "[]", 2) == ("json_array", [None, None])


def test_brace_span(spark):
    df = one_col(spark, ['x {"a": {"b": 1}} y', 'x {"a": "}"} y', '{"a": {', "none"])
    got = [r.s for r in df.select(PA.brace_span("t").alias("s")).collect()]
    assert got == ['{"a": {"b": 1}}', '{"a": "}', '{"a": {', None]


def test_indexed_keyed_not_positional(spark):
    # an empty [2] block and a duplicated [1] must not shift later answers (positional parsing would)
    text = "[1] one\n[2]\n[3] three\n[1] again"
    df = one_col(spark, [text]).select(PA.parse_indexed("t").alias("a"))
    got = df.select(*[PA.answer_for(F.col("a"), F.lit(i)).alias(f"a{i}") for i in (1, 2, 3)]).first()
    assert (got.a1, got.a2, got.a3) == ("one", None, "three")


def test_numbered_keeps_continuation_lines(spark):
    text = "Item 1: Kết quả: first\nsecond line\nItem 2: b"
    df = one_col(spark, [text]).select(PA.parse_numbered("t", 2).alias("a"))
    got = df.select(PA.answer_for(F.col("a"), F.lit(1)).alias("x")).first().x
    assert got == "first\nsecond line"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abc xyz.é")), min_size=1, max_size=10).map(str.strip).filter(bool),
                min_size=1, max_size=6))
def test_indexed_roundtrip(spark, answers):
    text = render_pack_answer(answers, "indexed")
    arr = one_col(spark, [text]).select(PA.parse_indexed("t").alias("a"))
    got = arr.select(*[PA.answer_for(F.col("a"), F.lit(i)).alias(f"a{i}") for i in range(1, len(answers) + 1)]).first()
    assert list(got) == [" ".join(a.split()) if "\n" in a else a for a in answers]


def test_pack_cascade_methods(spark):
    texts = ['[{"item_id": 2, "answer": "b"}, {"item_id": 1, "answer": "a"}]', "Item 1: a\nItem 2: b", "", "Empty response"]
    df = PA.with_pack_answers(one_col(spark, texts), "t", 2, out="p")
    got = [r.method for r in df.select("p.method").collect()]
    assert got == ["json_array", "numbered", "empty", "empty_api"]


def test_schema_checks(spark):
    df = one_col(spark, ['{"category": "a", "note_1": 2}', '{"AI_TOPICS": []}'])
    rows = df.select(PA.schema_applies("t").alias("ok"), PA.schema_violations("t").alias("v")).collect()
    assert rows[0].ok is True and "'product' is a required property" in rows[0].v
    assert "'note_1' is not of type 'string', 'null'" in rows[0].v
    assert rows[1].ok is False


def test_labelled_and_fields(spark):
    df = one_col(spark, ["Sentiment: Tích cực | Chủ đề: Review | Tóm tắt: a: b | Sentiment: again | Ghi chú: x | no label"])
    m = df.select(PA.parse_labelled("t").alias("m")).first().m
    assert m["Tóm tắt"] == "a: b" and m["Sentiment"] == "Tích cực"
    s = one_col(spark, ["A|B|C"]).select(PA.split_fields("t", fixed.RESULT_FIELDS).alias("s")).first().s
    assert (s.category, s.service, s.note_1) == ("A", "C", None)


def test_provider_bodies(spark):
    df = one_col(spark, ['{"candidates": []}', '{"candidates": [{"content": {"parts": [{"text": "hi"}]}}]}'])
    rows = df.select(PA.response_text("t", "gemini").alias("r")).collect()
    assert rows[0].r.error == fixed.API_EMPTY_CANDIDATES and rows[1].r.text == "hi"


_ANSWER = st.text(alphabet=st.sampled_from(list("abcxyz éố")), min_size=1, max_size=10).map(str.strip).filter(bool)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(_ANSWER, st.none()), min_size=1, max_size=6))
def test_pack_answers_roundtrip_items_and_json(spark, answers):
    """Rendered answers (None = left out) come back under their own item numbers, in both formats."""
    present = [a for a in answers if a is not None]
    n = len(answers)
    rows = [(render_pack_answer(answers, "items"), render_pack_answer(answers, "json"))]
    df = spark.createDataFrame(rows, "itm string, js string")
    df = PA.with_pack_answers(df, "itm", n, out="pi")
    df = PA.with_pack_answers(df, "js", n, out="pj")
    cols = [PA.answer_for(F.col("pi.answers"), F.lit(i)).alias(f"i{i}") for i in range(1, n + 1)]
    cols += [PA.answer_for(F.col("pj.answers"), F.lit(i)).alias(f"j{i}") for i in range(1, n + 1)]
    got = df.select(*cols).first()
    want_json = [None if a is None else json.dumps({"answer": a}, ensure_ascii=False, separators=(",", ":")) for a in answers]
    assert [got[f"j{i}"] for i in range(1, n + 1)] == want_json
    if present:
        assert [got[f"i{i}"] for i in range(1, n + 1)] == answers
