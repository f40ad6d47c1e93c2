"""Text cleaning, predicates and prompt rendering against plain-Python specifications."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import one_col
from weft.functions import fixed
from weft.functions import prompts as PR
from weft.functions import text as TX


def py_clean(t):
    """The original cleaning rule, written out in Python."""
    if t is None:
        return ""
    t = str(t).strip()
    return t.replace("\n\n\n", "\n\n").replace("\t", " ")


EDGE = [None, "", "   ", "\n" * 6, "\t\ta\tb\t", "\u00a0x\u3000", "a\n\n\n\nb", "x\u2028", " \x1c y \x1f", "\u200bz"]


def test_clean_text_edges(spark):
    rows = one_col(spark, EDGE).select(TX.clean_text("t").alias("c")).collect()
    assert [r.c for r in rows] == [py_clean(v) for v in EDGE]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \t\n\r\u00a0\u3000\u2028\u200bé")), max_size=12), min_size=1, max_size=8))
def test_clean_text_property(spark, values):
    rows = one_col(spark, values).select(TX.clean_text("t").alias("c")).collect()
    assert [r.c for r in rows] == [py_clean(v) for v in values]


def test_has_data_and_tag(spark):
    df = one_col(spark, [None, "", " \t", "x"]).select(TX.has_data("t").alias("h"), TX.tag_no_data(TX.has_data("t")).alias("s"))
    assert [(r.h, r.s) for r in df.collect()] == [(False, "NO_DATA"), (False, "NO_DATA"), (False, "NO_DATA"), (True, None)]


def test_has_any_data(spark):
    df = spark.createDataFrame([(None, " "), ("a", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(TX.has_any_data(["a", "b"])).collect()] == [False, True, False]


def test_preview(spark):
    df = one_col(spark, ["x" * 60, "short"])
    rows = df.select(TX.preview("t", 50, always_ellipsis=False).alias("s"), TX.preview("t", 3).alias("p")).collect()
    assert rows[0].s == "x" * 50 + "..." and rows[1].s == "short"
    assert rows[1].p == "sho..."


def test_prompt_single_exact(spark):
    p = "Hãy xử lý:"
    got = one_col(spark, ["nội dung"]).select(PR.prompt_single(p, F.col("t")).alias("p")).first().p
    assert got == f"{p}\n\nNội dung cần xử lý:\nnội dung\n\nKết quả:"


def test_prompt_multi_sync_exact(spark):
    df = spark.createDataFrame([("hi\t", None)], "MESSAGE string, AUTHOR string")
    got = df.select(PR.prompt_multi_sync("P", ["MESSAGE", "AUTHOR"]).alias("p")).first().p
    want = ("\nP\n\nTHÔNG TIN CÁC CỘT:\n- Cột 1 (MESSAGE): MESSAGE\n- Cột 2 (AUTHOR): AUTHOR\n\n"
            "DỮ LIỆU CẦN XỬ LÝ:\n1. MESSAGE: hi\n2. AUTHOR: N/A\n\nKết quả:")
    assert got == want
    legacy = df.select(PR.prompt_multi_sync("P", ["MESSAGE", "AUTHOR"], legacy_double_wrap=True).alias("p")).first().p
    assert legacy == want + "\n\nNội dung cần xử lý:\n\n\nKết quả:"


def _items(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts, 1)]
    df = spark.createDataFrame(rows, "item_id int, text string")
    return df.agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("items"))


def test_prompt_pack_indexed_exact(spark):
    got = _items(spark, ["a", "b c"]).select(PR.prompt_pack_indexed("P", "items").alias("p")).first().p
    want = ("P\n\nHƯỚNG DẪN BATCH PROCESSING:\n- Xử lý 2 mục dữ liệu dưới đây\n- Trả về kết quả theo thứ tự tương ứng\n"
            "- Format: [1] Kết quả 1\n[2] Kết quả 2\n[3] Kết quả 3...\n\nDỮ LIỆU CẦN XỬ LÝ:\n[1] a\n\n[2] b c\n\nKẾT QUẢ:")
    assert got == want


def test_prompt_pack_items_text_and_json(spark):
    items = _items(spark, ["a", "b"])
    txt = items.select(PR.prompt_pack_items("P", "items").alias("p")).first().p
    assert txt == ("P\n\nXỬ LÝ BATCH 2 ITEMS:\nItem 1: a\n\nItem 2: b\n\nHãy trả về kết quả cho từng item theo format:\n"
                   "Item 1: [kết quả item 1]\nItem 2: [kết quả item 2]\n...\nItem 2: [kết quả item 2]\n\nKết quả:")
    js = items.select(PR.prompt_pack_items("P", "items", as_json=True).alias("p")).first().p
    assert js.endswith('  {"item_id": 2, ...}\n]\n\nMỗi JSON object phải có field "item_id" để xác định thứ tự.\n'
                       "CHỈ trả về JSON array, KHÔNG có text khác.")


def test_validate_prompt(spark):
    rows = one_col(spark, ["", "   ", "short", "long enough prompt"]).select(PR.validate_prompt("t").alias("v")).collect()
    assert [r.v.ok for r in rows] == [False, False, False, True]
    assert rows[0].v.message == "Prompt không được để trống"


def test_prompt_from_context_sequential(spark):
    df = spark.createDataFrame([("T {input_text} / {context_info}", True, "txt {metadata}", "P")], "tpl string, req boolean, t string, p string")
    got = df.select(PR.prompt_with_registry("tpl", "req", F.col("t"), F.col("p")).alias("x")).first().x
    # the text carries a later placeholder, which the sequential replacement expands too
    assert got == "T txt P / P"


def test_templates_registry():
    assert list(fixed.TEMPLATES) == ["summarize", "classify", "sentiment", "extract_keywords", "translate", "custom", "json_classify"]
    assert PR.template("custom") == "Hãy xử lý nội dung sau theo yêu cầu:"


def test_templates_frame(spark):
    rows = {r.name: r.prompt for r in PR.templates_frame(spark).collect()}
    assert rows == fixed.TEMPLATES


def test_summary_by_document_frequency(spark):
    import re

    from weft.operators.tasks import summarize_by_frequency

    texts = ["Alpha beta. Gamma beta delta! Nothing here at all? Gamma.", "gamma gamma gamma. beta", "1 2 3. 4 5.", "", None, "one sentence only", "Alpha beta. Alpha beta. Alpha beta.",
             " . a. Delta", "É été été. ete beta"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.k: r.summary for r in summarize_by_frequency(spark.createDataFrame(rows, "k int, t string"), "k", "t", k=2).collect()}

    def sentences(t):
        return [s for s in re.sub(r"([.!?])[ \t\n\r]+", "\\1\x01", t).split("\x01") if s]

    def terms(s):
        return {w for w in re.findall(r"[^\W\d_]+", s.lower()) if len(w) >= 4}

    seen = [set().union(*map(terms, sentences(t))) if t else set() for t in texts]
    for i, t in rows:
        if t is None:
            assert got[i] is None
            continue
        sents = sentences(t)
        order = sorted(range(len(sents)), key=lambda n: (-sum(sum(w in d for d in seen) for w in terms(sents[n])), n))
        assert got[i] == " ".join(sents[n] for n in sorted(order[:2])), (i, t)
    assert len(got) == len(texts)


def test_phrases_of_a_large_dictionary(spark):
    import re
    from collections import Counter

    from weft.operators.phrases import classify_by_phrases, sentiment_by_phrases

    names = ["".join(chr(97 + (i // 26 ** p) % 26) for p in range(4)) for i in range(100_000)]
    known = [(f"{n} {n}x" if i % 2 else n, f"c{i % 7}", i % 5 - 2) for i, n in enumerate(names)]
    small = [("New  York", "city", 2), ("york", "name", -3), ("york", "name", -3), ("the new york", "phrase", 1), ("new", "city", 1), ("", "none", 9), ("12", "none", 9), ("same", "b", 1), ("same", "a", 1)]
    texts = ["The New York. new york york", "york", "same", "12 nothing", "", None, " ".join(f"{n} {n}x" for n in names[:3000]), "york " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    table = spark.createDataFrame(known + small, "phrase string, category string, weight int")
    rows = {(" ".join(re.findall(r"[a-z]+", p.lower())), c, w) for p, c, w in known + small}
    found = {r.k: (r.category, r.hits) for r in classify_by_phrases(df, "k", "t", table).collect()}
    feel = {r.k: (r.score, r.sentiment) for r in sentiment_by_phrases(df, "k", "t", table).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[a-z]+", (t or "").lower())
        runs = Counter(" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
        hits, score = Counter(), 0
        for p, c in {(p, c) for p, c, _ in rows if p}:
            hits[c] += runs[p]
        score = sum(runs[p] * x for p, x in {(p, x) for p, _, x in rows if p})
        best = min(((-n, c) for c, n in hits.items() if n), default=(0, "other"))
        assert found[k] == (best[1], -best[0]) and feel[k] == (score, "positive" if score > 0 else "negative" if score < 0 else "neutral"), (k, t)
    assert [r.category for r in classify_by_phrases(df, "k", "t", table.limit(0)).collect()] == ["other"] * len(texts)


def test_summary_by_document_frequency_hashes_the_vocabulary(spark):
    """Texts are dealt to tasks by their key before they are cut into words, and the words are joined without a sort."""
    from weft.operators.tasks import distinct_words, summarize_by_frequency

    rows = [(i, f"Word{'a' * (i % 7)} alpha. ΟΔΟΣ beta\x01gamma word! Gamma\u00e9 x{i}y zz alpha? end") for i in range(40)] + [(40, None), (None, "Alpha beta. Gamma")]
    df = spark.createDataFrame(rows, "k int, t string").coalesce(1)
    out = summarize_by_frequency(df, "k", "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [term" in plan and "SortMergeJoin [term" not in plan
    cuts = plan.split("Generate explode")[1:]
    assert len(cuts) == 2 and all("REPARTITION_BY_COL" in c for c in cuts)
    got = {r.k: r.summary for r in out.collect()}
    assert len(got) == 42 and got[40] is None and got[None] == "Alpha beta. Gamma"
    assert got[0] == "Word alpha. ΟΔΟΣ beta" and got[1] == "ΟΔΟΣ beta gamma word!"
    words = spark.createDataFrame([("Ab abc\u00c9d ABCD abcd a1bcde x",)], "t string")
    assert words.select(distinct_words("t", 4)).first()[0] == ["abc\u00e9d", "abcd", "bcde"]
    assert words.select(distinct_words("t", 0)).first()[0] == ["ab", "abc\u00e9d", "abcd", "a", "bcde", "x"]
