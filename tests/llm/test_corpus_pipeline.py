"""The pipeline: its stages in order, each against what a plain version keeps of its own input."""
import re
from collections import Counter

import corpus_pipeline
from tests.llm.helpers import SMALL, groups, jaccard_links, words
from weft.llm.shared import land


def test_stages(spark):
    import sentencepiece

    from weft.llm import pieces

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = land(stage(spark, docs, SMALL), f"test-{name}")
        seen[name] = (before, docs.collect())
        assert docs.columns[: len(columns)] == columns
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    before, after = seen["language"]
    assert len(after) > 0.95 * len(before) and all(any(map(str.isalpha, r["text"])) for r in after)
    before, after = seen["exact_copies"]
    least = {}
    for r in before:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])
        least[key] = min(least.get(key, r["doc_id"]), r["doc_id"])
    assert ids(after) == sorted(least.values())
    before, after = seen["near_copies"]
    before = sorted(before, key=lambda r: r["doc_id"])
    roots = groups(len(before), jaccard_links([r["text"] for r in before]))
    assert ids(after) == sorted({before[i]["doc_id"] for i in roots})
    before, after = seen["mix"]
    size = {r["doc_id"]: len(words(r["text"])) for r in before}
    taken = Counter(r["doc_id"] for r in after)
    assert max(taken.values()) <= 3 and set(taken) <= set(size)
    total = sum(size.values())
    assert 0.95 * total <= sum(size[i] * n for i, n in taken.items()) <= total
    before, after = seen["pieces"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert ids(after) == ids(before) and all(list(r["piece_ids"]) == library.encode(r["text"]) for r in after)


def test_language_stage_without_labels(spark):
    rows = [(1, "some words", None), (2, "12 + 3", None), (3, None, None), (4, "слова", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.by_language(spark, docs, SMALL).collect()) == [1, 4]


def test_language_stage_drops_foreign_and_garbled_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, "a gyors barna róka átugrik a lusta kutya fölött és hazamegy mert holnap korán kell kelnie", None),
           (-2, "qzv xkj wpf bqh zxv kqj vwx jjq pzx qwk fvz xqj hzk wvq zqx kpv jxw qhz vkq xzj", None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.by_language(spark, docs.unionByName(odd), SMALL).collect()}
    assert not kept & {-1, -2} and len(kept) >= 0.99 * docs.count()


def test_floor_counts_every_text(spark, monkeypatch):
    """5 in 5 000 right predictions score low: the floor is the exact quantile of all texts; copies and wrong predictions don't count."""
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from weft.llm import language

    n = 5_000
    low = F.when(F.col("id") < 5, 0.3 + F.col("id") / 1000)
    rows = spark.range(n).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.coalesce(low, 0.9 + F.col("id") / 1e6).alias("score"))
    copies = rows.where("text = 'text 0'").crossJoin(spark.range(50)).drop("id")
    wrong = rows.where("text like 'text 1%'").withColumns({"lang": F.lit("fr"), "score": F.lit(0.1)})
    scores = rows.select("text", F.col("lang").alias("lang_pred"), "score")
    monkeypatch.setattr(language, "identify", lambda df, net: df.join(scores, "text"))
    labelled = rows.unionByName(copies).unionByName(wrong).select("text", "lang")
    floor = language.least_score(labelled, SimpleNamespace(labels=["en", "fr"]))
    every = sorted([0.3 + i / 1000 for i in range(5)] + [round(0.9 + i / 1e6, 6) for i in range(5, n)])
    low = every[int(language.DOUBTED * n)]
    assert abs(floor - (0.5 + (low - 0.5) * n / (n + language.DRAWN) - 1e-6)) < 1e-9


def test_pieces_are_decoded(spark):
    import sentencepiece

    from weft.llm import pieces

    rows = [(1, "plain words"), (2, "\U0001f9ff \u4e97 \x01"), (3, "")]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = corpus_pipeline.to_pieces(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    assert {r["doc_id"]: r["round_trip"] for r in got} == {i: library.decode(library.encode(t)) == t for i, t in rows}


def test_run_is_the_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "mix", "pieces"]
    first = corpus_pipeline.run(spark, SMALL)
    assert "piece_ids" in first.columns and first.count() > 50
