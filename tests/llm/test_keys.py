"""Sharding, exact deduplication and mixing: against DuckDB, and their defined results at the edges."""
import hashlib
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SMALL, docs, duck, same_rows, words
from weft.llm import exact_dedup, extendible, mixing, shards


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_shards_are_the_shortest_prefixes_that_fit(spark, small):
    limit = 20_000
    got = shards.assign_shards(small, limit=limit).collect()
    same_rows(got, duck(shards.shards_sql(limit), documents=small.toPandas()))
    assert len({r["shard"] for r in got}) > 10 and all(r["shard_bytes"] <= limit for r in got)


def test_directory_goes_on_beyond_the_first_round(spark):
    rows = spark.range(300).select(F.lit(77).alias("h0"), F.col("id").alias("h"), F.lit(10).alias("size"))
    found = extendible.build(rows, "h", "size", 40)
    assert [bits for bits, _ in found.cells] == [12, 24, 32]
    placed = found.assign(rows, "h").groupBy("bucket_depth", "bucket_prefix").agg(F.sum("size").alias("s"), F.bool_and("bucket_fits").alias("f")).collect()
    assert all(r["s"] <= 40 and r["f"] for r in placed)


def test_repeated_rows_are_chained_within_the_limit(spark):
    df = docs(spark, [(1, "x" * 30)] * 50 + [(2, "y" * 500), (3, None), (4, ""), (None, "z")])
    got = shards.assign_shards(df, limit=100).collect()
    assert len(got) == 54
    assert all(r["shard_bytes"] <= 100 or r["size"] > 100 and r["shard_rows"] == 1 for r in got)
    assert {r["doc_id"]: r["size"] for r in got} == {1: 30, 2: 500, 3: 0, 4: 0, None: 1}


def test_shards_of_nothing_and_files(spark, tmpdir_path):
    assert shards.assign_shards(docs(spark, [])).count() == 0
    df = docs(spark, [(i, "t" * 50, i, "a") for i in range(40)], ", h long, shard string")
    shards.write_shards(df, f"{tmpdir_path}/out", limit=300)
    back = spark.read.parquet(f"{tmpdir_path}/out")
    assert sorted(map(tuple, back.drop("_shard").collect())) == sorted(map(tuple, df.collect()))
    assert back.groupBy("_shard").count().agg(F.max("count")).first()[0] <= 6


def test_exact_groups_match_sql(spark, small):
    same_rows(exact_dedup.exact_groups(small).drop("bucket").collect(), duck(exact_dedup.SQL, documents=small.toPandas()))


def test_exact_edges_and_chains(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a\x0b b"), (4, "a\u00a0b"), (7, None), (6, ""), (8, " "), (2, "c" * 100_000), (1, "c" * 100_000), (1, "c" * 100_000), (None, "a b"), (None, "only")]
    for key_hex in (16, 1):  # one hexadecimal digit: different texts share keys and are told apart by their bytes
        got = exact_dedup.exact_groups(docs(spark, rows), key_hex=key_hex, bucket_bytes=1000).collect()
        assert len(got) == len(rows)
        by = {}
        for i, t in rows:
            by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
        for r in got:
            mine = next(v for k, v in by.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
            least = min((x for x in mine if x is not None), default=None)
            assert r["doc_id"] in mine and (r["keep_id"], r["group_size"], r["kept"]) == (least, len(mine), r["doc_id"] == least)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_drop_copies_keeps_own_columns(spark):
    rows = [(1, "a b", 1, "x"), (1, "a b", 1, "x"), (2, "a  b", 2, "y"), (3, None, 3, None), (4, "", 4, "z"), (1, "other", 9, "w")]
    df = docs(spark, rows, ", keep_id long, norm string")
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[5]], key=str)


def test_mix_matches_sql(spark, small):
    want = duck(mixing.SQL, documents=small.toPandas())
    same_rows(mixing.mix(small).drop("copies").collect(), want)
    same_rows(mixing.mix(small.repartition(7), slot_rows=3).drop("copies").collect(), want)


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 500), ("B", 300)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # by code point B, a, b, c, null weigh 5, 2, 1, 5, 2; a and c stop at 30 and 0, B at 900
    assert got["a"] == 30 and got["c"] == 0 and got["B"] == 900
    assert got["b"] == pytest.approx((1810 - 930) / 3) and got[None] == pytest.approx(2 * (1810 - 930) / 3)
    assert sum(got.values()) == pytest.approx(1810)


def test_mix_edges(spark):
    rows = [(i, " ".join("w" * (1 + i % 7)) if i % 5 else None, "hot" if i % 3 else None, i) for i in range(300)] + [(7, "w w", "one", 0)] * 3
    df = docs(spark, rows, ", source string, size long")
    got = mixing.mix(df, slot_rows=10).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mix(df.repartition(5), slot_rows=10).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken = pd.DataFrame([r.asDict() for r in got]).groupby("target").agg(taken=("taken", "sum"), size=("source_size", "first"))
    assert all(abs(t - r["taken"]) <= 8 for t, r in taken.iterrows())
    out = mixing.mixed(df, slot_rows=10)
    assert out.columns == df.columns
    assert out.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == sum(r["taken"] for r in got)
    assert mixing.mix(docs(spark, [], ", source string")).count() == 0
    blank = mixing.mix(docs(spark, [(1, None, None), (2, " ", "x")], ", source string")).collect()
    assert [r["taken"] for r in blank] == [0, 0]


@pytest.mark.parametrize("empty", ["blank", None, "zz"])
def test_mix_of_a_source_without_words(spark, empty):
    rows = [(i, "some words here" if i % 2 else ["", None, " "][i % 3], "full" if i % 2 else empty) for i in range(40)] + [(99, "w " * 5, "other")]
    df = docs(spark, rows, ", source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and {r["taken"] for r in got if r["size"] == 0} == {0}
    same_rows([r for r in mixing.mix(df).drop("copies").collect()], duck(mixing.SQL, documents=df.toPandas()))
    assert mixing.mixed(df).where("source <=> 'full'").count() > 0


def test_many_sources(spark):
    sizes = spark.createDataFrame([(f"host{i:05d}", 1 + i * i % 97) for i in range(3000)], "source string, size long")
    got = {r["source"]: r for r in mixing.source_targets(sizes.repartition(7)).collect()}
    assert sorted(r["src"] for r in got.values()) == list(range(1, 3001)) and [got[s]["src"] for s in sorted(got)] == list(range(1, 3001))
    total = sum(r["source_size"] for r in got.values())
    assert sum(r["target"] for r in got.values()) == pytest.approx(total) and all(r["target"] <= 3 * r["source_size"] + 1e-6 for r in got.values())
    free = {r["target"] / r["weight"] for r in got.values() if r["target"] < 3 * r["source_size"] - 1e-6}
    assert max(free) == pytest.approx(min(free))


def test_a_text_of_a_third_of_all_rows_is_few_rows_to_its_owner(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = exact_dedup.exact_groups(docs(spark, rows), bucket_bytes=200).collect()
    assert {r["group_size"] for r in got} == {1, 1000} and len({r["bucket"] for r in got}) > 50
    assert {r["keep_id"] for r in got if r["group_size"] == 1000} == {0}


def test_size_counts_words(spark):
    text = "a\u00a0b  c\x1cd\te\x0bf\n"
    assert docs(spark, [(1, text)]).select(mixing.n_words(F.col("text"))).first()[0] == len(words(text)) == 4
