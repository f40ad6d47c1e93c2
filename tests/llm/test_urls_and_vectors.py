"""URL filters and nearest neighbours: against plain versions, and at the edges."""
import re
import string

import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.llm.helpers import SMALL
from weft.llm import neighbours, urls

ODD = [None, "nohost", "http://EXAMPLE.org", "http://ÀB.Com/fr/x?y=/de/", "x://a.com?b=c/d", "x://org/#/q", "", "x://example.org/en/1", "h://" + "a" * 50_000 + ".com/de/z",
       "a://b://c.org/x\n?y", "x://notorg/", "x://www.example.org/es/", "x://example.org/es", "x://com/fr/", "x://com.net/fr/", "x://a.org:80/"]


def parts(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(ODD)], "page_id long, url string")
    every = pages.union(odd)
    known = {r["page_id"]: r["url"] for r in every.collect()}
    got = urls.judge(every.withColumnRenamed("page_id", "host"), key="host").collect()
    assert len(got) == len(known)
    for r in got:
        host, path, rule, verdict = parts(known[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow")) and 0 <= r["score"] <= 1
    decided = [(r["score"] >= 0.5) == (r["verdict"] == "block") for r in got if r["rule"]]
    assert np.mean(decided) > 0.9


def test_trees_on_urls_they_have_not_seen(spark):
    """A third of the distinct URLs, by a hash, is neither in the trees' rows nor in the suffix and folder statistics."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    held = F.pmod(F.xxhash64("url", F.lit("held out")), F.lit(3)) == 0
    ids = {r["page_id"] for r in pages.where(held).collect()}
    every = urls.judge(pages, learn_from=~held).collect()
    unseen = [r for r in every if r["rule"] and r["page_id"] in ids]
    blocked = np.mean([r["verdict"] == "block" for r in unseen])
    right = np.mean([(r["score"] >= 0.5) == (r["verdict"] == "block") for r in unseen])
    print("unseen", len(unseen), "blocked", blocked, "right", right)
    assert len(unseen) > 100 and right > 0.9 and right > max(blocked, 1 - blocked) + 0.05
    # nothing to learn from: scores are those of a table without rules
    assert {r["score"] for r in urls.judge(pages, learn_from=F.lit(None).cast("boolean")).collect()} == {0.0}


def test_undecidable_tables(spark):
    frame = lambda *u: spark.createDataFrame(list(enumerate(u)), "page_id long, url string")
    assert urls.judge(frame()).count() == 0
    assert [r["verdict"] for r in urls.judge(frame("x://a.net/", None)).collect()] == ["allow", "allow"]
    assert {r["page_id"]: r["verdict"] for r in urls.judge(frame("x://a.com/de/", "x://a.net/")).collect()} == {0: "block", 1: "block"}


def test_repeated_urls_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(urls, "TRAIN_ROWS", 40)
    frame = lambda u: spark.createDataFrame(list(enumerate(u)), "page_id long, url string")
    # two distinct URLs: a hash alone can pick none of them, or one label
    for i in range(4):
        block, allow = f"http://h{i}.com/de/a", f"http://g{i}.com/fr/a"
        got = urls.judge(frame([block] * 150 + [allow] * 150 + ["http://x.net/a"])).collect()
        score = {r["verdict"]: r["score"] for r in got if r["rule"]}
        assert len(got) == 301 and score["allow"] < 0.3 < 0.7 < score["block"], i
    # a hot URL that sorts first does not keep the URLs of the other label out, and weighs as much as it has rows
    hot = ["http://a.com/de/a"] * 400 + [f"http://b{i}.com/fr/{i}" for i in range(400)] + [f"http://c{i}.com/de/{i}" for i in range(400)]
    rows = urls.host_and_path(F.col("url"))
    rows = frame(hot).withColumns({"host": rows[0], "path": rows[1]})
    label = (urls.matching_rule(F.col("host"), F.col("path"))[1] == "block").cast("int")
    rows = rows.withColumns({"label": label, "suffix": urls.suffix(F.col("host")), "folder": urls.first_folder(F.col("path"))})
    sample = urls.training_sample(rows).toPandas()
    assert len(sample) == 40 == sample["url"].nunique() and (sample["label"] == 1).sum() == 20
    assert sample[sample["url"] == hot[0]]["weight"].tolist() == [400]
    assert sample.groupby("label")["weight"].sum().to_dict() == pytest.approx({0: 400, 1: 800}, rel=0.5)
    got = urls.judge(frame(hot)).collect()
    assert len(got) == 1200 and np.mean([(r["score"] >= 0.5) == (r["verdict"] == "block") for r in got]) > 0.95


def test_trees_learn_what_features_tell():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = urls.Boosted().fit(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    assert urls.Boosted().fit(np.ones((10, 2)), np.array([1.0] * 3 + [0.0] * 7)).predict(np.ones((1, 2)))[0] == pytest.approx(0.3, abs=0.02)


def test_lexical_features():
    got = dict(zip(urls.FEATURES, urls.lexical("https://a-b.org/x1/y.html?p=1&q=2#f", "a-b.org", "/x1/y.html"), strict=False))
    assert (got["depth"], got["labels"], got["parameters"], got["hyphens"], got["secure"], got["fragment"], got["extension"]) == (2, 2, 2, 1, True, True, True)
    assert urls.lexical(None, "", "")[:5] == [0, 0, 0, 0, 0]


def plain(rows, k=10):
    ok = sorted((i, v) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v))
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok], dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if j != i][:k]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, shard string")
    df = df.select("vec_id", "embedding", "shard")
    out = {}
    for r in neighbours.search(df, df.where("vec_id % 100 = 0"), **options).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_recall_and_scores(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = [(r["vec_id"], [float(v) for v in r["embedding"]]) for r in table]
    nan, width = float("nan"), len(rows[0][1])
    rows += [(1000, [0.0] * width), (1100, None), (1200, [nan] * width), (1300, [None] * width), (None, [1.0] * width), (1500, [])]
    rows += [(2000 + i, rows[3][1]) for i in range(150)]  # a very common vector
    got, want = run(spark, rows, shard_rows=100), plain(rows)
    assert set(got) == set(want)
    hits = [len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
    x = dict(rows)
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        for _, v, s in found:
            assert s == pytest.approx(float(np.linalg.norm(np.array(x[v]) - np.array(x[q]))), abs=1e-12)
    assert [v for _, v, _ in got[2000]] == [3, *range(2001, 2010)]


def shapes():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 24))
    gauss = rng.normal(size=(4000, 24))
    return {"uniform": rng.uniform(-1, 1, (4000, 16)), "clustered": centres[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 24)),
            "tiny": gauss * 1e-25, "large": gauss * 1e25, "huge": gauss * 1e200, "mixed": gauss * np.where(np.arange(4000) % 2, 1e-60, 1e60)[:, None]}


@pytest.mark.parametrize("shape", list(shapes()))
def test_recall_in_shards_of_two_thousand(spark, shape):
    x = shapes()[shape]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    scale = np.abs(x).max()
    hits = []
    for q in range(0, len(x), 100):
        d = np.sqrt((((x - x[q]) / scale) ** 2).sum(axis=1))
        if shape == "mixed" and q % 2:
            d = np.where(np.arange(len(x)) % 2, np.sqrt((((x - x[q]) / 1e-60) ** 2).sum(axis=1)) * 1e-120, d)
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        hits.append(len({v for v, _ in got[q]} & set(want.tolist())) / 10)
        assert len(got[q]) == 10 and all(np.isfinite(s) and s == pytest.approx(d[v] * scale, rel=1e-9) for v, s in got[q])
    assert np.mean(hits) >= 0.9


def test_repeated_ids_keep_the_smallest_vector(spark):
    rows = [(0, [3.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 5.0]), (1, [1.0, 1.0]), (2, [9.0, 9.0])]
    got = run(spark, rows)
    assert [(v, round(s, 6)) for _, v, s in got[0]] == [(1, 1.0), (2, round(float(np.hypot(8, 9)), 6))]


def test_shards_grow_with_the_table():
    assert [neighbours.rows_of_shard(n) for n in (0, 51_282, 10**8, 10**12)] == [2000, 2000, 31622, 50_000]


def test_few_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [2.0, 0.0]), (5, [1.0, 0.0])]
    got = run(spark, rows)
    assert {q: [(v, round(s, 6)) for _, v, s in f] for q, f in got.items()} == {0: [(5, 0.0), (100, 1.0), (1, 1.414214)], 100: [(0, 1.0), (5, 1.0), (1, 2.236068)]}
    assert run(spark, [(0, [1.0])]) == {} and run(spark, [(0, None)]) == {}


def test_robust_prune_keeps_diverse_edges():
    x = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 2], [-1, 0]], dtype=np.float32)
    edges = neighbours.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, 1, 0]]), 4, 1.2)[0]
    assert edges.tolist() == [1, 4, 3, -1]  # 2 lies behind 1
