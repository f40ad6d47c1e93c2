"""The Merkle manifest, centroid clustering and the licence scan: against DuckDB, plain versions, and at their edges."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SMALL, docs, duck, same_rows
from weft.llm import centroids, licenses, merkle


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# ---- operator 11 -------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(root, siblings of each leaf)"""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            if (i ^ 1) < len(level):
                proofs[leaf].append((level[i ^ 1], i & 1))
            else:
                proofs[leaf].append((None, 0))
            at[leaf] = i // 2
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], proofs


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*map(field, r))
    out, subroots, langs = [], [], sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, proofs = tree([leaf(r) for r in own])
        subroots.append((root, own, proofs))
    root, above = tree([s[0] for s in subroots])
    for (sub, own, proofs), high in zip(subroots, above, strict=True):
        for r, low in zip(own, proofs, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            folded = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for sibling, right in low + high:
                folded = sha(folded) if sibling is None else sha(sibling, folded) if right else sha(folded, sibling)
            proof = sha(*[s for s, _ in low + high if s is not None])
            out.append((r[0], leaf(r), sub, root, proof, folded, folded == root))
    return sorted(map(str, out))


def as_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def manifest_rows(df, **options):
    found = merkle.audit(df, claimed=merkle.tampered(), **options)
    cols = found.select("key", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256), "folded_root", "verified")
    return sorted(str(tuple(r)) for r in cols.collect())


def test_manifest_matches_sql(spark):
    got = merkle.op11_merkle(spark, SMALL).collect()
    same_rows(got, duck(merkle.SQL, documents=spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().astype({"n_chars": "Int64"})))
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("stride,chain_bits", [(4, 8), (1, 2), (2, 4)])
def test_manifest_matches_a_plain_tree(spark, stride, chain_bits):
    rng = random.Random(11)
    rows = [(i, f"s{i % 3}", rng.choice(["de", "en", "en", "en", "Z", "é"]), i if i % 4 else None, "x" * (i % 9)) for i in range(700)]
    rows += [(None, None, None, None, None), (None, "", "en", 3, None), (5, "s", "lone", 1, "t")] + [(77, "same", "en", 7, "copy")] * 40
    rng.shuffle(rows)
    assert manifest_rows(as_docs(spark, rows), stride=stride, chain_bits=chain_bits) == plain_manifest(rows)


@pytest.mark.parametrize("n,langs", [(1, 1), (2, 1), (3, 3), (16, 1), (17, 2), (257, 1)])
def test_manifest_sizes(spark, n, langs):
    rows = [(i, "s", f"l{i % langs}", 1, "t") for i in range(n)]
    assert manifest_rows(as_docs(spark, rows)) == plain_manifest(rows)


def test_manifest_edges_and_files(spark, tmpdir_path):
    assert merkle.audit(as_docs(spark, [])).count() == 0
    df = as_docs(spark, [(i, "s", "l", 1, "long " * 100_000 if i == 3 else "") for i in range(9)])
    clash = df.withColumns({c: F.lit(1) for c in ("leaf", "tree", "position", "idx", "node", "key", "group", "hash")})
    assert manifest_rows(clash) == manifest_rows(df)
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.write_manifest(merkle.build(df), f"{tmpdir_path}/manifest")
    back = spark.read.parquet(f"{tmpdir_path}/manifest/leaves")
    assert back.count() == 9 and all(r["parent"] is None and len(r["siblings"]) == 4 for r in back.collect())  # the root is a stride above
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before  # the climb puts the limit back
    assert all(r["verified"] for r in merkle.audit(df).collect())


def test_nodes_that_all_leaves_pass_are_not_one_key(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, "a").alias("lang"), F.col("id").alias("n_chars"), F.lit("t").alias("text"))
    nodes = merkle.build(df).nodes
    assert nodes.count() == nodes.select("node").distinct().count()
    served = nodes.groupBy("parent").count().where("parent is not null").agg(F.max("count")).first()[0]
    assert served <= 16


# ---- operator 12 -------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), c


def test_centroids_match_sql(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    same_rows(centroids.op12_centroids(spark, SMALL).collect(), duck(centroids.SQL, embeddings=table.toPandas()))


@pytest.mark.parametrize("block,chunk", [(2, 8192), (5, 7), (64, 3)])
def test_centroids_match_plain_rounds(spark, block, chunk):
    rng = np.random.default_rng(12)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 64)]) for i in range(150)]
    rows += [(900 + i, rows[3][1]) for i in range(80)] + [(7, rows[9][1]), (7, rows[9][1]), (None, rows[2][1])]
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [None] + [0.1] * 63), (304, [float("nan")] * 64), (305, [float("inf")] * 64), (306, [0.0] * 64)]
    found, c = centroids.cluster(vectors(spark, rows).repartition(5), block=block, chunk=chunk)
    want, plain = plain_clusters(rows)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()) == want and c.tolist() == plain


def test_centroid_edges(spark):
    found, c = centroids.cluster(vectors(spark, []))
    assert found.columns == ["vec_id", "cluster", "distance"] and found.count() == 0 and not len(c)
    few = vectors(spark, [(i, [float(i)] * 64) for i in range(3)]).withColumns({"x": F.lit(1), "ids": F.lit("a"), "cluster": F.lit(None)})
    found, c = centroids.cluster(few)
    assert [r["distance"] for r in found.collect()] == [0, 0, 0] and len(c) == 3
    far, _ = centroids.cluster(vectors(spark, [(1, [1e308] * 64), (2, [-1e308] * 64)]), k=1, rounds=0)
    assert sorted(r["distance"] for r in far.collect()) == [0, 64 << 56]


def test_dictionaries_are_lossless():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (500, 6)).astype(np.int64)
    for a in range(0, 6, 2):
        entries, codes = centroids._encode(x[:, a : a + 2])
        assert (entries[codes] == x[:, a : a + 2]).all() and len(entries) == len(np.unique(x[:, a : a + 2], axis=0))


# ---- operator 13 -------------------------------------------------------------------------------------------------


def plain_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hits = [(i, label) for label, p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), sorted({x for _, x in hits})


def check_base(df, rows):
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_phrases(t), t[:200]
        assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
    return got


def test_licenses_match_sql(spark, small):
    same_rows(licenses.op13_licenses(spark, SMALL).collect(), duck(licenses.SQL, documents=small.toPandas()))


def test_license_phrases_match_a_plain_scan(spark):
    rng = random.Random(13)
    words = ["mit", "MIT", "license", "License", "apache", "general", "public", "the", "x-y", "licénse", "m", "2.0", "İ", "mit_license", ""]
    rows = [(i, rng.choice([" ", "\n", ", ", " ", "-"]).join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(300)]
    got = check_base(docs(spark, rows).repartition(5), rows)
    assert any(r["n_base"] > 2 for r in got.values()) and any(r["n_base"] == 0 for r in got.values())


def test_license_notices(spark):
    texts = {label: text for label, text, _ in licenses.NOTICES}
    rows = [(i, f"some words before {text.upper()}, and after") for i, (_, text, _) in enumerate(licenses.NOTICES)]
    other = len(rows)
    rows += [(other, "permission is hereby granted to license the apache plain"), (other + 1, texts["bsd"].replace("source", "sauce")),
             (other + 2, texts["bsd"].replace("without modification", "changes forbidden")), (other + 3, "cc by nc"), (other + 4, "clean text about nothing")]
    got = check_base(docs(spark, rows), rows)
    for i, (label, _, _) in enumerate(licenses.NOTICES):
        assert label in got[i]["labels"] and got[i]["score"] == 1, label
    assert got[other]["labels"] == got[other + 1]["labels"] == got[other + 4]["labels"] == []
    assert got[other + 2]["labels"] == ["bsd"] and licenses.LEAST_SHARE <= got[other + 2]["score"] < 1
    assert {p["label"] for p in got[0]["places"]} == set(got[0]["labels"])


def test_license_edges(spark):
    rows = [(1, None), (2, ""), (3, "mit license " * 30_000), (4, "word " * 200_000 + "Apache\tLicense"), (5, "MIT license"), (6, "...")]
    df = docs(spark, rows).withColumns({c: F.lit("x") for c in ("words", "found", "row", "word", "template", "start")})
    got = check_base(df, rows)
    assert got[3]["n_base"] == 30_000 and got[4]["first_word"] == 200_000
    again = docs(spark, [(5, "mit license")] * 3 + [(None, "gpl")])
    assert sorted(str(r["doc_id"]) for r in licenses.scan(again).collect()) == ["5", "5", "5", "None"]
    assert licenses.scan(docs(spark, [])).count() == 0
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
