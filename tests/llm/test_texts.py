"""Near duplicates, pieces, personal data, language and quality: against plain versions, and at the edges."""
import hashlib
import math
import random
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import KINDS, SMALL, base_spans, docs, groups, jaccard_links, neighbours, words
from weft.llm import language, near_dups, personal, pieces, quality
from weft.llm.components import components


def near_fixture():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(25):
        out.append(rng.choices(vocabulary, k=rng.randint(1, 80)))
    base = rng.choices(vocabulary, k=120)
    for _ in range(70):  # one large group whose members differ in a few places
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(copy)
    for t in out[:10]:
        out.append(list(t))
        out.append(t[:-1] + ["changed"])
    return [" ".join(t) for t in out] + [None, "", "  ", "few words", "few  words", "a b c d e", "a b c d e f"]


@pytest.mark.parametrize("block", [512, 9])
def test_links_match_all_pairs(spark, block):
    texts = near_fixture()
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    df = docs(spark, [(i, texts[i], "c", 1) for i in order], ", cluster string, node long")
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(df, block=block).collect()}
    links = jaccard_links(texts)
    near, group = neighbours(links), groups(len(texts), links)
    assert len(got) == len(texts)
    assert {i: got[i]["n_links"] for i in got} == {i: len(near[i]) for i in got}
    assert {i: got[i]["group_id"] for i in got} == dict(enumerate(group))
    assert all(got[i]["group_size"] == group.count(group[i]) for i in got)
    kept = near_dups.one_per_group(df, block=block)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group))


def test_near_duplicates_of_repeated_rows_and_nothing(spark):
    text = " ".join(map(str, range(30)))
    df = docs(spark, [(1, text), (1, text), (2, text + " x"), (3, "else " * 9), (None, text), (4, None), (3, text + " y")])
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in near_dups.near_duplicates(df).collect()}
    assert got == {(1, 1, 3), (2, 2, 3), (3, 3, 0), (3, 3, 3), (4, 4, 0)}
    kept = sorted(map(tuple, near_dups.one_per_group(df).collect()), key=str)
    assert [r[0] for r in kept] == [1, 3, 3, 4, None]
    assert near_dups.near_duplicates(docs(spark, [])).count() == 0


def test_pruning_rule_is_the_posterior():
    for k, need in near_dups.least_matches():
        grid = np.linspace(0, 1, 200_001)

        def above(m):
            density = grid**m * (1 - grid) ** (k - m)
            return density[grid >= 0.8].sum() / density.sum()

        assert above(need) >= 0.99e-6 and (need == 0 or above(need - 1) < 1.01e-6)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 102), (7, 7), (200, 200)] + [(500 + i, 500) for i in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 102: 100, 105: 100, **{500 + i: 500 for i in range(50)}}


def odd_texts(n, seed=2):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "é", "日", "①", "END", "the", "ing", "\t", "▁", ".", "5", "😀", "    ", "e", "t", "in"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = [*odd_texts(3000), "a" * 3000, " " * 100, "日" * 1000, "", None]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = docs(spark, [(i, t, "x") for i, t in enumerate(texts)], ", piece_ids string").repartition(3)
    got = pieces.encode_texts(df, check="same").collect()
    assert len(got) == len(texts) and all(r["same"] for r in got)
    assert all(list(r["piece_ids"]) == library.encode(r["text"] or "") for r in got)


def test_segment_shares_prefixes_and_takes_the_best_path():
    p = pieces.Pieces(pieces.read_model(pieces.default_model()))

    def merged(word):  # byte-pair merging as defined, without any sharing
        s = list(word)
        while True:
            best = min(((p.rank[a + b], i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in p.rank), default=None)
            if best is None:
                return s
            s[best[1] : best[1] + 2] = ["".join(s[best[1] : best[1] + 2])]

    words = {w for t in odd_texts(400, 5) for w in t.replace(" ", "▁").split("\n") if w}
    assert all(merged(w) == found for w, found in p.segment(words))


def test_decode(spark):
    df = spark.createDataFrame([(1, [3 + 0xC3, 3 + 0x28]), (2, None), (3, [])], "k long, piece_ids array<int>")
    assert [r["decoded"] for r in pieces.decode_ids(df).collect()] == ["\ufffd(", None, ""]
    assert pieces.encode_texts(docs(spark, [])).count() == 0


def test_personal_base_spans(spark):
    rng = random.Random(3)
    parts = ["1", "2", "55", "255", ".", "@", " ", "-", "+", "(", ")", "a", "b.c", "é", "😀", "4111111111111111", "\n", "a@b.c", "%", "+1 (234) 555-1234", "1.2.3.4", "000", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "1" * 30_000, "a." * 10_000 + "@", "1." * 10_000, "+1" + " (" * 10_000, "a@b.c " * 500]
    df = docs(spark, [(i, t, "x") for i, t in enumerate(texts)], ", base string").repartition(4)
    got = personal.personal_data(df).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s.startswith(k) for s in want) for k in KINDS]
        assert set(want) <= set(r["spans"].split(",")) | {""} and r["n_added"] == len(list(filter(None, r["spans"].split(",")))) - len(want)


def test_personal_added_spans_and_edges(spark):
    texts = ["write to joe [at] host [dot] com now", "call (017) 555-1234 today", "4111111111111111 5555555555554444 here", "order 1234567890123456 shipped", "plain text 12 34"]
    texts += ["mail a@b.com", "4111111111111111", "tel +1 (234) 555-1234 ok"] * 30
    got = {r["doc_id"]: r for r in personal.personal_data(docs(spark, list(enumerate(texts)))).collect()}
    assert got[2]["spans"] == "card:0:16,card:17:33" and got[2]["n_card"] == 0 and got[2]["n_added"] == 2
    assert got[3]["spans"] == "" and got[4]["spans"] == ""
    assert personal.personal_data(docs(spark, [])).count() == 0


def test_personal_data_of_very_many_matches(spark):
    part = "".join(f"a{i % 10}@b.com +49 30 1234567 " for i in range(500))
    long = part * 100
    got = personal.personal_data(docs(spark, [(1, long), (2, part)])).collect()
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_email"], by[1]["n_phone"]) == (50_000, 50_000) and by[2]["n_email"] == 500
    for i, text in ((1, long), (2, part)):
        assert by[i]["base_sha256"] == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()
    assert by[1]["spans"].startswith(by[2]["spans"])


def test_sums_and_overlaps_in_blocks(spark):
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 10, 101):
        values = [rng.randrange(9) for _ in range(n)]
        ends = [sum(values[: i + 1]) for i in range(n)]
        base = [(3 * e, 3 * e + 2) for e in sorted(set(ends))]
        chosen = [(a, a + rng.randrange(1, 4)) for a in rng.choices(range(3 * sum(values) + 9), k=20)]
        df = spark.createDataFrame([(values, base, chosen)], "v array<int>, b array<struct<s:int,e:int>>, c array<struct<s:int,e:int>>")
        r = df.select(personal._sums_before(F.col("v")).alias("v"), personal._apart(F.col("c"), F.col("b")).alias("c")).first()
        assert r["v"] == [sum(values[:i]) for i in range(n)]
        assert [tuple(x) for x in r["c"]] == [x for x in chosen if not any(x[0] < b[1] and b[0] < x[1] for b in base)]


def test_reliabilities_follow_agreement():
    votes = lambda **v: {"n": 100, "check": 1, "gazetteer": 1, "context": 2, "edges": 1} | v
    share, law, post = personal.reliabilities([votes(n=300), votes(n=200, check=0, gazetteer=0), votes(n=5, check=0)])
    assert 0.4 < share < 0.8 and post[0] > 0.9 and post[1] < 0.1 and law["check"][0][1] > 0.8


def test_gru_gradients():
    net = language.ByteGRU.fresh(["a", "b", "c"], 4, 1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    data, label = np.random.default_rng(0).integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, grads = net.gradients(data, label)
    for name, grad in grads.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        moved = []
        for step in (1e-4, -2e-4):
            net.params[name][at] += step
            moved.append(net.gradients(data, label)[0])
        net.params[name][at] += 1e-4
        assert grad[at] == pytest.approx((moved[0] - moved[1]) / 2e-4, rel=1e-2, abs=1e-5)


def test_language_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.train(language.training_sample(df.where(language.remainder("doc_id", 3) != 1)))
    langs = {r["doc_id"]: r["lang"] for r in df.collect()}
    got = language.identify(df.select("doc_id", "text"), net).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(got) == len(langs) and np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97
    odd = docs(spark, [(1, None, 5.0), (2, "", 5.0), (3, "12 + 34 = ½ …", 5.0), (4, "the " * 30_000, 5.0), (5, "x" * 100_000, 5.0), (4, "the " * 30_000, 5.0)], ", score double")
    rows = language.identify(odd, net).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert len(rows) == 6 and [by[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and by[4][0] == "en" and by[5][0] != "und" and 0 <= by[5][1] <= 1
    # a word's sums are those of the network run over it alone
    one = net.word_sums([b"thing", b"y" * 90])
    assert one[0, :-1] == pytest.approx(net.probabilities(np.frombuffer(b" thing", dtype=np.uint8)[None]).sum(axis=(0, 1)), abs=1e-4) and one[1, -1] == 91


def test_language_of_long_documents_only(spark):
    rng = np.random.default_rng(3)
    voc = {"en": "the house stands with green water when which they both knew".split(), "pl": "który wszyscy dom przez zielony czwartek jest szczęście woda".split()}
    text = lambda lang, n: " ".join(rng.choice(voc[lang], n))
    rows = [(i, text("pl", 5_000), "pl") for i in range(6)] + [(10 + i, text("en", 300), "en") for i in range(40)] + [(60, "文字" * 60_000, "zh")]
    df = docs(spark, rows, ", lang string")
    assert min(len(r[1]) for r in rows if r[2] != "en") > 25_000
    sample = language.training_sample(df)
    assert {lang for lang, t in sample if t} == {"en", "pl", "zh"}
    for lang, _ in sample:
        assert sum(len(t.split()) for l, t in sample if l == lang) < 3 * language.SAMPLE_WORDS
    net = language.train(sample)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df.drop("lang"), net).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_language_without_anything_to_learn(spark):
    empty = docs(spark, [], ", lang string")
    net = language.train(language.training_sample(empty))
    assert [(r["lang_pred"], r["score"]) for r in language.identify(docs(spark, [(1, "word")]), net).collect()] == [("und", 0.0)]
    assert language.identify(docs(spark, []), net).count() == 0


def test_quality_on_held_out_documents(spark):
    from pyspark.sql import functions as F

    path = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op8_quality(spark, path).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    held = [(got[i]["predicted"], q) for i, q in labels.items() if i in got and got[i]["held_out"]]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.95
    assert np.mean([p for p, q in held if q == 1]) > 0.97 and all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    counted = quality.document_counts(docs(spark, [(1, None), (2, ""), (3, "word " * 50_000), (4, "x" * 100_000), (4, "x" * 100_000)]))
    none = counted.select(F.col("doc_id"), F.lit(None).cast("int").alias("label"))
    assert quality.train(counted, none) == 0.5
    assert quality.train(counted, counted.select("doc_id", F.lit(1).alias("label"))) == 1.0
    assert [r["score"] for r in quality.score_documents(counted, 0.5).collect()] == [0.5] * 5


def test_discriminant_is_the_log_density_ratio():
    rng = np.random.default_rng(5)
    x = [rng.normal(0, 1, (400, 3)), rng.normal(1, [0.5, 2, 1], (300, 3))]
    model = quality.Discriminant.fit(None, np.array([400, 300]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]))
    at = rng.normal(0, 1, (7, 3))
    logs = []
    for mean, factor in zip(model.means, model.factors, strict=True):
        cov = factor @ factor.T
        logs.append([-0.5 * ((p - mean) @ np.linalg.inv(cov) @ (p - mean) + np.log(np.linalg.det(cov))) for p in at])
    assert model.margin(at) == pytest.approx(np.arcsinh((np.array(logs[1]) - logs[0]) / 2))


def test_quality_counts():
    n, letters, upper, digits, symbols, pipes, bangs, stops, lines, short, repeats, again = quality.counts(["Ab ab ab! 12 x|y\n$$. É"])[0]
    assert (n, letters, upper, digits, symbols, pipes, bangs, stops, lines, short, repeats) == (7, 9, 1, 2, 2, 1, 1, 1, 1, 7, 0)
    assert quality.counts(["a a a b", None, ""])[:, [0, 10]].tolist() == [[4, 2], [0, 0], [0, 0]]


def _plain_counts(text):
    """The counts of a text, said again by patterns and loops."""
    t = text or ""
    w = words(t)
    ascii_letters = string.ascii_letters
    letters = sum(c in ascii_letters or ord(c) > 127 for c in t)  # a letter beyond ASCII is told by its first byte
    symbols = sum(ord(c) < 128 and not c.isalnum() and c not in ".,;:'\"()-?! \n\t\r\x0b\x0c|" for c in t)
    again = max(len(w) - len(set(w)) - len(w) * math.log10(max(len(w), 1)) / 8, 0)
    return [len(w), letters, sum(c in string.ascii_uppercase for c in t), sum(c in string.digits for c in t), symbols, t.count("|"), t.count("!"),
            t.count(".") + t.count(","), t.count("\n"), sum(len(x.encode()) <= 3 for x in w), sum(a == b for a, b in zip(w, w[1:])), again]


def test_quality_matches_a_plain_version(spark):
    """The whole query: counts by loops, covariances and densities by their formulas, the calibration by bisection of its slopes."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r["quality"] is not None}
    ids = [r["doc_id"] for r in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    c = np.array([_plain_counts(r["text"]) for r in rows])
    learnt = np.array([i in labels and not held(i) for i in ids])
    usual = c[learnt, 1:].sum(axis=0) / c[learnt, 0].sum()
    damped = (c[:, 1:] + 30 * usual) / (c[:, :1] + 30)
    x = np.column_stack([np.sqrt(damped[:, 1:]), np.log(damped[:, 0] + 0.1)])
    y = np.array([labels.get(i, -1) for i in ids])
    parts = [x[learnt & (y == k)] for k in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * v for p, v in zip(parts, covs)) / sum(map(len, parts))
    logs = []
    for p, v in zip(parts, covs):
        v = 0.95 * (0.7 * v + 0.3 * pooled) + 0.05 * np.diag(np.diag(pooled) + 1e-4)
        off = x - p.mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", off, np.linalg.inv(v), off) + np.linalg.slogdet(v)[1]))
    margin = np.arcsinh((logs[1] - logs[0]) / 2)
    m, t = margin[learnt], y[learnt]
    # the penalised fit: at its end both slopes are nought
    a, b = 1.0, 0.0
    for _ in range(200_000):
        r = 1 / (1 + np.exp(-(a * m + b))) - t
        da, db = (r * m).sum() + 0.01 * (a - 1), r.sum() + 0.01 * b
        if max(abs(da), abs(db)) < 1e-7:
            break
        a, b = a - 2e-3 * da, b - 2e-3 * db
    expect = dict(zip(ids, 1 / (1 + np.exp(-(a * margin + b)))))
    got = quality.op8_quality(spark, SMALL).collect()
    assert len(got) == len(ids) and 10 < learnt.sum() < len(ids)
    for g in got:
        assert g["score"] == pytest.approx(expect[g["doc_id"]], abs=2e-3)
        assert g["held_out"] == held(g["doc_id"]) and g["predicted"] == int(g["score"] >= 0.7)


def _plain_gru(net, data, d):
    """States of one direction at every position, one byte after the other, in double precision."""
    x, u = net.params["x" + d].astype(float), net.params["u" + d].astype(float)
    size, h, out = u.shape[0], np.zeros(u.shape[0]), {}
    s = lambda v: 1 / (1 + np.exp(-v))
    for t in range(len(data)) if d == "f" else reversed(range(len(data))):
        a, g = x[data[t]], h @ u
        z, r = s(a[:size] + g[:size]), s(a[size : 2 * size] + g[size : 2 * size])
        h = (1 - z) * np.tanh(a[2 * size :] + r * g[2 * size :]) + z * h
        out[t] = h
    return out


def test_language_matches_a_plain_version(spark):
    """The whole query: each document by itself, word by word and byte by byte, without what batches share or keep."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = language.train(language.training_sample(df.where(language.remainder("doc_id", 3) != 1)))
    got = {r["doc_id"]: r for r in language.op10_language(spark, SMALL).collect()}
    rows = df.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    checked = 0
    for r in sorted(rows, key=lambda r: len(r["text"] or ""))[:60]:
        text, g = r["text"] or "", got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not any(c.isalpha() for c in text):
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
            continue
        probs = []
        for w in text.encode().split():
            w = b" " + w
            for piece in (w[i : i + 40] for i in range(0, len(w), 40)):
                f, b = _plain_gru(net, piece, "f"), _plain_gru(net, piece, "b")
                for t in range(len(piece)):
                    e = np.exp(np.concatenate([f[t], b[t]]) @ net.params["v"] + net.params["b"])
                    probs.append(e / e.sum())
        mean = np.mean(probs, axis=0)
        assert g["score"] == pytest.approx(mean.max(), abs=1e-4) and mean[net.labels.index(g["lang_pred"])] == pytest.approx(mean.max(), abs=1e-4)
        checked += 1
    assert checked > 40
