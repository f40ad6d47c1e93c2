"""Operator 10: language identification by a bidirectional gated recurrent network over bytes (numpy).

A text is read word by word: a sequence is a blank and the bytes of a word (runs between ASCII spaces; words of
over 40 bytes are read in pieces of 40), and the network, one pass in each direction, labels every position
with a probability for each language.  A document's probabilities are the mean over all its positions.  Since the
state begins anew with each word, a word's sum is worked out once and reused wherever the word comes again.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.shared import kept, land, table
from weft.session import ship_package

UNKNOWN = "und"
#: The training sample: documents in all (shared evenly by the languages, by a hash of the id, whatever their
#: length), and words a language, by a hash of the id and the word's place in the text.
SAMPLE_DOCS, SAMPLE_WORDS = 800, 12_000
#: Words (runs between ASCII spaces) as the sample takes them; longer runs come in pieces of so many characters.
SAMPLE_WORD = r"[^ \t\n\x0B\f\r]{1,39}"
HIDDEN, EPOCHS, SEED = 16, 6, 10
MOST_BYTES = 40
#: Words that a worker keeps, and their bytes; characters of text that it works on at a time.
KEEP_WORDS, KEEP_BYTES, CHUNK_CHARS = 300_000, 16 << 20, 4 << 20


def _sequences(words: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Bytes of each word's pieces by length: for each length the words' numbers and a matrix of bytes."""
    cut: dict[int, tuple[list[int], list[bytes]]] = {}
    sizes = np.zeros(len(words), dtype=np.float32)
    for i, w in enumerate(words):
        w = b" " + w
        sizes[i] = len(w)
        for a in range(0, len(w), MOST_BYTES):
            piece = w[a : a + MOST_BYTES]
            at, held = cut.setdefault(len(piece), ([], []))
            at.append(i)
            held.append(piece)
    return sizes, [(np.array(at), np.frombuffer(b"".join(held), dtype=np.uint8).reshape(len(held), n)) for n, (at, held) in cut.items()]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class ByteGRU:
    """Parameters: for each direction a table of byte inputs (256 x 3h) and recurrent weights (h x 3h) in the order
    update, reset, candidate; output weights (2h x labels) and bias."""

    labels: list[str]
    params: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = SEED) -> ByteGRU:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        p = {}
        for d in "fb":
            p["x" + d] = draw(256, 3 * hidden, scale=0.3)
            p["u" + d] = draw(hidden, 3 * hidden, scale=hidden**-0.5)
        p["v"] = draw(2 * hidden, len(labels), scale=hidden**-0.5)
        p["b"] = np.zeros(len(labels), dtype=np.float32)
        return cls(labels, p)

    def _pass(self, d: str, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The states of one direction, time first, in the order of the positions."""
        x, u = self.params["x" + d], self.params["u" + d]
        n, steps = data.shape
        size = u.shape[0]
        h = np.zeros((n, size), dtype=np.float32)
        out = np.empty((steps, n, size), dtype=np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, g = x[data[:, t]], h @ u
            zr = _sigmoid(a[:, : 2 * size] + g[:, : 2 * size])
            z, r, gc = zr[:, :size], zr[:, size:], g[:, 2 * size :]
            c = np.tanh(a[:, 2 * size :] + r * gc)
            if keep is not None:
                keep.append((t, h, z, r, c, gc))
            h = c + z * (h - c)
            out[t] = h
        return out

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """Label probabilities at every position (time, sequences, labels)."""
        states = np.concatenate([self._pass("f", data), self._pass("b", data)], axis=2)
        return _softmax(states @ self.params["v"] + self.params["b"])

    def word_sums(self, words: list[bytes], block: int = 4096) -> np.ndarray:
        """For each word the sum of its positions' probabilities, and the number of positions last."""
        out = np.zeros((len(words), len(self.labels) + 1), dtype=np.float32)
        out[:, -1], groups = _sequences(words)
        for at, data in groups:
            for a in range(0, len(at), block):
                np.add.at(out[:, :-1], at[a : a + block], self.probabilities(data[a : a + block]).sum(axis=0))
        return out

    def gradients(self, data: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients by backpropagation through time."""
        p, (n, steps) = self.params, data.shape
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._pass(d, data, kept[d]) for d in "fb"], axis=2)
        prob = _softmax(states @ p["v"] + p["b"])
        rows = np.arange(n)
        loss = float(-np.log(prob[:, rows, label] + 1e-9).mean())
        err = prob
        err[:, rows, label] -= 1
        err /= n * steps
        size = p["uf"].shape[0]
        grads = {"v": np.einsum("tns,tnk->sk", states, err), "b": err.sum(axis=(0, 1))}
        back = err @ p["v"].T
        for d, part in (("f", back[:, :, :size]), ("b", back[:, :, size:])):
            u, gu, gx = p["u" + d], np.zeros_like(p["u" + d]), np.zeros_like(p["x" + d])
            later = np.zeros((n, size), dtype=np.float32)
            for t, h, z, r, c, gc in reversed(kept[d]):
                dh = part[t] + later
                ac = dh * (1 - z) * (1 - c * c)
                az, ar = dh * (h - c) * z * (1 - z), ac * gc * r * (1 - r)
                dg = np.concatenate([az, ar, ac * r], axis=1)
                gu += h.T @ dg
                np.add.at(gx, data[:, t], np.concatenate([az, ar, ac], axis=1))
                later = dh * z + dg @ u.T
            grads["u" + d], grads["x" + d] = gu, gx
        return loss, grads

    def fit(self, words: list[bytes], label: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 256, seed: int = SEED) -> list[float]:
        """Adam over batches of words of one length; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        _, groups = _sequences(words)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        losses, step = [], 0
        for epoch in range(epochs):
            parts = []
            for g, (at, _) in enumerate(groups):
                order = rng.permutation(len(at))
                parts += [(g, order[a : a + batch]) for a in range(0, len(at), batch)]
            total = 0.0
            for i in rng.permutation(len(parts)):
                g, rows = parts[i]
                at, data = groups[g]
                loss, grads = self.gradients(data[rows], label[at[rows]])
                total += loss
                step += 1
                for k, grad in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    size = rate * (1 - 0.8 * epoch / epochs) / (1 - 0.9**step)
                    self.params[k] -= (size * first[k] / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / max(len(parts), 1))
        return losses


def training_sample(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(lang, words) of the bounded sample, a row per document: of every language the first documents by a hash of the
    id, of any length, and of their words about 2 * SAMPLE_WORDS a language (all, if there are fewer) by a hash."""
    rows = df.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.md5(F.concat(F.lit("lang-"), F.col(doc_id).cast("string"))).alias("h"))
    n = rows.select("lang").distinct().count()
    each = max(SAMPLE_DOCS // max(n, 1), 1)
    found = rows.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("n") <= each)
    found = found.select("lang", "h", F.regexp_extract_all("text", F.lit(SAMPLE_WORD), F.lit(0)).alias("words"))
    found = found.withColumn("part", 2 * SAMPLE_WORDS / F.greatest(F.sum(F.size("words")).over(W.partitionBy("lang")), F.lit(1)))
    even = lambda i: F.pmod(F.xxhash64("h", i), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.concat_ws(" ", F.filter("words", lambda w, i: even(i) < F.col("part")))
    return sorted((r["lang"], r["text"]) for r in found.select("lang", chosen.alias("text")).collect())


def train(sample: list[tuple[str, str]], epochs: int = EPOCHS) -> ByteGRU:
    """A network fitted to the words of the sample; without any rows it has no labels."""
    rng = np.random.default_rng(SEED)
    labels = sorted({lang for lang, _ in sample})
    words, target = [], []
    for k, lang in enumerate(labels):
        own = [w for l, t in sample if l == lang for w in t.encode("utf-8", "replace").split()]
        take = rng.permutation(len(own))[:SAMPLE_WORDS]
        words += [own[i] for i in take]
        target += [k] * len(take)
    net = ByteGRU.fresh(labels)
    if len(labels) > 1:
        net.fit(words, np.array(target), epochs)
    return net


class _Scorer:
    """A worker's network and the words whose sums it keeps."""

    def __init__(self, net: ByteGRU):
        self.net, self.rows, self.sums, self.held = net, {}, np.zeros((0, len(net.labels) + 1), dtype=np.float32), 0

    def pooled(self, texts: list[str]) -> np.ndarray:
        if len(self.rows) > KEEP_WORDS or self.held > KEEP_BYTES:
            self.__init__(self.net)
        rows, ids, ends, known = self.rows, [], [], len(self.rows)
        for t in texts:
            ids += [rows.setdefault(w, len(rows)) for w in t.encode("utf-8", "replace").split()]
            ends.append(len(ids))
        if len(rows) > known:
            new = list(rows)[known:]
            self.held += sum(map(len, new))
            self.sums = np.concatenate([self.sums, self.net.word_sums(new)])
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        full = np.flatnonzero(np.diff(offsets) > 0)
        out = np.zeros((len(texts), self.sums.shape[1]))
        if len(full):
            out[full] = np.add.reduceat(self.sums[np.array(ids)].astype(np.float64), offsets[full], axis=0)
        return out[:, :-1] / np.maximum(out[:, -1:], 1)


def identify(df: DataFrame, net: ByteGRU, text: str = "text", name: str = "") -> DataFrame:
    """``df`` with lang_pred and score (columns of these names are replaced).

    ``und`` with score 0 for texts that are null or have no letter, and for all texts when nothing was learnt.
    Ties go to the first label by name.  Texts of any length are read whole, in chunks of whole documents.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((net.labels, net.params))  # some thousands of weights
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    place = keep.index(text)
    key = f"language-{name}{hash(net.params['v'].tobytes())}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weft.llm.pieces import _chunks

        scorer = kept(key, lambda: _Scorer(ByteGRU(*shared.value)))
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in _chunks(texts, CHUNK_CHARS):
                own = [t if t and any(map(str.isalpha, t)) else "" for t in texts[a:b]]
                prob = scorer.pooled(own) if scorer.net.labels else np.zeros((b - a, 1))
                best = prob.argmax(axis=1)
                known = [bool(t) and bool(scorer.net.labels) for t in own]
                langs = [scorer.net.labels[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
                scores = np.where(known, np.round(prob.max(axis=1), 6).clip(0, 1), 0.0)
                columns = [*batch.slice(a, b - a).columns, pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    schema = df.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return df.select(*keep).mapInArrow(run, schema)


#: Of the labelled texts that the network was not trained on and whose language it finds, such a share may score below the floor;
#: and the number of texts by which the floor is drawn towards chance.
DOUBTED, DRAWN = 0.001, 100


def _in_rank(scores: DataFrame, share: float) -> tuple[float | None, int]:
    """The score (of six digits) that such a share of all ``score`` rows lies below, exactly, and the number of rows.

    The rows are counted by score, and the counts by their first three digits: the driver sees some thousand rows."""
    counts = land(scores.groupBy(F.round(F.col("score") * 1_000_000).cast("long").alias("at")).agg(F.count("*").alias("n")), "scores")
    coarse = F.expr("at div 1000")
    total = counts.agg(F.sum("n")).first()[0] or 0
    left = int(share * total)
    for r in counts.groupBy(coarse.alias("part")).agg(F.sum("n").alias("n")).orderBy("part").collect():
        if left < r["n"]:
            for x in counts.where(coarse == r["part"]).orderBy("at").collect():
                if left < x["n"]:
                    return x["at"] / 1_000_000, total
                left -= x["n"]
        left -= r["n"]
    return None, total


def least_score(labelled: DataFrame, net: ByteGRU) -> float:
    """A floor for scores: the DOUBTED quantile of the scores of right predictions for all ``labelled`` texts (text, lang; equal
    ones count once), drawn towards one over the number of labels when these are few.  It tells texts without a clear language,
    not those in foreign letters, which the network can be sure of."""
    chance = 1 / len(net.labels)
    found = identify(labelled.where(F.col("lang").isNotNull()).select("text", "lang"), net)
    right = found.where(F.col("lang_pred") == F.col("lang"))
    # a copy is told by its digest: no text moves
    once = right.groupBy(F.sha2("text", 256).alias("digest"), "lang").agg(F.min("score").alias("score"))
    low, n = _in_rank(once.select("score"), DOUBTED)
    low = chance if low is None else low
    return chance + (low - chance) * n / (n + DRAWN) - 1e-6  # scores have six digits


def remainder(doc_id: str, n: int):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = train(training_sample(docs.where(remainder("doc_id", 3) != 1)))
    found = identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
