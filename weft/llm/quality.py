"""Operator 8: quality classifier, a regularised quadratic discriminant over document statistics."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.language import remainder
from weft.llm.pieces import _chunks
from weft.llm.shared import land, table
from weft.llm.shingles import word_hashes
from weft.session import ship_package

#: Rates are drawn towards the usual rate by as many words, so that a short text is no outlier by its length.
DAMPING = 30
#: Share of the pooled, spherical covariance in a class's own; labelled rows that the calibration looks at, at most.
SHRINK, POOL, CALIBRATION_ROWS = 0.05, 0.3, 20_000
KEPT_AT = 0.7
CHUNK_CHARS = 2 << 20
FEATURES = ("upper", "digits", "symbols", "pipes", "bangs", "stops", "lines", "short", "repeats", "again", "letters")
_PLAIN = b".,;:'\"()-?! \n\t\r\x0b\x0c|"


def _kinds() -> np.ndarray:
    """Membership of each byte in the classes that are counted."""
    b = np.arange(256)
    upper, digit = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    letter = upper | ((b >= 97) & (b <= 122)) | (b >= 0xC0)
    symbol = (b < 128) & ~digit & ~letter & ~np.isin(b, list(_PLAIN))
    return np.stack([upper, digit, symbol, b == ord("|"), b == ord("!"), np.isin(b, list(b".,")), b == 10, letter]).astype(np.uint8)


_KINDS = _kinds()


def counts(texts: list[str | None]) -> np.ndarray:
    """Per text: words, letters, and the counts behind FEATURES (zeros for null and empty texts)."""
    words, offsets = word_hashes(texts)
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(x) + 1 for x in blobs])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    upper, digits, symbols, pipes, bangs, stops, lines, letters = (np.add.reduceat(k[data].astype(np.int32), starts) for k in _KINDS)
    lines = lines - 1  # the joint after each text
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    repeat = np.zeros(len(words), dtype=bool)
    repeat[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    keyed = np.sort((owner << np.uint64(44)) | (words >> np.uint64(20)))
    fresh = np.ones(len(words), dtype=bool)
    fresh[1:] = keyed[1:] != keyed[:-1]
    distinct = np.bincount((keyed[fresh] >> np.uint64(44)).astype(np.int64), minlength=len(n))
    space = _SPACES[data]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    short = np.bincount(owner[end - begin <= 3].astype(np.int64), minlength=len(n))
    repeats = np.bincount(owner[repeat].astype(np.int64), minlength=len(n))
    # words said before beyond what a text of this length has anyway (in prose, repeats grow by about n log n)
    again = np.maximum(n - distinct - n * np.log10(np.maximum(n, 1)) / 8, 0)
    return np.stack([n, letters, upper, digits, symbols, pipes, bangs, stops, lines, short, repeats, again], axis=1).astype(np.float64)


_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def statistics(counted: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """The transformed statistics: square roots of damped rates per word, and the logarithm of letters per word.

    ``usual`` has the rate of each count per word over the training rows."""
    n, letters, rest = counted[:, :1], counted[:, 1:2], counted[:, 2:]
    rates = (rest + DAMPING * usual[1:]) / (n + DAMPING)
    per_word = (letters + DAMPING * usual[0]) / (n + DAMPING)
    return np.concatenate([np.sqrt(rates), np.log(per_word + 0.1)], axis=1)


@dataclass
class Discriminant:
    """Per class: mean, Cholesky factor of the shrunk covariance, log determinant; and the calibration."""

    usual: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, usual, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Discriminant:
        """From counts, sums and sums of outer products by class.

        A class's covariance is mixed with the pooled one and with the diagonal of that."""
        means = sums / np.maximum(n, 1)[:, None]
        own = squares / np.maximum(n, 1)[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = np.average(own, axis=0, weights=np.maximum(n, 1e-9))
        diagonal = np.diag(np.diag(pooled) + 1e-4)
        cov = (1 - SHRINK) * ((1 - POOL) * own + POOL * pooled) + SHRINK * diagonal
        factors = np.linalg.cholesky(cov)
        logdets = 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
        return cls(usual, means, factors, logdets)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0 (tails tempered, so that a far outlier stays finite)."""
        logs = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(-0.5 * ((z * z).sum(axis=0) + logdet))
        return np.arcsinh((logs[1] - logs[0]) / 2)

    def calibrate(self, margin: np.ndarray, label: np.ndarray, steps: int = 50) -> None:
        """A logistic curve over the margin, by Newton's method with a slight penalty."""
        w = np.array([1.0, 0.0])
        design = np.stack([margin, np.ones_like(margin)], axis=1)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(design @ w).clip(-30, 30)))
            grad = design.T @ (p - label) + 0.01 * (w - [1.0, 0.0])
            hess = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
            w = w - np.linalg.solve(hess, grad).clip(-2, 2)
        self.slope, self.shift = max(float(w[0]), 1e-3), float(w[1])

    def score(self, counted: np.ndarray) -> np.ndarray:
        margin = self.margin(statistics(counted, self.usual))
        return 1 / (1 + np.exp(-(self.slope * margin + self.shift).clip(-30, 30)))


def document_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counted): the counts of every whole text, a row per row."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts, CHUNK_CHARS):
                rows = pa.array(list(counts(texts[a:b])), type=pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), rows], names=["doc_id", "counted"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, df.select(F.col(doc_id).alias("doc_id")).withColumn("counted", F.array(F.lit(0.0))).schema)


def train(counted: DataFrame, labels: DataFrame) -> Discriminant | float:
    """The discriminant of ``labels`` (doc_id, label: 0 or 1; the larger of several) over ``counted``.

    Means and covariances are sums over all labelled rows; only the calibration reads a bounded sample of them,
    chosen by a hash of the id.  With fewer than two classes the result is a constant score: the label, or 0.5.
    """
    labels = labels.where("label is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("label").alias("label"))
    rows = land(counted.join(labels, F.col("doc_id") == F.col("_id")).select("doc_id", "label", "counted"), "quality-training")
    width = len(FEATURES) + 1
    whole = rows.agg(*[F.sum(F.col("counted")[i]).alias(f"c{i}") for i in range(width)], F.count("*").alias("n")).first()
    if not whole["n"]:
        return 0.5
    usual = np.array([whole[f"c{i}"] for i in range(1, width)]) / max(whole["c0"], 1)
    damped = [(F.col("counted")[i] + F.lit(float(DAMPING * usual[i - 1]))) / (F.col("counted")[0] + DAMPING) for i in range(1, width)]
    x = rows.select("label", *[F.sqrt(c).alias(f"x{i}") for i, c in enumerate(damped[1:])], F.log(damped[0] + 0.1).alias(f"x{width - 2}"))
    p = width - 1
    found = x.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)],
                                   *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in range(p) for j in range(i + 1)])
    by = {r["label"]: r for r in found.where("label in (0, 1)").collect()}
    if len(by) < 2:
        return float(next(iter(by), 0.5))
    n = np.array([by[k]["n"] for k in (0, 1)], dtype=float)
    sums = np.array([[by[k][f"s{i}"] for i in range(p)] for k in (0, 1)])
    squares = np.array([[[by[k][f"q{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)] for k in (0, 1)])
    model = Discriminant.fit(usual, n, sums, squares)
    share = int(min(1.0, CALIBRATION_ROWS / n.sum()) * 1_000_000)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(1_000_000)) < share).select("counted", "label").collect()
    if sample:
        at = model.margin(statistics(np.array([r["counted"] for r in sample]), usual))
        model.calibrate(at, np.array([float(r["label"]) for r in sample]))
    return model


def score_documents(counted: DataFrame, model: Discriminant | float) -> DataFrame:
    """``counted`` with score, from 0 to 1: how likely label 1 is."""
    if isinstance(model, float):
        return counted.withColumn("score", F.lit(model))
    shared = counted.sparkSession.sparkContext.broadcast(model)  # two means and two matrices

    @F.pandas_udf("double")
    def score(col):
        import pandas as pd

        return pd.Series(shared.value.score(np.stack(col.to_numpy()))) if len(col) else pd.Series([], dtype=float)

    return counted.withColumn("score", score("counted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns from labels of rows that are not held out."""
    counted = land(document_counts(table(spark, sf_dir, "documents")), "quality-counts")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    found = score_documents(counted, train(counted, labels))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= KEPT_AT).cast("int").alias("predicted"))
