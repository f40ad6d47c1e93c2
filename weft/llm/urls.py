"""Operator 6: URL filters, rules first and gradient-boosted trees on lexical features for the rest."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.shared import land, table
from weft.session import ship_package

#: (verdict, host, path): a rule fits its host and all subdomains where the path begins with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Distinct labelled URLs that the trees are fitted to, at most; the trees, their depth, rate, bins and regularisation.
TRAIN_ROWS, TREES, DEPTH, RATE, BINS, PENALTY = 20_000, 40, 4, 0.2, 32, 1.0
BLOCK_AT = 0.5
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case.  Path: from there up to
    ``?``, ``#`` or the end.  Both are empty for null and where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _CAPITALS, _SMALL), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; of rules of one length the first."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last one that fits wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def suffix(host: Column) -> Column:
    """The last label of a host (empty for none)."""
    return F.substring_index(host, ".", -1)


def first_folder(path: Column) -> Column:
    """The first folder of a path (empty for none)."""
    return F.regexp_extract(path, "^/([^/]*)/", 1)


FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "path_digits", "host_entropy", "path_entropy", "parameters",
            "query_length", "hyphens", "secure", "fragment", "extension", "suffix_rate", "suffix_seen", "folder_rate", "folder_seen")


def _entropy(s: str) -> float:
    if not s:
        return 0.0
    n = np.unique(np.frombuffer(s.encode("utf-8", "replace"), dtype=np.uint8), return_counts=True)[1] / len(s.encode("utf-8", "replace"))
    return float(-(n * np.log2(n)).sum())


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """The lexical features of a URL, without the statistics."""
    url = url or ""
    query = url.partition("#")[0].partition("?")[2]
    digits = sum(c.isdigit() for c in url)
    name = path.rpartition("/")[2]
    return [len(url), len(host), len(path), path.count("/"), host.count(".") + bool(host), digits / max(len(url), 1), sum(c.isdigit() for c in path),
            _entropy(host), _entropy(path), query.count("&") + 1 if query else 0, len(query), url.count("-"), url.startswith("https://"), "#" in url, "." in name]


INPUTS = ("url", "host", "path", "suffix_rate", "suffix_seen", "folder_rate", "folder_seen")


def features(frame: pd.DataFrame) -> np.ndarray:
    """The matrix of FEATURES of a frame with the columns INPUTS."""
    lex = np.array([lexical(*x) for x in zip(frame["url"], frame["host"], frame["path"], strict=True)], dtype=np.float64).reshape(len(frame), len(FEATURES) - 4)
    return np.column_stack([lex, *[frame[f"{k}_rate"].to_numpy(float) if s == "rate" else np.log1p(frame[f"{k}_seen"].to_numpy(float))
                                   for k in ("suffix", "folder") for s in ("rate", "seen")]])


@dataclass
class Boosted:
    """Trees of fixed depth over binned features, fitted to the logistic loss by gradient and curvature sums."""

    prior: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def _leaves(tree, bins: np.ndarray) -> np.ndarray:
        feature, cut, _ = tree
        node = np.zeros(len(bins), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[np.arange(len(bins)), feature[node]] > cut[node])
        return node - (2**DEPTH - 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        """``weight``: the rows that each row of ``x`` stands for (1 by default)."""
        weight = np.ones(len(y)) if weight is None else weight
        share = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
        self.prior = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        bins, margin, width = self._bins(x), np.full(len(y), self.prior), BINS + 1
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (p - y), weight * p * (1 - p)
            inner = 2**DEPTH - 1
            feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, width)  # a node that isn't split sends all left
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(DEPTH):
                first = 2**level - 1
                best = np.full(2**level, 1e-6)
                for k in range(x.shape[1]):
                    at = (node - first) * width + bins[:, k]
                    gs = np.bincount(at, g, 2**level * width).reshape(-1, width)
                    hs = np.bincount(at, h, 2**level * width).reshape(-1, width)
                    gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                    ga, ha = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + PENALTY) + (ga - gl) ** 2 / (ha - hl + PENALTY) - ga**2 / (ha + PENALTY)
                    top = gain.argmax(axis=1)
                    most = gain[np.arange(len(top)), top]
                    won = np.flatnonzero(most > best)
                    best[won], feature[first + won], cut[first + won] = most[won], k, top[won]
                node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - inner
            value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + PENALTY)
            self.trees.append((feature, cut, value))
            margin += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins, margin = self._bins(x), np.full(len(x), self.prior)
        for tree in self.trees:
            margin += tree[2][self._leaves(tree, bins)]
        return 1 / (1 + np.exp(-margin))


def training_sample(labelled: DataFrame) -> DataFrame:
    """At most TRAIN_ROWS distinct URLs of ``labelled`` (INPUTS' plain columns, suffix, folder, label), with ``weight``.

    A URL's priority is a hash of it, even over (0, 1), over its number of rows; of each label the URLs of least
    priority are taken, half of TRAIN_ROWS or what the other label leaves over.  The weight is the number of rows that
    a URL stands for: its own, or if that is more, the inverse of the first priority that is left out (priority
    sampling).  Thus repeats weigh as much as they are rows, and never keep other URLs out.
    """
    found = labelled.groupBy("url", "host", "path", "suffix", "folder", "label").agg(F.count("*").alias("rows"))
    even = (F.pmod(F.xxhash64("url", F.lit("train")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    found = land(found.withColumn("priority", even / F.col("rows")), "url-distinct")
    # URLs by powers of two of the priority, some 90 groups a label: the first powers that hold enough bound what is sorted
    power = F.floor(F.log2("priority"))
    counts: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for r in found.groupBy("label", power.alias("power")).count().collect():
        counts[r["label"]][r["power"]] = r["count"]
    urls = {label: sum(c.values()) for label, c in counts.items()}
    parts = []
    for label, c in counts.items():
        own = found.where(F.col("label") == label)
        most = max(TRAIN_ROWS // 2, TRAIN_ROWS - urls[1 - label])
        if urls[label] > most:
            held = 0
            for last in sorted(c):
                held += c[last]
                if held > most:
                    break
            first = own.where(power <= last).orderBy("priority", "url").limit(most + 1)
            left_out = first.agg(F.max("priority")).first()[0]
            own = first.where(F.col("priority") < left_out).withColumn("weight", F.greatest(F.col("rows").cast("double"), F.lit(1 / left_out)))
        else:
            own = own.withColumn("weight", F.col("rows").cast("double"))
        parts.append(own)
    return parts[0].unionByName(parts[1]).drop("rows", "priority")


def judge(df: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, learn_from: Column | None = None) -> DataFrame:
    """One row per row of ``df``: page_id (the key), host, path, rule, verdict, score.

    Of the rows that a rule decides, those for which ``learn_from`` is true (all by default) are learnt from; the others' scores
    tell how well the trees do on URLs that they have not seen.

    The URLs that a rule decides are the labelled ones.  For the others the trees give the probability of "block",
    ``score``, and the verdict is "block" from 0.5 on.  The suffix and folder statistics (share of blocked URLs, and
    number of labelled URLs, by the last label of the host and by the first folder of the path) are taken over
    all labelled rows; the trees are fitted to at most TRAIN_ROWS distinct URLs of them, of both labels, weighted by
    the rows that they stand for (``training_sample``).  A table whose rules give one verdict only, or none, has score 0 or 1, or 0 (allow).  Null, empty and very long URLs, repeated rows and ties are judged like others.
    """
    ship_package(df.sparkSession)
    host, path = host_and_path(F.col(url))
    rows = df.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"),
                     F.coalesce(F.lit(True) if learn_from is None else learn_from, F.lit(False)).alias("learnt"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    keys = {"suffix": suffix(F.col("host")), "folder": first_folder(F.col("path"))}
    rows = land(rows.withColumns({"rule": rule, "decided": verdict, **keys}), "url-rows")
    label = (F.col("decided") == "block").cast("int")
    labelled = rows.where("decided is not null and learnt").withColumn("label", label)
    whole = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    n, blocked = whole["n"], whole["blocked"] or 0
    share = blocked / n if n else 0.0
    stats = {k: land(labelled.groupBy(k).agg(F.count("*").alias(f"{k}_seen"), F.sum("label").alias("blocked")), f"url-{k}") for k in keys}

    def with_stats(frame: DataFrame) -> DataFrame:
        for k, found in stats.items():
            # shares are drawn towards the whole table's by 20 URLs
            rate = (F.col("blocked") + 20 * share) / (F.col(f"{k}_seen") + 20)
            frame = frame.join(found.select(k, rate.alias(f"{k}_rate"), f"{k}_seen"), k, "left")
        return frame.na.fill({f"{k}_rate": share for k in stats} | {f"{k}_seen": 0 for k in stats})

    if 0 < blocked < n:
        sample = with_stats(training_sample(labelled)).select(*INPUTS, "label", "weight").toPandas().sort_values("url", ignore_index=True)
        # in all, the weights are as many as the rows, or TRAIN_ROWS
        weight = sample["weight"].to_numpy(float) * min(1.0, TRAIN_ROWS / n)
        model = Boosted().fit(features(sample), sample["label"].to_numpy(float), weight)
        shared = df.sparkSession.sparkContext.broadcast(model)  # 40 trees of 16 leaves

        @F.pandas_udf("double")
        def score(inputs: pd.DataFrame) -> pd.Series:
            return pd.Series(shared.value.predict(features(inputs)) if len(inputs) else [], dtype=float)

        scored = with_stats(rows).withColumn("score", score(F.struct(*INPUTS)))
    else:
        scored = rows.withColumn("score", F.lit(float(share)))
    said = F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", said).alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
