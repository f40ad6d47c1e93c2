"""Operator 9: approximate nearest neighbours over robust-pruned directed graphs, one per shard."""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.shared import land, table
from weft.session import ship_package

#: Vectors in a shard, on average and at least (see ``rows_of_shard``); edges of a node; beam while building and while searching; relaxation of the pruning.
SHARD_ROWS, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 2000, 24, 48, 128, 1.2
NEAREST = 10
QUERY_BLOCK = 512


def _distances(x: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own rows (-1: infinite)."""
    d = x[rows] - queries[:, None, :]
    out = np.einsum("qkd,qkd->qk", d, d)
    out[rows < 0] = np.inf
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int, visited: bool = False):
    """Greedy searches of a block of queries at once: each follows the edges of the nearest node of its beam that it
    has not yet followed, until it has followed all of them.

    Returns the beams (node numbers, squared distances, nearest first; -1: none), and with ``visited`` for each
    query the nodes that it followed, in their order."""
    n_q, degree = len(queries), graph.shape[1]
    ids = np.full((n_q, beam), -1, dtype=np.int64)
    dist = np.full((n_q, beam), np.inf, dtype=x.dtype)
    done = np.ones((n_q, beam), dtype=bool)
    first = start[:beam]
    ids[:, : len(first)] = first
    dist[:, : len(first)] = _distances(x, ids[:, : len(first)], queries)
    done[:, : len(first)] = False
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist, done = (np.take_along_axis(v, order, 1) for v in (ids, dist, done))
    path: list[tuple[np.ndarray, np.ndarray]] = []
    live = np.arange(n_q)
    while len(live):
        todo = ~done[live]
        live = live[todo.any(axis=1)]
        if not len(live):
            break
        at = (~done[live]).argmax(axis=1)
        node = ids[live, at]
        done[live, at] = True
        if visited:
            path.append((live, node))
        near = graph[node]
        # neighbours that the beam already holds are no news
        known = (near[:, :, None] == ids[live][:, None, :]).any(axis=2)
        near = np.where(known, -1, near)
        d = _distances(x, near, queries[live])
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_dist = np.concatenate([dist[live], d], axis=1)
        all_done = np.concatenate([done[live], near < 0], axis=1)
        keep = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live], done[live] = (np.take_along_axis(v, keep, 1) for v in (all_ids, all_dist, all_done))
        done[live] |= ~np.isfinite(dist[live])
    return (ids, dist, path) if visited else (ids, dist)


def robust_prune(x: np.ndarray, own: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The edges of each node of ``own`` out of its candidates ``pool`` (-1: none).

    The nearest candidate becomes an edge, and drops the candidates that are nearer to it, by the factor
    ``alpha``, than to the node; so it goes on until ``degree`` edges are found or no candidate is left.  What was
    dropped may fill places that are left over, nearest first."""
    pool = np.sort(pool, axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    pool[pool == own[:, None]] = -1
    dist = _distances(x, pool, x[own])
    order = np.argsort(dist, axis=1, kind="stable")
    pool, dist = np.take_along_axis(pool, order, 1), np.take_along_axis(dist, order, 1)
    width = min(pool.shape[1], 4 * degree)
    pool, dist = pool[:, :width], dist[:, :width]
    rows = np.arange(len(own))
    left = np.isfinite(dist)
    out = np.full((len(own), degree), -1, dtype=np.int64)
    for e in range(degree):
        some = left.any(axis=1)
        if not some.any():
            break
        r = rows[some]
        at = left[r].argmax(axis=1)
        chosen = pool[r, at]
        out[r, e] = chosen
        left[r, at] = False
        d = x[pool[r]] - x[chosen][:, None, :]
        left[r] &= ~(alpha * alpha * np.einsum("qkd,qkd->qk", d, d) <= dist[r])
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(graph, start nodes): out-edges of each vector, by two passes over all of them in random order.

    A block of vectors is searched for in the graph so far; the nodes that its searches followed and found, with
    its present edges, are pruned to its new edges, which are then offered to their ends as back edges."""
    n = len(x)
    rng = np.random.default_rng(seed)
    degree = min(degree, max(n - 1, 1))
    graph = rng.integers(0, n, (n, degree)) if n > 1 else np.full((n, degree), -1)
    graph = np.where(graph == np.arange(n)[:, None], (graph + 1) % max(n, 1), graph) if n > 1 else graph
    centre = x.mean(axis=0)
    start = np.argsort(((x - centre) ** 2).sum(axis=1), kind="stable")[:1]
    start = np.unique(np.concatenate([start, rng.integers(0, n, 7)])) if n > beam else np.arange(n)
    for relax in (1.0, alpha):
        order = rng.permutation(n)
        for a in range(0, n, QUERY_BLOCK):
            own = order[a : a + QUERY_BLOCK]
            ids, _, path = beam_search(x, graph, start, x[own], beam, visited=True)
            followed = np.full((len(own), len(path)), -1, dtype=np.int64)
            for k, (who, node) in enumerate(path):
                followed[who, k] = node
            graph[own] = robust_prune(x, own, np.concatenate([graph[own], ids, followed], axis=1), degree, relax)
            tail, head = np.repeat(own, degree), graph[own].ravel()
            tail, head = tail[head >= 0], head[head >= 0]
            by = np.argsort(head, kind="stable")
            ends, first, many = np.unique(head[by], return_index=True, return_counts=True)
            back = np.full((len(ends), min(int(many.max(initial=0)), 4 * degree)), -1, dtype=np.int64)
            place = np.arange(len(by)) - np.repeat(first, many)
            fits = place < back.shape[1]
            back[np.repeat(np.arange(len(ends)), many)[fits], place[fits]] = tail[by][fits]
            graph[ends] = robust_prune(x, ends, np.concatenate([graph[ends], back], axis=1), degree, relax)
    return graph, start


def rows_of_shard(n: int, least: int = SHARD_ROWS, most: int = 50_000) -> int:
    """Vectors of a shard for ``n`` in all: every query visits every shard, so shards grow with the square root of the table."""
    return max(least, min(most, math.isqrt(10 * n)))


def _length(diff: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the rows of ``diff``; where squares leave the range of a double, of scaled components."""
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((diff**2).sum(axis=1))
        odd = ~np.isfinite(out) | (out < 1e-140)
        if odd.any():
            most = np.abs(diff[odd]).max(axis=1)
            most[most == 0] = 1
            out[odd] = np.sqrt(((diff[odd] / most[:, None]) ** 2).sum(axis=1)) * most
    return out


#: Components of a query, or of a shard's vectors between themselves, further apart than this are compared one by one.
SPREAD = 1e100


@dataclass
class _Shard:
    """A shard's vectors ``x`` and its graph, in double precision and scaled by the largest component."""

    x: np.ndarray
    ids: list[list[int]]

    def __post_init__(self):
        most = np.abs(self.x).max(axis=1)
        self.scale = float(most.max())
        self.flat = most.min() * SPREAD > self.scale
        self.scaled = self.x / self.scale
        self.graph, self.start = build_graph(self.scaled) if self.flat else (None, None)

    def nearest(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Node numbers (-1: none) for each query: those of its beam, or all where squares could leave the range."""
        most = np.abs(queries).max(axis=1)
        fits = self.flat & (most < self.scale * SPREAD) & (most * SPREAD > self.scale)
        out = np.full((len(queries), len(self.x) if not fits.all() else beam), -1, dtype=np.int64)
        out[~fits] = np.arange(out.shape[1])
        if fits.any():
            found, _ = beam_search(self.scaled, self.graph, self.start, queries[fits] / self.scale, beam)
            width = min(found.shape[1], out.shape[1])
            out[np.flatnonzero(fits)[:, None], np.arange(width)] = found[:, :width]
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), width)


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST, shard_rows: int | None = None, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (key and vector, as in ``vectors``) its ``k`` nearest
    rows of ``vectors`` with another id, nearest first, ties by the smaller id.  The score is the Euclidean
    distance of the original vectors in double precision, of any size that a double holds.

    Vectors that are null, empty or all zero, or hold a null or a component that is not finite, take no part; nor do rows
    without an id, and vectors of another length than most (the smallest of ties).  Copies of a vector are one
    node of a graph, with the k + 1 smallest ids (more can't be among the k nearest).  The nodes are dealt to shards
    by a hash; a task builds a shard's graph, and each block of queries is searched for in each shard.  With at
    most ``k`` candidates all are found.  Of rows that repeat an id the smallest vector by components counts, among the
    queries as among the candidates.
    """
    ship_package(vectors.sparkSession)
    good = lambda c: F.col(c).isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(c, lambda v: v != 0)

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda v: v.cast("double")).alias("x"))
        return rows.where(F.col("id").isNotNull() & good("x"))

    rows = land(usable(vectors).groupBy("id").agg(F.min("x").alias("x")), "ann-rows")
    widths = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = widths["w"] if widths else 1
    rows = rows.where(F.size("x") == width)
    # a grouped limit before the shuffle, so that a very common vector is not gathered anywhere
    ranked = rows.withColumn("n", F.row_number().over(W.partitionBy("x").orderBy("id"))).where(F.col("n") <= k + 1)
    nodes = ranked.groupBy("x").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = land(nodes.select("node", "x", "ids"), "ann-nodes")
    n = nodes.count()
    shards = max(1, round(n / (shard_rows or rows_of_shard(n))))
    asked = usable(queries).groupBy("id").agg(F.min("x").alias("x"))
    asked = land(asked.where(F.size("x") == width), "ann-queries")
    # a partition per shard, in which the nodes come first, then every query
    left = nodes.select(F.expr(f"cast(pmod(xxhash64(node, 9), {shards}) as int)").alias("shard"), F.lit(0).alias("kind"), "node", "x", "ids")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("id").alias("node"), "x", F.array(F.col("id")).alias("ids"))
    both = left.union(right).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current, graph = None, None

        def built() -> _Shard:
            t = pa.Table.from_batches(held).combine_chunks()
            return _Shard(_matrix(t.column("x").chunk(0), width), t.column("ids").to_pylist())

        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if shard[a] != current:
                    current, held, graph = shard[a], [], None
                if kind[a] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue  # a shard without nodes
                graph = graph or built()
                x, ids = graph.x, graph.ids
                q = _matrix(part.column("x"), width)
                for p in range(0, len(q), QUERY_BLOCK):
                    own = q[p : p + QUERY_BLOCK]
                    found = graph.nearest(own, max(beam, k + 1))
                    names = part.column("node").slice(p, len(own)).to_pylist()
                    out_q, out_v, out_d = [], [], []
                    for name, v, nodes_of in zip(names, own, found, strict=True):
                        nodes_of = nodes_of[nodes_of >= 0]
                        d = _length(x[nodes_of] - v)
                        best = sorted((float(e), i) for e, node in zip(d, nodes_of, strict=True) for i in ids[node] if i != name)[:k]
                        out_q += [name] * len(best)
                        out_v += [i for _, i in best]
                        out_d += [e for e, _ in best]
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_d, pa.float64())], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, among all the others."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
