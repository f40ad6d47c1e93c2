"""Operator 12: centroid clustering over subvector dictionaries.

Vectors become whole numbers once and are landed as chunks of at most ``CHUNK`` rows.  In a chunk each block of ``BLOCK``
dimensions has a dictionary of its distinct subvectors, and a vector is its codes.  A round computes the exact distance of
every dictionary entry to every centroid's block once, and adds these partial distances up by code.  Chunks never
meet: what leaves a task is, for each centroid, a count and a sum per dimension, which Spark adds up.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.shared import land, table
from weft.session import ship_package

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Vectors of a chunk at most, and dimensions of a dictionary's entries.
CHUNK, BLOCK = 8192, 2
#: Whole numbers beyond this are taken as it: the squared distance of any two vectors fits a long.
LARGEST = 1 << 27
_IDS, _OUT = "vec_id long, row int", "vec_id long, cluster int, distance long"


def _encode(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, codes) of the rows of a block: its distinct subvectors in order, and the number of each row's."""
    order = np.lexsort(block.T[::-1])
    held = block[order]
    new = np.ones(len(block), dtype=bool)
    new[1:] = (held[1:] != held[:-1]).any(axis=1)
    codes = np.empty(len(block), dtype=np.uint16)
    codes[order] = np.cumsum(new) - 1
    return held[new], codes


def _chunks(dimensions: int, block: int, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[np.ndarray] = []

        def cut() -> pa.RecordBatch:
            x = np.concatenate(parts)
            entries, codes = zip(*(_encode(x[:, a : a + block]) for a in range(0, dimensions, block)), strict=True)
            out = [pa.array([ids], pa.list_(pa.int64())), pa.array([[e.astype("<i4").tobytes() for e in entries]], pa.list_(pa.binary())),
                   pa.array([[c.astype("<u2").tobytes() for c in codes]], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(out, names=["ids", "entries", "codes"])

        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            names, at = batch.column("vec_id").to_pylist(), 0
            while at < len(x):
                take = min(chunk - len(ids), len(x) - at)
                ids, parts, at = ids + names[at : at + take], [*parts, x[at : at + take]], at + take
                if len(ids) == chunk:
                    yield cut()
                    ids, parts = [], []
        if ids:
            yield cut()

    return run


def encode(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(rows, chunks), landed.  rows: vec_id and x, the kept vectors in whole numbers floor(scale * component).  chunks: ids, entries
    (each block's dictionary, int32) and codes (uint16) of up to ``chunk`` of them.

    Vectors of another length, and those that are null or hold a null or a component that is not finite, are left out.
    Whole numbers are held to +-2^27.  Null ids are kept; equal rows are vectors of their own."""
    ship_package(df.sparkSession)
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") == dimensions)
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    rows = land(rows.select("vec_id", F.transform("v", whole).alias("x")), "centroid-rows")
    chunks = rows.mapInArrow(_chunks(dimensions, block, chunk), "ids array<long>, entries array<binary>, codes array<binary>")
    return rows, land(chunks, "centroid-chunks")


def _assigned(entries: list[bytes], codes: list[bytes], centroids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, cluster, distance) of a chunk: partial distances of the dictionaries' entries, added up by code."""
    total, parts = None, []
    for b, (e, c) in enumerate(zip(entries, codes, strict=True)):
        width = min(block, centroids.shape[1] - b * block)
        held = np.frombuffer(e, "<i4").astype(np.int64).reshape(-1, width)
        code = np.frombuffer(c, "<u2")
        diff = held[:, None, :] - centroids[None, :, b * block : b * block + width]
        partial = np.einsum("ekd,ekd->ek", diff, diff)[code]
        total = partial if total is None else total + partial
        parts.append(held[code])
    cluster = total.argmin(axis=1)  # of equal distances the first centroid's
    return np.concatenate(parts, axis=1), cluster, total[np.arange(len(cluster)), cluster]


def _sums(centroids: np.ndarray, block: int):
    """For each chunk: (cluster, dimension, total, rows) of the clusters that it has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["entries", "codes"]).to_pylist():
                x, cluster, _ = _assigned(r["entries"], r["codes"], centroids, block)
                rows = np.bincount(cluster, minlength=len(centroids))
                total = np.zeros(centroids.shape, dtype=np.int64)
                np.add.at(total, cluster, x)
                live = np.flatnonzero(rows)
                d = centroids.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(live, d).astype(np.int32)), pa.array(np.tile(np.arange(d, dtype=np.int32), len(live))),
                                                  pa.array(total[live].ravel()), pa.array(np.repeat(rows[live], d).astype(np.int64))], names=["cluster", "dimension", "total", "rows"])

    return run


def _labels(centroids: np.ndarray, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _, cluster, distance = _assigned(r["entries"], r["codes"], centroids, block)
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` rows with the smallest sha256 of ``<seed>:<vec_id>`` (ties by components, null ids last), in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    some = rows.select(name.alias("name"), "x").orderBy(F.col("name").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in some], dtype=np.int64)


def moved(chunks: DataFrame, centroids: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The centroids after one round: the floored mean of each one's vectors; one without vectors stays.
    The driver gets a row for each centroid and dimension."""
    found = chunks.mapInArrow(_sums(centroids, block), "cluster int, dimension int, total long, rows long")
    sums = found.groupBy("cluster", "dimension").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("rows").alias("rows"))
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"], r["dimension"]] = int(r["total"]) // r["rows"]
    return out


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS,
            scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each kept vector, landed; the final centroids).

    ``rounds`` times every vector goes to the nearest centroid (ties: the smaller number), and the centroids move; then
    vectors are assigned once more.  There are fewer than ``k`` centroids where fewer vectors are kept, and no rows where
    none is.  See ``encode`` for what is kept.  Other columns of ``df`` are not read."""
    rows, chunks = encode(df, key, vector, dimensions, scale, block, chunk)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], _OUT), centroids
    for _ in range(rounds):
        centroids = moved(chunks, centroids, block)
    return land(chunks.mapInArrow(_labels(centroids, block), _OUT), "centroid-labels"), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of distances that pass a long are null.  The table of centroids that is broadcast has CENTROIDS rows at most."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("held"))
    total = sums.agg(F.sum("held")).first()[0]
    names = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())], "cluster int, centroid string")
    one = sums.join(names, "cluster").select("cluster", F.expr("try_cast(held AS bigint)").alias("cluster_inertia"), F.lit(None if total is None else str(total)).try_cast("long").alias("inertia"),
                                             F.sha2("centroid", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(one), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def centroids_sql(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> str:
    """Plain rounds: every vector against every centroid."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS one, list_transform(embedding, lambda x: greatest(least(floor(x::DOUBLE * {SCALE}), {LARGEST}), -{LARGEST})::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dimensions} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS k, x AS c FROM v QUALIFY k < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT one, any_value(vec_id) AS vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT one, vec_id, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r}) GROUP BY one)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (one), range(1, {dimensions + 1}) t(i) GROUP BY k, i),
f{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM m{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(f{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN f{r} USING (k))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""


SQL = centroids_sql()
