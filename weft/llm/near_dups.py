"""Operator 2: Jaccard join on word shingles with Bayesian pruning of candidates.

1. One scan takes the shingle set and the MinHash values of every text.  Texts with the same set are one class.
2. Classes that agree on a band of MinHash values are candidates.  A band's bucket is cut into blocks of bounded
   size, and a task gets two blocks: hot buckets are spread over many tasks and no group is held as a whole.
3. In a task the MinHash values of a pair are compared step by step.  After each step the pair is dropped when the
   posterior probability that its similarity reaches the threshold (flat prior, so a beta law) is below the
   tolerance.  A pair counts in the first band it shares only.  Survivors leave the task as a spanning forest.
4. The components of those forests are clusters: classes of a cluster meet again, in blocks, with their shingle
   sets.  The same pruning gives the same survivors, and each is verified exactly.  What leaves a task is a row per
   class: its links, and the least class that it is linked to within the block.  Pairs are never written out.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.components import components
from weft.llm.pieces import _chunks
from weft.llm.shared import kept, land, table
from weft.llm.shingles import minhash, mix64, set_digest, shingle_sets
from weft.session import ship_package

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: 25 bands of 5 values: a pair at the threshold agrees on no band with probability 5e-5, at 0.9 with 2e-10.
BANDS, ROWS, STEP = 25, 5, 25
#: Classes in a block; a task's unit of work is two blocks at most.
BLOCK = 512
CHUNK_CHARS = 2 << 20


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, n: int = BANDS * ROWS, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on): with m of k equal, the posterior of the similarity is
    Beta(m + 1, k - m + 1), and its mass above the threshold is the chance of at most m successes in k + 1 draws."""
    out = []
    for k in range(step, n + 1, step):
        mass, need = 0.0, 0
        for m in range(k + 1):
            mass += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if mass >= tolerance:
                need = m
                break
        out.append((k, need))
    return out


def _survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, plan: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that are left when the MinHash values are compared step by step."""
    same, done = np.zeros(len(a), dtype=np.int16), 0
    for k, need in plan:
        same = same + (sig[a, done:k] == sig[b, done:k]).sum(axis=1, dtype=np.int16)
        keep = same >= need
        a, b, same, done = a[keep], b[keep], same[keep], k
    return a, b


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each member's component, for pairs over range(n)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _pairs(first: np.ndarray, second: np.ndarray, same: bool, rows: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of one block, or of two, a bounded number at a time."""
    if same:
        a, b = np.triu_indices(len(first), 1)
        yield first[a], first[b]
        return
    step = max(rows // max(len(second), 1), 1)
    for i in range(0, len(first), step):
        part = first[i : i + step]
        yield np.repeat(part, len(second)), np.tile(second, len(part))


def _scan(texts: list, words: int, seed: int):
    flat, offsets = shingle_sets(texts, words)
    sig = minhash(flat, offsets, BANDS * ROWS, seed)
    return flat, offsets, sig


def _digests(flat: np.ndarray, offsets: np.ndarray, seed: int) -> list[bytes]:
    """128 bits for each set."""
    both = np.stack([set_digest(flat, offsets), set_digest(mix64(flat ^ np.uint64(seed)), offsets)], axis=1)
    return [x.tobytes() for x in both]


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of equal-sized rows of a matrix."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def signatures(df: DataFrame, doc_id: str, text: str, words: int = WORDS, seed: int = 1) -> DataFrame:
    """(doc_id, n, digest, sig): number of shingles, a 128-bit digest of the set, MinHash values; a row per row."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near-duplicates")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts, CHUNK_CHARS):
                flat, offsets, sig = _scan(texts[a:b], words, seed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(_digests(flat, offsets, seed), type=pa.binary()), _binary(sig)], names=["doc_id", "n", "digest", "sig"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, digest binary, sig binary")


def _blocked(rows: DataFrame, group: str, member: str, block: int) -> DataFrame:
    """Rows once for each pair of blocks that they take part in: (group, i, j, side) are added, i <= j.

    A member's block is a hash of it modulo the group's number of blocks, which follows from the group's size.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size")).where("_size > 1")
    rows = rows.join(sizes, group).withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int"))
    rows = rows.withColumn("_own", F.expr(f"cast(pmod(xxhash64({member}, 17), _blocks) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    return rows.select("*", other).select(
        *[c for c in rows.columns if c not in ("_size", "_blocks", "_own")],
        F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).cast("int").alias("side"))


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal keys (the first columns), from sorted batches."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([*left, batch]).combine_chunks()
        differs = np.zeros(whole.num_rows - 1, dtype=bool)
        for k in range(keys):
            col = whole.column(k).to_numpy()
            differs |= col[1:] != col[:-1]
        cuts = np.flatnonzero(differs)
        if len(cuts):
            yield whole.slice(0, cuts[-1] + 1)
            whole = whole.slice(cuts[-1] + 1)
        left = whole.to_batches()
    if left:
        yield pa.Table.from_batches(left)


def _bounds(t: pa.Table, keys: int) -> np.ndarray:
    differs = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
    for k in range(keys):
        col = t.column(k).to_numpy()
        differs |= col[1:] != col[:-1]
    return np.concatenate([[0], np.flatnonzero(differs) + 1, [t.num_rows]])


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    col = t.column(name).combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint32).reshape(t.num_rows, -1)


def _members(bounds: np.ndarray, i: np.ndarray, j: np.ndarray, side: np.ndarray):
    """For each run: whether it is one block, and the row numbers of its first and its second block."""
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a < 2:
            continue
        at = np.arange(a, b)
        if i[a] == j[a]:
            yield True, at, at
        else:
            yield False, at[side[a:b] == 0], at[side[a:b] == 1]


def _small_pairs(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of all the runs of at most 8 rows at once, and which runs those are."""
    sizes = np.diff(bounds)
    small = (sizes > 1) & (sizes <= 8)
    first, second = [], []
    for n in range(2, 9):
        starts = bounds[:-1][sizes == n]
        a, b = np.triu_indices(n, 1)
        first.append((starts[:, None] + a).ravel())
        second.append((starts[:, None] + b).ravel())
    return np.concatenate(first), np.concatenate(second), small


def candidate_forest(sigs: DataFrame, plan: list[tuple[int, int]], block: int = BLOCK) -> DataFrame:
    """(u, v): a spanning forest, block by block, of the candidate pairs that survive the pruning."""
    bands = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(
        k.alias("band"), F.xxhash64(k, F.substring(F.col("sig"), k * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("bucket")))).alias("b")
    keys = sigs.select("node", bands).select("node", "b.*")
    live = _blocked(keys, "bucket", "node", block)
    live = live.join(sigs.select("node", "sig"), "node").select("bucket", "i", "j", "side", "band", "node", "sig")
    live = live.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near-duplicates")
        for t in _units(batches, 3):
            sig, ids = _matrix(t, "sig"), t.column("node").to_numpy()
            band, side = t.column("band").to_numpy(), t.column("side").to_numpy()
            i, j, bounds = t.column("i").to_numpy(), t.column("j").to_numpy(), _bounds(t, 3)
            bands_of = sig.reshape(len(sig), BANDS, ROWS)

            def fresh(a, b):
                """The pairs whose first shared band is this one."""
                ok = np.ones(len(a), dtype=bool)
                for k in range(BANDS):
                    at = np.flatnonzero(ok & (band[a] > k))
                    ok[at] = ~(bands_of[a[at], k] == bands_of[b[at], k]).all(axis=1)
                return a[ok], b[ok]

            found_a, found_b = [], []
            a, b, small = _small_pairs(bounds)
            mixed = (i[a] != j[a]) & (side[a] == side[b])
            a, b = _survivors(sig, *fresh(a[~mixed], b[~mixed]), plan)
            found_a.append(a)
            found_b.append(b)
            large = np.flatnonzero((np.diff(bounds) > 8))
            for r in large:
                for same, first, second in _members(bounds[r : r + 2], i, j, side):
                    roots_a, roots_b = [], []
                    for x, y in _pairs(first, second, same):
                        x, y = _survivors(sig, *fresh(x, y), plan)
                        roots_a.append(x)
                        roots_b.append(y)
                    base = bounds[r]
                    root = _forest(np.concatenate(roots_a) - base, np.concatenate(roots_b) - base, bounds[r + 1] - base)
                    linked = np.flatnonzero(root != np.arange(len(root)))
                    found_a.append(linked + base)
                    found_b.append(root[linked] + base)
            u, v = np.concatenate(found_a), np.concatenate(found_b)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])

    return live.mapInArrow(run, "u long, v long")


def _set_rows(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(cluster, node, weight, sig, shingles) of classes that are in a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near-duplicates")
        for batch in batches:
            texts = batch.column(4).to_pylist()
            for a, b in _chunks(texts, CHUNK_CHARS):
                flat, offsets, sig = _scan(texts[a:b], words, seed)
                sets = [flat[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                of_class = pa.array([x.as_py() == y for x, y in zip(batch.column(3).slice(a, b - a), _digests(flat, offsets, seed), strict=True)], type=pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in range(3)], _binary(sig), pa.array(sets, type=pa.binary())],
                    names=["cluster", "node", "weight", "sig", "shingles"]).filter(of_class)

    return docs.select("cluster", "node", "weight", "digest", "text").mapInArrow(run, "cluster long, node long, weight long, sig binary, shingles binary")


def verified_links(sets: DataFrame, plan: list[tuple[int, int]], threshold: float, block: int = BLOCK) -> DataFrame:
    """(node, links, least): for a class and a pair of blocks, the rows it is linked to and the least class of
    its component within the blocks.  A link is a candidate pair that survives and whose exact similarity reaches
    the threshold."""
    live = _blocked(sets, "cluster", "node", block).select("cluster", "i", "j", "side", "node", "weight", "sig", "shingles")
    live = live.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")

    def linked(sets, a, b):
        """Which pairs reach the threshold; they are in the order of a."""
        ok = np.zeros(len(a), dtype=bool)
        sizes = np.array([len(s) for s in sets])
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else []
        for x, y in zip(starts, [*starts[1:], len(a)], strict=True):
            own, others = sets[a[x]], b[x:y]
            for p in range(0, len(others), 512):
                part = others[p : p + 512]
                flat = np.concatenate([sets[k] for k in part])
                at = np.searchsorted(own, flat).clip(max=len(own) - 1)
                hits = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
                ok[x + p : x + p + len(part)] = hits >= threshold * (len(own) + sizes[part] - hits) - 1e-9
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near-duplicates")
        for t in _units(batches, 3):
            node = t.column("node").to_numpy()
            repeated = np.flatnonzero(node[1:] == node[:-1]) + 1  # rows of a document that repeat
            t = t.take(np.setdiff1d(np.arange(len(node)), [r for r in repeated if not any(t.column(c)[r] != t.column(c)[r - 1] for c in range(3))])) if len(repeated) else t
            sig, ids, weight = _matrix(t, "sig"), t.column("node").to_numpy(), t.column("weight").to_numpy()
            i, j, side, bounds = t.column("i").to_numpy(), t.column("j").to_numpy(), t.column("side").to_numpy(), _bounds(t, 3)
            held = [np.frombuffer(s, dtype=np.uint64) for s in t.column("shingles").to_pylist()]
            bands_of = sig.reshape(len(sig), BANDS, ROWS)
            links, root, seen = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids)), np.zeros(len(ids), dtype=bool)
            for same, first, second in _members(bounds, i, j, side):
                found_a, found_b = [], []
                for a, b in _pairs(first, second, same):
                    share = np.zeros(len(a), dtype=bool)
                    for k in range(BANDS):
                        at = np.flatnonzero(~share)
                        share[at] = (bands_of[a[at], k] == bands_of[b[at], k]).all(axis=1)
                    a, b = _survivors(sig, a[share], b[share], plan)
                    ok = linked(held, a, b)
                    found_a.append(a[ok])
                    found_b.append(b[ok])
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                seen[a] = seen[b] = True
                if len(a):
                    base, top = min(first[0], second[0]), max(first[-1], second[-1]) + 1
                    root[base:top] = _forest(a - base, b - base, top - base) + base
            at = np.flatnonzero(seen)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(ids[root[at]])], names=["node", "links", "least"])

    return live.mapInArrow(run, "node long, links long, least long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
                    tolerance: float = TOLERANCE, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, class_id, group_id, n_links, group_size.

    The similarity of two texts is the Jaccard index of their shingle sets (``shingles``), and they are linked when
    it reaches the threshold.  ``class_id`` is the least doc_id with the same shingle set, ``n_links`` the number of
    other rows that the row is linked to, copies included, ``group_id`` the least doc_id of its connected
    component and ``group_size`` the rows of that.  Texts without words (null, empty, blank) are linked to nothing,
    not to each other either.  Repeated rows are copies of each other; rows of one id with different texts are
    told apart by their texts.  Rows without an id are left out.  An empty table has no rows.
    """
    plan = least_matches(threshold, tolerance)
    sigs = land(signatures(df.where(F.col(doc_id).isNotNull()), doc_id, text, words, seed), "near-signatures")
    some = sigs.where("n > 0")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("weight"))
    classes = land(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    first = classes.withColumnsRenamed({"digest": "_digest", "class_id": "_class"})
    reps = some.join(first, (F.col("doc_id") == F.col("_class")) & (F.col("digest") == F.col("_digest")))
    reps = reps.select("node", "sig").dropDuplicates(["node"])
    edges = land(candidate_forest(reps, plan, block), "near-candidates")
    clusters = land(components(edges).withColumnRenamed("component", "cluster"), "near-clusters")
    texts = df.select(F.col(doc_id).cast("long").alias("class_id"), F.col(text).alias("text"))
    members = texts.join(clusters.join(classes, "node"), "class_id")
    sets = land(_set_rows(members, words, seed), "near-sets")
    links = land(verified_links(sets, plan, threshold, block), "near-links")
    groups = components(links, "node", "least")
    count = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(count, "node", "left").join(groups, "node", "left")
    known = known.select("digest", "class_id", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("group"))
    sizes = known.groupBy("group").agg(F.sum("weight").alias("group_size"), F.min("class_id").alias("group_id"))
    linked = some.select("doc_id", "digest").join(known.join(sizes, "group"), "digest")
    linked = linked.select("doc_id", "class_id", "group_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), "group_size")
    own = F.col("doc_id")
    alone = sigs.where("n = 0").select(own, own.alias("class_id"), own.alias("group_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("group_size"))
    return linked.unionByName(alone)


def one_per_group(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one row of each group of near duplicates, the one with the least doc_id, in its own columns.

    Rows without an id stay, and so do texts without words.  Of repeated rows of that document one stays.  An id
    that comes with different texts goes only when each of them has an earlier near duplicate.
    """
    found = near_duplicates(df, doc_id, text, **options)
    gone = found.groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_and(F.expr("doc_id <> group_id")).alias("_all")).where("_all").drop("_all")
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.col(doc_id).cast("long").alias("_id"))
    left = rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    again = found.where("n_links > 0 and doc_id = group_id").groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1")
    left = left.join(again, F.col("_id") == F.col("_again"), "left")
    ranked = left.where("_n is not null").withColumn("_k", F.row_number().over(W.partitionBy("_id").orderBy(F.xxhash64("_row"))))
    return left.where("_n is null").select("_row.*").unionByName(ranked.where("_k = 1").select("_row.*"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
