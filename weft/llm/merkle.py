"""Operator 11: a Merkle manifest of a dataset, whose proofs a recursive query climbs.

Rows are the leaves of a tree per group, and the trees' roots those of a last tree over the groups.  The levels are
built from below, STRIDE of them at a time, and stored as rows: a node, its parent (the ancestor a stride above) and
the siblings met on the way there; a leaf's row holds its own link.  Nodes above 2^CHAIN_BITS leaves are stored once for
every 2^CHAIN_BITS leaves below them, so that a node near the root, which every leaf passes, is not one key of a join.  A
recursive query then ascends from every leaf at once, step by step: it hands on the siblings of the stride and folds them
into the leaf's hash.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.shared import in_order, land, table

STRIDE = 4
#: Leaves that share the stored nodes above them, as a power of two; a multiple of STRIDE.
CHAIN_BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Steps of the recursive query at most: ten strides of a tree over 2^40 leaves, and as many over the groups.
LEVELS = 40
_TOP = 32


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_text(fields: tuple[str, ...] = FIELDS, **instead: Column) -> Column:
    """What a leaf's hash is taken of: each field's UTF-8 byte count, a colon and its value; ``-`` for null."""
    def one(name: str) -> Column:
        value = instead.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.concat(*map(one, fields))


@dataclass
class Manifest:
    """Landed tables.  leaves: position, tree, idx, key, group, leaf, claimed, and their link: parent, siblings; trees: tree, n, top,
    root; nodes: node, place, parent, siblings.  A parent that is null is the root, and so is ``root`` (None for an empty table)."""

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    root: str | None


def _above(level: Column) -> Column:
    """The next level: the hash of every two nodes, or of a last one alone."""
    pair = lambda i: _hash(F.concat(_hex(level[i * 2]), F.coalesce(_hex(F.get(level, i * 2 + 1)), F.lit(""))))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) + 1) / 2).cast("int") - 1), pair)


def _strides(live: DataFrame, name: str, stride: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels above ``live`` (tree, idx, hash, n: nodes of its tree on this level), a stride at a time.

    Returns a table per stride (tree, idx, siblings: a null where there is none) and the trees' roots (tree, root).
    A group holds the 2^stride nodes under one ancestor at most.
    """
    done, out = [], []
    while True:
        done.append(live.where("n = 1").select("tree", F.col("hash").alias("root")))
        live = live.where("n > 1")
        if live.isEmpty():
            break
        packs = live.groupBy("tree", F.shiftright("idx", stride).alias("up"), "n").agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("kids"))
        packs = packs.withColumn("first", F.col("kids")[0]["idx"]).withColumn("l0", F.transform("kids", lambda x: x["hash"])).drop("kids")
        steps = sum((F.when(F.col("n") > (1 << k), 1).otherwise(0) for k in range(stride)), F.lit(0))
        packs = packs.withColumn("steps", steps)
        for k in range(1, stride + 1):
            below = F.col(f"l{k - 1}")
            packs = packs.withColumn(f"l{k}", F.when(F.col("steps") >= k, _above(F.col(f"l{k - 1}"))))
        packs = land(packs, name)
        sibling = lambda j, k: F.get(F.col(f"l{k}"), F.shiftright(j, k).bitwiseXOR(F.lit(1)))
        met = packs.select("*", F.posexplode("l0").alias("j", "own"))
        siblings = F.slice(F.array(*[sibling(F.col("j"), k) for k in range(stride)]), F.lit(1), F.col("steps"))
        out.append(met.select("tree", (F.col("first") + F.col("j")).alias("idx"), siblings.alias("siblings")))
        top = F.coalesce(*[F.get(F.col(f"l{k}"), F.lit(0)) for k in range(stride, 0, -1)])
        live = packs.select("tree", F.col("up").alias("idx"), top.alias("hash"), F.ceil(F.col("n") / F.expr("shiftleft(1, steps)")).cast("long").alias("n"))
    roots = done[0]
    for more in done[1:]:
        roots = roots.union(more)
    return out, land(roots, f"{name}-roots")


def build(df: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, claimed: Column | None = None,
          stride: int = STRIDE, chain_bits: int = CHAIN_BITS) -> Manifest:
    """The manifest of ``df``: a leaf per row, a tree per value of ``group`` (null is one) with leaves by ascending ``key``,
    and a tree over the groups in their order (null first, then by UTF-8 bytes).

    ``claimed`` is the text whose hash is to be checked in place of each leaf's own (as given by ``leaf_text``).
    Equal keys are ordered by their leaf hash, null keys come first; equal rows are leaves of their own.  Other columns of
    ``df`` are not read.  The texts are read once; from then on a row is its key, group and digests.
    """
    own = leaf_text(fields)
    rows = df.select(F.col(key).alias("key"), F.col(group).alias("group"), _hash(own).alias("leaf"), _hash(own if claimed is None else claimed).alias("claimed"))
    rows = in_order(land(rows, "merkle-rows"), F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), "leaf", name="merkle-leaves")
    rows = land(rows, "merkle-ranked")
    groups = rows.groupBy("group").agg(F.min("position").alias("tree"), F.count("*").alias("n"))
    groups = land(in_order(groups, "tree", name="merkle-groups").withColumnRenamed("position", "top"), "merkle-trees")
    named = groups.select(F.col("group").alias("_group"), "tree", "n", "top")
    leaves = rows.join(named, F.col("group").eqNullSafe(F.col("_group"))).drop("_group").withColumn("idx", F.col("position") - F.col("tree"))
    leaves = land(leaves, "merkle-leaves")
    strides, roots = _strides(leaves.select("tree", "idx", F.col("leaf").alias("hash"), "n"), "merkle-level", stride)
    trees = land(groups.join(roots, "tree"), "merkle-trees")
    over = trees.select(F.lit(0).cast("long").alias("tree"), F.col("top").alias("idx"), F.col("root").alias("hash"), F.lit(trees.count()).alias("n"))
    tops, whole = _strides(over, "merkle-top", stride)
    last = whole.first()
    linked, nodes = _links(leaves, trees, strides, tops, stride, chain_bits)
    return Manifest(land(linked, "merkle-linked"), trees, land(nodes, "merkle-nodes"), last and bytes(last["root"]).hex())


def _node(level: Column | int, at: Column) -> Column:
    return (F.shiftleft(F.lit(level).cast("long") if isinstance(level, int) else level.cast("long"), 48) + at).cast("long")


def _links(leaves: DataFrame, trees: DataFrame, strides: list[DataFrame], tops: list[DataFrame], stride: int, chain_bits: int) -> tuple[DataFrame, DataFrame]:
    """(leaves with parent and siblings; nodes: node, place, parent, siblings).  A node's number is its stride and, from its tree's
    first leaf on, its place there; from 2^chain_bits leaves on, the place of the chain, of which there is one for that many leaves."""
    free = chain_bits // stride
    height = F.lit(0)  # strides of a tree
    for r in range(len(strides)):
        height = height + F.when(F.col("n") > (1 << (stride * r)), 1).otherwise(0)
    trees = trees.select("tree", "top", height.alias("height"))
    none = F.lit(None).cast("long")
    first_top = _node(_TOP, F.col("tree") + F.col("at")) if tops else none
    up = lambda r: F.when(F.col("height") > r + 1, _node(r + 1, F.col("tree") + F.col("at"))).otherwise(first_top)
    link = lambda rows, node, parent: rows.select(node.alias("node"), F.col("idx").alias("place"), parent.alias("parent"), "siblings")
    empty = F.array().cast("array<binary>")
    own = leaves.withColumn("at", F.shiftright("idx", stride)).join(trees.drop("top"), "tree")
    own = own.join(strides[0], ["tree", "idx"], "left") if strides else own.withColumn("siblings", empty)
    linked = own.select(*leaves.columns, F.when(F.col("height") > 0, up(0)).otherwise(first_top).alias("parent"), F.coalesce("siblings", empty).alias("siblings"))
    chains = leaves.where(F.col("idx").bitwiseAND((1 << chain_bits) - 1) == 0).select("tree", F.shiftright("idx", chain_bits).alias("at"))
    chains = land(chains.join(trees, "tree"), "merkle-chains")
    nodes = link(chains.withColumns({"idx": F.col("tree"), "siblings": empty}), F.col("tree"), none).where("false")
    for r, met in enumerate(strides[1:], 1):
        if r < free:
            rows = met.join(trees, "tree").withColumn("at", F.shiftright("idx", stride))
            nodes = nodes.union(link(rows, _node(r, F.col("tree") + F.col("idx")), up(r)))
        else:
            rows = chains.withColumn("idx", F.shiftright("at", stride * (r - free))).join(met, ["tree", "idx"])
            nodes = nodes.union(link(rows, _node(r, F.col("tree") + F.col("at")), up(r)))
    for c, met in enumerate(tops):
        rows = chains.withColumn("idx", F.shiftright("top", stride * c)).join(met.drop("tree"), "idx")
        nodes = nodes.union(link(rows, _node(_TOP + c, F.col("tree") + F.col("at")), _node(_TOP + c + 1, F.col("tree") + F.col("at")) if c + 1 < len(tops) else none))
    return linked, nodes


@contextmanager
def _unbounded(spark: SparkSession) -> Iterator[None]:
    """No limit on the rows of a recursive query, which is a million by default."""
    names = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(LEVELS)}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


FOLD = """aggregate(transform({siblings}, (s, k) -> struct(s AS s, k AS k)), {start}, (a, x) -> unhex(sha2(
           CASE WHEN x.s IS NULL THEN lower(hex(a))
                WHEN (shiftright({place}, x.k) & 1) = 1 THEN concat(lower(hex(x.s)), lower(hex(a)))
                ELSE concat(lower(hex(a)), lower(hex(x.s))) END, 256)))"""
CLIMB = f"""
WITH RECURSIVE climb(position, node, step, folded, siblings) AS (
  SELECT position, parent, CAST(0 AS INT), {FOLD.format(siblings="siblings", start="claimed", place="idx")}, siblings FROM {{leaves}}
  UNION ALL
  SELECT c.position, n.parent, c.step + 1, {FOLD.format(siblings="n.siblings", start="c.folded", place="n.place")}, n.siblings
  FROM climb c JOIN {{nodes}} n ON c.node = n.node
)
SELECT position, step, folded, siblings FROM climb
"""


def climb(manifest: Manifest, proofs: bool = True) -> DataFrame:
    """(position, proof, folded), landed: for each leaf its siblings from below to the root, as digests, and the hash to which they
    fold its claimed leaf.  Without ``proofs``, ``proof`` is the sha256 of the siblings' hexadecimal digests, which takes
    far less room than they do."""
    spark = manifest.leaves.sparkSession
    with _unbounded(spark):
        steps = spark.sql(CLIMB, leaves=manifest.leaves.select("position", "parent", "idx", "claimed", "siblings"), nodes=manifest.nodes)
        one = steps.groupBy("position").agg(F.array_sort(F.collect_list(F.struct("step", "siblings"))).alias("met"), F.max_by("folded", "step").alias("folded"))
        proof = F.filter(F.flatten(F.transform("met", lambda m: m["siblings"])), lambda s: s.isNotNull())
        if not proofs:
            proof = _hash(F.array_join(F.transform(proof, _hex), ""))
        return land(one.select("position", proof.alias("proof"), "folded"), "merkle-climb")


def audit(df: DataFrame, claimed: Column | None = None, proofs: bool = True, **options) -> DataFrame:
    """One row per row of ``df``: key, leaf, subroot, root, proof (siblings from below, or their sha256: see ``climb``), folded_root,
    verified: whether the claimed leaf folds to the root.  An empty table has no rows; a single row is its own root, with an
    empty proof."""
    manifest = build(df, claimed=claimed, **options)
    found = manifest.leaves.select("position", "tree", "key", "leaf").join(climb(manifest, proofs), "position")
    found = found.join(manifest.trees.select("tree", F.col("root").alias("subroot")), "tree")
    root = F.lit(manifest.root).cast("string")
    proof = F.transform("proof", _hex) if proofs else _hex(F.col("proof"))
    return found.select("key", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"), proof.alias("proof"),
                        _hex(F.col("folded")).alias("folded_root"), (_hex(F.col("folded")) == root).alias("verified"))


def write_manifest(manifest: Manifest, path: str) -> None:
    """The manifest as Parquet: leaves, trees and nodes, from which any row's proof can be read."""
    for name in ("leaves", "trees", "nodes"):
        getattr(manifest, name).write.parquet(f"{path.rstrip('/')}/{name}")


def tampered() -> Column:
    """The claimed text of the query: where 7 divides crc32 of the id, a character more is counted."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return leaf_text(n_chars=F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit(table(spark, sf_dir, "documents"), claimed=tampered(), proofs=False)
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


def _part(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"


def _levels(source: str) -> str:
    up = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
    return f"SELECT lang, 0 AS lvl, nodes FROM {source} UNION ALL SELECT lang, lvl + 1, {up} FROM {{name}} WHERE len(nodes) > 1"


SQL = rf"""
WITH RECURSIVE crc AS (SELECT DISTINCT doc_id, 4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS c FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT doc_id, lang, source, n_chars, text, CASE WHEN c % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS m FROM documents LEFT JOIN crc USING (doc_id)),
h AS (SELECT doc_id, lang, sha256({" || ".join(map(_part, FIELDS))}) AS leaf, sha256({" || ".join(_part("m" if f == "n_chars" else f) for f in FIELDS)}) AS claimed FROM d),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM h),
own AS (SELECT lang, list(leaf ORDER BY idx) AS nodes FROM l GROUP BY lang),
tree AS ({_levels("own").format(name="tree")}),
s AS MATERIALIZED (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top FROM tree WHERE len(nodes) = 1),
above AS (SELECT NULL::VARCHAR AS lang, list(subroot ORDER BY top) AS nodes FROM s),
roof AS ({_levels("above").format(name="roof")}),
path AS (SELECT l.*, subroot, list_concat(
    (SELECT coalesce(list({{'s': t.nodes[xor(idx >> lvl, 1) + 1], 'r': (idx >> lvl) & 1}} ORDER BY lvl), []) FROM tree t WHERE t.lang IS NOT DISTINCT FROM l.lang AND len(t.nodes) > 1),
    (SELECT coalesce(list({{'s': t.nodes[xor(top >> lvl, 1) + 1], 'r': (top >> lvl) & 1}} ORDER BY lvl), []) FROM roof t WHERE len(t.nodes) > 1)) AS met
  FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang),
climb AS (SELECT doc_id, leaf, subroot, met, claimed AS folded, 1 AS k FROM path
  UNION ALL
  SELECT doc_id, leaf, subroot, met, sha256(CASE WHEN met[k].s IS NULL THEN folded WHEN met[k].r = 1 THEN met[k].s || folded ELSE folded || met[k].s END), k + 1 FROM climb WHERE k <= len(met)),
r AS (SELECT nodes[1] AS root FROM roof WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(met, lambda x: coalesce(x.s, ''))), 'string_agg', '')) AS proof_sha256,
       folded AS folded_root, folded = root AS verified
FROM climb, r WHERE k > len(met)
"""
