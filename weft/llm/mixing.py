"""Operator 3: mixing sources to target weights by weighted fair queueing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.shared import in_order, land, n_words, table

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Rows of a source that one task orders; a source has as many slots as it needs.
SLOT_ROWS = 2000
_COARSE, _FINE = 1024, 65536


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source of ``sizes`` (source, size): src (its rank), source, rows, source_size, weight, target.

    The sources, by code point with null last, share the sum of all sizes by the repeating ``weights``.  A target
    stops at ``repeats`` times its source's size, and the excess goes to the others by weight until none is above:
    in the order of cap / weight, a source is capped when the share left to it and those after it reaches its cap.
    Both orders are range-partitioned: there may be as many sources as hosts.  A source without words has the target 0.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    stats = in_order(stats, F.col("source").asc_nulls_last(), name="mix-sources").withColumnRenamed("position", "src").withColumn("src", F.col("src") + 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("src") - 1) % len(weights) + 1).cast("int")).cast("long")
    stats = stats.withColumns({"weight": weight, "cap": F.col("source_size") * repeats})
    stats = in_order(stats, F.col("source_size") / F.col("weight"), "src", sums=("cap", "weight"), name="mix-sources")
    sums = stats.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    stats = stats.withColumns({"left": F.lit(sums["size"]) - F.col("before_cap"), "over": F.lit(sums["weight"]) - F.col("before_weight")})
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    capped = exact("left") * exact("weight") >= exact("cap") * exact("over")
    stats = stats.withColumn("capped", capped)
    first = stats.where("not capped").agg(F.max(F.struct("over", "left")).alias("m")).first()["m"]  # the first one has the most weight left to share
    left, over = (float(first["left"]), float(first["over"])) if first else (0.0, 1.0)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(left) / F.lit(over))
    return stats.select(F.col("src").cast("int").alias("src"), "source", "rows", "source_size", "weight", target.alias("target"))


def _place(rows: DataFrame, stats: DataFrame, slot_rows: int) -> DataFrame:
    """``rows`` (source, size, h, doc_id, ...) with src, source_size, target and cum: the source's words up to
    and including the row, in the shuffled order.  The order is cut into slots of the hash range, so that
    each task orders a slot and adds the words of the slots before it."""
    own = stats.select(F.col("source").alias("_source"), "src", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("rows") / slot_rows)).alias("_slots"))
    rows = rows.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_slot", F.floor(F.col("h") / F.lit(float(1 << 60)) * F.col("_slots"))).drop("_slots")
    sums = rows.groupBy("src", "_slot").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy("src").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select("src", "_slot", F.coalesce(before, F.lit(0)).alias("_before"))
    run = F.sum("size").over(W.partitionBy("src", "_slot").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_run", run).join(offsets, ["src", "_slot"])
    return rows.withColumn("cum", F.col("_run") + F.col("_before")).drop("_slot", "_run", "_before")


def _finish(e: Column | int) -> Column:
    """Null where a source has no words and so no target."""
    return F.try_divide((F.col("source_size") * e + F.col("cum")).cast("double"), F.col("target"))


def _slots(finish: Column) -> tuple[Column, Column]:
    coarse = F.floor(F.least(finish * _COARSE, F.lit(65535.0)))
    return coarse, F.floor(F.least((finish * _COARSE - coarse) * _FINE, F.lit(65535.0)))


def _crossing(rows: DataFrame, slot: str, base: int, budget: int) -> tuple[int, int] | None:
    """The slot in which the running sum of sizes passes the budget, and the sum before it."""
    sums = rows.groupBy(slot).agg(F.sum("size").alias("s")).withColumn("upto", F.sum("s").over(W.orderBy(slot)))
    found = sums.where(F.col("upto") + base > budget).orderBy(slot).first()
    return found and (found[slot], base + found["upto"] - found["s"])


def _cut(placed: DataFrame, repeats: int, budget: int):
    """Where the globally sorted finish times are truncated: a predicate on a copy's number.

    Finish times are spread evenly by construction (the queue serves ``budget`` words a unit of time), so slots
    of equal time are a range partition.  Only the slot in which the budget runs out is sorted further.
    """
    copies = placed.where("size > 0").withColumn("e", F.explode(F.array(*map(F.lit, range(repeats)))))
    copies = copies.withColumn("finish", _finish(F.col("e")))
    coarse, fine = _slots(F.col("finish"))
    copies = copies.withColumns({"coarse": coarse, "fine": fine})
    one = _crossing(copies, "coarse", 0, budget)
    if one is None:
        return lambda e: F.lit(True)
    inside = copies.where(F.col("coarse") == one[0])
    two = _crossing(inside, "fine", one[1], budget)
    order = ["finish", "src", "h", "doc_id", "e"]
    last = inside.where(F.col("fine") == two[0]).withColumn("upto", F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = last.where(F.col("upto") + two[1] <= budget).agg(F.max(F.struct(*order)).alias("m")).first()["m"]

    def taken(e: int) -> Column:
        finish = _finish(e)
        at, within = _slots(finish)
        held = (at < one[0]) | ((at == one[0]) & (within < two[0]))
        if last is None:
            return held
        key = F.struct(finish.alias("finish"), "src", "h", "doc_id", F.lit(e).alias("e"))
        edge = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["src"]).alias("src"), F.lit(last["h"]).alias("h"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["e"]).alias("e"))
        return held | ((at == one[0]) & (within == two[0]) & (key <= edge))

    return taken


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        repeats: int = REPEATS, slot_rows: int = SLOT_ROWS, carry: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, size, source_size, target, taken, copies, and with ``carry`` the struct ``row``.

    The budget is the sum of all sizes (words).  A source's documents queue in the order of a hash of their id
    (ties: id, size), at most ``repeats`` times over.  A copy's virtual finish time is its source's words up to and
    including it, divided by the source's target; copies are served by finish time (ties: source rank, hash,
    id, copy) until the next one would pass the budget.  So each source gets its target to within a document.
    Null and blank texts have size 0 and are taken 0 times.  Null is a source like others.  Rows that repeat
    are queued one by one.  An empty table has no rows.  Ids must be integers.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), h.alias("h"),
                     *[F.struct(*[F.col(c) for c in df.columns]).alias("row")] * carry)
    sizes = land(rows.drop("row"), "mix-sizes")
    stats = land(source_targets(sizes, weights, repeats), "mix-targets")
    placed = land(_place(sizes, stats, slot_rows).drop("source"), "mix-placed")
    budget = stats.agg(F.sum("source_size")).first()[0] or 0
    taken = _cut(placed, repeats, budget)
    copies = sum((F.when((F.col("size") > 0) & F.coalesce(taken(e), F.lit(False)), 1).otherwise(0) for e in range(repeats)), F.lit(0))
    out = (_place(rows, stats, slot_rows) if carry else placed).withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *["row"] * carry)


def mixed(df: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``df`` in its own columns, each as often as it is taken."""
    rows = mix(df, carry=True, **options).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).select("row.*")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('mix-' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((src - 1) % 3 + 1)::INT]::BIGINT AS weight FROM g),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER q, 0))::BIGINT AS room,
             (sum(weight) OVER () - coalesce(sum(weight) OVER q, 0))::BIGINT AS rest
      FROM w WINDOW q AS (ORDER BY source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT room::DOUBLE AS room, rest::DOUBLE AS rest FROM l WHERE room * weight < source_size * 3 * rest ORDER BY l.rest DESC LIMIT 1),
t AS (SELECT l.source, l.src, l.source_size, CASE WHEN l.room * weight >= source_size * 3 * l.rest THEN (source_size * 3)::DOUBLE
             ELSE weight * (SELECT room FROM f) / (SELECT rest FROM f) END AS target FROM l),
p AS (SELECT doc_id, size, h, t.src, source_size, target, row_number() OVER () AS one,
             sum(size) OVER (PARTITION BY t.src ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (source_size * e + cum)::DOUBLE / target AS finish FROM p, range(0, 3) r(e) WHERE size > 0),
s AS (SELECT one, size, sum(size) OVER (ORDER BY finish, src, h, doc_id, e ROWS UNBOUNDED PRECEDING) AS upto FROM c),
k AS (SELECT one, sum(size)::BIGINT AS taken FROM s WHERE upto <= (SELECT sum(size) FROM d) GROUP BY one)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM p LEFT JOIN k USING (one)
"""
