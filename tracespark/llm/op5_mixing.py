"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source is a queue of its documents in a shuffled order (a digest of the id), run through
twice at most. A document's virtual finish time is the words its source has sent so far,
divided by the source's target; all queues are merged by a range sort of finish times and the merged
order is truncated where the total budget is spent.

Running sums are taken in two steps, so that neither a hot source nor the merged order meets in
one task: of a source, sums of order-preserving slices of about max(500, sqrt(rows)) rows first, then a
window inside each slice, added to the sum of the slices before it; of the merged order, sums of the
sorted ranges first, then a window inside the one range where the budget ends.

Defined cases: a null text has size 0 and is never taken more than zero words; a null source is
a source of its own, sorted last, the empty string another; sources without words have
target 0; documents that finish at the same time go in or stay out together; an empty table gives an empty result; further
columns travel in the struct `row`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The budget as a share of all words, and the most that a source may give of its own.
BUDGET, MOST = 1.5, 2
#: Least rows of a slice.
SLICE = 500


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size): target, where shares by weight stop at MOST times the
    source's size and the excess goes to the others by weight (a water level)."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    level = Window.orderBy("full_at")
    everything = Window.partitionBy()
    return (
        sizes.withColumn("w", weight)
        .withColumn("most", F.col("source_size") * MOST)
        .withColumn("full_at", F.col("most") / F.col("w"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(BUDGET))
        .withColumn("before", F.coalesce(F.sum("most").over(level.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.sum("most").over(Window.partitionBy("full_at")))
        .withColumn("left_w", F.sum("w").over(Window.orderBy(F.desc("full_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("full", (F.col("budget") - F.col("before")) / F.col("left_w") >= F.col("full_at"))
        .withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0)))
        .withColumn("open_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(everything))
        .select("source", "source_size", "budget", F.when(F.col("full"), F.col("most").cast("double")).otherwise((F.col("budget") - F.col("spent")) / F.col("open_w") * F.col("w")).alias("target"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, t (a hash of the text), source, size, source_size, target,
    taken, copies (0, 1 or 2)."""
    rows = docs.count()
    slices = math.ceil(rows / max(SLICE, math.isqrt(rows))) or 1
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    base = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text_col).alias("t"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            digest.alias("u"),
        ).withColumn("slice", F.floor(F.conv(F.substring("u", 1, 7), 16, 10).cast("long") * slices / F.lit(float(1 << 28))).cast("int"))
    )
    sums = base.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    per_source = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    before = (
        sums.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))
        .alias("s")
        .join(per_source.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")), "left")
        .select("s.source", "slice", "before", "source_size", "target", "budget")
    )
    inside = Window.partitionBy("source", "slice").orderBy("u", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = (
        base.withColumn("so_far", F.sum("size").over(inside))
        .alias("b")
        .join(before.alias("o"), F.col("b.source").eqNullSafe(F.col("o.source")) & (F.col("b.slice") == F.col("o.slice")))
        .select("doc_id", "t", "b.source", "size", "u", "source_size", "target", "budget", (F.col("before") + F.col("so_far")).alias("sent"))
    )
    turns = materialise(
        queued.withColumn("f1", F.try_divide("sent", "target")).withColumn("f2", F.try_divide(F.col("sent") + F.col("source_size"), F.col("target")))
    )
    item = F.explode(F.array(F.col("f1"), F.col("f2")))
    items = turns.filter("size > 0 and target > 0").select("size", "budget", item.alias("f"))
    merged = materialise(items.repartitionByRange(partitions(docs.sparkSession), "f").withColumn("range", F.spark_partition_id()))
    ranges = merged.groupBy("range").agg(F.sum("size").alias("words"), F.max("f").alias("last"), F.first("budget").alias("budget")).orderBy("last").collect()
    spent, last = 0, -1.0  # what is sent up to a finish time; nothing finishes before 0
    for r in ranges:
        if spent + r.words > r.budget:
            order = Window.orderBy("f").rangeBetween(Window.unboundedPreceding, Window.currentRow)
            within = merged.filter(F.col("range") == r.range).withColumn("upto", F.sum("size").over(order) + spent).filter("upto <= budget").agg(F.max("f")).first()[0]
            last = last if within is None else within
            break
        spent, last = spent + r.words, r.last
    sent = lambda f: (F.col(f) <= last).cast("int")
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), sent("f1") + sent("f2")).otherwise(0)
    return turns.select("doc_id", "t", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it (rows of equal id, text and source
    as often as the one of them that it takes most)."""
    often = mix(docs, id_col, text_col, source_col).filter("copies > 0").groupBy("doc_id", "t", "source").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col(source_col).cast("string").alias("s"))
    same = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("t")) & F.col("s").eqNullSafe(F.col("source"))
    return rows.join(often, same).select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def query(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("copies", "t", "source")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM d GROUP BY source
), w AS (
  SELECT *, CASE nr % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS w, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget FROM s
), l AS (
  SELECT *, 2 * source_size / w AS full_at,
         (SELECT coalesce(sum(2 * o.source_size), 0) FROM w o WHERE 2 * o.source_size / o.w < 2 * w.source_size / w.w)::DOUBLE AS before,
         (SELECT sum(o.w) FROM w o WHERE 2 * o.source_size / o.w >= 2 * w.source_size / w.w)::DOUBLE AS left_w
  FROM w
), f AS (
  SELECT *, (budget - before) / left_w >= full_at AS is_full FROM l
), t AS (
  SELECT source, source_size, budget,
         CASE WHEN is_full THEN (2 * source_size)::DOUBLE
              ELSE (budget - coalesce(sum(CASE WHEN is_full THEN 2 * source_size END) OVER (), 0)::DOUBLE) / (sum(CASE WHEN NOT is_full THEN w END) OVER ())::DOUBLE * w END AS target
  FROM f
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY u, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING)::DOUBLE AS sent
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), i AS (
  SELECT size, budget, unnest([sent / target, (sent + source_size) / target]) AS f FROM q WHERE size > 0 AND target > 0
), c AS (
  SELECT max(f) AS last FROM (SELECT f, budget, sum(size) OVER (ORDER BY f RANGE UNBOUNDED PRECEDING) AS upto FROM i) WHERE upto <= budget
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN size > 0 AND target > 0 THEN size * ((sent / target <= last)::INT + ((sent + source_size) / target <= last)::INT) ELSE 0 END)::BIGINT AS taken
FROM q, c
"""
