"""Exact dedup by content sort (DataFrame functions only).

Sampled splitters (Spark's range partitioner) deal out the white-space-free texts by their
first code points and a 64-bit hash; an external sort places equal texts adjacent; a window
then compares whole neighbouring texts and keeps the best row of each run.

The splitters carry a bounded prefix and the hash, not the text, so sampling sends little to
the driver. A text with more copies than a partition holds on average is *hot*: its rows get a
salt that is part of the sort key, so that splitters can fall inside the group; the at most
`partitions` winners of each hot text meet in a second, pre-aggregated step. There are fewer
hot texts than partitions, which bounds what is collected and broadcast.

Defined cases: a null text is an empty one; empty texts form one group; of equal rows (same text,
same id) one is kept; a null id sorts after all others; an empty table gives an empty result;
the input's own columns travel in the struct `row`, so that their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, squeeze, table

#: Code points of the text in the range key.
PREFIX = 48
#: A text with fewer copies than this is never treated as hot.
HOT_LEAST = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row."""
    parts = partitions(docs.sparkSession)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.length(text_col), F.lit(0)).alias("n"),
        squeeze(F.col(text_col)).alias("norm"),
        F.struct("*").alias("row"),
    ).select("doc_id", "n", "row", F.substring("norm", 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("h"))

    least = max(HOT_LEAST, docs.count() // parts)
    hot = [r.h for r in base.groupBy("h").count().filter(F.col("count") > least).select("h").collect()]
    dealt_by = ["prefix", "h", *(["salt"] if hot else [])]
    salt = F.when(F.col("h").isin(hot), F.pmod(F.xxhash64("doc_id", "n"), F.lit(parts))).otherwise(0) if hot else F.lit(0)
    keys = [*dealt_by, "norm"]  # the window needs no exchange: equal keys are in one range already
    dealt = (
        base.withColumn("salt", salt.cast("long"))
        .repartitionByRange(parts, *dealt_by)
        .withColumn("norm", squeeze(F.col("row")[text_col]))  # again: one copy of the text is shuffled, not two
    )
    best_first = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc_nulls_last("doc_id"))
    whole = best_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = dealt.select(
        "doc_id",
        "n",
        "h",
        "salt",
        "row",
        F.sha2("norm", 256).alias("text_sha256"),
        F.row_number().over(best_first).alias("place"),
        F.first("doc_id").over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
    )
    if hot:
        tops = (
            runs.filter(F.col("h").isin(hot) & (F.col("place") == 1))
            .groupBy(F.col("text_sha256").alias("hot_sha"))
            .agg(
                F.min(F.struct(-F.col("n"), F.col("doc_id").isNull(), "doc_id", "salt")).alias("top"),
                F.sum("group_size").alias("hot_size"),
            )
        )
        runs = runs.join(F.broadcast(tops), F.col("text_sha256") == F.col("hot_sha"), "left").select(
            "doc_id",
            F.when(F.col("hot_sha").isNotNull(), F.col("top.doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("hot_size", "group_size").alias("group_size"),
            F.when(F.col("hot_sha").isNotNull() & (F.col("salt") != F.col("top.salt")), 0).otherwise(F.col("place")).alias("place"),
            "text_sha256",
            "row",
        )
    return runs.select("doc_id", "keep_id", "group_size", (F.col("place") == 1).alias("kept"), "text_sha256", "row")


def query(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
