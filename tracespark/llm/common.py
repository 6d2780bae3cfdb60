"""What the corpus operators share: reading tables, the shared scratch folder, cutting lineage."""

from __future__ import annotations

import tempfile
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters `[\x20\x09-\x0D]` that count as white space in every contract.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names in
    spark.checkpoint.dir. Where that is unset, one has to be set first; only a session that runs
    inside one process (tests) gets a folder of its own. With spark.cleaner.referenceTracking.cleanCheckpoints
    Spark deletes the files once nothing refers to them."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], n: str, least: int, counted: DataFrame | None = None) -> DataFrame:
    """Inner join of many with one, which has a row for each key; n in `counted` (or one) says how many rows of
    many have it. Keys with over `least` rows, at most a `least`-th as many as there are rows, are
    told apart by hashes and join by broadcast, so that no task needs all rows of such a key; the
    others meet in a shuffle. n is dropped from one."""
    h = F.xxhash64(*keys)
    hot = [r[0] for r in (one if counted is None else counted).filter(F.col(n) > least).select(h).collect()]
    one = one if counted is not None else one.drop(n)
    if not hot:
        return many.join(one, keys)
    return many.filter(h.isin(hot)).join(F.broadcast(one.filter(h.isin(hot))), keys).unionByName(many.filter(~h.isin(hot)).join(one.filter(~h.isin(hot)), keys))


class Several(NamedTuple):
    """What `collapsed` found: whether rows were folded, and how many partitions the session deals into."""

    any: bool
    partitions: int


def collapsed(rows: DataFrame, keys: list[str], text: str, least: int = 64) -> tuple[DataFrame, int, Several]:
    """Rows with a column copies, their bytes of text, and what `restored` needs. Rows that agree in the keys are
    equal; where more of them agree than a partition holds on average, they become one row before
    any shuffle of texts, so that no task meets a large group of copies. The number of such keys is below that of
    partitions, so they are collected as hashes."""
    parts = partitions(rows.sparkSession)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.sum(F.length(text)).alias("bytes"))
    n, n_bytes, most = counts.agg(F.sum("copies"), F.sum("bytes"), F.max("copies")).first()
    least = max(least, (n or 0) // parts)
    if (most or 0) <= least:
        return rows.withColumn("copies", F.lit(1).cast("long")), n_bytes or 0, Several(False, parts)
    h = F.xxhash64(*keys)
    hot = h.isin([r[0] for r in counts.filter(F.col("copies") > least).select(h).collect()])
    once = rows.filter(hot).groupBy(*keys).agg(*[F.first(c).alias(c) for c in rows.columns if c not in keys], F.count(F.lit(1)).alias("copies"))
    return rows.filter(~hot).withColumn("copies", F.lit(1).cast("long")).unionByName(once), n_bytes, Several(True, parts)


def restored(rows: DataFrame, several: Several, piece: int = 1000) -> DataFrame:
    """The rows as often as `copies` says, without that column; many copies are dealt out in pieces."""
    if not several.any:
        return rows.drop("copies")
    rows = materialise(rows)  # it is read twice
    pieces = rows.filter("copies > 1").withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {piece}")))).repartition(several.partitions)
    size = F.least(F.lit(piece).cast("long"), F.col("copies") - F.col("__piece") * piece)
    again = pieces.withColumn("__nr", F.explode(F.sequence(F.lit(1).cast("long"), size))).drop("__piece", "__nr")
    return rows.filter("copies = 1").unionByName(again).drop("copies")


def squeeze(text: Column) -> Column:
    """The text without its white space; null counts as empty. Chained replace() works on
    bytes, which is several times faster than a regular expression here."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def batches(df: DataFrame, rows: int = 256) -> DataFrame:
    """Rows to an Arrow batch: whole texts can be long, so Python sees few at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df
