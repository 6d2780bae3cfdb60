"""Trie of conversation prefixes by chained digests.

Conversations pass a task in order, turn by turn: a prefix's digest is the SHA-256 of the digest before it and of the
turn (role and text). Every prefix becomes a row, and rows of equal (depth, digest) are
a node, with partial aggregation. Sums over subtrees come from exploding each node to its ancestors.

Only nodes of two members or more are exploded: under a node of one member there is one leaf and nothing
to save, which is counted at its parent. Ancestors come from a window over the prefixes of the
node's smallest member. A node is exploded to the ancestors in its own span of SPAN depths, and the tops of
spans, with their sums, likewise on the next level; then full sums go down again, from each top to the
SPAN - 1 ancestors above it. Up to SPAN depths that is one explosion to all ancestors; beyond,
rows grow with the depth and not with its square.

The identifiers of conversations that end at a node are hashed as a stream: sorted by range over all tasks, joined
to pieces there, and a node's pieces pass one task in order, so no row or task holds a large group.

Defined cases: rows without conv_id are left out; null roles and texts are empty; turns of a conversation
are in the order of turn (null first), then role, then the turn's digest; repeated rows are turns of their own;
conv_id % 100 has the sign of conv_id; an empty table has no node; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialise, partitions, table

#: Turns that a conversation takes from the first of its hundred are below this.
HEADS = 6
#: Depths of a span; identifiers to a piece.
SPAN, PIECE = 64, 8192
ROOT = hashlib.sha256(b"").digest()
#: A node of less rows is never hot.
HOT_LEAST = 64
PREFIX = "conv_id long, depth long, digest binary, parent binary, points long, ends boolean"
PREFIX_SCHEMA = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("points", pa.int64()), ("ends", pa.bool_())])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of role and text), points (code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("points"))


def shared_heads(own: DataFrame) -> DataFrame:
    """(conv_id, heads, place, digest, points): the first turns that conversations take from the first of their
    hundred; heads says how many of their own these replace."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    first = own.filter("conv_id % 100 = 0").withColumn("place", F.row_number().over(order)).filter(F.col("place") < HEADS)
    taken = own.select("conv_id").distinct().withColumn("heads", heads_of()).filter("heads > 0").withColumn("of", F.expr("conv_id - conv_id % 100"))
    return taken.join(first.select(F.col("conv_id").alias("of"), "place", "digest", "points"), "of").filter("place <= heads").select("conv_id", "heads", "place", "digest", "points")


def heads_of():
    return (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")


def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation, heads first, to a row for each prefix, the empty one too. A row is held back until it is
    known whether the conversation ends with it."""
    conv, seen, last = None, 0, None
    for b in batches:
        out = []
        for c, place, heads, digest, points in zip(*(b.column(x).to_pylist() for x in ("conv_id", "place", "heads", "digest", "points")), strict=True):
            if c != conv:
                if last is not None:
                    out.append((*last, True))
                conv, seen, last = c, 0, (c, 0, ROOT, None, 0)
            if place is None:  # one of its own
                seen += 1
                if seen <= heads:
                    continue
            out.append((*last, False))
            last = (c, last[1] + 1, hashlib.sha256(last[2] + digest).digest(), last[2], points)
        yield rows_of(out)
    if last is not None:
        yield rows_of([(*last, True)])


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(PREFIX_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PREFIX_SCHEMA, strict=True)], schema=PREFIX_SCHEMA)


def prefix_rows(conversations: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation."""
    own = turns(conversations)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = own.select("conv_id", none("int", "place"), heads_of().alias("heads"), "turn", "role", "digest", "points").unionByName(shared_heads(own).select("conv_id", "place", "heads", none("long", "turn"), none("string", "role"), "digest", "points"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("place").asc_nulls_last(), F.col("turn").asc_nulls_first(), "role", "digest")
    return ordered.select("conv_id", "place", "heads", "digest", "points").mapInArrow(prefixes, PREFIX)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(digest, conv_id) to (digest, ends_sha256): of the decimal identifiers in order, joined by commas."""
    parts = partitions(ends.sparkSession)

    def pieces(batches):
        key, first, held = None, None, []

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(map(str, held))])], ["digest", "first", "ids"])

        for b in batches:
            made = []
            for digest, c in zip(b.column("digest").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if digest != key or len(held) >= PIECE:
                    if held:
                        made.append(piece())
                    key, first, held = digest, c, []
                held.append(c)
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
        if held:
            yield piece()

    def hashed(batches):
        key, state = None, None
        for b in batches:
            made = []
            for digest, ids in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if digest != key:
                    if key is not None:
                        made.append((key, state.hexdigest()))
                    key, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], ["digest", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])

    ranged = ends.repartitionByRange(parts, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    joined = ranged.mapInArrow(pieces, "digest binary, first long, ids string")
    return joined.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(hashed, "digest binary, ends_sha256 string")


SUMS = ("leaf", "saved")


def exploded(nodes: DataFrame, path: DataFrame, stride: int, least) -> DataFrame:
    """Each node to its ancestors of the last SPAN - 1 multiples of stride, from a depth on: (digest, sums)."""
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(-(SPAN - 1), -1)
    steps = path.filter(F.col("depth") % stride == 0).withColumn("above", F.collect_list(F.struct("depth", "digest")).over(above)).filter("own").select("digest", "above")
    rows = nodes.select("digest", "depth", *SUMS).join(steps, "digest").withColumn("least", least)
    return rows.select(F.explode(F.filter("above", lambda a: a["depth"] >= F.col("least"))).alias("a"), *SUMS).select(F.col("a.digest").alias("digest"), *SUMS)


def summed(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """The nodes with what came to them."""
    every = nodes.select("digest", "depth", *SUMS).unionByName(more.withColumn("depth", F.lit(None).cast("long")))
    return every.groupBy("digest").agg(F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in SUMS])


def subtree_sums(shared: DataFrame, rows: DataFrame) -> DataFrame:
    """(digest, depth, leaf, saved) of the shared nodes, summed over their subtrees. shared: digest, depth,
    conv_id, leaf, saved; rows: all prefixes."""
    reach = shared.groupBy("conv_id").agg(F.min("depth").alias("since"), F.max("depth").alias("last"))
    path = materialise(rows.join(reach, "conv_id").filter(F.col("depth") <= F.col("last")).select("conv_id", "depth", "digest", (F.col("depth") >= F.col("since")).alias("own")))
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    levels, stride, nodes = [], 1, shared
    while True:
        span = stride * SPAN
        top = F.col("depth") - F.col("depth") % span
        levels.append(summed(nodes, exploded(nodes, path, stride, top)))
        if span > deepest:
            break
        levels[-1] = materialise(levels[-1])
        nodes, stride = levels[-1].filter(F.col("depth") % span == 0), span
    full = levels.pop()
    while levels:
        span, stride = stride, stride // SPAN
        full = materialise(full)
        tops = full.filter("depth > 0")
        lower = levels.pop().filter(F.col("depth") % span != 0)
        full = summed(lower, exploded(tops, path, stride, F.col("depth") - span + 1)).unionByName(full)
    return full


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node: digest, parent (its digest), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    rows = materialise(prefix_rows(conversations))
    parts = partitions(rows.sparkSession)
    nodes = materialise(rows.groupBy("depth", "digest").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), F.first("points").alias("points")))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    known = materialise(nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    leaf = F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("alone", F.lit(0))).cast("long")
    shared = known.filter("n_convs > 1").select("digest", "depth", "conv_id", leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    sums = subtree_sums(shared, rows).drop("depth")
    ends = ends_digests(rows.filter("ends").select("digest", "conv_id"))

    parents = known.filter("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = join_hot(known.filter("parent IS NOT NULL").select("digest", "parent"), parents, ["parent"], "n_children", max(HOT_LEAST, known.count() // parts)).select("digest", "parent_conv_id")
    found = known.join(below, "digest", "left").join(sums, "digest", "left").join(ends, "digest", "left")
    return found.select(
        "digest",
        "parent",
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("leaf", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"),
    )


def query(spark, sf_dir):
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).drop("digest", "parent")


#: Whole lists of turns in place of digests; CRC-32 bit by bit.
ORACLE = r"""
WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS p,
  concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) AS turn, length(coalesce(text, '')) AS points FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id AS c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, turn, points FROM (
  SELECT c, false AS own, p, turn, points FROM c JOIN t ON t.conv_id = c - c % 100 WHERE p <= h UNION ALL SELECT c, true, p, turn, points FROM c JOIN t ON t.conv_id = c WHERE p > h)),
s AS MATERIALIZED (SELECT c.c, coalesce(list(sha256(turn) ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS turns, coalesce(list(points ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS points FROM c LEFT JOIN r ON r.c = c.c GROUP BY c.c),
x AS MATERIALIZED (SELECT c, len(turns) AS l, unnest(range(0, len(turns) + 1)) AS d, unnest(list_transform(range(0, len(turns) + 1), lambda i: sha256(array_to_string(list_slice(turns, 1, i), ',')))) AS k,
  unnest(list_concat([NULL], list_transform(range(0, len(turns)), lambda i: sha256(array_to_string(list_slice(turns, 1, i), ','))))) AS parent, unnest(list_concat([0], points)) AS points FROM s),
n AS MATERIALIZED (SELECT d, k, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(points) AS points, string_agg(CASE WHEN l = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM x GROUP BY d, k),
b AS (SELECT d, k, conv_id, (n_convs - 1) * points AS saved, (SELECT count(*) FROM n m WHERE m.parent = n.k) AS n_children FROM n),
a AS (SELECT x.d, x.k, sum(b.saved) AS saved_tokens, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM b JOIN x ON x.c = b.conv_id AND x.d <= b.d GROUP BY x.d, x.k)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, b.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN b USING (d, k) JOIN a USING (d, k) LEFT JOIN n p ON p.k = n.parent AND p.d = n.d - 1
"""
