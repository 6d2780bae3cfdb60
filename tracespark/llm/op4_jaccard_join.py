"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed shingles of five words; a set is embedded as WIDTH min-hash values.
From the root of a tree, every run samples a coordinate and sends a set to the child that its
value at this coordinate names; children with more than LEAF sets split again on coordinates
sampled by their path (1/THRESHOLD on average), up to DEPTH. Sets that meet in a leaf are compared by brute
force, leaves that stay large (near copies agree on nearly every coordinate) in pairs
of blocks. Runs repeat until a pair at the threshold is met with probability TARGET.

A pair is judged once, in the least leaf that both sets share; so nothing has to
remember pairs, and none are written: leaves return each set's number of links and the edges of a
spanning forest. Pairs that agree on too few coordinates are passed over; all others are verified
by whole sets, read again from the texts of the sets concerned. Connected components come from
alternating large-star and small-star steps.

Equal sets are one class from the start, so copies meet nowhere else. Sizes of classes, components
and leaves and the degrees of nodes are counted with partial aggregation; what belongs to a hot class,
component or node joins by broadcast, of which there are fewer than partitions. A leaf of m different near
copies takes m * m / 2 comparisons, as links are counted, in cells of at most 2 * BLOCK rows and 2 * MASS shingles.

Defined cases: words are runs of `[^\\x20\\x09-\\x0D]`; a text of fewer than five words is one shingle; null and
wordless texts have the empty set and are copies of each other; rows of equal id and text
share one result; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, join_hot, materialise, partitions, table
from .textnp import chunks, mixed, prefix_sums, release, spans_hash, words

SHINGLE, THRESHOLD = 5, 0.8
#: Coordinates of the embedding, and how many must agree for a pair to be verified (a pair
#: at the threshold falls short with probability 1e-6).
WIDTH, AGREE = 64, 34
#: Largest leaf that isn't split, deepest path; most rows and most shingles of a leaf's block, and into how
#: many blocks a leaf is dealt before they grow over a quarter of that.
LEAF, DEPTH, BLOCK, MASS, BLOCKS = 128, 3, 1024, 1 << 21, 64
#: A class, component or node of less is never hot; sets to a bucket of cells.
HOT_LEAST, BUCKET = 64, 2000
#: A child with so much of its parent's sets holds near copies that no split parts; it is a leaf.
STUCK = 0.8
TARGET = 1 - 1e-6
#: How often a node samples a second coordinate, so that it has 1/THRESHOLD on average.
SECOND = 1 / THRESHOLD - 1
FACTORS = np.random.default_rng(41).integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
NOBODY = 2**63 - 1


def runs_needed(depth: int = DEPTH, target: float = TARGET) -> int:
    """Runs until a pair at the threshold has met with probability `target` in leaves of that depth.
    All runs share one embedding, so the chance is taken over how many coordinates agree."""

    def survives(share: float) -> float:
        met = 1.0
        for _ in range(depth - 1):
            x = share * met
            met = (1 - SECOND) * x + SECOND * (1 - (1 - x) ** 2)
        return share * met

    agree = [math.comb(WIDTH, k) * THRESHOLD**k * (1 - THRESHOLD) ** (WIDTH - k) for k in range(WIDTH + 1)]
    runs = 1
    while sum(p * (1 - survives(k / WIDTH)) ** runs for k, p in enumerate(agree)) > 1 - target:
        runs += 1
    return runs


def roots() -> list[int]:
    """The coordinate sampled at the root of each run; without repetition while there are any."""
    rng, n = np.random.default_rng(17), runs_needed()
    return np.concatenate([rng.permutation(WIDTH) for _ in range(n // WIDTH + 1)])[:n].tolist()


def shingles(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    start, end, first = words(data, at)
    h = spans_hash(prefix_sums(data), start, end)
    five = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        part = h[k:] * np.uint64(2 * k * k + 6 * k + 3)
        five[: len(part)] += np.bitwise_xor(part, part >> np.uint64(29))
    five = mixed(five)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(five[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mixed(np.array([sum(int(x) * (i + 1) for i, x in enumerate(h[a:b])) & (2**64 - 1)], dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(sets: list[np.ndarray]) -> tuple[list[bytes], list[list[int]]]:
    """A 128-bit name of each set, and its min-hash values."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    names, values = [bytes(16)] * len(sets), [[0] * WIDTH] * len(sets)
    if len(full):
        every = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        one = np.add.reduceat(mixed(every ^ np.uint64(0xA5A5)), starts)
        two = np.add.reduceat(mixed(every + np.uint64(0x5BD1E995)), starts)
        z = np.stack([np.minimum.reduceat((every * f) >> np.uint64(33), starts) for f in FACTORS], axis=1).astype(np.int32)
        both = np.stack([one, two], axis=1)
        for i, b, v in zip(full.tolist(), both, z.tolist(), strict=True):
            names[i], values[i] = b.tobytes(), v
    return names, values


def embed(docs: DataFrame) -> DataFrame:
    """(d, t, text) to (d, t, sid, n, z)."""

    def run(batches_in):
        for b in batches_in:
            sets = [s for _, _, data, at in chunks(b.column("text")) for s in shingles(data, at)]
            names, z = signature(sets)
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("t"), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(z, pa.list_(pa.int32()))], ["d", "t", "sid", "n", "z"])
        release()

    return batches(docs).mapInArrow(run, "d long, t long, sid binary, n int, z array<int>")


def leaves(sets: DataFrame, n_sets: int) -> DataFrame:
    """(key, sid, there, mass): the leaves of two sets or more that each set reaches, with the number of
    their sets and of these sets' shingles."""
    chosen = F.explode(F.array(*[F.struct(F.lit(slot).alias("slot"), F.get("z", F.lit(i)).alias("v")) for slot, i in enumerate(roots())]))
    entries = sets.filter("n > 0").select("sid", "n", chosen.alias("c")).select("sid", "n", F.xxhash64("c.slot", "c.v").alias("key"), F.lit(None).cast("long").alias("above"))
    found, n_entries, parts = None, n_sets * len(roots()), partitions(sets.sparkSession)
    for depth in range(1, DEPTH + 1):
        there = entries.groupBy("key").agg(F.count(F.lit(1)).alias("there"), F.sum("n").alias("mass")).filter("there > 1")
        there = materialise(there.withColumn("rows", F.col("there")))
        met = materialise(join_hot(entries, there, ["key"], "rows", max(HOT_LEAST, n_entries // parts)).select("key", "sid", "n", "there", "mass", "above"))
        splits = (F.col("there") > LEAF) & ~F.coalesce(F.col("there") >= STUCK * F.col("above"), F.lit(False)) if depth < DEPTH else F.lit(False)
        done = met.filter(~splits).select("key", "sid", "there", "mass")
        found = done if found is None else found.unionByName(done)
        if met.filter(splits).isEmpty():
            break
        i, second = (F.pmod(F.xxhash64("key", F.lit(k)), F.lit(WIDTH)).cast("int") for k in (1, 2))
        more = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1000)) < int(1000 * SECOND)
        child = lambda i: F.struct(i.alias("i"), F.get("z", i).alias("v"))
        entries = materialise(  # it is counted and joined
            met.filter(splits)
            .join(sets.select("sid", "z"), "sid")
            .select("sid", "n", "key", "there", F.explode(F.when(more & (i != second), F.array(child(i), child(second))).otherwise(F.array(child(i)))).alias("c"))
            .select("sid", "n", F.xxhash64("key", "c.i", "c.v").alias("key"), F.col("there").alias("above"))
        )
        n_entries = entries.count()
    return found


CELL = "key long, x int, y int"


def cells(found: DataFrame, sets: DataFrame, buckets: int) -> DataFrame:
    """A row for each set and cell: its block in the leaf, its leaves, its embedding."""
    rows = F.least(F.greatest(F.col("e.there") / BLOCKS, F.lit(BLOCK / 4)), F.lit(BLOCK))
    blocks = F.greatest(F.ceil(F.col("e.there") / rows), F.ceil(F.col("e.mass") / MASS)).cast("int")
    own = F.pmod(F.xxhash64("sid", "e.key"), F.col("blocks")).cast("int")
    return (
        found.groupBy("sid")
        .agg(F.collect_list(F.struct("key", "there", "mass")).alias("es"))
        .join(sets.select("sid", "z"), "sid")
        .select("sid", "z", F.sort_array(F.col("es.key")).alias("keys"), F.explode("es").alias("e"))
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .select("sid", "z", "keys", "own", F.col("e.key").alias("key"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("sid", "z", "keys", "own", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
        .withColumn("bucket", F.pmod(F.xxhash64("key", "x", "y"), F.lit(buckets)).cast("int"))
    )


def by_cell(t: pa.Table):
    """The rows of each cell of a bucket, as index arrays."""
    key, x, y = (t.column(c).to_numpy() for c in ("key", "x", "y"))
    order = np.lexsort((y, x, key))
    new = (np.diff(key[order]) != 0) | (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    return [c for c in np.split(order, np.flatnonzero(new) + 1) if len(c) > 1]


def list_column(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    c = t.column(name).combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    at = c.offsets.to_numpy()
    return c.values.to_numpy(zero_copy_only=False), at


def judged_here(rows: np.ndarray, own: np.ndarray, x: int, y: int, key: int, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each pair of a cell's rows (upper triangle), whether this leaf is the least they share."""
    n = len(rows)
    pairs = np.triu(np.ones((n, n), dtype=bool), 1)
    if x != y:
        pairs &= own[rows][:, None] != own[rows][None, :]
    less = [k[k < key] for k in (keys[at[r] : at[r + 1]] for r in rows)]
    every = np.concatenate(less)
    if len(every):
        values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        shared = counts > 1
        if shared.any():
            of = np.repeat(np.arange(n), [len(k) for k in less])[shared[inverse]]
            pairs &= products(n, of, (np.cumsum(shared) - 1)[inverse[shared[inverse]]]) == 0
    return pairs


CELLS = pa.schema([("sid", pa.binary()), ("keys", pa.list_(pa.int64())), ("own", pa.int32()), ("key", pa.int64()), ("x", pa.int32()), ("y", pa.int32())])


def candidates(t: pa.Table) -> pa.Table:
    """Of a bucket of cells, the sets that have a pair to verify, cell by cell."""
    t = t.combine_chunks()
    z = list_column(t, "z")[0].reshape(-1, WIDTH)
    keys, at = list_column(t, "keys")
    own, key, x, y = (t.column(c).to_numpy() for c in ("own", "key", "x", "y"))
    keep = []
    for rows in by_cell(t):
        alike = np.zeros((len(rows), len(rows)), np.int16)
        for k in range(WIDTH):
            alike += z[rows, k][:, None] == z[rows, k][None, :]
        alike = np.triu(alike >= AGREE, 1)
        if alike.any():
            r = rows[0]
            alike &= judged_here(rows, own, x[r], y[r], key[r], keys, at)
            keep.append(rows[alike.any(axis=0) | alike.any(axis=1)])
    return t.take(pa.array(np.concatenate(keep) if keep else [], pa.int64())).select(["sid", "keys", "own", "key", "x", "y"]).cast(CELLS)


def set_rows(needed: DataFrame) -> DataFrame:
    """(text, sid, w, keys, cells) to a row for each cell with the whole set."""

    def run(batches_in):
        for b in batches_in:
            sets = [s for _, _, data, at in chunks(b.column("text")) for s in shingles(data, at)]
            n_cells = np.array([len(c) for c in b.column("cells")])
            of = np.repeat(np.arange(len(sets)), n_cells)
            cell = b.column("cells").flatten()
            for a in range(0, len(of), 500):
                part = of[a : a + 500]
                fields = [cell.field(c).slice(a, len(part)) for c in ("own", "key", "x", "y", "bucket")]
                own = [b.column(c).take(pa.array(part)) for c in ("sid", "w", "keys")]
                yield pa.RecordBatch.from_arrays([*own, *fields, pa.array([sets[i].tobytes() for i in part], pa.binary())], ["sid", "w", "keys", "own", "key", "x", "y", "bucket", "members"])
        release()

    return batches(needed, 256).mapInArrow(run, f"sid binary, w long, keys array<long>, own int, {CELL}, bucket int, members binary")


def products(n: int, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Of the n rows of a 0/1 matrix, given where it is 1, all products, some columns at a time."""
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        m = np.zeros((n, min(4096, width - a)), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - a] = 1
        out += m @ m.T
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections (below 2**24, so exact)."""
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts[inverse] > 1
    return products(len(sets), of[shared], (np.cumsum(counts > 1) - 1)[inverse[shared]]).astype(np.float64)


FOUND = "sid binary, other binary, links long"


def verify(t: pa.Table) -> pa.Table:
    """Of a bucket of cells with whole sets: links of each set, and edges to the first set of its
    part of the cell."""
    t = t.combine_chunks()
    keys, at = list_column(t, "keys")
    own, key, x, y, w = (t.column(c).to_numpy() for c in ("own", "key", "x", "y", "w"))
    sid = t.column("sid").to_pylist()
    members = [np.frombuffer(m, dtype=np.uint64) for m in t.column("members").to_pylist()]
    out: list[tuple] = []
    for rows in by_cell(t):
        n = np.array([len(members[r]) for r in rows])
        both = overlaps([members[r] for r in rows])
        linked = both >= THRESHOLD * (n[:, None] + n[None, :] - both) - 1e-9
        r = rows[0]
        linked &= judged_here(rows, own, x[r], y[r], key[r], keys, at)
        if not linked.any():
            continue
        linked |= linked.T
        links = linked @ w[rows]
        part = list(range(len(rows)))

        def root(i, part=part):
            while part[i] != i:
                part[i] = part[part[i]]
                i = part[i]
            return i

        for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
            a, b = root(int(i)), root(int(j))
            part[max(a, b)] = min(a, b)
        out += [(sid[rows[i]], sid[rows[root(i)]], int(links[i])) for i in range(len(rows)) if links[i]]
    s, o, n = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"sid": pa.array(s, pa.binary()), "other": pa.array(o, pa.binary()), "links": pa.array(n, pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, label): the least node of each connected component, for nodes with edges."""
    parts = partitions(edges.sparkSession)
    edges = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, before = edges.count(), None
    while n:
        hot = max(HOT_LEAST, 2 * n // parts)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = materialise(join_hot(both, least, ["a"], "degree", hot).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = join_hot(large, lower, ["a"], "degree", hot)
        edges = materialise(small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == before:
            break
        n, before = now[0], now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: d (the id, NOBODY for null), t (a hash of the text), class_id (least id
    of the documents it is linked to, directly or not), class_t (that document's t), copy_id (least id
    of those with the same shingles), n_links (other texts at the threshold or above)."""
    parts = partitions(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    rows = materialise(embed(texts))
    once = rows.groupBy("sid", "t").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("n_rows"), F.first("n").alias("n"), F.first("z").alias("z"))
    sets = materialise(once.groupBy("sid").agg(F.min(F.struct("d", "t")).alias("rep"), F.count(F.lit(1)).alias("w"), F.sum("n_rows").alias("n_rows"), F.first("n").alias("n"), F.first("z").alias("z")))

    n_sets = sets.count()
    buckets = max(4 * parts, n_sets // BUCKET)
    met = cells(leaves(sets, n_sets), sets, buckets)
    wanted = materialise(met.groupBy("bucket").applyInArrow(candidates, f"sid binary, keys array<long>, own int, {CELL}"))
    per_set = (
        wanted.withColumn("bucket", F.pmod(F.xxhash64("key", "x", "y"), F.lit(buckets)).cast("int"))
        .groupBy("sid")
        .agg(F.first("keys").alias("keys"), F.collect_list(F.struct("own", "key", "x", "y", "bucket")).alias("cells"))
        .join(sets.select("sid", "w", F.col("rep.d").alias("d"), F.col("rep.t").alias("t")), "sid")
    )
    needed = texts.join(per_set, ["d", "t"]).dropDuplicates(["sid"]).select("text", "sid", "w", "keys", "cells")
    found = materialise(set_rows(needed).groupBy("bucket").applyInArrow(verify, FOUND))

    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("sid").alias("a"), F.col("other").alias("b")))
    of_set = materialise(
        sets.select("sid", "rep", "w")
        .join(links, "sid", "left")
        .join(label.withColumnRenamed("node", "sid"), "sid", "left")
        .select("sid", "rep", F.coalesce("label", "sid").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    )
    lead = of_set.groupBy("label").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n_sets"))
    of_set = join_hot(of_set, lead, ["label"], "n_sets", max(HOT_LEAST, n_sets // parts)).select("sid", "rep", "lead", "n_links")
    found = join_hot(rows.select("d", "t", "sid"), of_set, ["sid"], "n_rows", max(HOT_LEAST, rows.count() // parts), sets)
    return found.select("d", "t", F.col("lead.d").alias("class_id"), F.col("lead.t").alias("class_t"), F.col("rep.d").alias("copy_id"), "n_links")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """d, the id or NOBODY; t, a hash of the text; text, or what else is asked for."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NOBODY)).alias("d"), F.xxhash64(text).alias("t"), *(more or [text.alias("text")]))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that are linked, directly or not, to a document of smaller id."""
    found = near_duplicates(docs, id_col, text_col)
    others = found.filter("d != class_id or t != class_t").select("d", "t").distinct()
    return keyed(docs, id_col, text_col, F.struct("*").alias("row")).join(others, ["d", "t"], "left_anti").select("row.*")


def query(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    real = lambda c: F.when(F.col(c) != NOBODY, F.col(c)).alias("doc_id" if c == "d" else c)
    return found.select(real("d"), real("class_id"), real("copy_id"), "n_links")
