"""Removal of repeated 100-byte strings, by column-wise construction over many documents.

The construction inserts one symbol of every document a round, from the last column to the first,
and keeps two arrays up to date: the order of all suffixes that begin at the current column (the
permutation of a collection's Burrows-Wheeler transform, restricted to one column) and the common
prefix of neighbours in that order. Neighbours with a common prefix of LENGTH or more start
equal strings; all but the earliest of such a run are marked. Nothing else marks anything.

Inserting every byte of whole documents would take a round for each byte of the longest text and
time that grows with its square. So documents are cut into short aligned strings first:

1. In every string of LENGTH bytes one GRAM of least hash is the anchor (leftmost of equals). Equal
   strings have equal anchors at equal offsets, so only strings around equal anchors can match. An
   anchor's surroundings are the bytes of all strings that it stands for.
2. A task runs the construction over the anchors that it meets more than once in GATHER of them.
   Surroundings without an earliest string are done; thousands of copies end here.
3. Of the others the hashes meet; those of anchors that several tasks have are cut out of the texts with
   their surroundings and go through the construction again, aligned at the anchor.
4. An anchor that may have over HOT different surroundings (a line that a third of all documents share)
   is *hot*: each of its strings becomes surroundings of its own, aligned at its own hash. Strings of hot
   anchors meet in two rounds, first in groups of tasks (about the root of their number), from which only the earliest
   goes on, so that no task needs all that have a string.

Steps pass packed arrays as rows, in buckets of about BUCKET bytes of text whatever the input's size; a task
holds one bucket. What the buckets find is checkpointed in the shared folder, texts are shuffled once by document.

Defined cases: null texts are empty and have no span; texts under LENGTH bytes are kept whole; ids order
the documents, null last; rows of equal id (null too) don't remove each other, and what repeats within one of them is judged
row by row; many equal rows are handled as one; an empty table gives an empty result; further columns are
ignored. Rows are told apart by id and 64 bits of hash of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as rows
from .common import batches, collapsed, materialise, restored, table
from .packed import PACKED, Table, as_table, by_kind, entries_of, merged, row_bucket, row_bucket_column, size, take
from .textnp import chunks, mixed, prefix_sums, release, runs_of, spans_hash

#: Bytes of a repeated string, of the anchor's gram, grams to a string.
LENGTH, GRAM = 100, 24
GRAMS = LENGTH - GRAM + 1
#: Columns of the surroundings: GRAMS-1 bytes before the anchor, LENGTH from it on.
COLUMNS = GRAMS - 1 + LENGTH
#: Most different surroundings of an anchor that a task should hold.
HOT = 65536
#: Bytes of text to a bucket, anchors that a task gathers.
BUCKET, GATHER = 16 << 20, 200_000
#: Bytes of text whose anchors are looked for together.
TEXT = 1 << 20
ANCHOR, NOTICE, MARK, PROBE, CONTEXT, STRING = KINDS = range(6)
FIELDS = {
    ANCHOR: {"h": "u8", "doc": "i8", "k": "i8", "q": "i4", "lo": "u1", "hi": "u1"},
    NOTICE: {"h": "u8"},
    MARK: {"doc": "i8", "k": "i8", "start": "i4", "end": "i4"},
    PROBE: {"doc": "i8", "k": "i8", "q": "i4", "lo": "u1", "hi": "u1", "hot": "u1"},
    CONTEXT: {"h": "u8", "doc": "i8", "k": "i8", "q": "i4", "lo": "u1", "hi": "u1", "bytes": f"({COLUMNS},)u1"},
}
FIELDS[STRING] = FIELDS[CONTEXT]


def unpack(kind: int, blobs: list[bytes]) -> Table:
    return rows.unpack(FIELDS[kind], blobs)


def send(kind: int, t: Table, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    return rows.send(kind, FIELDS[kind], t, bucket)


def send_marks(t: Table, n_buckets: int) -> Iterator[pa.RecordBatch]:
    t = merged(t)
    return send(MARK, t, row_bucket(t["doc"], t["k"], n_buckets))


def send_strings(t: Table, group: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Strings of hot anchors to where the group's meet."""
    return send(STRING, t, anchor_bucket(mixed(t["h"] + np.uint64(group) * np.uint64(0x9E3779B97F4A7C15)), n_buckets))


def anchors(data: np.ndarray, at: np.ndarray, sums: np.ndarray, doc: np.ndarray, k: np.ndarray) -> tuple[Table, np.ndarray]:
    """The anchors of the texts, with q counted from the text's start, and the text each is in."""
    n = len(data) - GRAM + 1
    if n < GRAMS:
        return unpack(ANCHOR, []), np.zeros(0, np.int64)
    grams = spans_hash(sums, np.arange(n), np.arange(GRAM, n + GRAM))
    least = (grams & ~np.uint64((1 << 31) - 1)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < GRAMS:
        least = np.minimum(least[: width - GRAMS], least[GRAMS - width :])
    at_text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    p = np.flatnonzero(np.arange(len(least)) + LENGTH <= at[at_text + 1])
    if not len(p):
        return unpack(ANCHOR, []), np.zeros(0, np.int64)
    where = (least[p] & np.uint64((1 << 31) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
    last = np.concatenate([first[1:], [len(p)]]) - 1
    q, text = where[first], at_text[p[first]]
    found = {"h": grams[q], "doc": doc[text], "k": k[text], "q": (q - at[text]).astype(np.int32), "lo": (q - p[first]).astype(np.uint8), "hi": (q - p[last]).astype(np.uint8)}
    return found, text


def surroundings(padded: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The bytes of all strings that anchors at q stand for, each at its place among COLUMNS, else zero.
    padded: the text between GRAMS - 1 and LENGTH other bytes."""
    j = np.arange(COLUMNS)
    around = np.lib.stride_tricks.sliding_window_view(padded, COLUMNS)[q]
    around[(j < GRAMS - 1 - lo.astype(np.int64)[:, None]) | (j >= COLUMNS - hi.astype(np.int64)[:, None])] = 0
    return around


def padded_text(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(GRAMS - 1, np.uint8), data, np.zeros(LENGTH, np.uint8)])


def strings_of(t: Table, done: np.ndarray | None = None) -> Table:
    """Each string that these anchors stand for, but for those that are done, as surroundings of its own."""
    parts = []
    for a in range(0, size(t), 1000):
        c = take(t, slice(a, a + 1000))
        j = np.arange(GRAMS)
        own = (j >= GRAMS - 1 - c["lo"].astype(np.int64)[:, None]) & (j < GRAMS - c["hi"].astype(np.int64)[:, None])
        if done is not None:
            own &= ~done[a : a + 1000]
        row, j = np.nonzero(own)
        flat = np.ascontiguousarray(c["bytes"]).ravel()
        start = row * COLUMNS + j
        around = np.zeros((len(row), COLUMNS), np.uint8)
        around[:, GRAMS - 1 :] = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[start]
        none = np.zeros(len(row), np.uint8)
        p = c["q"][row] - (GRAMS - 1) + j.astype(np.int32)
        parts.append({"h": spans_hash(prefix_sums(flat), start, start + LENGTH), "doc": c["doc"][row], "k": c["k"][row], "q": p, "lo": none, "hi": none, "bytes": around})
    return {f: np.concatenate([x[f] for x in parts]) for f in FIELDS[CONTEXT]} if parts else unpack(CONTEXT, [])


def sizes_of(h: np.ndarray) -> np.ndarray:
    """How often each entry's value occurs."""
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    return counts[inverse]


def anchor_bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(33)).astype(np.int64) % n


def scan(n_buckets: int, hot_here: int, groups: int):
    """Texts to marks, and the anchors of what no task-wide construction marks. hot_here: most
    different surroundings of an anchor in a gathering that isn't hot."""

    def flush(gathered: list[Table]) -> Iterator[pa.RecordBatch]:
        t = {f: np.concatenate([g[f] for g in gathered]) for f in FIELDS[CONTEXT]}
        gathered.clear()
        again = sizes_of(t["h"]) > 1
        met, t = take(t, again), take(t, ~again)
        done = columns(met)
        yield from send_marks(marks(met, done), n_buckets)
        left = own_strings(met) > done.sum(axis=1)
        met, done = take(met, left), done[left]
        hot = sizes_of(met["h"]) > hot_here
        strings = strings_of(take(met, hot), done[hot])
        yield from send_strings(strings, TaskContext.get().partitionId() % groups, n_buckets)
        noticed = {"h": np.unique(met["h"][hot])}
        yield from send(NOTICE, noticed, anchor_bucket(noticed["h"], n_buckets))
        for rest, of in ((met, ~hot), (t, slice(None))):
            rest = take({f: rest[f] for f in FIELDS[ANCHOR]}, of)
            yield from send(ANCHOR, rest, anchor_bucket(rest["h"], n_buckets))

    def run(batches_in):
        gathered, n = [], 0
        for batch in batches_in:
            doc, k = batch.column("doc").to_numpy(), batch.column("k").to_numpy()
            for i, j, data, at in chunks(batch.column("text"), TEXT):
                t, text = anchors(data, at, prefix_sums(data), doc[i:j], k[i:j])
                if size(t):
                    t["bytes"] = surroundings(padded_text(data), at[text] + t["q"], t["lo"], t["hi"])
                    gathered.append(t)
                    n += size(t)
                if n > GATHER:
                    yield from flush(gathered)
                    n = 0
        if gathered:
            yield from flush(gathered)
        release()

    return run


def resolve(n_buckets: int):
    """A bucket of anchors to probes of those that others have too; the rest passes."""

    def run(packed: pa.Table) -> pa.Table:
        got = by_kind(packed, KINDS)
        t = unpack(ANCHOR, got[ANCHOR])
        there, noticed = sizes_of(t["h"]), np.isin(t["h"], unpack(NOTICE, got[NOTICE])["h"])
        t["hot"] = ((there > HOT) | noticed).astype(np.uint8)
        probes = take(t, (there > 1) | noticed)
        kind = packed.column("kind")
        rest = packed.filter(pc.or_(pc.equal(kind, MARK), pc.equal(kind, STRING)))
        return pa.concat_tables([rest, as_table(list(send(PROBE, probes, row_bucket(probes["doc"], probes["k"], n_buckets))))])

    return run


def texts_by_key(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    texts = texts.combine_chunks()
    column = texts.column("text")
    return texts.column("doc").to_numpy(), texts.column("k").to_numpy(), column.chunk(0) if column.num_chunks else pa.array([], pa.binary())


def cut_out(n_buckets: int, groups: int):
    """Texts and their probes to surroundings."""

    def run(texts: pa.Table, packed: pa.Table) -> pa.Table:
        t = unpack(PROBE, by_kind(packed, KINDS)[PROBE])
        if not size(t):
            return as_table([])
        t = take(t, np.lexsort((t["q"], t["k"], t["doc"])))
        doc, k, column = texts_by_key(texts)
        cut, seen = [], set()
        for i, a, b in entries_of(t, doc, k):
            if a == b or (doc[i], k[i]) in seen:
                continue
            seen.add((doc[i], k[i]))
            _, _, data, _ = next(chunks(column.slice(i, 1)))
            own = take(t, slice(a, b))
            own["bytes"] = surroundings(padded_text(data), own["q"], own["lo"], own["hi"])
            cut.append(own)
        t = {f: np.concatenate([c[f] for c in cut]) for f in ("doc", "k", "q", "lo", "hi", "hot", "bytes")}
        del cut
        grams = np.ascontiguousarray(t["bytes"][:, GRAMS - 1 : GRAMS - 1 + GRAM]).ravel()
        starts = np.arange(size(t)) * GRAM
        t["h"] = spans_hash(prefix_sums(grams), starts, starts + GRAM)
        hot = t["hot"] == 1
        strings, t = strings_of(take(t, hot)), take(t, ~hot)
        group = int(row_bucket(doc[:1], k[:1], n_buckets)[0]) % groups
        return as_table([*send_strings(strings, group, n_buckets), *send(CONTEXT, t, anchor_bucket(t["h"], n_buckets))])

    return run


def own_strings(t: Table) -> np.ndarray:
    return t["lo"].astype(np.int64) - t["hi"] + 1


def columns(t: Table) -> np.ndarray:
    """The column-wise construction over surroundings aligned at their anchors: for each of them and
    each column, whether the string that starts there also starts earlier."""
    m = size(t)
    done = np.zeros((m, GRAMS), dtype=bool)
    if not m:
        return done
    place, of_doc, of_row = (np.empty(m, np.int64) for _ in range(3))  # in the order of documents, rows and positions; equal for the same
    order = np.lexsort((t["q"], t["k"], t["doc"]))
    doc, k = t["doc"][order], t["k"][order]
    place[order], of_doc[order], of_row[order] = runs_of(doc, k, t["q"][order]), runs_of(doc), runs_of(doc, k)
    rank = np.argsort(t["h"], kind="stable")  # rows in the order of their suffixes
    group = runs_of(t["h"][rank]) << 9
    common = np.zeros(m, np.int32)  # with the row before in that order
    common[0] = -1
    common[1:][group[1:] != group[:-1]] = -1
    symbols = np.ascontiguousarray(t["bytes"].T)
    first, end = GRAMS - 1 - t["lo"].astype(np.int64), COLUMNS - t["hi"].astype(np.int64)
    for j in range(COLUMNS - 1, -1, -1):
        symbol = np.where((j >= first) & (j < end), symbols[j].astype(np.int64) + 1, 0)
        key = np.sort(((group | symbol[rank]) << 31) | np.arange(len(rank)))
        old, key = key & ((1 << 31) - 1), key >> 31
        same = np.zeros(len(rank), dtype=bool)
        same[1:] = (key[1:] == key[:-1]) & ((key[1:] & 511) != 0)
        fresh = np.zeros(len(rank), np.int32)
        at = np.flatnonzero(same)
        if len(at):
            low, high = old[at - 1] + 1, old[at]
            fresh[at] = 1 + common[high]
            if len(apart := np.flatnonzero(low < high)):
                fresh[at[apart]] = 1 + range_minimum(common, low[apart], high[apart])
        group = key & ~511
        edge = np.ones(len(rank), dtype=bool)
        edge[1:] = group[1:] != group[:-1]
        fresh[edge] = -1
        rank, common = rank[old], fresh
        if j < GRAMS:
            repeats(done, place, of_doc, of_row, rank, common, j)
            reach = common + j >= LENGTH  # what can still grow to LENGTH, with the row before or behind
            reach[:-1] |= reach[1:]
            if 2 * np.count_nonzero(reach) < len(rank):
                dropped = np.cumsum(~reach)
                rank, group, common, dropped = rank[reach], group[reach], common[reach], dropped[reach]
                if not len(rank):
                    break
                common[0] = -1
                common[1:][dropped[1:] != dropped[:-1]] = 0  # no more than it is, and too little to count
                common[1:][group[1:] != group[:-1]] = -1
    return done


def repeats(done: np.ndarray, place: np.ndarray, of_doc: np.ndarray, of_row: np.ndarray, rank: np.ndarray, common: np.ndarray, j: int) -> None:
    """Mark the strings at column j that equal one of a smaller document or an earlier one of their row."""
    joined = common >= LENGTH
    within = joined.copy()
    within[:-1] |= joined[1:]
    at = np.flatnonzero(within)
    if len(at):
        run = np.cumsum(~joined[at])
        equal = rank[at]
        equal = equal[np.lexsort((place[equal], run))]
        starts = np.flatnonzero(~joined[at])
        least = np.repeat(of_doc[equal[starts]], np.diff(np.append(starts, len(at))))
        rows = runs_of(run, of_row[equal])
        begins = place[equal][np.append(True, np.diff(rows) > 0)][rows]
        done[equal[(of_doc[equal] != least) | (place[equal] != begins)], j] = True


def marks(t: Table, done: np.ndarray) -> Table:
    """The bytes of the strings that are done, a mark for each run of columns."""
    edges = np.diff(np.pad(done, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    q = t["q"][row] - (GRAMS - 1)
    return {"doc": t["doc"][row], "k": t["k"][row], "start": (q + start).astype(np.int32), "end": (q + end - 1 + LENGTH).astype(np.int32)}


def range_minimum(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of values[a..b] for each pair, from minima of 1, 2, 4, ... neighbours."""
    out = np.empty(len(a), values.dtype)
    level = np.frexp(b - a + 1)[1] - 1
    minima = values
    for k in range(int(level.max()) + 1):
        if k:
            minima = np.minimum(minima[: -(1 << (k - 1))], minima[1 << (k - 1) :])
        of = level == k
        out[of] = np.minimum(minima[a[of]], minima[b[of] - (1 << k) + 1])
    return out


def construct(n_buckets: int):
    """Surroundings of a bucket to marks; of a group's strings the earliest go on to where all groups' meet."""

    def run(packed: pa.Table) -> pa.Table:
        got = by_kind(packed, KINDS)
        t = unpack(CONTEXT, got[CONTEXT])
        t = take(t, sizes_of(t["h"]) > 1)
        out = list(send_marks(marks(t, columns(t)), n_buckets))
        t = unpack(STRING, got[STRING])
        done = columns(t)
        out += send_marks(marks(t, done), n_buckets)
        t = take(t, ~done[:, GRAMS - 1])
        out += send(CONTEXT, t, anchor_bucket(t["h"], n_buckets))
        return pa.concat_tables([packed.filter(pc.equal(packed.column("kind"), MARK)), as_table(out)])

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove(texts: pa.Table, packed: pa.Table) -> pa.Table:
    """Texts and all their marks to the spans removed and the bytes kept."""
    told = merged(unpack(MARK, by_kind(packed, KINDS)[MARK]))
    doc, k, column = texts_by_key(texts)
    spans, kept = [], []
    for i, a, b in entries_of(told, doc, k):
        data = column[i].as_py()
        own = list(zip(told["start"][a:b].tolist(), told["end"][a:b].tolist(), strict=True))
        spans.append([{"start": s, "end": e} for s, e in own])
        edges = [0, *(x for s in own for x in s), len(data)]
        kept.append(b"".join(data[edges[x] : edges[x + 1]] for x in range(0, len(edges), 2)))
    return pa.table({"doc_id": texts.column("doc_id"), "copies": texts.column("copies"), "n_bytes": pa.array([len(x.as_py()) for x in column], pa.int64()), "spans": pa.array(spans, SPANS), "kept": pa.array(kept, pa.binary())})


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (array of start and end, in bytes), kept (the
    bytes that remain)."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    ).withColumn("k", F.xxhash64("text"))
    texts, n_bytes, several = collapsed(texts, ["doc", "k"], "text")
    n_buckets = max(several.partitions, n_bytes // BUCKET)
    gatherings = n_bytes // (GATHER * GRAMS // 2) + texts.rdd.getNumPartitions()  # an anchor in GRAMS / 2 bytes
    groups = math.isqrt(max(gatherings, n_buckets)) + 1
    entries = batches(texts.select("doc", "k", "text")).mapInArrow(scan(n_buckets, max(1, HOT // gatherings), groups), PACKED)
    first = materialise(entries.groupBy("bucket").applyInArrow(resolve(n_buckets), PACKED))

    dealt = texts.withColumn("bucket", row_bucket_column("doc", "k", n_buckets))
    second = dealt.groupBy("bucket").cogroup(first.filter(F.col("kind") == PROBE).groupBy("bucket")).applyInArrow(cut_out(n_buckets, groups), PACKED)
    second = second.unionByName(first.filter(F.col("kind") == STRING))
    for _ in range(2):
        second = second.groupBy("bucket").applyInArrow(construct(n_buckets), PACKED)
    told = first.filter(F.col("kind") == MARK).unionByName(second)
    schema = "doc_id long, copies long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return restored(dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(remove, schema), several)


def query(spark, sf_dir):
    found = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
