"""Removal of word windows that a document of smaller id has too, behind a count-min prefilter.

1. Every window of WINDOW words is counted in a count-min sketch of two rows. Its cells are hashes of
   the window's *anchor*, the gram of GRAM words with the least hash in it (leftmost of equals): equal
   windows have equal anchors, so no count falls below the true one, and the consecutive windows
   of one anchor, about 13, are counted with one entry. Each partition fills a sparse sketch
   of its own for every unit of documents; the sketches are merged segment by segment (a segment has
   2 * 2**BITS cells, the number of segments follows the input), and every unit is told which of its cells
   were counted twice or more. No task and no broadcast ever holds the whole sketch.
2. The second pass groups exactly, by 96 bits of hash of all their words, only the windows whose estimate says
   repeated: first within the unit, where all but the windows of the least document are marked and
   done, then in the bucket of the anchor. Windows estimated over HOT times first meet in groups of
   units (about the root of their number) and only the least document's go on, so a passage that all
   documents have reaches no task in more copies than that.

Texts are shuffled twice, by unit (about BUCKET bytes); only packed arrays move besides.

Defined cases: null texts have no words; a text of fewer than WINDOW words is kept whole; ids order the
documents, null last; rows of equal id (null too) are one document and don't remove each other; many equal
rows are handled as one; an empty table gives an empty result; further columns are ignored. Rows are told apart by
id and 64 bits of hash of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, collapsed, materialise, restored, table
from .packed import PACKED, as_table, batches_of, by_kind, entries_of, in_rows, joined, merged, row_bucket, row_bucket_column, send, size, take, unpack
from .textnp import chunks, mixed, prefix_sums, release, runs_of, spans_hash, weighted_sums, words

#: Words of a window and of an anchor, anchors to a window.
WINDOW, GRAM = 50, 25
GRAMS = WINDOW - GRAM + 1
#: Cells of a segment's row, as a power of 2; anchors that a segment takes on average.
BITS, LOAD = 22, 1 << 20
#: Bytes of text to a unit, bytes looked at together, anchors that a partition gathers before it sends its sketch.
BUCKET, TEXT, GATHER = 16 << 20, 1 << 20, 1 << 20
#: An estimate over which windows meet in groups of units first.
HOT = 1000
CELLS, REPEATED, WINDOWS, HOT_WINDOWS, MARK = KINDS = range(5)
FIELDS = {CELLS: {"unit": "u4", "count": "u1", "cell": "u8"}, REPEATED: {"cell": "u8", "hot": "u1"}, MARK: {"doc": "i8", "k": "i8", "start": "i4", "end": "i4"}}
FLAT = ("doc", "k", "start", "one", "two")


class Anchored:
    """The words of some texts, and the anchors of their windows."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        start, end, self.first = words(data, at)
        self.values = spans_hash(prefix_sums(data), start, end)
        self.sums = weighted_sums(self.values)
        n = len(start) - GRAM + 1
        self.gram = self.low = self.high = self.text = np.zeros(0, np.int64)
        if n < GRAMS:
            return
        grams = spans_hash(self.sums, np.arange(n), np.arange(GRAM, n + GRAM))
        least = (grams & ~np.uint64((1 << 31) - 1)) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= GRAMS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < GRAMS:
            least = np.minimum(least[: width - GRAMS], least[GRAMS - width :])
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[: len(least)]
        p = np.flatnonzero(np.arange(len(least)) + WINDOW <= self.first[text + 1])
        if not len(p):
            return
        where = (least[p] & np.uint64((1 << 31) - 1)).astype(np.int64)
        begins = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
        self.low, self.high = p[begins], p[np.concatenate([begins[1:], [len(p)]]) - 1]
        self.gram, self.text = grams[where[begins]], text[self.low]

    def windows(self, of: np.ndarray, doc: np.ndarray, k: np.ndarray) -> tuple[dict, np.ndarray]:
        """The windows of some anchors with their hashes, and the anchor of each."""
        n = self.high[of] - self.low[of] + 1
        anchor = np.repeat(of, n)
        p = np.repeat(self.low[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
        text = self.text[anchor]
        other = weighted_sums(mixed(self.values ^ np.uint64(0xD6E8FEB86659FD93)))
        two = (spans_hash(other, p, p + WINDOW) >> np.uint64(32)).astype(np.uint32)
        return {"doc": doc[text], "k": k[text], "start": (p - self.first[text]).astype(np.int32), "one": spans_hash(self.sums, p, p + WINDOW), "two": two}, anchor


def cells_of(gram: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of an anchor and its two cells there, as one number that tells most segments apart too."""
    segment = (mixed(gram ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)) % np.uint64(n_segments)
    return segment.astype(np.int32), (segment << np.uint64(2 * BITS)) | (gram & np.uint64((1 << 2 * BITS) - 1))


def sketched(n_units: int, n_segments: int):
    """Texts to the partition's sketches: how often each unit's anchors fill which cells."""

    def flush(gathered: list[dict]) -> Iterator[pa.RecordBatch]:
        t = joined(gathered, ("segment", "unit", "cell"))
        gathered.clear()
        t = take(t, np.lexsort((t["cell"], t["unit"])))  # a cell is of one segment
        new = np.flatnonzero(np.append(True, np.diff(runs_of(t["unit"], t["cell"])) > 0))
        count = np.minimum(np.diff(np.append(new, size(t))), 255)
        t = take(t, new) | {"count": count}
        yield from send(CELLS, FIELDS[CELLS], t, t["segment"])

    def run(batches_in):
        gathered, n = [], 0
        for batch in batches_in:
            unit = row_bucket(batch.column("doc").to_numpy(), batch.column("k").to_numpy(), n_units)
            for i, j, data, at in chunks(batch.column("text"), TEXT):
                a = Anchored(data, at)
                if len(a.gram):
                    segment, cell = cells_of(a.gram, n_segments)
                    gathered.append({"segment": segment, "unit": unit[i:j][a.text], "cell": cell})
                    n += len(cell)
                if n > GATHER:
                    yield from flush(gathered)
                    n = 0
        if gathered:
            yield from flush(gathered)
        release()

    return run


def merge(packed: pa.Table) -> pa.Table:
    """All partitions' sketches of a segment to one, and to each unit the cells of its windows estimated repeated."""
    t = unpack(FIELDS[CELLS], by_kind(packed, KINDS)[CELLS])
    mask = np.uint64((1 << BITS) - 1)
    rows = [(t["cell"] & mask).astype(np.int64), (t["cell"] >> np.uint64(BITS) & mask).astype(np.int64)]
    estimate = np.minimum(*(np.bincount(r, weights=t["count"])[r] for r in rows)) if size(t) else np.zeros(0)
    t["hot"] = (estimate > HOT).astype(np.uint8)
    t = take(t, estimate >= 2)
    return as_table(list(send(REPEATED, FIELDS[REPEATED], t, t["unit"].astype(np.int32))))


def window_rows(kind: int, t: dict, bucket: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Packed rows of windows: consecutive ones share a head."""
    order = np.argsort(bucket, kind="stable")
    t, bucket = take(t, order), bucket[order]
    for of, i, j in in_rows(bucket, 20_000):
        w = take(t, slice(i, j))
        new = np.ones(j - i, dtype=bool)
        new[1:] = (w["doc"][1:] != w["doc"][:-1]) | (w["k"][1:] != w["k"][:-1]) | (w["start"][1:] != w["start"][:-1] + 1)
        heads = np.flatnonzero(new)
        n = np.diff(np.append(heads, j - i)).astype(np.int32)
        yield of, kind, b"".join([np.array([len(heads), j - i], np.int32).tobytes(), *(w[f][heads].tobytes() for f in ("doc", "k", "start")), n.tobytes(), w["one"].tobytes(), w["two"].tobytes()])


def windows_of(blobs: list[bytes]) -> dict:
    """The windows of packed rows."""
    parts = [{"doc": np.zeros(0, np.int64), "k": np.zeros(0, np.int64), "start": np.zeros(0, np.int32), "one": np.zeros(0, np.uint64), "two": np.zeros(0, np.uint32)}]
    for b in blobs:
        heads, m = np.frombuffer(b, np.int32, 2).tolist()
        at, got = 8, []
        for kind, n in (("i8", heads), ("i8", heads), ("i4", heads), ("i4", heads), ("u8", m), ("u4", m)):
            got.append(np.frombuffer(b, kind, n, at))
            at += got[-1].nbytes
        doc, k, start, n, one, two = got
        ahead = np.arange(m) - np.repeat(np.cumsum(n) - n, n)
        parts.append({"doc": np.repeat(doc, n), "k": np.repeat(k, n), "start": (np.repeat(start, n) + ahead).astype(np.int32), "one": one, "two": two})
    return joined(parts, FLAT)


def later(t: dict) -> np.ndarray:
    """Whether a document of smaller id among these has the same window."""
    done = np.zeros(size(t), dtype=bool)
    if not size(t):
        return done
    order = np.lexsort((t["doc"], t["two"], t["one"]))
    run = runs_of(t["one"][order], t["two"][order])
    doc = t["doc"][order]
    least = doc[np.append(True, np.diff(run) > 0)][run]
    done[order] = doc > least
    return done


def told(t: dict, n_units: int) -> Iterator[pa.RecordBatch]:
    """Windows as marks, sent to their units."""
    marks = merged({"doc": t["doc"], "k": t["k"], "start": t["start"], "end": t["start"] + np.int32(WINDOW)})
    return send(MARK, FIELDS[MARK], marks, row_bucket(marks["doc"], marks["k"], n_units))


def found_in(n_units: int, n_segments: int):
    """A unit's texts and what it is told of the sketch to marks, and to windows that other units may have."""
    groups = max(1, math.isqrt(n_units))

    def run(texts: pa.Table, packed: pa.Table) -> pa.Table:
        said = unpack(FIELDS[REPEATED], by_kind(packed, KINDS)[REPEATED])
        if not size(said) or not texts.num_rows:
            return as_table([])
        known, hot_cells = np.unique(said["cell"]), np.unique(said["cell"][said["hot"] == 1])
        texts = texts.combine_chunks()
        doc, k = texts.column("doc").to_numpy(), texts.column("k").to_numpy()
        parts = []
        for i, j, data, at in chunks(texts.column("text").chunk(0), TEXT):
            a = Anchored(data, at)
            if len(a.gram):
                _, cell = cells_of(a.gram, n_segments)
                of = np.flatnonzero(np.isin(cell, known))
                t, anchor = a.windows(of, doc[i:j], k[i:j])
                parts.append(t | {"gram": a.gram[anchor], "hot": np.isin(cell[anchor], hot_cells)})
        if not parts:
            return as_table([])
        t = joined(parts, (*FLAT, "gram", "hot"))
        del parts
        done = later(t)
        out = list(told(take(t, done), n_units))
        t = take(t, ~done)
        group = np.uint64(row_bucket(doc[:1], k[:1], n_units)[0] % groups)
        for kind, of in ((WINDOWS, ~t["hot"]), (HOT_WINDOWS, t["hot"])):
            w = take(t, of)
            key = w["gram"] if kind == WINDOWS else mixed(w["gram"] + group * np.uint64(0x9E3779B97F4A7C15))
            out += batches_of(window_rows(kind, w, (key >> np.uint64(33)).astype(np.int64) % n_units))
        return as_table(out)

    return run


def settle(n_units: int):
    """Windows of a bucket to marks; of hot ones those of the least document go on."""

    def run(packed: pa.Table) -> pa.Table:
        got = by_kind(packed, KINDS)
        out = []
        for kind in (WINDOWS, HOT_WINDOWS):
            t = windows_of(got[kind])
            done = later(t)
            out += told(take(t, done), n_units)
            if kind == HOT_WINDOWS:
                t = take(t, ~done)
                out += batches_of(window_rows(WINDOWS, t, (t["one"] >> np.uint64(33)).astype(np.int64) % n_units))
        return pa.concat_tables([packed.filter(pc.equal(packed.column("kind"), MARK)), as_table(out)])

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove(texts: pa.Table, packed: pa.Table) -> pa.Table:
    """Texts and all their marks to the words removed and the text kept."""
    marks = merged(unpack(FIELDS[MARK], by_kind(packed, KINDS)[MARK]))
    column = texts.column("text")
    spans, kept, counts = [], [], []
    for i, a, b in entries_of(marks, texts.column("doc").to_numpy(), texts.column("k").to_numpy()):
        own = column[i].as_py().split()
        at = list(zip(marks["start"][a:b].tolist(), marks["end"][a:b].tolist(), strict=True))
        spans.append([{"start": s, "end": e} for s, e in at])
        counts.append(len(own))
        for s, e in reversed(at):
            del own[s:e]
        kept.append(b" ".join(own))
    return pa.table({"doc_id": texts.column("doc_id"), "copies": texts.column("copies"), "n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, SPANS), "kept": pa.array(kept, pa.binary())})


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, spans (array of start and end, in words, of what documents
    of smaller id have too), kept (the words that remain, joined by one space)."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("k", F.xxhash64("text"))
    texts, n_bytes, several = collapsed(texts.withColumn("text", F.col("text").cast("binary")), ["doc", "k"], "text")
    n_units = max(several.partitions, n_bytes // BUCKET)
    n_segments = max(several.partitions, n_bytes // (90 * LOAD))  # an anchor in about 90 bytes
    sketches = batches(texts.select("doc", "k", "text")).mapInArrow(sketched(n_units, n_segments), PACKED)
    repeated = sketches.groupBy("bucket").applyInArrow(merge, PACKED)

    dealt = texts.withColumn("bucket", row_bucket_column("doc", "k", n_units))
    marks = dealt.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(found_in(n_units, n_segments), PACKED)
    for _ in range(2):
        marks = marks.groupBy("bucket").applyInArrow(settle(n_units), PACKED)
    schema = "doc_id long, copies long, n_words long, spans array<struct<start:long,end:long>>, kept binary"
    found = dealt.groupBy("bucket").cogroup(materialise(marks).groupBy("bucket")).applyInArrow(remove, schema)
    return restored(found, several).withColumn("kept", F.col("kept").cast("string"))


def query(spark, sf_dir):
    found = repeated_windows(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: Whole window strings in place of hashes.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT r, o, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(list_slice(w, i, i + 49), ' ')))) AS h FROM d WHERE len(w) >= 50),
m AS (SELECT h, min(o) AS least FROM g GROUP BY h),
c AS MATERIALIZED (SELECT DISTINCT r, i + unnest(range(0, 50)) AS i FROM g JOIN m USING (h) WHERE o > least),
x AS MATERIALIZED (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
k AS (SELECT x.r, count(*) AS n, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN c ON x.r = c.r AND x.i = c.i GROUP BY x.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
