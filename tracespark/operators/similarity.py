"""Subtree signatures, similarity of traces, and compression of spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pa_json
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import fnv1a_64
from .trees import trees

#: Least size of a span's JSON, least gain, and level of its compression.
LEAST_BYTES, LEAST_RATIO, LEVEL = 256, 1.2, 3
SIMILAR = 0.9


def signatures(tree: DataFrame) -> DataFrame:
    """CMP-03 to CMP-05: the signature of every subtree. tree: trees(spans, hashes=True), which needs no text, or
    trees(spans, structures=True), or "roots" for whole trees alone."""
    return tree.filter("in_tree AND (hash IS NOT NULL OR structure IS NOT NULL)").select("trace_id", "span_id", F.coalesce("hash", fnv1a_64(F.col("structure"))).alias("hash"), "structure", "operations", F.col("height").alias("depth"), "is_root")


def occurrences(signed: DataFrame, repeated_only: bool = False) -> DataFrame:
    """AGG-13, CMP-08, CMP-09: how often each signature occurs, and the first subtree that has it; hits are occurrences after
    the first."""
    found = signed.groupBy("hash").agg(F.count(F.lit(1)).alias("count"), F.max("depth").alias("depth"), F.min(F.struct("trace_id", "span_id")).alias("example"))
    found = found.withColumn("hits", F.col("count") - 1)
    return found.filter("count > 1") if repeated_only else found


def spelt(spans: DataFrame, found: DataFrame) -> DataFrame:
    """occurrences() with the structure of each: the examples alone are spelt, in the traces that have one."""
    example = found.select("example.*").withColumn("marked", F.lit(True))
    traces = example.select("trace_id").distinct()
    tree = trees(spans.join(traces, "trace_id", "left_semi").join(example, ["trace_id", "span_id"], "left"), structures="marked")
    text = tree.filter("structure IS NOT NULL").select(F.struct("trace_id", "span_id").alias("example"), "structure")
    return found.join(text, "example")


def similarity(a, b):
    """CMP-06, SET-02: of operations a (as a set) and b (as a list): |{i: b_i in a}| over the union."""
    shared = F.size(F.filter(b, lambda x: F.array_contains(a, x)))
    return shared / (F.size(F.array_distinct(a)) + F.size(b) - shared)


def similar(signed: DataFrame, hash_: str, threshold: float = SIMILAR, one=None) -> DataFrame:
    """CMP-07: distinct signatures at least so similar to one of them, whose operations (one row, no
    more than a subtree's spans) are fetched, unless `one` is a row that has them, and become a literal."""
    one = one or signed.filter(F.col("hash") == hash_).select("operations").first()
    each = signed.groupBy("hash", "operations").agg(F.max("depth").alias("depth"))  # a hash has one list; as a key it needs no sort
    if one is None:
        return each.withColumn("similarity", F.lit(0.0)).filter("false")
    wanted = F.array(*map(F.lit, one.operations))
    return each.filter(F.col("hash") != hash_).withColumn("similarity", similarity(wanted, F.col("operations"))).filter(F.col("similarity") >= threshold)


def classes(signed: DataFrame) -> DataFrame:
    """A row for each signature: hash, set_id and bag_id of its operations (distinct ones; all of them in any order), which
    are all that similarity depends on, and these as the sorted arrays ops_set and ops_bag."""
    each = signed.select("hash", "operations").distinct().select("hash", F.sort_array("operations").alias("ops_bag")).withColumn("ops_set", F.array_distinct("ops_bag"))
    name = lambda c: F.sha2(F.to_json(c), 256)
    return each.select("hash", name("ops_set").alias("set_id"), name("ops_bag").alias("bag_id"), "ops_set", "ops_bag")


def similar_classes(found: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """CMP-07 for all pairs at once: (set_id, bag_id, similarity) of the sets and bags of classes() that are at least so similar. Two
    signatures are similar in the one order if the set of the first and the bag of the second are.

    An inverted index of operations: a bag is looked up by its rarest operations only, as many as leave too little
    weight in the rest to reach the threshold with any set (prefix filter), and only among sets that aren't too
    large for it (size filter); what is found is verified. Nothing is crossed."""
    bags = found.groupBy("bag_id").agg(F.first("ops_bag").alias("ops_bag")).withColumn("n", F.size("ops_bag"))
    sets = found.groupBy("set_id").agg(F.first("ops_set").alias("ops_set")).withColumn("k", F.size("ops_set"))
    entries = bags.select("bag_id", "n", F.explode("ops_bag").alias("op")).groupBy("bag_id", "n", "op").agg(F.count(F.lit(1)).alias("m"))
    common = entries.groupBy("op").agg(F.count(F.lit(1)).alias("bags"))
    rest = Window.partitionBy("bag_id").orderBy("bags", "op").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    least = threshold / (1 + threshold) * (1 + F.col("n"))  # what any set has to share, the smallest too
    prefix = entries.join(common, "op").withColumn("left", F.sum("m").over(rest)).filter(F.col("left") >= least - 1e-9).select("bag_id", "n", "op")
    index = sets.select("set_id", "k", F.explode("ops_set").alias("op"))
    met = prefix.join(index, "op").filter(F.col("k") * threshold <= F.col("n") + 1e-9).select("set_id", "bag_id").distinct()
    judged = met.join(sets.select("set_id", "ops_set"), "set_id").join(bags.select("bag_id", "ops_bag"), "bag_id")
    return judged.withColumn("similarity", similarity(F.col("ops_set"), F.col("ops_bag"))).filter(F.col("similarity") >= threshold).select("set_id", "bag_id", "similarity")


PACKED = "trace_id string, span_id string, is_compressed boolean, original_size int, compressed_size int, ratio double, data binary"


def packed_texts(z: zstandard.ZstdCompressor, raw: pa.Array) -> list[bytes]:
    """Each text of an array compressed by itself, all in one call."""
    if not len(raw):
        return []
    at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.uint64)
    segments = np.stack([at[:-1], np.diff(at)], axis=1)
    return [x.tobytes() for x in z.multi_compress_to_buffer(zstandard.BufferWithSegments(raw.buffers()[2], segments.tobytes()))]


def compress(spans: DataFrame, level: int = LEVEL) -> DataFrame:
    """CMP-01: each span's JSON, compressed where it is long and gains enough (else kept as it is)."""
    names = spans.columns

    def run(batches):
        z = zstandard.ZstdCompressor(level=level)
        for b in batches:
            raw = b.column("json").cast(pa.binary())
            size = pc.binary_length(raw).to_numpy()
            long = np.flatnonzero(size >= LEAST_BYTES)
            packed = pa.array(packed_texts(z, raw.take(pa.array(long))), pa.binary())
            gain = np.ones(len(raw))
            gain[long] = size[long] / pc.binary_length(packed).to_numpy()
            good = gain >= LEAST_RATIO
            data = pc.replace_with_mask(raw, pa.array(good), packed.filter(pa.array(good[long])))
            yield pa.RecordBatch.from_arrays([b.column("trace_id"), b.column("span_id"), pa.array(good), pa.array(size, pa.int32()), pc.binary_length(data), pa.array(np.where(good, gain, 1.0)), data], [x.split()[0] for x in PACKED.split(", ")])

    return spans.select("trace_id", "span_id", F.to_json(F.struct(*names)).alias("json")).mapInArrow(run, PACKED)


#: Types that Arrow's reader of JSON takes as from_json does, or refuses.
PLAIN = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def plain_rows(texts: list[bytes], wanted: pa.Schema) -> pa.StructArray | None:
    """The wanted fields of JSON objects; None if anything is in them that Arrow refuses."""
    data = b"\n".join(texts) + b"\n"
    try:
        t = pa_json.read_json(pa.BufferReader(data), pa_json.ReadOptions(use_threads=False, block_size=len(data)), pa_json.ParseOptions(explicit_schema=wanted, unexpected_field_behavior="ignore"))
    except pa.ArrowInvalid:
        return None
    if t.num_rows != len(texts) or t.schema.names != wanted.names:
        return None
    return pa.StructArray.from_arrays([pa.concat_arrays(c.chunks) for c in t.columns], fields=list(wanted))


def decompress(packed: DataFrame, schema) -> DataFrame:
    """CMP-02: the spans back. A batch whose fields are plain is read where it is decompressed, any other by from_json."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    types = [f.dataType.simpleString() for f in schema]
    wanted = pa.schema([(f.name, PLAIN[t]) for f, t in zip(schema, types, strict=True)]) if set(types) <= set(PLAIN) else None
    out = T.StructType().add("json", "string").add("s", schema)

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            if not b.num_rows:
                continue
            texts = [z.decompress(d) if c else d for c, d in zip(b.column("is_compressed").to_pylist(), b.column("data").to_pylist(), strict=True)]
            rows = plain_rows(texts, wanted)
            left = pa.nulls(len(texts), pa.string()) if rows is not None else pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([left, pa.nulls(len(texts), pa.struct(wanted)) if rows is None else rows], ["json", "s"])

    def spelt_out(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([(z.decompress(d) if c else d).decode() for c, d in zip(b.column("is_compressed").to_pylist(), b.column("data").to_pylist(), strict=True)], pa.string())], ["json"])

    data = packed.select("is_compressed", "data")
    if wanted is None:
        return data.mapInArrow(spelt_out, "json string").select(F.from_json("json", schema).alias("s")).select("s.*")
    return data.mapInArrow(run, out).select(F.coalesce("s", F.from_json("json", schema)).alias("s")).select("s.*")


def totals(packed: DataFrame) -> DataFrame:
    """AGG-17: sizes, ratio and savings of the spans that were compressed; null where none was."""
    c = F.col("is_compressed")
    found = packed.agg(F.count(F.lit(1)).alias("total_spans"), F.count_if(c).alias("compressed_spans"), F.sum(F.when(c, F.col("original_size"))).alias("total_original"), F.sum(F.when(c, F.col("compressed_size"))).alias("total_compressed"))
    ratio = F.col("total_original") / F.col("total_compressed")
    return found.withColumn("ratio", ratio).withColumn("savings_percent", (1 - 1 / ratio) * 100)
