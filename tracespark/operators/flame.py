"""Flame graphs over span trees: folded stacks, frame statistics, hot spots, SVG."""

from __future__ import annotations

import html

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fnv1a_32, frame_name, whole_micros
from .folds import by_key, whole_groups
from .trees import Forest

# Sizes and colours of the picture, and the least width of a frame with a label.
WIDTH, ROW, FONT, TOP, LABELLED = 1200, 18, 12, 25.0, 80
HUE, HUES, SATURATION, LIGHTNESS = 200, 60, (60, 90), (40, 70)


def folded(tree: DataFrame) -> DataFrame:
    """FG-02: a line for each span of a tree, frames joined by ; and the whole duration in microseconds, in
    the order of a walk (trace_id, visit). tree: trees(spans, paths=True)."""
    line = F.concat(F.array_join("frames", ";"), F.lit(" "), whole_micros(F.col("duration_ms")).cast("string"))
    return tree.filter("in_tree").select("trace_id", "visit", line.alias("line"))


def frames(tree: DataFrame) -> DataFrame:
    """FG-01: a frame for each span of a tree."""
    return tree.filter("in_tree").select("trace_id", "span_id", frame_name(F.col("service_name"), F.col("operation"), F.col("protocol")).alias("name"), whole_micros(F.col("duration_ms")).alias("value_us"), "duration_ms", (F.col("duration_ms") - F.col("child_ms")).alias("self_ms"), "depth", "visit", "is_root")


def frame_stats(tree: DataFrame, compat: bool = False) -> DataFrame:
    """AGG-12, FG-03: by frame name over all trees: total, calls, self time (summed; with compat
    that of the frame visited last), share of the roots' time."""
    f = frames(tree)
    last = F.max_by("self_ms", F.struct("trace_id", "visit")) if compat else F.sum("self_ms")
    total = f.filter("is_root").agg(F.sum("duration_ms").alias("all_ms"))
    found = f.groupBy("name").agg(F.sum("duration_ms").alias("total_ms"), F.count(F.lit(1)).alias("calls"), last.alias("self_ms"))
    return found.withColumn("percentage", F.col("total_ms") / total.scalar() * 100)


def hot_spots(tree: DataFrame, n: int = 10) -> DataFrame:
    """TOP-01, FG-04: the frames of most self time; all of them if n isn't positive."""
    ordered = frames(tree).select("trace_id", "span_id", "name", "self_ms").orderBy(F.desc("self_ms"), "trace_id", "span_id")
    return ordered.limit(n) if n > 0 else ordered


def fnv32(text: str) -> int:
    h = 0x811C9DC5
    for b in text.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def colour(name: str, duration_ms: float, depth: int) -> str:
    """FG-06: by name; slow frames orange and red; deeper frames darker."""
    h = fnv32(name)
    hue, saturation = HUE + h % HUES, SATURATION[0] + (h >> 8) % (SATURATION[1] - SATURATION[0])
    if duration_ms > 500:
        hue, saturation = 0, 90
    elif duration_ms > 200:
        hue, saturation = 30, 80
    return f"hsl({hue}, {saturation}%, {max(LIGHTNESS[1] - 3 * depth, LIGHTNESS[0])}%)"


PLACED = "trace_id string, span_id string, name string, duration_ms double, value_us long, depth int, x double, y double, width double, levels int, shown long"


def picture(spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """FG-05: x, y and width of the frames that can be seen in the pictures of all traces. Widths are in
    proportion to the root, children stand side by side under their parent; a frame under half a pixel wide or
    wholly right of the picture (where children overlap in time) goes with all below it. levels is the height
    of the whole tree, shown the number of its rows here. Durations that are null count as 0."""
    columns = [c.split() for c in PLACED.split(", ")]
    types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}

    def run(batches):
        for t in whole_groups(batches, "trace_id"):
            f, value = Forest(t), t.column("value_us").to_numpy()
            total, left, seen, elder = np.maximum(value[f.root], 1), np.zeros(f.n, np.int64), f.is_root.copy(), f.elders(value)
            for level in f.levels[1:]:
                above = f.parent[level]
                left[level] = left[above] + elder[level]
                seen[level] = seen[above] & (2 * width * value[level] >= total[level]) & (left[level] < total[level])
            rows = np.flatnonzero(seen)
            shown = np.bincount(f.trace[rows], minlength=1)[f.trace[rows]]
            made = dict(depth=f.depth[rows], x=left[rows] / total[rows] * width, y=TOP + (f.depth[rows] - 1.0) * ROW, width=np.where(f.is_root[rows], width, value[rows] / total[rows] * width), levels=f.height[f.root[rows]], shown=shown)
            kept = t.take(pa.array(rows))
            yield from pa.Table.from_arrays([pa.array(made[c], types[k]) if c in made else kept.column(c) for c, k in columns], names=[c for c, _ in columns]).to_batches()

    named = spans.select("trace_id", "span_id", "parent_span_id", frame_name(F.col("service_name"), F.col("operation"), F.col("protocol")).alias("name"), "duration_ms", F.coalesce(whole_micros(F.col("duration_ms")), F.lit(0)).cast("long").alias("value_us"), "start_ns")
    return by_key(named, ["trace_id"], ["start_ns", "span_id"], run, PLACED)


def svg(frames: list[dict], title: str = "Flame graph", width: int = WIDTH) -> str:
    """One trace as a picture: rows of picture(), each an inner picture that clips its own label."""
    levels, shown = (frames[0]["levels"], frames[0]["shown"]) if frames else (0, 0)
    foot = f"{levels} levels, {max((r['duration_ms'] or 0 for r in frames if r['depth'] == 1), default=0):.2f} ms" + (f", {shown - len(frames)} deeper frames left out" if shown > len(frames) else "")
    height = max((r["y"] for r in frames), default=TOP) + 2 * ROW
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height:g}" width="{width}">', f"<style>text{{font:{FONT - 1}px sans-serif;fill:#fff}}.note{{fill:#222}}</style>", f'<text class="note" x="4" y="{ROW - 4}">{html.escape(title)}</text>']
    for r in frames:
        about = html.escape(f"{r['name']} | {r['duration_ms'] or 0:.3f} ms | {r['span_id']}")
        label = f'<text x="3" y="{ROW - 5}">{html.escape(r["name"])}</text>' if r["width"] >= LABELLED else ""
        parts.append(f'<svg x="{r["x"]:.2f}" y="{r["y"]:.2f}" width="{r["width"]:.2f}" height="{ROW - 1}"><title>{about}</title><rect width="100%" height="100%" fill="{colour(r["name"], r["duration_ms"] or 0, r["depth"] - 1)}"/>{label}</svg>')
    return "\n".join([*parts, f'<text class="note" x="4" y="{height - 6:g}">{foot}</text>', "</svg>"])


def colours(tree: DataFrame) -> DataFrame:
    """FG-06 as columns: the colour of every frame of every tree."""
    f = frames(tree)
    h = fnv1a_32(F.col("name"))
    slow, slower = F.col("duration_ms") > 200, F.col("duration_ms") > 500
    hue = F.when(slower, 0).when(slow, 30).otherwise(HUE + h % HUES).cast("long")
    saturation = F.when(slower, 90).when(slow, 80).otherwise(SATURATION[0] + F.shiftright(h, 8) % (SATURATION[1] - SATURATION[0])).cast("long")
    return f.select("trace_id", "span_id", hue.alias("hue"), saturation.alias("saturation"), F.greatest(LIGHTNESS[1] - 3 * (F.col("depth") - 1), F.lit(LIGHTNESS[0])).alias("lightness"))
