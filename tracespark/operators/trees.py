"""Span trees: roots, depths, paths, orphans and subtree structures, a partition of traces at a time.

Traces are dealt by id once; within a task all trees of a batch are walked together, in arrays. A trace is
never cut, so memory is that of the largest trace (beside a batch): about 200 bytes a span. Paths and structures
are texts that grow with the square of the depth; they are only made where asked for, and hashes of structures need none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import by_key, spread, tasks_of, whole_groups
from .labels import Labels

COLUMNS = "trace_id string, span_id string, parent_span_id string, service_name string, operation string, protocol string, duration_ms double, start_ns long"
ADDED = "depth int, height int, visit int, children int, child_ms double, frames array<string>, structure string, hash string, operations array<string>, in_tree boolean, is_root boolean, is_orphan boolean"


def root_and_children(rows: list[dict]) -> tuple[int | None, list[list[int]]]:
    """Of one trace's rows in order: its root (the last span without parent) and the children of each row."""
    at = {r["span_id"]: i for i, r in enumerate(rows)}  # the last of equal ids wins
    root, children = None, [[] for _ in rows]
    for i, r in enumerate(rows):
        if at[r["span_id"]] == i:
            if not r["parent_span_id"]:
                root = i
            elif (p := at.get(r["parent_span_id"])) is not None:
                children[p].append(i)
    return root, children


class Forest:
    """The trees of some whole traces as arrays; rows in order of (trace, start, span)."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        n = self.n = t.num_rows
        column = lambda c: t.column(c).chunk(0) if t.column(c).num_chunks else pa.array([], t.schema.field(c).type)
        trace = self.trace = column("trace_id").dictionary_encode().indices.to_numpy().astype(np.int64)
        spans = column("span_id").dictionary_encode()
        own = trace * (len(spans.dictionary) + 1) + spans.indices.to_numpy()
        above = pc.fill_null(column("parent_span_id"), "")
        parent_code = pc.fill_null(pc.index_in(above, value_set=spans.dictionary), len(spans.dictionary)).to_numpy()
        order = np.argsort(own, kind="stable")
        ends = np.flatnonzero(np.append(np.diff(own[order]) != 0, True)) if n else np.zeros(0, np.int64)
        last = order[ends]  # the last of equal ids wins
        counts = np.zeros(n, dtype=bool)
        counts[last] = True
        top = pc.equal(above, "").to_numpy(zero_copy_only=False)
        wanted = trace * (len(spans.dictionary) + 1) + parent_code
        found = np.minimum(np.searchsorted(own[last], wanted), max(0, len(last) - 1))
        there = counts & ~top & (own[last][found] == wanted) if n else counts
        self.orphan = counts & ~top & ~there
        self.parent = np.where(there, last[found], -1) if n else np.zeros(0, np.int64)
        root_of = np.full(int(trace[-1]) + 1 if n else 0, -1)
        root_of[trace[counts & top]] = np.flatnonzero(counts & top)  # the last span without parent is the root
        self.is_root = np.zeros(n, dtype=bool)
        self.is_root[root_of[root_of >= 0]] = True
        self.children = np.bincount(self.parent[self.parent >= 0], minlength=n)
        # Jumps of 1, 2, 4, ... parents at once: how far the root is, if it is reached.
        jump, self.depth = np.where(self.parent >= 0, self.parent, np.arange(n)), (self.parent >= 0).astype(np.int64)
        for _ in range(n.bit_length()):
            if (jump == jump[jump]).all():
                break
            self.depth, jump = self.depth + self.depth[jump], jump[jump]
        self.root, self.in_tree = jump, self.is_root[jump]
        self.depth = np.where(self.in_tree, self.depth + 1, 0)
        inner = np.flatnonzero(self.in_tree)
        by_depth = inner[np.argsort(self.depth[inner], kind="stable")]
        self.levels = np.split(by_depth, np.flatnonzero(np.diff(self.depth[by_depth])) + 1) if len(by_depth) else []
        self.size, self.height, self.visit = np.ones(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64)
        for level in reversed(self.levels[1:]):
            np.add.at(self.size, self.parent[level], self.size[level])
            np.maximum.at(self.height, self.parent[level], self.height[level] + 1)
        kids = np.flatnonzero(self.in_tree & (self.parent >= 0))
        self.kids = kids[np.argsort(self.parent[kids], kind="stable")]
        # A span is visited after its parent and the subtrees of its elder siblings.
        elder = self.elders(self.size)
        for level in self.levels[1:]:
            self.visit[level] = self.visit[self.parent[level]] + 1 + elder[level]
        self.walked = inner[np.lexsort((self.visit[inner], trace[inner]))]  # in the order of the walk

    def elders(self, values: np.ndarray) -> np.ndarray:
        """Of each span the sum of whole numbers over its elder siblings."""
        out, kids = np.zeros(self.n, np.int64), self.kids
        if len(kids):
            upto = np.cumsum(values[kids]) - values[kids]
            first = np.append(True, np.diff(self.parent[kids]) != 0)
            out[kids] = upto - upto[np.maximum.accumulate(np.where(first, np.arange(len(kids)), 0))]
        return out

    def child_ms(self, duration: np.ndarray) -> np.ndarray:
        of = self.in_tree & (self.parent >= 0)
        return np.bincount(self.parent[of], weights=duration[of], minlength=self.n).astype(np.float64)

    def lists(self, length: np.ndarray, values: pa.Array) -> pa.Array:
        """A list of so many of the values to each span of a tree, null to the others."""
        offsets = np.append(0, np.cumsum(np.where(self.in_tree, length, 0)))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(~self.in_tree))

    def paths(self, frames: pa.Array) -> pa.Array:
        """The frames from the root to each span."""
        offsets = np.append(0, np.cumsum(self.depth))[:-1]
        of = np.zeros(int(self.depth.sum()), np.int64)
        above = np.zeros((0, 0), np.int64)
        place = np.zeros(self.n, np.int64)
        for level in self.levels:
            depth = self.depth[level[0]]
            above = np.hstack([above[place[self.parent[level]]], level[:, None]]) if depth > 1 else level[:, None]
            of[offsets[level][:, None] + np.arange(depth)] = above
            place[level] = np.arange(len(level))
        return self.lists(self.depth, frames.take(pa.array(of)))

    def below(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each wanted span how many spans its subtree has, and these one after another as visited."""
        start = np.zeros(self.n, np.int64)
        start[self.walked] = np.arange(len(self.walked))
        size = np.where(wanted, self.size, 0)
        return size, self.walked[np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]

    def hashes(self, names: list[str], labels: Labels) -> list[str | None]:
        """The hash of the structure of each span's subtree."""
        out: list[str | None] = [None] * self.n
        walked = self.walked.tolist()
        spelt = [names[i] for i in walked]
        sizes, depths = self.size[self.walked].tolist(), self.depth[self.walked].tolist()
        at = 0
        while at < len(walked):
            end = at + sizes[at]
            for i, h in zip(walked[at:end], labels.of_tree(spelt[at:end], sizes[at:end], depths[at:end]), strict=True):
                out[i] = f"{int(h):016x}"
            at = end
        return out

    def structures(self, names: list[str], wanted: np.ndarray) -> list[str | None]:
        """The subtree of each wanted span spelt out, a line for each opening and closing."""
        lines: list[tuple[int, str]] = []
        opened, closed = {}, {}
        pending: list[tuple[int, int]] = []  # spans that are open, with what of their subtree is to come
        left = self.size.tolist()
        depth, kids = self.depth.tolist(), self.children.tolist()
        for at, i in enumerate(self.walked.tolist()):
            while pending and pending[-1][1] <= at:
                last, _ = pending.pop()
                lines.append((depth[last], "]"))
                closed[last] = len(lines)
            opened[i] = len(lines)
            lines.append((depth[i], names[i] + "[" if kids[i] else names[i]))
            if kids[i]:
                pending.append((i, at + left[i]))
            else:
                closed[i] = len(lines)
        while pending:
            last, _ = pending.pop()
            lines.append((depth[last], "]"))
            closed[last] = len(lines)
        out: list[str | None] = [None] * self.n
        for i in np.flatnonzero(wanted).tolist():
            out[i] = "".join("  " * (d - depth[i]) + text + "\n" for d, text in lines[opened[i] : closed[i]])
        return out


def trees(spans: DataFrame, structures: bool | str = False, paths: bool = False, hashes: bool = False, operations: bool = False) -> DataFrame:
    """TR-03, TR-04, FG-01, CMP-03: the spans with their place in their trace's tree. Spans that the
    root doesn't reach have in_tree false and no depth. paths adds the frames above each span,
    structures its subtree and the operations in it ("roots": those of roots alone; "marked": those of spans
    whose column marked is true), hashes the signature of its subtree without its text, operations those in it."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    added = [c.split()[0] for c in ADDED.split(", ")]
    more = ["marked"] if structures == "marked" else []

    def run(batches):
        labels = Labels()
        for t in whole_groups(batches, "trace_id"):
            f = Forest(t)
            outside = ~f.in_tree
            number = lambda x: pa.array(x, pa.int32(), mask=outside)
            made = dict(depth=number(f.depth), height=number(f.height), visit=number(f.visit), children=pa.array(f.children, pa.int32()), child_ms=pa.array(f.child_ms(t.column("duration_ms").to_numpy())), in_tree=pa.array(f.in_tree), is_root=pa.array(f.is_root), is_orphan=pa.array(f.orphan))
            service, operation_ = (t.column(c).combine_chunks() for c in ("service_name", "operation"))
            if paths:
                protocol = pc.fill_null(t.column("protocol").combine_chunks(), "")
                ending = pc.if_else(pc.equal(protocol, ""), "", pc.binary_join_element_wise(" [", protocol, "]", ""))
                made["frames"] = f.paths(pc.binary_join_element_wise(service, ":", operation_, ending, ""))
            frame = pc.binary_join_element_wise(service, ":", operation_, "").to_pylist() if structures or hashes else []
            if hashes:
                made["hash"] = pa.array(f.hashes(frame, labels), pa.string())
            if structures:
                wanted = f.is_root if structures == "roots" else f.in_tree
                if more:
                    wanted = wanted & pc.fill_null(t.column("marked").combine_chunks(), False).to_numpy(zero_copy_only=False)
                made["structure"] = pa.array(f.structures(frame, wanted), pa.string())
            if structures or operations:
                size, below = f.below(wanted if structures else f.in_tree)
                made["operations"] = f.lists(size, operation_.take(pa.array(below)))
            made = [made[c] if c in made else pa.nulls(f.n, ADDED_SCHEMA.field(c).type) for c in added]
            yield from pa.Table.from_arrays([*[t.column(c) for c in names], *made], names=[*names, *added]).to_batches()

    return by_key(spans.select(*names, *more), ["trace_id"], ["start_ns", "span_id"], run, f"{COLUMNS}, {ADDED}")


ADDED_SCHEMA = pa.schema(
    [("depth", pa.int32()), ("height", pa.int32()), ("visit", pa.int32()), ("children", pa.int32()), ("child_ms", pa.float64()), ("frames", pa.list_(pa.string())), ("structure", pa.string()), ("hash", pa.string()), ("operations", pa.list_(pa.string())), ("in_tree", pa.bool_()), ("is_root", pa.bool_()), ("is_orphan", pa.bool_())]
)


def depths(tree: DataFrame) -> DataFrame:
    """TR-04: levels of each trace's tree."""
    return tree.filter("in_tree").groupBy("trace_id").agg(F.max("depth").alias("depth"))


def orphans(spans: DataFrame) -> DataFrame:
    """JN-02: spans whose parent isn't there (in the list of a trace, not in its tree)."""
    n, keys = tasks_of(spans), ["trace_id", "span_id"]
    child = spans.filter(F.coalesce("parent_span_id", F.lit("")) != "").select("trace_id", F.col("span_id").alias("child_id"), F.col("parent_span_id").alias("span_id"))
    there = spread(spans.select(*keys), n, *keys)  # children follow; dealt here too, they'd be dealt again above the join
    return child.join(there, keys, "left_anti").select("trace_id", F.col("child_id").alias("span_id"), F.col("span_id").alias("parent_span_id"))


def children_in_order(spans: DataFrame) -> DataFrame:
    """SRT-05: a row for each parent with its children by start."""
    kids = spans.filter(F.coalesce("parent_span_id", F.lit("")) != "")
    return kids.groupBy("trace_id", "parent_span_id").agg(F.sort_array(F.collect_list(F.struct("start_ns", "span_id"))).alias("c")).select("trace_id", "parent_span_id", F.array_join("c.span_id", ",").alias("children"))


def roots(spans: DataFrame) -> DataFrame:
    """The root of each trace: its last span without parent."""
    last = Window.partitionBy("trace_id").orderBy(F.desc("start_ns"), F.desc("span_id"))
    return spans.filter(F.coalesce("parent_span_id", F.lit("")) == "").withColumn("nr", F.row_number().over(last)).filter("nr = 1").drop("nr")
