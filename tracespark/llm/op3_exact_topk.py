"""Exact top-k search by columnar branch-and-bound.

Candidates lie column by column (one array per block of dimensions, largest spread first). A query's
scores are accumulated a block at a time; after each block the remaining dimensions can change a
score by no more than the product of the remaining lengths (Cauchy-Schwarz), so candidates whose
best case is under the k-th best worst case are dropped and the survivors compacted.

All queries meet all rows in a grid of bounded blocks: a query goes to each candidate block, a
candidate to each query block, dealt by a hash of the id, so many copies of one vector spread
evenly. Each block returns k rows for a query, and the k best of these are the result.

Defined cases: vectors that are null or hold null or non-finite components take no part, as
query or candidate; vectors of different lengths don't meet; a query isn't its own candidate, by
id, so rows that share its id aren't either; equal rows are one query, rows of one id with different
vectors are queries of their own, each with its k rows; repeated candidates each count; ties go to the smaller id; a query without candidates has no row; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table

#: Rows of a block of candidates (between these) and of queries; dimensions of a column block.
CANDIDATES, QUERIES, BLOCK = (4096, 65536), 4096, 8
#: Most components of a block of candidates or queries, so that wide vectors come in fewer rows.
COMPONENTS = 1 << 22
SCALE = 256


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, code, width) of the vectors that take part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    code = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return vectors.filter(v.isNotNull() & F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), code.alias("code"), F.size(v).alias("width"))


def branch_and_bound(columns: list[np.ndarray], rest: list[np.ndarray], ids: np.ndarray, q: list[np.ndarray], own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the k best candidates for one query. rest[b]: length of each
    candidate in the blocks from b on."""
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive), dtype=columns[0].dtype if columns else np.int64)
    q_rest = np.sqrt(np.cumsum([float((x.astype(np.float64) ** 2).sum()) for x in q[::-1]])[::-1])
    for b, part in enumerate(columns):
        score = score + q[b] @ (part if len(alive) == part.shape[1] else part[:, alive])
        if b + 1 < len(columns) and len(alive) > k:
            reach = q_rest[b + 1] * rest[b + 1][alive] * (1 + 1e-9) + 1
            worst = score - reach
            least = np.partition(worst, len(worst) - k)[len(worst) - k]
            keep = score + reach >= least
            if not keep.all():
                alive, score = alive[keep], score[keep]
    best = np.lexsort((ids[alive], -score))[:k]
    return alive[best], score[best]


def search_block(k: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        width = t.column("width")[0].as_py()
        code = t.column("code").combine_chunks()
        code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
        code = code.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, width)
        ids, asks = t.column("id").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False)
        most = float(np.abs(code.astype(np.float64)).max()) if code.size else 0
        if most * most * max(1, width) < 2**52:
            code = code.astype(np.float64)  # sums stay exact, and products are much faster
        rows, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
        order = np.argsort(-code[rows].astype(np.float64).var(axis=0), kind="stable") if len(rows) else np.arange(width)
        blocks = [order[i : i + BLOCK] for i in range(0, width, BLOCK)]
        columns = [np.ascontiguousarray(code[rows][:, b].T) for b in blocks]
        squares = [(c.astype(np.float64) ** 2).sum(axis=0) for c in columns]
        rest = [np.sqrt(x) for x in np.cumsum(squares[::-1], axis=0)[::-1]] if squares else []
        out: list[list] = [[], [], [], []]
        which = t.column("which").to_numpy()
        for a in ask.tolist() if len(rows) else []:
            found, score = branch_and_bound(columns, rest, ids[rows], [code[a, b] for b in blocks], ids[a], k)
            out[0] += [int(ids[a])] * len(found)
            out[1] += ids[rows[found]].tolist()
            out[2] += [int(s) for s in score]
            out[3] += [int(which[a])] * len(found)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score", "which"), out, strict=True)})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query."""
    asked = quantised(queries, id_col, vec_col).dropDuplicates(["id", "code"])
    there = quantised(candidates, id_col, vec_col)
    parts = partitions(there.sparkSession)
    rows, widest = there.agg(F.count(F.lit(1)), F.max("width")).first()
    most = max(1, COMPONENTS // max(1, widest or 0))
    size = min(most, CANDIDATES[1], max(CANDIDATES[0], rows // (2 * parts)))
    across, down = -(-rows // size) or 1, -(-asked.count() // min(most, QUERIES)) or 1
    deal = lambda n: F.pmod(F.xxhash64("id", F.size("code"), F.get("code", F.lit(0))), F.lit(n))
    cell = (F.col("y") * across + F.col("x")).cast("long").alias("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = (
        asked.withColumn("y", deal(down))
        .withColumn("x", every(across))
        .select("id", "code", "width", F.lit(True).alias("asks"), F.xxhash64("code").alias("which"), cell)
        .unionByName(there.withColumn("x", deal(across)).withColumn("y", every(down)).select("id", "code", "width", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("which"), cell))
    )
    found = grid.groupBy("cell", "width").applyInArrow(search_block(k), "query_id long, vec_id long, score long, which long")
    best = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5)


ORACLE = """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS code
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.code, c.code) AS BIGINT) AS score
  FROM c q JOIN c ON q.vec_id <> c.vec_id AND len(q.code) = len(c.code)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
