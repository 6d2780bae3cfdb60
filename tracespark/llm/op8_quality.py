"""Quality classification by regularised quadratic discriminant analysis.

A text becomes transformed statistics of its whole bytes and words. Each class has a
mean and a covariance shrunk towards its diagonal; the score is the logistic of the difference of the
two Gaussian log densities (with the classes' shares), through Cholesky factors that are
computed once.

Fitted on the driver from a bounded sample: SAMPLE labelled texts at most, half of each class, by a
hash of the id of which about twice the sample reaches the driver. Every text is scored where it lies; nothing but the sample moves.

Defined cases: null and empty texts have statistics of zero and get a score like any other; labels
other than 0 and 1 are not learned from; with labels of one class only, or none, the score is that
class, or 0.5; repeated rows of one id and label count once, and so do documents of one id in the sample (the
least text), so that the sample is bounded however often an id occurs; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, table
from .op2_language_id import drawn_below, split
from .textnp import chunks, prefix_sums, release, spans_hash, words

#: Most texts that the classifier is fitted on.
SAMPLE = 8000
#: Share of the diagonal in each covariance.
SHRINK = 0.2
UPPER, DIGIT, LETTER, MARK, PLAIN = (np.zeros(256, dtype=bool) for _ in range(5))
UPPER[65:91] = True
DIGIT[48:58] = True
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
MARK[[*b"!#$%&*+/<=>@[\\]^_`{|}~"]] = True
PLAIN[[*b".,;:?'\"()-"]] = True
NAMES = ["words", "word_length", "spread", "unique", "most", "again", "again5", "upper", "digit", "mark", "plain", "letter", "lines", "line_again", "marked_words"]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text."""
    out = np.zeros((len(column), len(NAMES)))
    for i, _, data, at in chunks(column):
        start, end, first = words(data, at)
        sums = prefix_sums(data)
        h = spans_hash(sums, start, end)
        length = (end - start).astype(np.float64)
        kinds = np.vstack([np.concatenate([[0], np.cumsum(kind[data])]) for kind in (UPPER, DIGIT, LETTER, MARK, PLAIN)])
        last_mark = MARK[data[end - 1]] if len(end) else np.zeros(0, bool)
        feeds = np.flatnonzero(data == 10)
        for k in range(len(at) - 1):
            a, b = first[k], first[k + 1]
            n, size = b - a, at[k + 1] - at[k]
            if not n:
                continue
            own, long = h[a:b], length[a:b]
            _, counts = np.unique(own, return_counts=True)
            upper, digit, letter, mark, plain = kinds[:, at[k + 1]] - kinds[:, at[k]]
            five = own[4:] + own[3:-1] * np.uint64(3) + own[2:-2] * np.uint64(5) + own[1:-3] * np.uint64(7) + own[:-4] * np.uint64(11)
            cuts = np.concatenate([[at[k]], feeds[np.searchsorted(feeds, at[k]) : np.searchsorted(feeds, at[k + 1])] + 1, [at[k + 1]]])
            lines = spans_hash(sums, cuts[:-1], cuts[1:])
            out[i + k] = (
                np.log1p(n),
                np.log(long.mean()),
                np.log1p(long.std()),
                len(counts) / n**0.8,
                np.sqrt(counts.max() / n),
                np.sqrt((own[1:] == own[:-1]).mean()) if n > 1 else 0,
                np.sqrt(1 - len(np.unique(five)) / len(five)) if n > 4 else 0,
                np.sqrt(upper / max(letter, 1)),
                np.sqrt(digit / size),
                np.sqrt(mark / size),
                np.sqrt(plain / size),
                letter / size,
                np.log1p(len(lines)),
                np.sqrt(1 - len(np.unique(lines)) / len(lines)),
                np.sqrt(last_mark[a:b].mean()),
            )
    return out


class Discriminant:
    def __init__(self, x: np.ndarray, y: np.ndarray, share: float):
        self.share, self.one = share, None
        if len(set(y.tolist())) < 2:
            self.one = float(y[0]) if len(y) else 0.5
            return
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.centre) / self.scale
        self.mean, self.root, self.log_det = [], [], []
        for c in (0, 1):
            own = z[y == c]
            spread = np.cov(own, rowvar=False) if len(own) > 1 else np.eye(x.shape[1])
            spread = (1 - SHRINK) * spread + SHRINK * np.diag(np.diag(spread)) + 1e-2 * np.eye(x.shape[1])
            factor = np.linalg.cholesky(spread)
            self.mean.append(own.mean(axis=0))
            self.root.append(np.linalg.inv(factor))
            self.log_det.append(2 * np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.one is not None:
            return np.full(len(x), self.one)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ r.T) ** 2).sum(axis=1) - 0.5 * d for m, r, d in zip(self.mean, self.root, self.log_det, strict=True)]
        odds = density[1] - density[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Discriminant:
    """A classifier from at most `sample` labelled texts. labels: id and label."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).distinct()
    there = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    if not there:
        return Discriminant(np.zeros((0, len(NAMES))), np.zeros(0), 0.5)
    most = sample // 2
    share = F.create_map(*[F.lit(v) for y, n in there.items() for v in (int(y), drawn_below((2 * most + 50) / n))])
    draw = F.xxhash64(F.lit("quality"), "id")
    ids = marked.filter(draw <= share[F.col("y").cast("int")]).withColumn("draw", draw)  # about 2 * sample, of any table
    drawn = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").groupBy("id", "y", "draw").agg(F.min("text").alias("text"))

    def run(batches_in):
        for b in batches_in:
            yield pa.RecordBatch.from_arrays([b.column("draw"), b.column("id"), b.column("y").cast(pa.int32()), pa.array(statistics(b.column("text")).tolist(), pa.list_(pa.float64()))], ["draw", "id", "y", "x"])

    rows = sorted(map(tuple, batches(drawn).mapInArrow(run, "draw long, id long, y int, x array<double>").collect()), key=lambda r: r[:3])
    rows = [r for c in (0, 1) for r in [r for r in rows if r[2] == c][:most]]
    return Discriminant(np.array([r[3] for r in rows]).reshape(len(rows), len(NAMES)), np.array([r[2] for r in rows]), there.get(1, 0) / sum(there.values()))


def classify(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches_in):
        for b in batches_in:
            score = shared.value.score(statistics(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])
        release()

    return batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.select("doc_id", "text"), labels.filter(split("doc_id", 3) != 1))
    return classify(docs, model).select("doc_id", (split("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
