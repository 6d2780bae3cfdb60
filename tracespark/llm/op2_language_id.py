"""Language identification by hierarchical discrimination.

A text becomes the square roots of its hashed letter-trigram shares. Linear support vector
machines, one against one, first decide the language family; within the family another set of
one-against-one machines separates the related languages.

The machines are fitted on the driver from a bounded sample: SAMPLE labelled texts at most, the same
number of each language, chosen by a 64-bit hash of the id of which so small a range is read that about twice
the sample reaches the driver, whatever the table's size. Every text is scored whole, where it lies:
the trained weights (classes x DIM numbers) are broadcast and nothing is shuffled.

Defined cases: a null text or one without a letter is `und` with score 0; rows without a
language are not learned from; with one learned language it is always predicted, with none
every text is `und`; a null id counts as the empty string in the split; ties go to the class
that sorts first; further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, table
from .textnp import chunks, release

#: Most texts that the machines are fitted on.
SAMPLE = 4000
#: Numbers that a text becomes.
DIM = 2048
UND = "und"
#: Families of language codes; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi".split(),
    "romance": "an ca co es fr gl it la lmo oc pt rm ro sc scn".split(),
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk".split(),
    "turkic": "az ba kk ky tk tr tt ug uz".split(),
    "indic": "as bn gu hi mr ne or pa sa si ur".split(),
    "uralic": "et fi hu se".split(),
    "semitic": "am ar he mt".split(),
    "austronesian": "id jv mg mi ms su tl".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
LETTER = np.zeros(256, dtype=np.uint32)
LETTER[128:] = np.arange(128, 256)
LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def features(column: pa.Array) -> np.ndarray:
    """One row of DIM numbers of unit length for each text; zeros where there is no trigram."""
    out = np.zeros((len(column), DIM), dtype=np.float32)
    for i, _, data, at in chunks(pc.utf8_lower(column.cast(pa.string()))):
        b = LETTER[data]
        if len(b) < 3:
            continue
        code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM.bit_length() + 1)
        for k in range(len(at) - 1):
            if at[k + 1] - at[k] > 2:
                out[i + k] = np.bincount(code[at[k] : at[k + 1] - 2], minlength=DIM)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def has_letter(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), dtype=bool)
    for i, t in enumerate(column.to_pylist()):
        out[i] = t is not None and any(map(str.isalpha, t))
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by dual coordinate descent;
    y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = (x * x).sum(axis=1) + 0.5 / cost
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class OneVersusOne:
    """A machine for each pair of classes; the most votes win, then the largest margins."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(itertools.combinations(range(len(self.classes)), 2))
        names = np.array(self.classes)
        self.w = np.array([self._fit(x, labels, names[a], names[b]) for a, b in self.pairs]).reshape(len(self.pairs), x.shape[1] + 1)

    @staticmethod
    def _fit(x, labels, a, b):
        of = (labels == a) | (labels == b)
        return fit_svm(x[of], np.where(labels[of] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers, and the winner's least confidence against any other class."""
        if not self.pairs:
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        margin = x @ self.w[:, :-1].T + self.w[:, -1]
        votes = np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(self.pairs):
            soft = np.tanh(margin[:, k]) * 1e-3
            votes[:, a] += (margin[:, k] >= 0) + soft
            votes[:, b] += (margin[:, k] < 0) - soft
        best = votes.argmax(axis=1)
        least = np.full(len(x), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            least = np.where(best == a, np.minimum(least, margin[:, k]), np.where(best == b, np.minimum(least, -margin[:, k]), least))
        return best, 1 / (1 + np.exp(-4 * np.clip(least, -50, 50)))


class Hierarchy:
    """Families first, then the languages of each family."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        families = np.array([FAMILY_OF.get(s, s) for s in langs.tolist()], dtype=object)
        self.top = OneVersusOne(x, families)
        self.within = [OneVersusOne(x[families == f], langs[families == f]) for f in self.top.classes]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, score = self.top.predict(x)
        lang = np.empty(len(x), dtype=object)
        for k, machine in enumerate(self.within):
            if len(of := np.flatnonzero(family == k)):
                best, sure = machine.predict(x[of])
                lang[of] = np.array(machine.classes, dtype=object)[best]
                score[of] = score[of] * sure
        return lang, score


def split(id_col, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(n))


def drawn_below(share: float) -> int:
    """The bound under which a 64-bit hash falls with this probability."""
    return -(2**63) + min(2**64 - 1, int(share * 2**64))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", sample: int = SAMPLE) -> Hierarchy | None:
    """A hierarchy from at most `sample` of the labelled rows."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("lid"), order_col).alias("draw"))
    there = {r.lang: r["count"] for r in docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count().collect()}
    if not there:
        return None
    each = max(1, sample // len(there))
    share = F.create_map(*[F.lit(v) for k, n in there.items() for v in (k, drawn_below((2 * each + 50) / n))])
    drawn = batches(labelled.filter(F.col("draw") <= share[F.col("lang")]))

    def run(batches_in):
        for b in batches_in:
            x = features(b.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("draw"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "draw", "x"])

    rows = sorted(map(tuple, drawn.mapInArrow(run, "lang string, draw long, x binary").collect()), key=lambda r: (r[0], r[1], r[2]))
    rows = [r for _, g in itertools.groupby(rows, key=lambda r: r[0]) for r in itertools.islice(g, each)]
    if not rows:
        return None
    x = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.float16).reshape(len(rows), DIM).astype(np.float32)
    return Hierarchy(x, np.array([r[0] for r in rows], dtype=object))


def predict(docs: DataFrame, model: Hierarchy | None, text_col: str = "text") -> DataFrame:
    """The rows of docs as struct `row`, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches_in):
        for b in batches_in:
            text, model = b.column("__text"), shared.value
            lang, score = np.full(len(text), UND, dtype=object), np.zeros(len(text))
            of = np.flatnonzero(has_letter(text))
            if model is not None and len(of):
                lang[of], score[of] = model.predict(features(text.take(pa.array(of))))
            keep = [c for c in b.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(lang.tolist(), pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])
        release()

    source = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("__text"))
    schema = source.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return batches(source).mapInArrow(run, schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(split("doc_id", 4) != 2))
    narrow = docs.select("doc_id", "text", (split("doc_id", 4) == 2).alias("held_out"))
    shared = predict(narrow.select("doc_id", "held_out", "text"), model)
    return shared.select("row.doc_id", "row.held_out", "lang_pred", "score")
