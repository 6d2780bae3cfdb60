"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

Pieces of text (matches of the splitting pattern) become rows of token ids, one per byte, in
matrices of similar lengths. In each round every row merges its leftmost pair of least rank; pair
ranks come from an open-addressing hash table, finished rows leave the matrix and the others lose
a column. A piece that is itself in the vocabulary is one token, as in the tiktoken library.

Texts are cut first at white space, where the pattern always cuts, and the encodings of the cut
strings are kept in a dictionary of at most KEPT short strings, so that a frequent word is merged once per worker.
Pieces longer than LONG bytes are merged with a heap in O(n log n): the same merges in the same
order, without a matrix that is as wide as the piece is long.

Defined cases: a null text is an empty one and has no token; special tokens are never
produced; further columns are ignored; rows are independent, so repeated rows give equal results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, table
from .textnp import chunks, release

#: Bytes of the widest matrix; longer pieces take the heap.
LONG = 1024
#: Encodings kept by a worker before it starts afresh, and the characters of the longest string that is kept.
KEPT, KEPT_LENGTH = 300_000, 48
#: Texts, and bytes of text, taken together, so that a matrix has many rows.
STEP, BYTES = 512, 4 << 20
NONE = np.int32(2**31 - 1)
#: White space by the Unicode property, as the pattern's \s has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CUT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Ranks of a tiktoken file: the tokens' bytes and the hash table of mergeable pairs."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern, self.ranks = pattern, ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.names = {v: str(v) for v in self.bytes}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, ids = [], []
        for whole, rank in ranks.items():
            for i in range(1, len(whole)):
                if (a := ranks.get(whole[:i])) is not None and (b := ranks.get(whole[i:])) is not None:
                    keys.append(a << 32 | b)
                    ids.append(rank)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ids = np.full(1 << self.bits, NONE, dtype=np.int32)
        todo = np.arange(len(keys))
        keys, ids = np.array(keys, dtype=np.int64), np.array(ids, dtype=np.int32)
        at = self._slot(keys)
        while len(todo):
            free = self.keys[at[todo]] == -1
            slots, first = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slots], self.ids[slots] = keys[placed], ids[placed]
            todo = todo[~np.isin(todo, placed)]
            at[todo] = np.where(self.keys[at[todo]] == -1, at[todo], (at[todo] + 1) & (len(self.keys) - 1))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge."""
        keys = ((left.astype(np.int64) << 32) | right).ravel()
        at, out = self._slot(keys), np.full(keys.size, NONE, dtype=np.int32)
        todo = np.flatnonzero(keys >= 0)
        while len(todo):
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.ids[at[todo[hit]]]
            todo = todo[~hit & (there != -1)]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return out.reshape(left.shape)

    def merge_matrix(self, rows: np.ndarray) -> list[list[int]]:
        """rows: ids padded with -1; the ids of each row after its last merge."""
        done: list = [None] * len(rows)
        number = np.arange(len(rows))
        while len(rows):
            if rows.shape[1] > 1:
                ranks = self.pairs(rows[:, :-1], rows[:, 1:])
                ranks[rows[:, 1:] < 0] = NONE
                where = ranks.argmin(axis=1)
                least = ranks[np.arange(len(rows)), where]
            else:
                least, where = np.full(len(rows), NONE), None
            over = least == NONE
            ready = rows[over]
            ids, end = ready[ready >= 0].tolist(), 0
            for i, n in zip(number[over].tolist(), (ready >= 0).sum(axis=1).tolist(), strict=True):
                done[i] = ids[end : end + n]
                end += n
            if over.all():
                break
            rows, number, where, least = rows[~over], number[~over], where[~over], least[~over]
            rows = np.where(np.arange(rows.shape[1] - 1) <= where[:, None], rows[:, :-1], rows[:, 1:])
            rows[np.arange(len(rows)), where] = least
            used = int((rows >= 0).sum(axis=1).max())
            rows = rows[:, :used]
        return done

    def merge_long(self, piece: bytes) -> list[int]:
        ids = self.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda a, b: self.ranks.get(self.bytes[a] + self.bytes[b])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := rank(ids[x], ids[y])) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        widths: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = [whole]
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            else:
                widths.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, members in widths.items():
            step = max(1, (1 << 20) // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                lens = np.array([len(pieces[i]) for i in part])
                rows = np.full((len(part), int(lens.max())), -1, dtype=np.int32)
                rows[np.arange(rows.shape[1]) < lens[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces[i] for i in part), dtype=np.uint8)]
                for i, ids in zip(part, self.merge_matrix(rows), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Encoder:
    """Encodes texts with a bounded memory of strings seen before: string to (ids joined by
    commas, number of ids, decoded bytes)."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.split, self.known = vocabulary, regex.compile(vocabulary.pattern), {}

    def learn(self, strings: list[str]) -> None:
        word = lambda s: s.isascii() and s[s[0] == " " :].isalpha()  # one match of the pattern
        pieces = [[s] if word(s) else self.split.findall(s) for s in strings]
        flat = self.v.encode_pieces([p.encode() for ps in pieces for p in ps])
        at = 0
        names, parts = self.v.names.__getitem__, self.v.bytes.__getitem__
        for s, ps in zip(strings, pieces, strict=True):
            ids = flat[at] if len(ps) == 1 else [x for a in flat[at : at + len(ps)] for x in a]
            at += len(ps)
            self.known[s] = (",".join(map(names, ids)), len(ids), b"".join(map(parts, ids)))

    def texts(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        if len(self.known) > KEPT:
            self.known.clear()
        cut = [CUT.findall(t) for t in texts]
        new = set().union(*cut) - self.known.keys() if cut else set()
        if new:
            self.learn(sorted(new))
        out = [[self.known[s] for s in c] for c in cut]
        for s in new:
            if len(s) > KEPT_LENGTH:
                del self.known[s]
        return out


_ENCODERS: dict = {}


def encoder(shared) -> Encoder:
    """One encoder to a worker and broadcast."""
    if shared.value is not (_ENCODERS.get("of")):
        _ENCODERS.update(of=shared.value, encoder=Encoder(shared.value))
    return _ENCODERS["encoder"]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int), decoded (binary)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))  # its size is the vocabulary's

    def run(batches_in):
        for b in batches_in:
            for i, j, _, _ in chunks(b.column("text"), BYTES):
                part = b.slice(i, j - i)
                found = encoder(shared).texts([t or "" for t in part.column("text").to_pylist()])
                ids = [[int(x) for s in f if s[1] for x in s[0].split(",")] for f in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([b"".join(s[2] for s in f) for f in found], pa.binary())], ["doc_id", "ids", "decoded"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))

    def run(batches_in):
        for b in batches_in:
            counts, ids, decoded = [], [], []
            for i, j, _, _ in chunks(b.column("text"), BYTES):
                for f in encoder(shared).texts([t or "" for t in b.column("text").slice(i, j - i).to_pylist()]):
                    counts.append(sum([s[1] for s in f]))
                    ids.append(hashlib.sha256(",".join([s[0] for s in f]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join([s[2] for s in f])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return _narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _narrow(docs, id_col, text_col):
    return batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), STEP)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), *public_vocabulary())
