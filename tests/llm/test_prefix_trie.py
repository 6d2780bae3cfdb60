import hashlib
import random
import zlib

import duckdb
import pytest

from tracespark.llm import op12_prefix_trie as op12

SCHEMA = "conv_id long, turn long, role string, text string, depth string, digest string, parent string, points string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "x", "p", "n") for r in rows], SCHEMA)


def brute(rows):
    """Nodes by whole sequences of turns."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = {}
    for c, w in whole.items():
        for d in range(len(w) + 1):
            members.setdefault(w[:d], []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own_saved = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        leaves[k] = sum(leaves[x] for x in children.get(k, [])) or 1
        saved[k] = own_saved + sum(saved[x] for x in children.get(k, []))
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if whole[c] == k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(df):
    return [tuple(r) for r in df.select(*FIELDS).collect()]


def check(spark, rows):
    assert sorted(nodes(op12.trie(frame(spark, rows))), key=repr) == sorted(brute(rows), key=repr)


def conversations(seed, n=130, depth=14):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 350), n):
        for turn in range(rng.randint(1, depth)):
            rows.append((c, turn, ("user", "assistant")[turn % 2], "Hällo" if rng.random() < 0.8 else rng.choice("abc")))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    check(spark, conversations(1))


@pytest.mark.parametrize("span", [2, 3])
def test_many_spans_and_small_pieces(spark, monkeypatch, span):
    monkeypatch.setattr(op12, "SPAN", span)
    monkeypatch.setattr(op12, "PIECE", 2)
    monkeypatch.setattr(op12, "HOT_LEAST", 1)
    check(spark, conversations(2, 60, 40))


def test_deep_shared_conversation(spark):
    """Two copies of 700 turns and one that leaves them halfway: three levels of sums."""
    rows = [(c, t, "user", f"t{t % 7}") for c in (100, 200) for t in range(700)] + [(300, t, "user", f"t{t % 7}" if t < 350 else "other") for t in range(360)]
    check(spark, rows)


def test_group_of_copies(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 30_000, 100) for t in range(4)] + [(1, 0, "user", "x")]
    check(spark, rows)


def test_odd_tables(spark):
    rows = [(None, 1, "user", "lost"), (0, None, None, None), (0, 1, "user", None), (0, 1, "user", "b"), (0, 1, "user", "b"), (0, 2, None, "x" * 40_000), (7, None, "", ""), (7, 3, "user", ""), (205, 0, "user", "base is absent"), (1, -5, "a", "é𝄞"), (100, 0, "user", "only")]
    check(spark, rows)
    assert op12.trie(frame(spark, [])).count() == 0 and op12.trie(frame(spark, [(None, 1, "a", "b")])).count() == 0
    check(spark, [(5, 0, "user", "alone")])


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    cursor = con.execute(op12.ORACLE)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(FIELDS)
    want = [tuple(dict(zip(names, r, strict=True))[f] for f in FIELDS) for r in cursor.fetchall()]
    assert sorted(nodes(op12.query(spark, sf)), key=repr) == sorted(want, key=repr)
