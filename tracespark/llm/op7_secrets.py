"""Secret scanning over a trigram inverted index (DataFrame functions only).

Every rule's regular expression is taken apart into a Boolean query over trigrams that each of its
matches must hold. The index has a posting (trigram, document) for every trigram of these
queries; postings are intersected and united by a bit mask for each document, and the rules
are verified on their candidates alone. A rule without a mandatory trigram scans every text.

Matching is native: the texts between matches and the matches themselves, summed up, give the
offsets in code points.

Defined cases: a null text is empty and has no span; a null id is one of its own; rows of equal id and
text share postings; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

MANY = 64  #: strings followed at once when a pattern is taken apart


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern (in the syntax that Java and Python share), the group whose
    length counts, and the least length of that group in code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds of the contract, in its order; then those that the scanner adds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED
#: Quicker patterns that have the same matches of sufficient length.
QUICK = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


# Boolean trigram queries: True, a trigram, or ("and" | "or", frozenset of queries).


def both(*queries):
    flat = frozenset(x for q in queries if q is not True for x in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q]))
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", flat)


def either(*queries):
    if any(q is True for q in queries):
        return True
    flat = {x for q in queries for x in (q[1] if isinstance(q, tuple) and q[0] == "or" else [q])}
    parts = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in flat}
    flat = frozenset(q for q in flat if not any(other < parts[q] for other in parts.values()))  # the weaker covers the stronger
    return next(iter(flat)) if len(flat) == 1 else ("or", flat)


def of_strings(strings: set[str]):
    """What holds if one of these strings occurs."""
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings)) if strings else True


def join(left: set[str], right: set[str]) -> set[str] | None:
    out = {a + b for a in left for b in right}
    return out if len(out) <= MANY else None


def take_apart(items) -> tuple[set[str] | None, object]:
    """(the exact strings that the items match, if few; else a query that holds of any match)."""
    query, run = True, {""}  # run: strings one of which ends where we are
    exact = True
    for op, arg in items:
        known, needs = None, True
        if op is C.LITERAL:
            known = {chr(arg).lower()}
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 8:
            known = {chr(v).lower() for _, v in arg}
        elif op is C.SUBPATTERN:
            known, needs = take_apart(arg[-1])
        elif op is C.BRANCH:
            parts = [take_apart(p) for p in arg[1]]
            if all(k is not None for k, _ in parts):
                known = set().union(*(k for k, _ in parts))
            needs = either(*(of_strings(k) if k is not None else n for k, n in parts))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            k, n = take_apart(inner)
            if (low, high) == (0, 1) and k is not None:
                known = k | {""}
            elif low == high and low <= 8 and k is not None:
                known = {""}
                for _ in range(low):
                    known = known and join(known, k)
            elif low:
                needs = of_strings(k) if k is not None else n
        elif op is C.AT:
            known = {""}
        whole = join(run, known) if known is not None and len(known) <= MANY else None
        if whole is not None:
            run = whole
        else:
            query, exact = both(query, of_strings(run), of_strings(known) if known is not None else needs), False
            run = known if known is not None and len(known) <= MANY else {""}
    return (run, True) if exact else (None, both(query, of_strings(run)))


def trigram_query(pattern: str):
    """The Boolean query of a pattern over lower-case trigrams; True if it has no mandatory one."""
    exact, query = take_apart(parser.parse(pattern))
    return of_strings(exact) if exact is not None else query


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def holds(query, has) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return has(query)
    parts = [holds(q, has) for q in sorted(query[1], key=str)]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


def postings(docs: DataFrame, words: list[str]) -> DataFrame:
    """The index: (trigram, d, t), a posting for each of these trigrams that a text holds."""
    low = docs.select("d", "t", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(w)), F.lit(i)) for i, w in enumerate(words)]))
    return low.select("d", "t", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, words: list[str], queries: dict[str, object]) -> DataFrame:
    """(d, t, rules): the documents whose postings satisfy a rule's query, as a bit mask of rules."""
    width = 60  # bits of a mask
    n = -(-len(words) // width) or 1
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(width)])
    masks = [F.bit_or(F.when(F.floor(F.col("trigram") / width) == k, F.get(bits, F.col("trigram") % width)).otherwise(F.lit(0).cast("long"))).alias(f"mask{k}") for k in range(n)]
    has = lambda w: F.col(f"mask{words.index(w) // width}").bitwiseAND(F.lit(1 << (words.index(w) % width))) != 0
    rules = sum((F.when(holds(q, has), 1 << i).otherwise(0) for i, q in enumerate(queries.values()) if q is not True), F.lit(0))
    return index.groupBy("d", "t").agg(*masks).select("d", "t", rules.cast("int").alias("rules")).filter("rules != 0")


def spans(text: Column, rule: Rule, number: int, when: Column) -> Column:
    """Array of (start, kind number, end) of a rule's matches, in code points."""
    pattern = F.lit(QUICK.get(rule.kind, rule.pattern))
    found = F.when(when, F.regexp_extract_all(text, pattern, F.lit(0)))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    between = F.split(text, QUICK.get(rule.kind, rule.pattern), -1)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        mine = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(acc["out"], mine)).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("m"), counted.alias("g"))
    summed = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(F.size(found) > 0, summed).otherwise(empty)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, and found, an array of (start, kind number in RULES, end)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "t": F.xxhash64("text")})
    queries = {r.kind: trigram_query(r.pattern) for r in RULES}
    words = sorted(set().union(*map(trigrams, queries.values())))
    marked = candidates(postings(rows, words), words, queries)
    both_ = rows.join(marked, ["d", "t"], "left").select("doc_id", "text", F.coalesce("rules", F.lit(0)).alias("rules"))
    found = []
    for i, rule in enumerate(RULES):
        when = F.lit(True) if queries[rule.kind] is True else F.col("rules").bitwiseAND(F.lit(1 << i)) != 0
        found.append(spans(F.col("text"), rule, i, when))
    return both_.select("doc_id", F.sort_array(F.concat(*found)).alias("found"))


def written(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{RULES[k].kind}")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *map(count, range(len(BASE))), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def _sql(rule: Rule, n: int) -> str:
    """Matches of a rule as (start, n, end), in DuckDB."""
    p = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {n} AS n, unnest(range(1, len(m) + 1)) AS i, m, g, b FROM (
      SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {rule.group}) AS g, string_split_regex(text, '{p}') AS b FROM d)
      WHERE len(m) > 0"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(_sql(r, i) for i, r in enumerate(RULES))}),
placed AS (
  SELECT doc_id, n, length(g[i]) AS counted, length(m[i]) AS long,
         coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM raw
),
s AS (
  SELECT doc_id, n, start, [{", ".join(f"'{r.kind}'" for r in RULES)}][n + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(start + long AS BIGINT) AS span
  FROM placed WHERE counted >= [{", ".join(str(r.least) for r in RULES)}][n + 1]
),
a AS (
  SELECT doc_id, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, n) FILTER (n < 3) AS base, string_agg(span, ',' ORDER BY start, n) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
