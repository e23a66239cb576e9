"""Secret scans behind a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
hold. Texts are indexed block by block (trigram to rows, for the trigrams that queries name);
a rule's postings are intersected and united, and only the rows that remain are searched
with the expression itself. A rule without a mandatory trigram searches every row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesets import LOWER, chunks, texts
from .common import every, fresh, table

#: Bytes of text that are indexed at once, about.
BLOCK_BYTES = 4 << 20
#: Strings in a set, and conjunctions in a query, at most; a query that would outgrow this is weakened, never wrong.
MOST_STRINGS, MOST_TERMS = 64, 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` on UTF-8 bytes; a match counts if its group ``group`` has ``least`` bytes or more."""

    kind: str
    pattern: bytes
    least: int = 0
    group: int = 0


#: The kinds of the contract, in its order. A run of 32 or more is the same as a run that is 32 long or longer.
BASE = (
    Rule("assign", rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
    Rule("access", rb"AKIA[A-Z0-9]+", 16),
    Rule("hex", rb"[0-9a-f]{32,}", 32),
)
#: Public formats of further credentials.
MORE = (
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", rb"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", rb"-----BEGIN (?:[A-Z]{2,8} )?PRIVATE KEY-----"),
)
RULES = BASE + MORE

# --- Boolean queries ------------------------------------------------------
# A query is a set of sets of trigrams: one of the inner sets must be there whole. The set of the empty set holds always.

Query = frozenset
ALWAYS: Query = frozenset([frozenset()])


def _least(terms) -> Query:
    """Without conjunctions that another one implies."""
    terms = set(terms)
    return frozenset(t for t in terms if not any(o < t for o in terms))


def _either(a: Query, b: Query) -> Query:
    both = _least(a | b)
    return both if len(both) <= MOST_TERMS else ALWAYS


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_TERMS**2:
        return min(a, b, key=len)
    out = _least(x | y for x, y in product(a, b))
    return out if len(out) <= MOST_TERMS else min(a, b, key=lambda q: (q == ALWAYS, len(q)))


def _holds(strings) -> Query:
    """One of ``strings`` occurs."""
    return _least(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings)


@dataclass(frozen=True)
class _Match:
    """What is known of any match: all its possible texts (or None), its first and last bytes, and a query that it meets."""

    exact: frozenset | None
    first: frozenset
    last: frozenset
    query: Query

    def opened(self) -> _Match:
        """Without the exact texts; what they say moves to the query."""
        if self.exact is None:
            return self
        return _Match(None, self.exact, self.exact, _both(self.query, _holds(self.exact)))._short()

    def _short(self) -> _Match:
        """Ends of two bytes suffice for trigrams across a joint; longer ones are in the query already."""
        query = _both(_both(self.query, _holds(self.first)), _holds(self.last))
        cut = lambda strings, end: (lambda s: s if len(s) <= MOST_STRINGS else frozenset([b""]))(frozenset(s[:2] if end else s[-2:] for s in strings))
        return _Match(None, cut(self.first, True), cut(self.last, False), query)


def _text(strings) -> _Match:
    strings = frozenset(strings)
    return _Match(strings, strings, strings, ALWAYS)


_ANY = _Match(None, frozenset([b""]), frozenset([b""]), ALWAYS)
_EMPTY = _text([b""])


def _joined(a: _Match, b: _Match) -> _Match:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _text(x + y for x, y in product(a.exact, b.exact))
    # ends of an exact side are its whole texts; through them the other side's ends show
    first = frozenset(x + y for x, y in product(a.exact, b.first)) if a.exact is not None and len(a.exact) * len(b.first) <= MOST_STRINGS else a.first
    last = frozenset(x + y for x, y in product(a.last, b.exact)) if b.exact is not None and len(a.last) * len(b.exact) <= MOST_STRINGS else b.last
    query = _both(a.opened().query, b.opened().query)
    if len(a.last) * len(b.first) <= MOST_STRINGS:
        query = _both(query, _holds(x + y for x, y in product(a.last, b.first)))
    return _Match(None, first, last, query)._short()


def _one_of(a: _Match, b: _Match) -> _Match:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return _text(a.exact | b.exact)
    a, b = a.opened(), b.opened()
    return _Match(None, a.first | b.first, a.last | b.last, _either(a.query, b.query))._short()


def _folded(byte: int) -> bytes:
    return bytes([LOWER[byte]])


def _of_class(items) -> _Match:
    members: set[bytes] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            members.add(_folded(value))
        elif str(op) == "RANGE" and value[1] - value[0] < 8:
            members |= {_folded(c) for c in range(value[0], value[1] + 1)}
        else:
            return _ANY
    return _text(members) if len(members) <= 8 else _ANY


def _of_node(op: str, value) -> _Match:
    if op == "LITERAL":
        return _text([_folded(value)])
    if op == "IN":
        return _of_class(value)
    if op == "SUBPATTERN":
        return _of_sequence(value[3])
    if op == "BRANCH":
        first, *rest = map(_of_sequence, value[1])
        for x in rest:
            first = _one_of(first, x)
        return first
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, body = value
        if not low:
            return _one_of(_EMPTY, _of_sequence(body)) if high == 1 else _ANY
        once = _of_sequence(body)
        return once if high == 1 else once.opened()
    if op in ("AT", "ASSERT", "ASSERT_NOT"):
        return _EMPTY
    return _ANY


def _of_sequence(nodes) -> _Match:
    out = _EMPTY
    for op, value in nodes:
        out = _joined(out, _of_node(str(op), value))
    return out


def trigram_query(pattern: bytes) -> Query:
    """Trigrams of ASCII-lower-case text, as a set of conjunctions, one of which every match of ``pattern`` holds."""
    return _of_sequence(re._parser.parse(pattern)).opened().query


# --- index and search -----------------------------------------------------


class Index:
    """Trigram to the sorted rows of a block that hold it, for the trigrams in ``grams``."""

    def __init__(self, grams: list[bytes], slots: np.ndarray, codes: np.ndarray, offsets: np.ndarray):
        low = LOWER[codes].astype(np.int32)
        self.rows: dict[bytes, np.ndarray] = {g: np.zeros(0, np.int64) for g in grams}
        if len(low) < 3:
            return
        slot = slots[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(slot)
        row = np.searchsorted(offsets, at, side="right") - 1
        whole = at + 3 <= offsets[row + 1]  # a trigram does not cross texts
        pairs = np.unique(slot[at][whole].astype(np.int64) * len(offsets) + row[whole])
        which, where = np.divmod(pairs, len(offsets))
        for k, part in zip(*_runs(which)):
            self.rows[grams[k - 1]] = where[part]

    def candidates(self, query: Query) -> np.ndarray:
        """Rows that meet ``query``."""
        found = []
        for grams in query:
            lists = sorted((self.rows[g] for g in grams), key=len)
            hit = lists[0]
            for more in lists[1:]:
                hit = np.intersect1d(hit, more, assume_unique=True)
            found.append(hit)
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _runs(values: np.ndarray) -> tuple[list[int], list[slice]]:
    """Distinct values of a sorted array and where each stands."""
    kinds, starts = np.unique(values, return_index=True)
    ends = [*starts[1:].tolist(), len(values)]
    return kinds.tolist(), [slice(a, b) for a, b in zip(starts.tolist(), ends)]


@lru_cache(maxsize=4)
def _prepared(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for term in q for g in term})
    slots = np.zeros(1 << 24, np.uint16)
    for k, g in enumerate(grams, 1):
        slots[int.from_bytes(g, "big")] = k
    return [re.compile(r.pattern) for r in rules], queries, grams, slots


def _found(rules: tuple[Rule, ...], codes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(row, start, rule, end)`` of every span in a block of texts, in bytes from the block's start, sorted."""
    patterns, queries, grams, slots = _prepared(rules)
    index, blob, out = Index(grams, slots, codes, offsets), codes.tobytes(), []
    for k, (rule, pattern, query) in enumerate(zip(rules, patterns, queries)):
        for row in range(len(offsets) - 1) if query == ALWAYS else index.candidates(query).tolist():
            for m in pattern.finditer(blob, offsets[row], offsets[row + 1]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out.append((row, m.start(), k, m.end()))
    return sorted(out)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) and ``secret_spans``, an array of ``(kind, start, end, value)``:
    code points, end exclusive, by start and then by the order of the rules. A clashing name gets underscores in front.

    Every row gives one row, whatever repeats; a null or empty text has no spans. Matches of one rule do
    not overlap, and are leftmost; those of different rules may overlap. The whole text is
    searched, in blocks of whole texts of some ``BLOCK_BYTES``; a longer text is a block of its own. Nothing
    is shuffled, and an empty table gives an empty result.
    """
    mark, wide = fresh(docs, "secret_spans", "secret_text")
    kept = docs.select(*[F.col(f"`{c}`") for c in keep]) if keep is not None else docs
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())]))
    schema, n = T.StructType([*kept.schema.fields, T.StructField(mark, span)]), len(kept.columns)
    kinds, names = [r.kind for r in rules], [*kept.columns, mark]

    def scan(batches):
        for batch in batches:
            codes, offsets = texts(batch.column(n))
            for a, b in chunks(offsets, BLOCK_BYTES):
                block, ends = codes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                spans: list[list] = [[] for _ in range(b - a)]
                last, points = -1, None
                for row, start, k, end in _found(rules, block, ends):
                    if row != last:
                        last, points = row, np.concatenate([[0], np.cumsum((block[ends[row] : ends[row + 1]] & 0xC0) != 0x80)])
                    s, e = start - ends[row], end - ends[row]
                    spans[row].append({"kind": kinds[k], "start": int(points[s]), "end": int(points[e]), "value": block[start:end].tobytes().decode("utf-8", "replace")})
                columns = [batch.column(k).slice(a, b - a) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, _SPANS)], names)

    return docs.select(*every(kept), F.col(f"`{text}`").cast("string").alias(wide)).mapInArrow(scan, schema)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    of = lambda *kinds: F.filter("secret_spans", lambda s: s["kind"].isin(*kinds))
    base = of(*[r.kind for r in BASE])
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


def _sql_kind(k: int, kind: str, pattern: str, least: int, group: int) -> str:
    """Spans of a kind: the pieces between matches and the matches, laid end to end, give their places."""
    p = pattern.replace("'", "''")
    return f"""SELECT r, {k} AS k, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
             a := list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), n := length(m[i]), g := length(v[i])))) AS x
             FROM (SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS s FROM d)
             WHERE len(m) > 0"""


_EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
#: The rules again, as DuckDB writes them.
_SQL_RULES = [
    ("assign", _EITHER + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
    ("access", "AKIA[A-Z0-9]+", 16, 0),
    ("hex", "[0-9a-f]{32,}", 32, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("google", "AIza[0-9A-Za-z_-]{35}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("pem", "-----BEGIN (?:[A-Z]{2,8} )?PRIVATE KEY-----", 0, 0),
]
SQL_OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
     f AS (SELECT r, k, kind, x.a AS a, x.a + x.n AS b FROM ({" UNION ALL ".join(f"SELECT * FROM ({_sql_kind(k, *rule)}) WHERE x.g >= {rule[2]}" for k, rule in enumerate(_SQL_RULES))})),
     g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base,
                  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
