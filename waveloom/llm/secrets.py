"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain
(after Cox, "Regular expression matching with a trigram index", 2012). Every batch of documents gets an index
segment: posting lists, as bit vectors over its documents, of the trigrams that any rule asks for. A query
intersects and joins posting lists; only the documents left are verified with the expression itself. A rule
without mandatory trigrams, such as one of letter classes only, scans every document. Index and queries fold
ASCII case, so rules of either case share it; folding only adds candidates.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Sets of strings above this size are given up when a query is derived.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length is tested
    least: int = 1


#: The base kinds, as the contract has them, in its order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Publicly documented credential shapes that the base kinds leave out.
MORE_RULES = (
    Rule("temporary", r"ASIA[A-Z0-9]{16}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)

# A query is True (everything), or ("and", parts), or ("or", parts), where a part is a query or a trigram.


def _trigrams(strings: set[str]):
    """What a text that contains one of the strings must contain."""
    parts = []
    for s in sorted(strings):
        own = sorted({s[i : i + 3] for i in range(len(s) - 2)})
        if not own:
            return True
        parts.append(("and", tuple(own)))
    return parts[0] if len(parts) == 1 else ("or", tuple(dict.fromkeys(parts)))


def _all(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _fold(c: int) -> set[str]:
    return {chr(c).lower()} if c < 128 else set()


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL and arg < 128:
            out |= _fold(arg)
        elif op is C.RANGE and arg[1] < 128 and arg[1] - arg[0] <= MOST_STRINGS:
            out |= {x for c in range(arg[0], arg[1] + 1) for x in _fold(c)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(nodes):
    """(the strings a match can be, or None if they are too many, and a query that holds in that case)."""
    exact: set[str] | None = {""}
    queries = []

    def close():
        nonlocal exact
        if exact is not None:
            queries.append(_trigrams(exact))
        exact = None

    for op, arg in nodes:
        own: set[str] | None = None
        query = True
        if op is C.LITERAL and arg < 128:
            own = _fold(arg)
        elif op is C.IN:
            own = _class(arg)
        elif op is C.SUBPATTERN:
            own, query = _walk(arg[-1])
        elif op is C.BRANCH:
            found = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in found):
                own = set().union(*(s for s, _ in found))
            else:
                query = _any([_trigrams(s) if s is not None else q for s, q in found])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = arg
            s, q = _walk(body)
            if least == 0:
                own = s | {""} if most == 1 and s is not None else None
            elif s is not None and most == least and len(s) ** least <= MOST_STRINGS:
                own = {""}
                for _ in range(least):
                    own = {a + b for a in own for b in s}
            else:
                query = _trigrams(s) if s is not None else q
        elif op is C.AT:
            own = {""}
        if own is None:
            close()
            queries.append(query)
            exact = {""}
        elif len(own) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in own}
        else:
            close()
            exact = own
    if not queries:
        return exact, True
    close()
    return None, _all(queries)


def trigram_query(pattern: str):
    """The Boolean trigram query of a pattern; True if it has no mandatory trigram."""
    exact, query = _walk(_parser.parse(pattern))
    return query if exact is None else _trigrams(exact)


def asked(query) -> set[str]:
    return set() if query is True else set().union(*({p} if isinstance(p, str) else asked(p) for p in query[1]))


@lru_cache(4)
def compiled(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(set(), *(asked(q) for q in queries)))
    codes = np.array([ord(g[0]) << 16 | ord(g[1]) << 8 | ord(g[2]) for g in grams], np.int32)
    slot = np.full(1 << 24, -1, np.int16)
    slot[codes] = np.arange(len(codes))
    return [re.compile(r.pattern, re.ASCII) for r in rules], queries, {g: i for i, g in enumerate(grams)}, slot


def segment(texts: list[bytes], slot: np.ndarray, n_grams: int) -> np.ndarray:
    """Posting lists of an index segment: a bit for each trigram asked for and each document."""
    postings = np.zeros((n_grams, len(texts)), bool)
    if not n_grams:
        return postings
    data = np.frombuffer(b"\0\0".join(texts) + b"\0\0\0", np.uint8)
    ends = np.cumsum([len(t) + 2 for t in texts])
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    for at in range(0, len(data) - 2, 1 << 22):
        part = fold[data[at : at + (1 << 22) + 2]].astype(np.int32)
        got = slot[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
        where = np.flatnonzero(got >= 0)
        postings[got[where], np.searchsorted(ends, where + at, "right")] = True
    return postings


def evaluate(query, postings: np.ndarray, place: dict[str, int]) -> np.ndarray:
    if query is True:
        return np.ones(postings.shape[1], bool)
    parts = [postings[place[p]] if isinstance(p, str) else evaluate(p, postings, place) for p in query[1]]
    return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


def find(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule number, end), by start and then rule; code points, end exclusive."""
    regexes, queries, place, slot = compiled(rules)
    postings = segment([t.encode("utf-8", "surrogatepass") for t in texts], slot, len(place))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, regex, query) in enumerate(zip(rules, regexes, queries)):
        for i in np.flatnonzero(evaluate(query, postings, place)).tolist():
            for m in regex.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    for spans in found:
        spans.sort()
    return found


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, and all spans.

    Null and empty texts have no spans: zero counts, the SHA-256 of nothing, and an empty string. Spans of one kind
    never overlap; spans of different kinds may. Equal starts are ordered by the rules' order. Texts are scanned
    whole. Repeated rows give repeated results; other columns are ignored.
    """
    rules = BASE_RULES + tuple(more)
    base = {r.kind for r in BASE_RULES}

    def run(batches):
        for batch in slices(batches, 1, 1000):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            named = [[(rules[k].kind, s, e) for s, k, e in spans] for spans in find(texts, rules)]
            counts = {kind: [sum(x[0] == kind for x in spans) for spans in named] for kind in base}
            join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(counts[r.kind], pa.int64()) for r in BASE_RULES),
                    pa.array([hashlib.sha256(join([x for x in spans if x[0] in base]).encode()).hexdigest() for spans in named]),
                    pa.array([join(spans) for spans in named], pa.string()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def _sql() -> str:
    """The scan of `documents` as DuckDB SQL: each rule's matches are marked in the text by two private characters, and places counted from those."""
    kinds = []
    for k, r in enumerate(BASE_RULES + MORE_RULES):
        pattern = "'" + r.pattern.replace(r"[^\s", r"[^ \t\n\v\f\r").replace("'", "''") + "'"
        kinds.append(
            f"SELECT r, {k} AS k, '{r.kind}' AS kind, list_sum(list_transform(l[1:e - 1], lambda x: length(x) - 1)) + 1 AS a, split_part(l[e], chr(57345), 1) AS m, length(regexp_extract(split_part(l[e], chr(57345), 1), {pattern}, {r.group})) >= {r.least} AS ok "
            f"FROM (SELECT r, l, unnest(range(2, len(l) + 1)) AS e FROM (SELECT r, string_split(regexp_replace(t, {pattern}, chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) AS l FROM d WHERE regexp_matches(t, {pattern})))"
        )
    n = len(BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE_RULES))
    joined = lambda where: f"coalesce(string_agg(kind || ':' || a::BIGINT || ':' || (a + length(m))::BIGINT, ',' ORDER BY a, k){where}, '')"
    filled = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(kinds)}),
g AS (SELECT r, {counts}, {joined(f" FILTER (k < {n})")} AS base, {joined("")} AS spans FROM f WHERE ok GROUP BY r)
SELECT doc_id, {filled}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


SQL = _sql()
