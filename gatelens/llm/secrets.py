"""Secret scan over a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams that every match must contain. Documents are
indexed in segments (a few hundred documents of a task each): the postings of the rules' trigrams are read off the
segment's bytes at once, queries intersect and unite postings, and only candidate documents are verified with the
regular expression. A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _parser as regex_tree          # the parse tree of the standard library's regular expressions

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import slices

MAX_EXACT = 64        # alternatives kept as whole strings while a query is derived; more become "anything"
ANY = ("and",)        # the query that every document satisfies


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``min_chars`` are dropped."""

    kind: str
    pattern: str
    min_chars: int = 1
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# fixed values: the base kinds of the contract
BASE_RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 18),
    SecretRule("hex", r"[0-9a-f]{16,}"),       # the maximal runs of 16 or more
)
# fixed values: published formats of issued credentials
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,128}@"),
)


def _strings_query(strings: frozenset[str]) -> tuple:
    """Every match contains one of the strings: OR over them of AND over their trigrams."""
    parts = {tuple(sorted({s[i:i + 3] for i in range(len(s) - 2)})) for s in strings}
    return ANY if () in parts or not parts else ("or", *(("and", *p) for p in sorted(parts)))


def _class_chars(items: list) -> frozenset[str] | None:
    chars: set[str] = set()
    for op, arg in items:
        if op is regex_tree.LITERAL:
            chars.add(chr(arg).lower())
        elif op is regex_tree.RANGE and arg[1] - arg[0] < MAX_EXACT:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(chars) if len(chars) <= 10 else None


def _derive(tree) -> tuple[frozenset[str] | None, tuple]:
    """(all strings the expression can match, if few; query that holds for every match). Letters are lower-cased."""
    needed: list[tuple] = []
    run: frozenset[str] = frozenset({""})
    whole = True

    def close() -> None:
        nonlocal run
        needed.append(_strings_query(run))
        run = frozenset({""})

    for op, arg in tree:
        exact, query = None, ANY
        if op is regex_tree.LITERAL:
            exact = frozenset({chr(arg).lower()})
        elif op is regex_tree.IN:
            exact = _class_chars(arg)
        elif op is regex_tree.SUBPATTERN:
            exact, query = _derive(arg[3])
        elif op is regex_tree.BRANCH:
            derived = [_derive(x) for x in arg[1]]
            if all(e is not None for e, _ in derived):
                exact = frozenset().union(*(e for e, _ in derived))
            query = ("or", *((_strings_query(e) if e is not None else q) for e, q in derived))
        elif op in (regex_tree.MAX_REPEAT, regex_tree.MIN_REPEAT, regex_tree.POSSESSIVE_REPEAT):
            least, most, item = arg
            inner, inner_query = _derive(item)
            if inner is not None and (least, most) == (0, 1):
                exact = inner | {""}
            elif least > 0:
                query = _strings_query(inner) if inner is not None else inner_query
        elif op in (regex_tree.AT, regex_tree.ASSERT, regex_tree.ASSERT_NOT):
            exact = frozenset({""})
        if exact is not None and len(run) * len(exact) <= MAX_EXACT:
            run = frozenset(a + b for a, b in product(run, exact))
        else:
            whole = False
            close()
            needed.append(query if exact is None else _strings_query(exact))
    if whole:
        return run, _strings_query(run)
    close()
    return None, ("and", *(q for q in needed if q != ANY))


def trigram_query(rule: SecretRule) -> tuple:
    """Boolean query over lower-cased trigrams: ('and' | 'or', parts...), a part being a trigram or a query."""
    query = _derive(regex_tree.parse(rule.pattern))[1]
    return ANY if any(not t.isascii() for t in trigrams(query)) else query


def trigrams(query: tuple | str) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1:]))


class TrigramIndex:
    """Postings of the given trigrams, built segment by segment."""

    def __init__(self, wanted: set[str]):
        self.ids = {t: n for n, t in enumerate(sorted(wanted))}
        self.slot = np.full(1 << 24, -1, np.int16)
        for t, n in self.ids.items():
            a, b, c = t.encode()
            self.slot[a << 16 | b << 8 | c] = n

    def postings(self, texts: list[str]) -> np.ndarray:
        """Bitmap postings: row n holds the documents of the segment that contain trigram n, letters in any case."""
        raw = [t.encode().lower() for t in texts]
        data = np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8)
        bounds = np.cumsum([len(r) + 2 for r in raw])
        wide = data.astype(np.uint32)
        found = self.slot[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]]
        at = np.flatnonzero(found >= 0)
        out = np.zeros((len(self.ids), len(texts)), bool)
        out[found[at], np.searchsorted(bounds, at, "right")] = True
        return out

    def candidates(self, query: tuple | str, postings: np.ndarray) -> np.ndarray:
        if isinstance(query, str):
            return postings[self.ids[query]]
        parts = [self.candidates(q, postings) for q in query[1:]]
        if query[0] == "or":
            return np.logical_or.reduce(parts)
        return np.logical_and.reduce([np.ones(postings.shape[1], bool), *parts])


def matches(rule: SecretRule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if len(m[rule.group]) >= rule.min_chars]


def joined(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """kind:start:end by start, then kind in the rules' order."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """Spans of all rules in whole texts, in code points: (doc_id, n_<kind> of the first ``base`` rules,
    base_sha256, spans).

    A null or empty text has no spans (base_sha256 is that of the empty string). Repeated rows get equal rows; a null
    id stays null. Only the two named columns are read. Spans of different kinds may overlap.
    """
    kinds = [r.kind for r in rules]
    names = ["doc_id", *(f"n_{k}" for k in kinds[:base]), "base_sha256", "spans"]
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in kinds[:base]) + ", base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r) for r in rules]
        patterns = [r.compiled() for r in rules]
        index = TrigramIndex(set().union(*(trigrams(q) for q in queries)))
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            postings = index.postings(texts)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, (rule, pattern, query) in enumerate(zip(rules, patterns, queries)):
                for i in np.flatnonzero(index.candidates(query, postings)).tolist():
                    spans[i] += [(s, k, e) for s, e in matches(rule, pattern, texts[i])]
            own = [[x for x in s if x[1] < base] for s in spans]
            counts = [pa.array([sum(x[1] == k for x in s) for s in own], pa.int64()) for k in range(base)]
            digests = [hashlib.sha256(joined(s, kinds).encode()).hexdigest() for s in own]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digests, pa.string()),
                                              pa.array([joined(s, kinds) for s in spans], pa.string())], names=names)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, schema)
