"""Secret scans through a trigram index.

From each rule's regular expression a Boolean query over three-byte strings is derived that every match must
satisfy (case is folded for ASCII; where a rule ignores case beyond ASCII, letters with such a variant ask for no trigram).  A slice of texts is indexed once: for each trigram of the queries, the postings are the
texts that contain it.  Queries intersect and unite postings; only the candidates are searched by the expression.  A rule without
mandatory trigrams scans every text.

Whole texts are searched; nothing is shuffled.  Spans count code points, ends exclusive.

*Defined results.*  A null text counts as empty and has no spans.  Rows that repeat have equal spans.  Long texts are searched as a whole; an empty table gives none.
Columns of any name are carried inside ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op, _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from keysift.llm.words import LOWER, carried, column_bytes, slices

#: Queries are ALL (no trigram is needed), a trigram as bytes, or ("and" | "or", parts).
ALL = None
MOST_STRINGS = 64
FEW = 8
TYPES = re.ASCII | re.LOCALE | re.UNICODE
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


@dataclass(frozen=True)
class Rule:
    """A match counts when ``group`` has at least ``least`` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    flags: int = re.ASCII


#: The base kinds, in the order that breaks ties.  A run of 24 or more hex digits is what remains of all runs after the length check.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|npm_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,})"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{1,128}@"),
)


def _all_of(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list) -> object:
    if any(p is ALL for p in parts) or not parts:
        return ALL
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _needs(strings: set[str]) -> object:
    """What a text that contains one of ``strings`` must satisfy."""
    fewest = [s for s in sorted(strings) if not any(t != s and t in s for t in strings)]
    coded = [bytes(LOWER[np.frombuffer(s.encode("utf-8", "replace"), np.uint8)]) for s in fewest]
    return _any_of([_all_of([s[i:i + 3] for i in range(len(s) - 2)]) for s in coded])


def _scoped(flags: int, add: int, gone: int) -> int:
    """The flags inside a group that changes them."""
    return ((flags & ~TYPES if add & TYPES else flags) | add) & ~gone


def _plain(value: int, flags: int) -> bool:
    """Whether the character matches only itself, or in ASCII its other case.  Ignoring case beyond ASCII, the dotless and dotted i, the long s and
    the Kelvin sign match i, s and k."""
    beyond = flags & re.IGNORECASE and not flags & re.ASCII
    return not beyond or value < 128 and chr(value) not in "iIsSkK"


def _walk(tree, flags: int = re.ASCII) -> tuple[set[str] | None, object]:
    """(all strings that match, if few; the query that holds beside them)."""
    run, asked = {""}, []

    def cut():
        asked.append(_needs(run))
        return {""}

    for kind, value in tree:
        strings, query = None, ALL
        if kind is op.LITERAL and not _plain(value, flags) or kind is op.IN and any(k is op.LITERAL and not _plain(v, flags) for k, v in value):
            pass
        elif kind is op.LITERAL:
            strings = {chr(value).lower() if value < 128 else chr(value)}
        elif kind is op.IN and value[0][0] is not op.NEGATE and all(k is op.LITERAL for k, _ in value) and len(value) <= FEW:
            strings = {chr(v).lower() if v < 128 else chr(v) for _, v in value}
        elif kind is op.AT:
            strings = {""}
        elif kind is op.SUBPATTERN:
            strings, query = _walk(value[-1], _scoped(flags, *value[1:3]))
        elif kind is op.BRANCH:
            found = [_walk(x, flags) for x in value[1]]
            if all(s is not None for s, _ in found):
                strings = set().union(*(s for s, _ in found))
            else:
                query = _any_of([_all_of([q, *([_needs(s)] if s is not None else [])]) for s, q in found])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            part, beside = _walk(inner, flags)
            if (low, high) == (0, 1) and part is not None:
                strings = part | {""}
            elif low:
                query = _all_of([beside, *([_needs(part)] if part is not None else [])])
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        run = cut()
        if strings is not None:
            run = set(strings)
        asked.append(query)
    asked = [q for q in asked if q is not ALL]
    if not asked and tree and all(k in (op.LITERAL, op.IN, op.AT, op.SUBPATTERN, op.BRANCH, op.MAX_REPEAT) for k, _ in tree) and run != {""}:
        return (run, ALL) if _exact(tree, flags) else (None, _needs(run))
    return None, _all_of([*asked, _needs(run)])


def _exact(tree, flags: int) -> bool:
    """Whether ``_walk`` lists every string that ``tree`` matches."""
    for kind, value in tree:
        if kind is op.LITERAL and not _plain(value, flags):
            return False
        if kind is op.SUBPATTERN and not _exact(value[-1], _scoped(flags, *value[1:3])):
            return False
        if kind is op.BRANCH and not all(_exact(x, flags) for x in value[1]):
            return False
        if kind is op.IN and (value[0][0] is op.NEGATE or len(value) > FEW or any(k is not op.LITERAL or not _plain(v, flags) for k, v in value)):
            return False
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and (value[:2] != (0, 1) or not _exact(value[2], flags)):
            return False
        if kind not in (op.LITERAL, op.IN, op.AT, op.SUBPATTERN, op.BRANCH, op.MAX_REPEAT, op.MIN_REPEAT):
            return False
    return True


def trigram_query(rule: Rule) -> object:
    """The Boolean query that every text with a match of ``rule`` satisfies."""
    tree = parser.parse(rule.pattern, rule.flags)
    strings, query = _walk(list(tree), tree.state.flags)
    return _all_of([query, *([_needs(strings)] if strings is not None else [])])


def _trigrams(query) -> set[bytes]:
    return set() if query is ALL else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


class Index:
    """Rules with their queries, and the postings of the queries' trigrams over a slice of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r)) for r in rules]
        self.names = sorted(set().union(*(_trigrams(q) for *_, q in self.rules)))
        self.number = {t: i for i, t in enumerate(self.names)}
        self.table = np.zeros(1 << 24, np.uint16 if len(self.names) < 65535 else np.uint32)
        for i, t in enumerate(self.names):
            self.table[int.from_bytes(t, "big")] = i + 1

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[trigram, text]: whether the text contains the trigram."""
        found = np.zeros((len(self.names), len(offsets) - 1), bool)
        if len(data) < 3:
            return found
        low = LOWER[data].astype(np.int32)
        code = self.table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(code)
        text = np.searchsorted(offsets, at, "right") - 1
        whole = at + 2 < offsets[text + 1]
        found[code[at[whole]].astype(np.int64) - 1, text[whole]] = True
        return found

    def _ask(self, query, postings: np.ndarray) -> np.ndarray:
        if query is ALL:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, bytes):
            return postings[self.number[query]]
        parts = [self._ask(q, postings) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def search(self, column: pa.Array) -> list[list[dict]]:
        data, offsets = column_bytes(column)
        postings, texts = self.postings(data, offsets), pc.fill_null(column, "").to_pylist()
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in np.flatnonzero(self._ask(query, postings)):
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans[i].append((m.start(), k, m.end()))
        return [[{"kind": self.rules[k][0].kind, "start": a, "end": b} for a, k, b in sorted(x)] for x in spans]


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(row, secrets): the row as a struct (of the columns ``keep``, or all) and the spans in it by start, then in order of the rules."""
    out, texts = carried(docs, text_col, keep)
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        for batch in slices(batches, texts):
            found = pa.array(index.search(texts(batch)), pa.list_(SPAN))
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], ["row", "secrets"])

    return out.mapInArrow(run, T.StructType([out.schema["row"], T.StructField("secrets", kind)]))
