"""Secret scan by assignment-aware lexing.

Besides three base patterns, source and configuration syntax is lexed into
(name, literal) pairs: ``name = "x"``, ``name: x``, ``"name": "x"``,
``name => 'x'``, ``export NAME=x``, ``<add name="x"/>``, typed ones
(``name: str = "x"``, ``name string = "x"``), subscripts (``env["name"] =
"x"``), key/value attributes and fields (``key="name" value="x"``, either
first), and so on.  A bare word on the right that is itself given a literal
stands for that literal: the last one before it in the text or, if there is
none, the first one after.  Each literal is
scored by the words of its target names and by its own shape; literals that
reach ``ENOUGH`` are spans of kind ``literal``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, text_or_empty

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer is no match, so the whole run or none
KINDS = ("assign", "access", "hex", "literal")
LITERAL = r"(?:[rRbBuUfF]{1,2}(?=[\"']))?+(?:\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|([A-Za-z0-9_$][\w+/=.$@:-]*+))"
TYPE = r"[A-Za-z_][\w.]*+(?:[\[<][^\]>\n=]*+[\]>]{1,2})?+\??(?:[\x20\t]*+\|[\x20\t]*+[A-Za-z_][\w.]*+)*+"
# name, closing marks, type (before a quoted literal, or a bare word set off by blanks), operator, then a quoted literal or a bare word to the end of its run
PAIR = re.compile(r"(?<![\w.-])([A-Za-z_][\w.-]*+)(?:\[[0-9]*\])?[\"']?(?:[\x20\t]*+[\])]){0,2}+"
                  rf"(?:[?!]?[\x20\t]*+:[\x20\t]*+{TYPE}(?=[\x20\t]*+=[\x20\t]*+[\"'`]|[\x20\t]++=[\x20\t])|[\x20\t]++string(?=[\x20\t]*+=))?"
                  rf"[\x20\t]*+(?:=>|:=|={{1,3}}|:)[\x20\t]*+{LITERAL}", re.A)
WORD = re.compile(r"[A-Za-z_][\w.-]*", re.A)
# key="name" ... value="x" and value="x" ... key="name", as attributes or as fields, with at most eight other attributes between
KEY = r"(?<![\w.-])(?:key|name|id)[\"']?\s*+[:=]\s*+[\"']?([A-Za-z_][\w.:-]*+)[\"']?"
VALUE = rf"(?<![\w.-])value[\"']?\s*+[:=]\s*+{LITERAL}"
BETWEEN = r"[\s,;]++(?:[\w.:-]++\s*+=\s*+(?:\"[^\"\n]*+\"|'[^'\n]*+')\s++){0,8}?[\"']?"
KEYED = re.compile(KEY + BETWEEN + VALUE, re.A | re.I)
VALUED = re.compile(VALUE + BETWEEN + KEY, re.A | re.I)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# What a part of a target name says about its literal; a sum of 4 or more with the literal's shape is enough.
NAMES = {"password": 4, "passwd": 4, "pwd": 4, "passphrase": 4, "secret": 4, "token": 4, "apikey": 4, "credential": 4, "credentials": 4, "bearer": 3, "auth": 3,
         "authorization": 3, "private": 2, "access": 2, "key": 2, "api": 2, "signing": 2, "encryption": 2, "client": 1, "pass": 3, "salt": 2, "license": 1}
PLAIN = frozenset("true false null none undefined example changeme password secret token xxx todo test".split())
ENOUGH = 6
LEAST = 6


def shape(value: str) -> int:
    """What the literal's own form adds: length, mixed classes, entropy."""
    if len(value) < LEAST or value.lower() in PLAIN or value.isspace() or len(set(value)) < 4:
        return -9
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search("[^A-Za-z0-9]", value))))
    return (n >= 8) + (n >= 16) + (classes >= 2) + (entropy >= 3) + (entropy >= 3.5) - 3 * (" " in value.strip())


def sensitivity(name: str) -> int:
    parts = [p.lower() for p in PARTS.findall(name)]
    joined = {"".join(parts[i: i + 2]) for i in range(len(parts) - 1)}
    return max(sum(NAMES.get(p, 0) for p in parts), max((NAMES.get(j, 0) for j in joined), default=0))


def pairs(text: str) -> Iterator[tuple[str, int, int]]:
    """(target name, start, end) of every literal, those of constants too."""
    if "=" not in text and ":" not in text:
        return
    found = sorted(_found(text))
    first: dict[str, tuple[tuple[int, int], str | None]] = {}
    for _, name, span, word in found:
        first.setdefault(name, (span, word))
    ends: dict[str, tuple[int, int]] = {}  # the literal that each word stands for by first ones
    for start in first:
        way, w = [], start
        while w in first and w not in ends:
            way.append(w)
            ends[w] = first[w][0]
            w = first[w][1]
        span = ends[w] if w in ends else ends[way[-1]]  # a ring of names ends where it began
        ends.update(dict.fromkeys(way, span))
    known: dict[str, tuple[int, int]] = {}
    for _, name, span, word in found:
        if word is not None:
            span = known.get(word) or ends.get(word) or span  # a name that is given a literal stands for it
        known[name] = span
        yield name, *span


def _found(text: str) -> Iterator[tuple[int, str, tuple[int, int], str | None]]:
    """(place, target name, span of the literal, the literal if it is a bare word)."""
    def literal(m: re.Match, at: int) -> tuple[tuple[int, int], str | None]:
        which = next(i for i in range(at, at + 4) if m[i] is not None)
        return m.span(which), m[which] if which == at + 3 else None

    at = 0
    while m := PAIR.search(text, at):
        at = m.end()
        span, word = literal(m, 2)
        yield m.start(), m[1], span, word
        after = text[m.end(1): span[0]].partition(":")[2]
        if after.strip() and (t := PAIR.match(text, span[0] - len(after.lstrip()))):
            yield t.start(), t[1], *literal(t, 2)  # the type's word may be the name: ``note: token = "x"``
        if word is not None and WORD.fullmatch(word):
            at = span[0]  # a name with an operator of its own, perhaps
    if "value" in text.lower():
        for m in KEYED.finditer(text):
            yield m.start(), m[1], *literal(m, 2)
        for m in VALUED.finditer(text):
            yield m.start(), m[5], *literal(m, 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def literal_spans(text: str) -> set[tuple[int, int]]:
    """Literals whose target names and shape score enough."""
    named: dict[tuple[int, int], int] = {}
    for name, start, end in pairs(text):
        s = sensitivity(name)
        if s:
            named[start, end] = max(s, named.get((start, end), 0))
    return {(a, z) for (a, z), s in named.items() if s + shape(text[a:z]) >= ENOUGH}


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base
    spans) and spans (all spans, kind:start:end in code points, by start).
    Null or empty texts have no spans.  Rows are independent."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                found = [(a, z, "literal") for a, z in literal_spans(text)]
                kinds = Counter(k for _, _, k in base)
                rows.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(_told(base).encode()).hexdigest(), _told(base + found)))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
