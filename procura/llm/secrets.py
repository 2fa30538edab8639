"""Secrets in text: fixed formats, and literals that an assignment gives to a sensitive name.

The lexer reads source and configuration syntax line by line into (name, literal) pairs: `name = "x"`, `name: x`,
`name => 'x'`, `"name": "x"`, `export NAME=x`, `--name x`, `<name>x</name>`, also after a declaration keyword or type.
Names that are assigned to names pass their literal on (`KEY = k` with `k = "x"` before or after), and adjacent
literals joined by `+` count as one value with a span each. A pair scores by its name (words such as password, key,
token, credential; words such as path, name, example count against it) and by its literal (length, character mix,
entropy; placeholders and plain words count against it). From `SCORE` up the literal's span is added.

The base formats stay as they are, whatever the lexer finds. Defined cases: null and empty text have no spans; repeated
rows are scanned one by one; spans are in code points, end exclusive; a lexer span inside or equal to a base span is not
added again.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.llm.words import slices

#: Fixed formats.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of these characters is matched whole, so short runs simply do not match
KINDS = ("assign", "access", "hex", "literal")

SCORE = 4.0
_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*+"
_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
_BARE = r"[A-Za-z0-9+/_.=~!@#$%^&*-]+"
_PAIR = re.compile(
    rf"""(?:^|[\s,;({{\[])["']?(?P<name>{_NAME})["']?\s*(?::=|=>|=(?!=)|:(?![:/]))[^\S\n]*(?P<value>{_STRING}|{_BARE})|--(?P<flag>{_NAME})[= ](?P<given>{_STRING}|{_BARE})|<(?P<tag>{_NAME})>(?P<held>[^<\n]+)</(?P=tag)>""",
    re.MULTILINE,
)
_MORE = re.compile(rf"\s*[+.]?\s*(?P<value>{_STRING})")
_IDENTIFIER = re.compile(rf"^{_NAME}$")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Name parts that speak for and against a secret.
FOR = {"password": 4, "passwd": 4, "pwd": 4, "pass": 2, "passphrase": 4, "secret": 4, "token": 3, "apikey": 4, "key": 2, "api": 1, "auth": 2, "private": 2, "credential": 4, "credentials": 4, "access": 1, "salt": 2, "signature": 2, "bearer": 3, "cert": 1, "conn": 1}
AGAINST = {"path": 3, "file": 3, "dir": 3, "name": 2, "id": 1, "public": 3, "url": 2, "example": 3, "length": 4, "size": 4, "type": 3, "field": 2, "header": 2, "primary": 3, "foreign": 3, "count": 4, "max": 2, "min": 2}
PLACEHOLDERS = {"none", "null", "true", "false", "changeme", "example", "placeholder", "todo", "test", "xxx", "required", "optional", "your", "env", "default", "undefined"}


def entropy(text: str) -> float:
    """Bits per character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return float(sum(FOR.get(p, 0) - AGAINST.get(p, 0) for p in [*parts, *joined]))


def literal_score(literal: str) -> float:
    words = {p.lower() for p in re.findall(r"[A-Za-z0-9]+", literal)}
    if len(literal) < 6 or words <= PLACEHOLDERS or len(set(literal)) < 4 or re.match(r"^[$<{%]", literal):
        return -10.0
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    plain = bool(re.fullmatch(r"[A-Za-z][a-z]*(?:[ .,'-][A-Za-z]?[a-z]*)*", literal))
    return min(len(literal) / 8, 2.0) + (classes - 1) * 0.75 + (entropy(literal) - 3.0) - (3.0 if plain else 0.0)


def _inner(text: str, start: int, end: int) -> tuple[int, int]:
    return (start + 1, end - 1) if text[start] in "\"'`" else (start, end)


def pairs(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """(name, spans of its literal) in order, constants propagated."""
    direct: list[tuple[str, list[tuple[int, int]]]] = []
    given: dict[str, list[_Given]] = {}
    aliases: list[tuple[str, _Given]] = []
    for found in _PAIR.finditer(text):
        group = "value" if found["name"] else "given" if found["flag"] else "held"
        name = found["name"] or found["flag"] or found["tag"]
        start, end = found.span(group)
        spans = [_inner(text, start, end)]
        if text[start] in "\"'`":
            at = end
            while (more := _MORE.match(text, at)) and "\n" not in text[at : more.start("value")].strip(" \t\r\n+") and "+" in text[at : more.start("value")]:
                spans.append(_inner(text, *more.span("value")))
                at = more.end()
        source = text[start:end].rstrip(";,")
        one = _Given(start, spans, source if group == "value" and _IDENTIFIER.match(source) else None)
        if one.source:
            aliases.append((name, one))
        direct.append((name, spans))
        given.setdefault(name, []).append(one)
    known: dict[int, list[tuple[int, int]] | None] = {}
    return direct + [(name, spans) for name, one in aliases if (spans := _resolved(one, given, known))]


class _Given(NamedTuple):
    """What one assignment gives to its name: a literal, or perhaps the value of the name `source`."""

    at: int
    spans: list[tuple[int, int]]
    source: str | None


def _resolved(one: _Given, given: dict[str, list[_Given]], known: dict[int, list[tuple[int, int]] | None]) -> list[tuple[int, int]] | None:
    """The literal at the end of an alias's chain: of each name the last one given before the alias, else the first one after
    it; null if there is none or the chain is a cycle. known: answers so far by place, so a chain is walked once."""
    if one.source not in given:
        return None
    seen: dict[int, None] = {}
    while one.source in given and one.at not in known and one.at not in seen:
        seen[one.at] = None
        places = given[one.source]
        one = places[max(bisect_left(places, one.at, key=lambda g: g.at) - 1, 0)]
    answer = known[one.at] if one.at in known else None if one.at in seen else one.spans
    known.update(dict.fromkeys(seen, answer))
    return answer


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats, kind as a place in KINDS, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def literal_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the literals of sensitive names that no base span holds."""
    found = set()
    for name, spans in pairs(text):
        by_name = name_score(name)
        if by_name >= 2 and by_name + literal_score("".join(text[a:b] for a, b in spans)) >= SCORE:
            found.update((a, 3, b) for a, b in spans if a < b)
    return [s for s, held in _held(sorted(found), base) if not held]


def _held(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> Iterator[tuple[tuple[int, int, int], bool]]:
    """Each span with whether a base span holds it; one sweep over both sorted lists."""
    at, reach = 0, -1
    for span in spans:
        while at < len(base) and base[at][0] <= span[0]:
            reach = max(reach, base[at][2])
            at += 1
        yield span, span[2] <= reach


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            for text in part.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = sorted(base + literal_spans(text, base)) if _may_assign(text) else base
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.record_batch([part.column("doc_id"), pa.array(out, pa.list_(kind))], ["doc_id", "spans"])


def _may_assign(text: str) -> bool:
    return "=" in text or ":" in text or "--" in text or "</" in text


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) per document of `docs` (doc_id long, text string), spans by start, then
    kind in the order of KINDS."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
