"""Secrets: assignment, access-key and hex patterns, and a token-efficiency test.

A byte-pair vocabulary learned on prose and code needs few tokens for words and
many for random strings.  A candidate with few characters per token is reported
unless it is a labelled digest, a UUID, a plain number or another known identifier.
Where a pattern's span covers a part of a candidate, the parts outside are tested.

A null text is empty; repeated rows give repeated results; an empty table gives an
empty one.  Texts of any length are searched whole, in time linear in the text.
Spans that start together are listed in the order of ``KINDS``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SPAN, map_rows, worker_cache

#: Kinds whose spans always stay, in their listed order; ``random`` is the method's own.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
#: Characters per token under which a candidate counts as random.
MAX_CHARS_PER_TOKEN = 1.9
MIN_LENGTH = 20

_ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]++)", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % MIN_LENGTH)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_INTEGRITY = re.compile(r"(?:sha(?:1|256|384|512)|md5)-[A-Za-z0-9+/]+=*\Z")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128})\Z")
_LABEL = re.compile(r"(?:sha-?\d*|md5|digest|checksum|etag|commit|revision|blob)\W{0,4}\Z", re.I)


def encoder(vocabulary: str | None) -> Callable[[str], list[int]]:
    """Encodes ordinary text with the byte-pair ranks in the file ``vocabulary``."""
    cache = worker_cache()
    key = ("ranks", vocabulary)
    if key not in cache:
        import public_tokenizers
        import tiktoken

        path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        cache[key] = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
    return cache[key]


def known(candidate: str, before: str) -> bool:
    """A number, a digest under its label, an integrity value or a UUID."""
    if candidate.isdigit() or _UUID.match(candidate) or _INTEGRITY.match(candidate):
        return True
    return bool(_DIGEST.match(candidate) and _LABEL.search(before))


def _outside(start: int, end: int, covered: list[tuple[int, int]], at: int) -> Iterator[tuple[int, int]]:
    """The parts of ``start:end`` that no span from ``covered[at]`` on covers."""
    while at < len(covered) and covered[at][0] < end:
        if covered[at][0] > start:
            yield start, covered[at][0]
        start = max(start, covered[at][1])
        at += 1
    if start < end:
        yield start, end


def spans_of(text: str | None, encode: Callable[[str], list[int]]) -> list[dict]:
    """All spans of one text by start and then kind; ``score`` is tokens per character for ``random``."""
    text = text or ""
    found = []
    for m in _ASSIGN.finditer(text):
        if len(m.group(1)) >= 6:
            found.append(("assign", *m.span(), 1.0))
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            found.append(("access", *m.span(), 1.0))
    for m in _HEX.finditer(text):
        found.append(("hex", *m.span(), 1.0))
    covered: list[tuple[int, int]] = []
    for span_start, span_end in sorted((s, e) for _, s, e, _ in found):
        if covered and span_start <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(covered[-1][1], span_end))
        else:
            covered.append((span_start, span_end))
    at = 0
    for m in _CANDIDATE.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        for low, high in _outside(*m.span(), covered, at):
            value = text[low:high]
            if len(value) < MIN_LENGTH or known(value, text[max(0, low - 16) : low]):
                continue
            tokens = len(encode(value))
            if len(value) < MAX_CHARS_PER_TOKEN * tokens:
                found.append(("random", low, high, round(tokens / len(value), 4)))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return [dict(zip(("kind", "start", "end", "score"), s)) for s in found]


def find(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Columns ``keep`` and ``spans``, one row per document; positions are code points."""

    def start():
        encode = encoder(vocabulary)
        return lambda value: (spans_of(value, encode),)

    return map_rows(docs, [text], keep, T.StructType([T.StructField("spans", SPAN)]), start)


def redact(
    docs: DataFrame, text: str = "text", mark: str = "[secret]", vocabulary: str | None = None
) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``; a null text stays null."""

    def start():
        encode = encoder(vocabulary)

        def each(value):
            spans = spans_of(value, encode)
            if not spans:
                return (value,)
            parts, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    parts += [value[at : s["start"]], mark]
                at = max(at, s["end"])
            return ("".join([*parts, value[at:]]),)

        return each

    # Inner names keep columns that are named like the operator's own apart.
    inner = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text)
    made = map_rows(inner, [f"__c{at}"], inner.columns, T.StructType([T.StructField("clean", T.StringType())]), start)
    out = [F.col("clean") if i == at else F.col(c) for i, c in enumerate(inner.columns)]
    return made.select(*out).toDF(*docs.columns)


def has_secret(spans: Column) -> Column:
    return F.size(spans) > 0
