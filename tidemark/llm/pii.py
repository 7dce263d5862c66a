"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Every scan is linear in the text: digit runs are taken whole, an address is found
from its ``@``.  A null text is empty and has no spans; rows repeat as they come.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import SPAN, map_rows

#: Kinds whose spans always stay, in their listed order.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Score of a proposal before and after its validator, by kind.
PRIOR = {"email": 0.6, "ip": 0.4, "card": 0.3, "phone": 0.4, "iban": 0.3, "ssn": 0.3}
CONFIRMED = {"email": 0.0, "ip": 0.2, "card": 0.4, "phone": 0.2, "iban": 0.5, "ssn": 0.1}
#: A span of a kind outside ``BASE`` needs this score.
THRESHOLD = 0.5
NEAR = 48
CONTEXT_GAIN = 0.2
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write to|correo|adresse", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|addr", re.I),
    "card": re.compile(r"card|visa|credit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel\b|mobile|fax|telefon", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "ssn": re.compile(r"ssn|social security", re.I),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an account number by country.
_IBAN_LENGTH = {
    k[:2]: int(k[2:])
    for k in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 "
        "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
        "LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 "
        "SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of bank account numbers."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers that pass, with the words after them left out: the end that the country
    sets is tried first, then every other end of a word, the longest first."""
    at = 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        at = start + 4
        length = _IBAN_LENGTH.get(text[start : start + 2])
        ends = [end, *(p for p in range(end - 1, start + 14, -1) if text[p] == " ")]
        numbers = [(p, text[start:p].replace(" ", "")) for p in ends]
        numbers = [(p, number) for p, number in numbers if len(number) >= 15]
        numbers.sort(key=lambda x: len(x[1]) != length)
        for p, number in numbers:
            if mod97(number):
                yield start, p
                at = p
                break


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
        if domain and start < at:
            yield start, domain.end()
            floor = domain.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def _matches(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pattern and validator accept, by kind."""
    for start, end in _emails(text):
        yield "email", start, end
    if _DIGIT.search(text) is None:
        return
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield "phone", *m.span()
    for start, end in _ibans(text):
        yield "iban", start, end
    for m in _SSN.finditer(text):
        if m.group()[:3] not in ("000", "666") and m.group()[0] != "9":
            yield "ssn", *m.span()


def spans_of(text: str | None) -> list[dict]:
    """All spans of one text, by start and then kind, each with a score from 0 to 1."""
    text = text or ""
    found = []
    for kind, start, end in _matches(text):
        near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
        gain = CONTEXT_GAIN if CONTEXT[kind].search(near) else 0.0
        score = round(PRIOR[kind] + CONFIRMED[kind] + gain, 3)
        if kind in BASE or score >= THRESHOLD:
            found.append({"kind": kind, "start": start, "end": end, "score": score})
    found.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
    return found


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``spans``, one row per document; positions are code points."""
    fields = T.StructType([T.StructField("spans", SPAN)])
    return map_rows(docs, [text], keep, fields, lambda: lambda value: (spans_of(value),))
