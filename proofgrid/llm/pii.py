"""Personal data: regular expressions propose, checksums confirm, context words adjust the score (operator 6).

Base kinds (always kept): email, ip, card, phone.  Added kinds: ``iban``, confirmed by mod-97, and ``ssn``, which has
no checksum and is kept only with a context word near it.  Every span has a score: the prior of its kind, raised by
a passed checksum and by a context word within ``CONTEXT_CHARS`` characters before it.

All scans are linear in the text, also for texts that are one long run of digits or letters.  Offsets are code
points, end exclusive.

Defined results: a null or empty text has no spans; spans of different kinds may overlap; rows that repeat are
reported each.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")  # in the order in which equal starts are listed
BASE = KINDS[:4]
CONTEXT_CHARS = 40
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.5, "ssn": 0.3}
CHECKED = {"card": 0.3, "iban": 0.4}
CONTEXT_GAIN = 0.3
LEAST = {"iban": 0.5, "ssn": 0.5}
WHOLE_WORD = r"(?<![^\W_])(?:%s)(?![^\W_])"
CONTEXT = {kind: re.compile(WHOLE_WORD % words, re.I) for kind, words in {
    "email": r"e-?mails?|contacts?|correo|kontakt|courriels?",
    "ip": r"ip|hosts?|servers?|address(?:es)?|adresses?",
    "card": r"cards?|visa|credit|(?:kredit)?karten?(?:nummer)?|cartes?|tarjetas?",
    "phone": r"(?:tele)?phones?|tel|calls?|mobiles?|telefon(?:nummer)?",
    "iban": r"iban|banks?|accounts?|konto(?:nummer)?|comptes?|cuentas?",
    "ssn": r"ssn|social|security",
}.items()}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){0,3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![^\W_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")  # 34 code characters at most
IBAN_LENGTH = {c[:2]: int(c[2:]) for c in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18
DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20
LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24
TR26 UA29 VG24 XK20""".split()}
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str):
    """Leftmost non-overlapping matches of local part, at sign, domain: found from the at signs, so in linear time."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def ips(text: str):
    for m in DOTTED.finditer(text):  # a shorter run of parts cannot be the head of a longer match
        parts = m[0].split(".")
        if len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            yield m.span()


def cards(text: str):
    for m in DIGITS.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and 18 separators
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _alone(text: str, start: int, end: int) -> bool:
    return not (start and text[start - 1].isalnum()) and not text[end:end + 1].isalnum()


def _valid_head(text: str, start: int, end: int) -> int:
    """The end of the head of a proposal that is a valid code; 0 if there is none.

    One of the length of its country comes first (a longer one can pass by chance, with the start of the next code), then
    the longest.
    """
    best = 0
    for e in range(end, start + 14, -1):
        if text[e - 1] != " " and not text[e:e + 1].isalnum():
            code = text[start:e].replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                if len(code) == IBAN_LENGTH.get(code[:2]):
                    return e
                best = best or e
    return best


def ibans(text: str):
    """Leftmost non-overlapping codes: on behind an accepted one, from the next start if no head of a proposal is valid."""
    m = IBAN.search(text)
    while m:
        end = _valid_head(text, *m.span())
        if end:
            yield m.start(), end
        m = IBAN.search(text, end or m.start() + 1)


def ssns(text: str):
    for m in SSN.finditer(text):
        if _alone(text, *m.span()) and text[m.end():m.end() + 1] != "-" and text[max(m.start() - 1, 0):m.start()] != "-":
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones, ibans, ssns)))
HAS_DIGIT = re.compile("[0-9]")


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind."""
    out = []
    if text and ("@" in text or HAS_DIGIT.search(text)):
        for kind, finder in FINDERS.items():
            for start, end in finder(text):
                near = CONTEXT[kind].search(text, max(0, start - CONTEXT_CHARS), start)
                score = PRIOR[kind] + CHECKED.get(kind, 0.0) + CONTEXT_GAIN * bool(near)
                if score >= LEAST.get(kind, 0.0):
                    out.append((start, KINDS.index(kind), end, min(1.0, round(score, 3))))
    return [(KINDS[k], start, end, score) for start, k, end, score in sorted(out)]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): spans are (kind, start, end, score), by start, then kind."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("score", pa.float64())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)]
                 for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], names=["id", "spans"])

    out = map_arrow(docs.select(F.col(id_col), F.col(text_col)), scan,
                    f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return out.withColumnRenamed("id", id_col)
