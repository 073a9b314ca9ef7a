"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

The base kinds (email, ip, card, phone) are fixed patterns with a range, Luhn or length test; each
proposal that passes is a span, whatever its score. The further kinds (iban, aba, ssn) are spans only
from THRESHOLD up: a pattern gives a prior, a passed mod-97 or weighted mod-10 checksum raises it, words nearby
raise or lower it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import slices

BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.6
#: Characters on either side in which context words count.
NEAR = 40

# a match starts where a run of digits does, so that a long run is tried once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_REST = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Characters of an IBAN without spaces, by country.
_IBAN_LENGTH = {c[:2]: int(c[2:]) for c in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30".split()}
_ABA = re.compile(r"(?<![0-9.+-])[0-9]{9}(?![0-9.-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Words that make a kind likelier nearby, words that make any kind less likely.
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "debit", "visa", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "transfer"),
    "aba": ("routing", "aba", "bank", "account"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("example", "test", "sample", "dummy", "version", "isbn", "order")
#: The score of a pattern alone, and after a checksum that few random strings pass.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.3, "aba": 0.1, "ssn": 0.4}
CONFIRMED = {"iban": 0.9, "aba": 0.5, "ssn": 0.5}


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, digits of the results added: a multiple of ten."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: country and check digits moved to the end, letters as 10 to 35; the number leaves 1."""
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def routing(digits: str) -> bool:
    """Weights 3, 7, 1: a multiple of ten, and not all zero."""
    return digits.strip("0") != "" and sum(int(c) * w for c, w in zip(digits, (3, 7, 1) * 3)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of local part, @ and dotted domain, found from each @ on."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and not _LOCAL_REST.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            after = found.end()
        at = text.find("@", max(at + 1, after))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base kinds in code points, ends exclusive; a match that fails its test is dropped and not retried."""
    out = {kind: [] for kind in BASE}
    if "@" in text:
        out["email"] = _emails(text)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if text.count(".") > 2:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def _ibans(text: str) -> list[tuple[int, int]]:
    """Confirmed IBANs: the longest match, or what its country's length leaves of it before a space; what follows is looked at anew."""
    out, m = [], _IBAN.search(text)
    while m:
        end = m.end()
        if not mod97(m[0]):
            ends = [k for k in range(m.start() + 1, m.end()) if text[k] == " " and k - m.start() - text.count(" ", m.start(), k) == _IBAN_LENGTH.get(m[0][:2])]
            end = ends[0] if ends and mod97(text[m.start() : ends[0]]) else m.start() + 1
        if end > m.start() + 1:
            out.append((m.start(), end))
        m = _IBAN.search(text, end)
    return out


def context(text: str, start: int, end: int, kind: str) -> float:
    """What the words nearby add to the score."""
    near = set(re.findall(r"[a-z]+", f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()))
    return 0.2 * any(w in near for w in CONTEXT[kind]) - 0.2 * any(w in near for w in AGAINST)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans: the base kinds as listed, then the others, each by start."""
    out = [(kind, a, b, min(1.0, max(0.0, PRIOR[kind] + context(text, a, b, kind)))) for kind, found in base_spans(text).items() for a, b in found]
    further = [("iban", a, b) for a, b in _ibans(text)]
    for kind, pattern, confirms in (("aba", _ABA, routing), ("ssn", _SSN, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")):
        further += [(kind, *m.span()) for m in pattern.finditer(text) if confirms(m[0])]
    for kind, a, b in further:
        score = min(1.0, CONFIRMED[kind] + context(text, a, b, kind))
        if score >= THRESHOLD:
            out.append((kind, a, b, score))
    return out


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row: spans has kind, start and end in code points, and score.

    A null or empty text has no spans. Repeated rows stay repeated; rows are independent, and no other
    column is read. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for batch in slices(batches, "text"):
            found = [spans(t) if (t := x.as_py()) else [] for x in batch.column("text")]
            flat = [s for f in found for s in f]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            parts = [pa.array([s[k] for s in flat], kind.field(k).type) for k in range(4)]
            column = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(kind)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans {SPAN}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets, of overlapping ones the leftmost, then the longest."""

    def mask(text: str) -> str:
        out, at = [], 0
        for kind, a, b, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
                at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = pa.array([None if (t := x.as_py()) is None else mask(t) for x in batch.column(text_col)], pa.string())
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, texts)

    return docs.mapInArrow(run, docs.schema)
