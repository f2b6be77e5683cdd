"""Personal data: regular expressions propose, validators confirm, nearby words adjust.

Kinds and rules: email; ip (parts at most 255); card (14 to 19 digits passing Luhn); phone (10 to 15
digits after a plus sign); and, beyond these, iban (mod-97). Matches of one kind are leftmost and do
not overlap; a match that its validator rejects is dropped without a retry. An iban pattern may run on into the next words:
of its beginnings that end at a blank the longest that its validator confirms counts, and the search goes on behind it.
Offsets are code points, ends exclusive. Each text is handled alone in one pass without a shuffle.
Null text is empty. Null ids stay null, and repeated rows are judged each. Texts of any length are read whole. An empty table gives
no rows; other columns are not looked at, whatever their names (`keep` hands them on, but for those named spans or masked).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
#: Score of a confirmed span without context, and what a context word nearby adds.
CONFIDENCE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8}
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "server", "host"), "card": ("card", "credit", "visa", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "account", "bank", "konto"),
}
AGAINST = ("version", "release", "isbn", "order")
NEAR, STEP = 40, 0.1

SPAN = "struct<kind:string,start:long,end:long,score:double>"
SCHEMA = f"spans array<{SPAN}>, masked string"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the look-behinds only spare attempts from inside a run of digits that already failed at its start
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_DIGITS = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[a-z]+")
_DOUBLE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        total += _DOUBLE[ord(c) - 48] if k % 2 else ord(c) - 48
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ outwards."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, end)):
            found.append((start, m.end()))
            free = end = m.end()
        at = text.find("@", end)
    return found


def ibans(text: str) -> list[tuple[int, int]]:
    """Leftmost spans that pass mod-97: of a match, or its longest beginning that ends at a blank and passes."""
    found, m = [], _IBAN.search(text)
    while m:
        end = m.end()
        while end > m.start() and not mod97(text[m.start() : end]):
            end = text.rfind(" ", m.start(), end)
        if end > m.start():
            found.append((m.start(), end))
        m = _IBAN.search(text, end if end > m.start() else m.start() + 1)
    return found


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the confirmed spans, in order of start and kind."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
        found += [(s, 4, e) for s, e in ibans(text)]
        found.sort()
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    near = _WORD.findall(text[max(0, start - NEAR) : start].lower() + " " + text[end : end + NEAR].lower())
    up = any(w.startswith(CONTEXT[kind]) for w in near) if near else False
    down = any(w in AGAINST for w in near)
    return round(min(1.0, max(0.0, CONFIDENCE[kind] + STEP * (up - down))), 2)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, free = [], 0
    for start, kind, end in spans:
        if start >= free:
            out += [text[free:start], f"[{KINDS[kind].upper()}]"]
        free = max(free, end)
    return "".join([*out, text[free:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = False, keep: bool = False) -> DataFrame:
    """doc_id, spans and (if asked for) the masked text of each document; keep: after all columns of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col, "doc_id", "text", "spans", "masked")] if keep else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                spans, texts = [], []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    own = find(text)
                    spans.append([{"kind": KINDS[k], "start": s, "end": e, "score": score(text, KINDS[k], s, e)} for s, k, e in own])
                    texts.append((mask(text, own) if own else text) if masked else None)
                yield pa.RecordBatch.from_arrays([*(part.columns if keep else [part.column("doc_id")]), pa.array(spans, _ARROW), pa.array(texts, pa.string())], names=[*(part.schema.names if keep else ["doc_id"]), "spans", "masked"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in (rows.dtypes if keep else rows.dtypes[:1])) + ", " + SCHEMA)


def joined(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans, comma-joined (a column)."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
