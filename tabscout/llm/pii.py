"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, slices

#: Kinds that are reported whatever their score, in reporting order.
BASE = ("email", "ip", "card", "phone")
#: Kinds that are reported from a score of ``least`` on.
ADDED = ("iban", "ssn", "tel")
KINDS = BASE + ADDED

#: A confirmed span's score in percent before its surroundings are read.
SCORES = {"email": 80, "ip": 60, "card": 70, "phone": 60, "iban": 80, "ssn": 40, "tel": 40}
#: What a word that speaks for a kind, or against it, adds.
FOR, AGAINST = 20, -30
#: Kinds without a checksum: their words weigh double, so that alone they stay unreported.
UNCHECKED = ("ssn", "tel")
WORDS_FOR = {
    "email": "email|e-mail|mail|contact|write|address",
    "ip": "ip|host|address|server|login|client",
    "card": "card|credit|debit|visa|mastercard|amex|payment|cvv|expires",
    "phone": "phone|tel|telephone|mobile|cell|call|fax|whatsapp|contact",
    "iban": "iban|account|bank|transfer|bic|swift",
    "ssn": "ssn|social security|tax id|taxpayer",
    "tel": "phone|tel|telephone|mobile|cell|call|fax|whatsapp",
}
WORDS_AGAINST = {
    "email": "noreply|no-reply", "ip": "version|release|section|chapter",
    "card": "order|serial|tracking|isbn|sku", "phone": "order|serial|isbn",
    "iban": "", "ssn": "order|serial|part|isbn", "tel": "order|serial|part|isbn",
}
#: Code points read before and behind a span.
BEFORE, BEHIND = 40, 20

# Length of the account number of each country that takes part.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22,
    "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GE": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IS": 26, "IT": 27, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "TN": 24, "TR": 26, "UA": 29,
}

# Each pattern finds what its plain form finds from left to right, in time linear in the text:
# a run of digits is entered at its start only, and an address from its "@" backwards.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9-]++")
_SSN_SHAPE = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})")
_TEL = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}")
_DIGITS = re.compile(r"[0-9]")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[0::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number without spaces leaves 1 when divided by 97."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text):
    last = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def _ips(text):
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m.group().split("."))
        if all(len(p) < 3 or (len(p) == 3 and int(p) <= 255) for p in parts):
            yield m.span()


def _cards(text):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m.group())) <= 15:
            yield m.span()


def _ibans(text):
    for m in _IBAN.finditer(text):
        start, found = m.start(), m.group()
        length = IBAN_LENGTHS.get(found[:2])
        account = found.replace(" ", "")[:length] if length else ""
        if not length or len(account) < length:
            continue
        # The pattern may have read on into the next word.
        seen = end = 0
        while seen < length:
            seen += found[end] != " "
            end += 1
        before, behind = text[max(0, start - 1):start], text[start + end:start + end + 1]
        if not _ALNUM.match(before) and not _ALNUM.match(behind) and mod97(account):
            yield start, start + end


def _ssns(text):
    for m in _SSN.finditer(text):
        shape = _SSN_SHAPE.fullmatch(m.group()) if m.end() - m.start() == 11 else None
        if shape and shape[1] not in ("000", "666") and shape[1] < "900" and \
                shape[2] != "00" and shape[3] != "0000":
            yield m.span()


def _tels(text):
    for m in _TEL.finditer(text):
        start, end = m.span()
        if text[max(0, start - 1):start] not in _EDGE and text[end:end + 1] not in _EDGE:
            yield start, end


_EDGE = frozenset("0123456789+-./(")
_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans,
            "ssn": _ssns, "tel": _tels}


def word_pattern(words: str) -> str:
    """The words as whole words, in lower-case text."""
    return rf"(?:^|[^a-z0-9])(?:{words})(?:[^a-z0-9]|$)"


_NEAR = {k: (re.compile(word_pattern(WORDS_FOR[k])),
             re.compile(word_pattern(WORDS_AGAINST[k])) if WORDS_AGAINST[k] else None)
         for k in KINDS}


def _score(kind: str, text: str, start: int, end: int) -> int:
    near = f"{text[max(0, start - BEFORE):start]}\n{text[end:end + BEHIND]}".lower()
    good, bad = _NEAR[kind]
    weight = 2 if kind in UNCHECKED else 1
    score = SCORES[kind]
    score += weight * FOR if good.search(near) else 0
    score += AGAINST if bad is not None and bad.search(near) else 0
    return max(0, min(100, score))


def spans_of(text: str | None, least: int = 60) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, score) of one text, by kind in reporting order and then by start."""
    if not text:
        return []
    found: list[tuple[str, int, int, int]] = []
    taken = Apart()
    for kind in KINDS:
        for start, end in _FINDERS[kind](text):
            score = _score(kind, text, start, end)
            if kind in BASE:
                taken.merge(start, end)
            elif score < least or (kind in UNCHECKED and taken.meets(start, end)):
                continue
            found.append((kind, start, end, score))
    return found


class Apart:
    """Stretches of a text that do not overlap, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def _range(self, start: int, end: int) -> tuple[int, int]:
        return bisect_right(self.ends, start), bisect_left(self.starts, end)

    def meets(self, start: int, end: int) -> bool:
        low, high = self._range(start, end)
        return low < high

    def merge(self, start: int, end: int) -> None:
        low, high = self._range(start, end)
        if low < high:
            start, end = min(start, self.starts[low]), max(end, self.ends[high - 1])
        self.starts[low:high] = [start]
        self.ends[low:high] = [end]


SPANS = "array<struct<kind:string,start:int,`end`:int,score:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                             ("score", pa.int32())]))


def find_pii(docs: DataFrame, least: int = 60, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(key, spans), one row for each row; spans as (kind, start, end, score).

    Addresses, dotted IPs, payment cards (Luhn) and international phone numbers are always
    reported, account numbers (country's length and mod 97), national numbers and local phone numbers
    if their score reaches ``least``. Places are code points of the whole text, the end is exclusive.
    A score in percent starts at the kind's own value; a word near the span (40 code points before,
    20 behind) that speaks for the kind raises it, one that speaks against it lowers it. Kinds
    without a checksum need such a word and never overlap a span that is reported in any case.

    A null or empty text has no spans. Rows with equal or null keys are rows of their own; further
    columns are not looked at. One pass, without a shuffle.
    """
    def work(batches):
        for batch in slices(batches, "text"):
            rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True))
                     for s in spans_of(t, least)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(rows, _SPANS)], names=["key", "spans"])

    shown = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = shown.schema["key"].dataType.simpleString()
    found = in_batches(shown, work, f"key {kind}, spans {SPANS}")
    return found.withColumnRenamed("key", key)


def redact(docs: DataFrame, least: int = 50, text: str = "text") -> DataFrame:
    """All columns of ``docs``, with spans of a score of ``least`` and more replaced by ``<KIND>``.

    Of overlapping spans the one with the higher score counts, then the one that starts first. A
    null text stays null.
    """
    def mask(value):
        if not value:
            return value
        ranked = sorted((s for s in spans_of(value, least) if s[3] >= least),
                        key=lambda s: (-s[3], s[1], s[2]))
        chosen, taken = [], Apart()
        for s in ranked:
            if not taken.meets(s[1], s[2]):
                taken.merge(s[1], s[2])
                chosen.append(s)
        out, at = [], 0
        for kind, start, end, _ in sorted(chosen, key=lambda s: s[1]):
            out += [value[at:start], f"<{kind.upper()}>"]
            at = end
        return "".join([*out, value[at:]])

    where = docs.columns.index(text)

    def work(batches):
        for batch in slices(batches, text):
            masked = pa.array([mask(t) for t in batch.column(where).to_pylist()], pa.string())
            yield batch.set_column(where, batch.schema.field(where).with_type(pa.string()), masked)

    return in_batches(docs, work, docs.schema)


def digest(spans) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))
