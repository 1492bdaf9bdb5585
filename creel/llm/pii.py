"""Personal data: proposed by regular expressions, confirmed by checksums, weighed by nearby words.

Every kind has a pattern that proposes spans, a test that confirms them (Luhn for
cards, mod-97 for account numbers, ranges for addresses) and a score that words before
and after raise or lower. Spans of the base kinds stay whatever their score; spans of
the other kinds stay if their score reaches LEAST and they overlap no base span.

All patterns take time in proportion to the text: no run of signs is begun again from
each of its places.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creel.llm import arrow

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "tel")
KINDS = BASE + ADDED
LEAST = 0.5
BEFORE, AFTER = 48, 24

LOCAL_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
TEL = re.compile(r"(?<![0-9+.,-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}[0-9]{2,4}){1,5}(?![0-9])")
NO_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[^\W\d_]+")

# fixed values: the length of account numbers by country (ISO 13616)
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18,
    "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: For each kind the score of a confirmed span without any word nearby.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "tel": 0.2}
RAISE, LOWER = 0.3, 0.3
# fixed values: words near a span that speak for its kind, in the four languages of the texts
FOR = {
    "email": "email mail e contact write courriel correo contacto kontakt schreiben".split(),
    "ip": "ip address host server login adresse direccion servidor".split(),
    "card": "card visa mastercard amex credit debit payment carte carta tarjeta karte kreditkarte zahlung".split(),
    "phone": "phone tel telephone mobile cell call fax whatsapp téléphone appelez portable teléfono móvil llame telefon handy anruf".split(),
    "iban": "iban account bank transfer compte banque virement cuenta banco transferencia konto überweisung".split(),
    "ssn": "ssn social security".split(),
}
FOR["tel"] = FOR["phone"]
# fixed values: words that speak against it
AGAINST = {
    "email": [],
    "ip": "version release chapter section kapitel chapitre capítulo".split(),
    "card": "isbn order invoice tracking serial commande bestellung pedido".split(),
    "phone": "isbn order invoice version".split(),
    "iban": [],
    "ssn": "isbn part order serial".split(),
    "tel": "isbn order invoice version date page".split(),
}


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    score: float


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A name of as many signs as stand before an at sign, back to the last address or at sign, then a domain with a dot."""
    free = 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        low = max(free, text.rfind("@", free, at) + 1)
        name = len(text[low:at]) - len(text[low:at].rstrip(LOCAL_SIGNS))
        if name:
            yield at - name, m.end()
            free = m.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    """The sum of the digits, every second from the right doubled and its digits added, is a multiple of ten."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(NO_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def mod97(account: str) -> bool:
    """With the first four signs at the end and letters as 10 to 35, the remainder by 97 is 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of known countries, in one run or in groups with single blanks between."""
    for m in IBAN.finditer(text):
        length = IBAN_LENGTH.get(m[0][:2])
        if length is None:
            continue
        signs, at = m[0], m.end()
        while len(signs) < length and at < len(text):
            step = 1 if text[at] == " " else 0
            c = text[at + step : at + step + 1]
            if not (c.isascii() and (c.isdigit() or c.isupper())):
                break
            signs, at = signs + c, at + step + 1
        if len(signs) == length and not text[at : at + 1].isalnum() and mod97(signs):
            yield m.start(), at


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def tels(text: str) -> Iterator[tuple[int, int]]:
    """National numbers of 9 to 12 digits; words nearby must speak for them."""
    for m in TEL.finditer(text):
        if 9 <= len(NO_DIGIT.sub("", m[0])) <= 12:
            yield m.span()


PROPOSED = dict(zip(KINDS, (emails, ips, cards, phones, ibans, ssns, tels), strict=True))


def score(kind: str, text: str, start: int, end: int) -> float:
    """The kind's prior, raised once by a word nearby that speaks for it and lowered once by one against it."""
    near = {w.lower() for part in (text[max(start - BEFORE, 0) : start], text[end : end + AFTER]) for w in WORD.findall(part)}
    moved = PRIOR[kind] + RAISE * (not near.isdisjoint(FOR[kind])) - LOWER * (not near.isdisjoint(AGAINST[kind]))
    return round(min(max(moved, 0.0), 1.0), 2)


def find(text: str | None) -> list[Span]:
    """All spans of a text by start and kind; places are counted in code points, the end is exclusive."""
    text = text or ""
    base = [Span(s, k, e, score(kind, text, s, e)) for k, kind in enumerate(BASE) for s, e in PROPOSED[kind](text)]
    base.sort()
    # ends may fall back where one kind's span lies within another's, so the farthest so far is kept
    starts, ends, far = [x.start for x in base], [], 0
    for x in base:
        ends.append(far := max(far, x.end))
    taken: list[Span] = []
    free = 0
    for s, k, e in sorted((s, len(BASE) + i, e) for i, kind in enumerate(ADDED) for s, e in PROPOSED[kind](text)):
        before = bisect_left(starts, e)
        if s < free or (before and ends[before - 1] > s):
            continue
        x = Span(s, k, e, score(KINDS[k], text, s, e))
        if x.score >= LEAST:
            taken.append(x)
            free = e
    return sorted(base + taken)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[x.kind]}:{x.start}:{x.end}" for x in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first stands for all."""
    if not spans:
        return text
    out, at = [], 0
    for x in spans:
        if x.start >= at:
            out += [text[at : x.start], f"[{KINDS[x.kind]}]"]
        at = max(at, x.end)
    return "".join([*out, text[at:]])


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text, one row for each row of docs.

    Returns the id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans
    (`kind:start:end`, by start and kind), scores (of the spans, in the same order) and
    redacted (the text without them). A null or empty text has no spans, a null text
    stays null. A null id stays null, repeated rows are repeated, an empty table gives
    no rows, and other columns are ignored. Every text is read whole, however long;
    texts are looked at one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "__text"):
            texts = batch.column("__text").to_pylist()
            found = [find(t) for t in texts]
            base = [[x for x in spans if x.kind < len(BASE)] for spans in found]
            columns = [batch.column("__id")]
            columns += [pa.array([sum(x.kind == k for x in spans) for spans in base], pa.int64()) for k in range(len(BASE))]
            columns.append(pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string()))
            columns.append(pa.array([joined(spans) for spans in found], pa.string()))
            columns.append(pa.array([",".join(f"{x.score:.2f}" for x in spans) for spans in found], pa.string()))
            columns.append(pa.array([redact(t, spans) for t, spans in zip(texts, found, strict=True)], pa.string()))
            yield pa.record_batch(columns, names=names)

    names = ["__id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "scores", "redacted"]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE)
    out = rows.mapInArrow(run, f"__id {kind}, {counts}, base_sha256 string, spans string, scores string, redacted string")
    return out.withColumnRenamed("__id", id_col)
