"""Personal data: patterns propose spans, checksums confirm them, and words nearby adjust a score.

Each kind has a pattern, a validator and a prior score; a context word within 48 characters before a span raises its
score.  Spans of the four base kinds are kept once they pass their validator.  The further kinds, ``iban`` (mod-97)
and ``number`` (7 to 15 digits without a plus, which only words nearby make personal), must reach ACCEPT as well.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, frugal, slices_of, texts_of, with_column
from .spans import digest, joined, merged, overlaps

KINDS = ("email", "ip", "card", "phone", "iban", "number")
ACCEPT = 0.8
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.9, "number": 0.4}
NEAR = 48
BOOST = 0.45
CONTEXT = {
    "email": ("mail", "contact", "correo"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "number": ("phone", "tel", "call", "fax", "mobile", "telefon", "teléfono", "téléphone", "passport", "ssn"),
}
WORDS = {k: re.compile(r"(?<!\w)(?:" + "|".join(v) + r")(?!\w)", re.IGNORECASE) for k, v in CONTEXT.items()}

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits: if it could, the run's start would match as well.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(number)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, from each at sign outwards, so that long words cost no repeated tries."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", at + 1)
    return out


def propose(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds that pass their validators, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    cards = [(m.start(), m.end()) for m in CARD.finditer(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    if cards:
        out += [("card", a, b) for a, b in cards if b - a >= 13 and 13 <= len(d := digits(text[a:b])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def score(text: str, kind: str, start: int) -> float:
    near = WORDS[kind].search(text, max(0, start - NEAR), start)
    return round(min(1.0, PRIOR[kind] + BOOST * bool(near)), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans as (kind, start, end, score) by kind and start, base kinds first."""
    base = propose(text)
    taken = [(a, b) for _, a, b in base]
    more = []
    for m in IBAN.finditer(text):
        if mod97(m[0]) and not overlaps(m.span(), taken):
            more.append(("iban", *m.span()))
    taken += [(a, b) for _, a, b in more]
    for m in CARD.finditer(text):
        if 7 <= m.end() - m.start() <= 30 and 7 <= len(digits(m[0])) <= 15 and score(text, "number", m.start()) >= ACCEPT and not overlaps(m.span(), taken):
            more.append(("number", *m.span()))
    return [(k, a, b, score(text, k, a)) for k, a, b in base] + [(*s, score(text, s[0], s[1])) for s in more]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, score>> of each whole text; offsets in code points, end exclusive.

    Null and empty texts have no spans.  Row for row, without a shuffle; further columns are dropped, repeated rows stay.
    """

    def run(batch: pa.RecordBatch) -> dict:
        found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)] for t in texts_of(batch)]
        return {"doc_id": batch.column(0), "spans": found}

    return arrow_map(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), run, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>")


def masked(text: str) -> str:
    """The text with each span, overlapping ones joined, replaced by its kind in angle brackets."""
    found = find(text)
    out, at = [], 0
    for a, b in merged([(a, b) for _, a, b, _ in found]):
        kind = next(k for k, x, y, _ in found if a <= x < b)
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced; null stays null, other columns and rows stay as they are."""

    def run(batches):
        for batch in slices_of(batches):
            texts = batch.column(text_col).to_pylist()
            yield with_column(batch, text_col, [None if t is None else masked(t) for t in texts])

    return docs.mapInArrow(frugal(run), docs.schema)


def digest_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: counts and digests of what find() gives."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for t in texts_of(batch):
            found = find(t)
            base = [s for s in found if s[0] in KINDS[:4]]
            for k in KINDS[:4]:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(digest(base))
            out["spans"].append(joined(found))
        return {"doc_id": batch.column(0), **out}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
