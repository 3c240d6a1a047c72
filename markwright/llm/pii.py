"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Kinds: email, ip, card (Luhn), phone, and besides these iban (ISO 13616 account numbers, mod 97). Every proposal that passes
its kind's validator has a base score; context words within CONTEXT characters before it raise the score, words that speak
against personal data lower it. Spans of the four base kinds stay whatever their score; an account number needs LEAST.
All searches take time linear in the text, however long a run of digits or letters is.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, read

KINDS = ("email", "ip", "card", "phone", "iban")
CONTEXT = 40
LEAST = 0.5
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.8}
UP, DOWN = 0.15, 0.35
#: Words that speak for a kind, and words that speak against personal data of any kind.
FOR = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "client"),
    "card": ("card", "visa", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
AGAINST = ("version", "isbn", "order", "serial", "example", "test")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_WORDS = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064 over the account number with its first four characters moved to the end, letters as 10 to 35."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str):
    """An address is a maximal run before an @ (not reaching into the match before it) and the longest domain after it."""
    done = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            done = m.end()
            yield start, done


def ips(text: str):
    """Of each maximal dotted chain of numbers, four parts at a time from its left."""
    for m in _DOTTED.finditer(text):
        found = m[0].split(".")
        at = m.start()
        for k in range(0, len(found) - 3, 4):
            four = found[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def ibans(text: str):
    for m in _IBAN.finditer(text):
        if 15 <= len(raw := m[0].replace(" ", "")) <= 34 and mod97(raw):
            yield m.span()


def score(kind: str, text: str, start: int) -> float:
    near = {w.lower() for w in _WORDS.findall(text[max(0, start - CONTEXT) : start])}
    s = SCORES[kind] + (UP if near.intersection(FOR[kind]) else 0) - (DOWN if near.intersection(AGAINST) else 0)
    return round(min(1.0, max(0.0, s)), 2)


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), kinds in the order of KINDS, then by start; code points, end exclusive."""
    text = text or ""
    out = []
    for kind, find in zip(KINDS, (emails, ips, cards, phones, ibans), strict=True):
        for start, end in find(text):
            s = score(kind, text, start)
            if kind != "iban" or s >= LEAST:
                out.append((kind, start, end, s))
    return out


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, score>> of each document. A null text has no spans; overlapping spans of
    different kinds all stay; rows that repeat an id each get their own row; other columns are not read."""

    def work(rows):
        for doc_id, text in rows:
            yield doc_id, [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans_of(text)]

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>")


def redact(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """`docs` with its columns; in `text`, spans scored `least` or more are replaced by their kind in brackets, overlapping
    ones together under the kind that starts first. Null texts stay null."""
    at = docs.columns.index("text")

    def work(rows):
        for row in rows:
            text = row[at]
            if text:
                out, done = [], 0
                for kind, a, b, _ in sorted((x for x in spans_of(text) if x[3] >= least), key=lambda x: (x[1], -x[2])):
                    if a >= done:
                        out += [text[done:a], f"[{kind}]"]
                    done = max(done, b)
                text = "".join([*out, text[done:]])
            yield (*row[:at], text, *row[at + 1 :])

    return map_rows(docs, work, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the counts and places of personal data in its whole text. Null texts have none."""
    def work(rows):
        for doc_id, text in rows:
            found = spans_of(text)
            kinds = [x[0] for x in found]
            line = [f"{k}:{a}:{b}" for k, a, b, _ in found]
            base = ",".join(x for x in line if not x.startswith("iban"))
            yield doc_id, *(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(base.encode()).hexdigest(), ",".join(line)

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return map_rows(docs, work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
