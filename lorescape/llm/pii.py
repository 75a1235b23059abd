"""Personal data: patterns propose spans, checksums confirm them, words near by move the score.

Kinds, in the order in which spans with one start are listed: email, ip, card, phone, iban. For each kind matches are
leftmost and don't overlap; matches of different kinds may. A card needs 14 to 19 digits that pass the Luhn test, an IBAN
15 to 34 characters that pass mod 97, an ip four parts of at most 255, a phone 10 to 15 digits. A match that fails is
dropped, and the search goes on behind it; only an IBAN may end before capitals or digits that follow it, at its country's
length or, of an unknown country, at the last group that lets it pass. The first four kinds are always reported; an IBAN is when its score reaches
IBAN_SCORE. Offsets count code points, and the end is exclusive.

All patterns need time in proportion to the text, whatever it holds (long runs of digits or letters, too).

Defined cases: null and empty texts have no spans; repeated rows are scanned each by itself; an empty table gives an empty
table; columns other than the two named ones aren't read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from lorescape.llm.shared import per_slice, per_text

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long, scores string, max_score double"
)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # starting inside a run of digits can't help, so only its start is tried
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an account number by country.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

#: Score of a confirmed span without context, and the words that raise it when they stand within CONTEXT characters before.
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.85, "phone": 0.6, "iban": 0.9}
CONTEXT = 48
RAISING = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login|from)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|debit|visa|mastercard|amex|pay|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|contact)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|transfer|compte|cuenta)\b", re.I),
}
LOWERING = re.compile(r"\b(?:version|release|build|order|invoice|serial|isbn|example|test|sample|dummy)\b", re.I)
STEP = 0.15
IBAN_SCORE = 0.7


def luhn(digits: str) -> bool:
    """True if every second digit from the right, doubled, and the others sum to a multiple of ten."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """True if the account number, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each @, so that long words cost nothing: the local part is the run of its characters before the @."""
    out, floor = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255
    return [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15] if "+" in text else []


def ibans(text: str) -> list[tuple[int, int]]:
    """Behind a match that fails the search goes on at its second character: what it swallowed may hold an account number."""
    out, at = [], 0
    while m := IBAN.search(text, at):
        end = iban_end(m[0])
        if end:
            out.append((m.start(), m.start() + end))
        at = m.start() + (end or 1)
    return out


def iban_end(run: str) -> int | None:
    """Where the account number ends that a run of groups starts with: only the groups up to there pass mod 97.

    Of a known country that is its length, else the whole run; of others the longest run of whole groups that passes.
    """
    ends = [i for i in range(len(run), 14, -1) if run[i : i + 1] in ("", " ")]
    sized = [(i, run[:i].replace(" ", "")) for i in ends]
    if n := IBAN_LENGTHS.get(run[:2]):
        sized = [x for x in sized if len(x[1]) == n] + sized[:1]
    return next((i for i, plain in sized if len(plain) >= 15 and mod97(plain)), None)


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans}


def score(text: str, kind: str, start: int) -> float:
    """The kind's score, a step up for a word of its own before the span and a step down for one that speaks against it."""
    before = text[max(0, start - CONTEXT) : start]
    return round(min(1.0, max(0.0, BASE_SCORE[kind] + STEP * bool(RAISING[kind].search(before)) - STEP * bool(LOWERING.search(before)))), 2)


def find(text: str) -> list[tuple[int, int, int, float]]:
    """All spans of a text as (start, place in KINDS, end, score), in that order."""
    found = []
    for k, kind in enumerate(KINDS):
        for start, end in FINDERS[kind](text):
            s = score(text, kind, start)
            if kind in BASE_KINDS or s >= IBAN_SCORE:
                found.append((start, k, end, s))
    return sorted(found)


def listed(spans: list[tuple[int, int, int, float]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans if KINDS[k] in kinds)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document with counts by kind, all spans, their scores, and the SHA-256 of the base kinds' spans."""

    def work(keys: list, texts: list[str]) -> dict:
        found = [find(t) for t in texts]
        out = {"doc_id": keys, **{f"n_{kind}": [sum(x[1] == k for x in spans) for spans in found] for k, kind in enumerate(KINDS)}}
        return out | {
            "base_sha256": [hashlib.sha256(listed(x, BASE_KINDS).encode()).hexdigest() for x in found],
            "spans": [listed(x, KINDS) for x in found],
            "scores": [",".join(f"{s[3]:.2f}" for s in x) for x in found],
            "max_score": [max((s[3] for s in x), default=0.0) for x in found],
        }

    return per_text(docs, SCHEMA, lambda: work, key, text)


def redacted(text: str, least: float = 0.0) -> str:
    """The text with each span of at least that score replaced by its kind in brackets; overlapping spans become one."""
    out, at, end = [], 0, 0
    for start, k, stop, s in find(text):
        if s < least:
            continue
        if start >= end:
            out += [text[at:start], f"[{KINDS[k].upper()}]"]
        end = at = max(end, stop)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, least: float = 0.0, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced in the text; a null text stays null."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        at = part.schema.get_field_index(text)
        clean = [None if t is None else redacted(t, least) for t in part.column(at).to_pylist()]
        return part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))

    return per_slice(docs, text, lambda: work)
