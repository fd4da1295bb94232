"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, ASCII
digits, URL schemes and identifier cues. A deterministic local parser belongs to
each anchor: it expands from there to the left and right, validates what it
found (octets, Luhn, digit counts, IBAN check digits, host names) and fixes the
boundaries. No pattern is run over the whole text.

Kinds, in the order of ties: ``email``, ``ip``, ``card``, ``phone`` (the base
kinds), then the spans that the method adds: ``url`` (scheme with host) and
``account`` (IBAN, or digits behind an account cue).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from plumbline.llm.common import slices, texts, trim

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "HTTP://", "HTTPS://", "FTP://")
CUES = ("IBAN", "iban", "Iban", "account", "Account", "ACCOUNT", "acct", "Acct", "ACCT", "Konto", "KONTO", "cuenta", "Cuenta", "compte", "Compte")
DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
WORD = DIGITS | LETTERS
LABEL = WORD | {"-"}
LOCAL = DIGITS | LETTERS | frozenset("._%+-")
PHONE = DIGITS | frozenset(" ().-")
URL_END = frozenset(" \t\r\n\x0b\x0c<>\"'`{}|\\^")
ACCOUNT_DIGITS = (6, 18)
#: Characters that may stand between a cue and its number: "no.", "number:", "#", ...
CUE_GAP = 12


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in ("@", "+", *sorted(DIGITS), *SCHEMES, *CUES):
        found.add_word(mark, mark)
    found.make_automaton()
    return found


def _span(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters from ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, sign: int, floor: int) -> tuple[int, int] | None:
    start = sign
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _span(text, sign + 1, LABEL)
    if start == sign or end == sign + 1:
        return None
    labels = 0
    while text[end : end + 1] == "." and (more := _span(text, end + 1, LABEL)) > end + 1:
        end, labels = more, labels + 1
    return (start, end) if labels else None


def _ips(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Valid addresses in the chain of dotted digit runs from ``at``, four runs at a time; and where the chain ends."""
    runs = [(at, _span(text, at, DIGITS))]
    while text[runs[-1][1] : runs[-1][1] + 1] == "." and (end := _span(text, runs[-1][1] + 1, DIGITS)) > runs[-1][1] + 1:
        runs.append((runs[-1][1] + 1, end))
    found = []
    for k in range(0, len(runs) - 3, 4):
        if all(_at_most_255(text[a:b]) for a, b in runs[k : k + 4]):
            found.append((runs[k][0], runs[k + 3][1]))
    return found, runs[-1][1]


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _chain(text: str, at: int) -> tuple[int, int]:
    """End and number of digits of the chain of digits with single blanks or hyphens between."""
    n, digits = len(text), 0
    while at < n and text[at] in DIGITS:
        digits += 1
        at += 1
        if at + 1 < n and text[at] in " -" and text[at + 1] in DIGITS:
            at += 1
    return at, digits


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    if text[plus + 1 : plus + 2] not in DIGITS or plus + 1 >= len(text):
        return None
    end = _span(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end < plus + 4 or text[end - 1] not in DIGITS:
        return None
    return plus, end


def _url(text: str, start: int, scheme: str) -> tuple[int, int] | None:
    host = start + len(scheme)
    if text[host : host + 1] not in LABEL or host >= len(text):
        return None
    end, n = host, len(text)
    while end < n and text[end] not in URL_END:
        end += 1
    while end > host and text[end - 1] in ".,;:!?)]":
        end -= 1
    return start, end


def iban(code: str) -> bool:
    """ISO 13616: two letters, two check digits, 11 to 30 more, remainder 1 modulo 97."""
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _iban(text: str, at: int) -> int | None:
    """End of the longest IBAN from ``at``, in words with single blanks between; its first four characters are looked at first."""
    n, code, end, best = len(text), "", at, None
    while end < n and len(code) < 34:
        if text[end] in WORD:
            code += text[end].upper()
            end += 1
            if len(code) == 2 and not code.isalpha() or len(code) == 4 and not code[2:].isdigit():
                return None
            if len(code) >= 15 and (end == n or text[end] not in WORD) and iban(code):
                best = end
        elif text[end] == " " and end + 1 < n and text[end + 1] in WORD:
            end += 1
        else:
            break
    return best


def _account(text: str, after: int) -> tuple[int, int] | None:
    """The first IBAN or run of account digits that begins within ``CUE_GAP`` characters behind a cue."""
    for at in range(after, min(len(text), after + CUE_GAP)):
        if text[at] in WORD and text[at - 1] not in WORD:
            if text[at] in DIGITS:
                end, digits = _chain(text, at)
                return (at, end) if ACCOUNT_DIGITS[0] <= digits <= ACCOUNT_DIGITS[1] else None
            if best := _iban(text, at):
                return at, best
    return None


def find_spans(text: str, automaton: ahocorasick.Automaton | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then kind as listed, then end."""
    out: list[tuple[str, int, int]] = []
    floor = {"email": 0, "ip": 0, "card": 0, "phone": 0, "url": 0, "account": 0}
    for last, mark in (automaton or _automaton()).iter(text):
        if mark in DIGITS:
            if last >= floor["ip"]:
                found, floor["ip"] = _ips(text, last)
                out += [("ip", *x) for x in found]
            if last >= floor["card"]:
                end, n = _chain(text, last)
                floor["card"] = end
                if 14 <= n <= 19 and luhn("".join(c for c in text[last:end] if c in DIGITS)):
                    out.append(("card", last, end))
        elif mark == "@":
            if span := _email(text, last, floor["email"]):
                floor["email"] = span[1]
                out.append(("email", *span))
        elif mark == "+":
            if last >= floor["phone"] and (span := _phone(text, last)):
                floor["phone"] = span[1]
                if 10 <= sum(c in DIGITS for c in text[span[0] : span[1]]) <= 15:
                    out.append(("phone", *span))
        elif mark in SCHEMES:
            start = last + 1 - len(mark)
            if start >= floor["url"] and (span := _url(text, start, mark)):
                floor["url"] = span[1]
                out.append(("url", *span))
        elif last + 1 >= floor["account"] and (span := _account(text, last + 1)):
            floor["account"] = span[1]
            out.append(("account", *span))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_email, n_ip, n_card, n_phone, n_url, n_account, base_sha256, spans.

    A null or empty text has no spans. Repeated rows give repeated results, an
    empty table none. The time is linear in a text's length; very long texts are
    taken one by one. Other columns are ignored.
    """
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType)])
    for kind in BASE:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_url", "long").add("n_account", "long")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton()
        for batch in (part for whole in batches for part in slices(whole, "text")):
            found = [find_spans(t, automaton) for t in texts(batch["text"])]
            out = {"doc_id": batch["doc_id"]} | {f"n_{k}": [sum(s[0] == k for s in x) for x in found] for k in KINDS}
            out["base_sha256"] = [hashlib.sha256(written([s for s in x if s[0] in BASE]).encode()).hexdigest() for x in found]
            out["spans"] = [written(x) for x in found]
            yield pd.DataFrame(out)[schema.fieldNames()]

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(look, schema).withColumnRenamed("doc_id", id_col)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"[{kind.upper()}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; all columns and rows stay, null stays null."""

    @F.pandas_udf("string")
    def clean(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton()
        for column in columns:
            yield pd.Series([redact_text(t, find_spans(t, automaton)) if isinstance(t, str) else None for t in column], dtype="object")
        trim()

    return docs.withColumn(text_col, clean(F.col(text_col)))
