"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors of a text: at-signs, plus signs,
digits, ``://`` and identifier cues (``account``, ``iban``, ``ssn`` ...). Small
deterministic parsers then expand around each anchor and validate what they
find. Every parser is linear in the text: a digit run that cannot begin an
address is not tried again, and an at-sign looks back to the previous one only.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are exact: their spans are those of
a leftmost, non-overlapping search with the patterns below, less the matches
that fail validation. ``account`` (an identifier after a cue; IBANs pass mod 97),
``login`` (user data in a URL's authority) and ``secret`` (a quoted credential
after a cue) are the method's own.

Offsets are code points, ends exclusive. Null and empty texts have no span.
Repeated rows and repeated ids are judged row by row; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwash.llm.memo import forgetful

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "login", "secret")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-"
_USERINFO = re.compile(r"[^\s/?#@<>\"']+@[A-Za-z0-9.:\[\]-]+")
_ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|num|number|id)\b)?[\x20.:#=]{0,4}([A-Z]{0,4}[0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
_SECRET = re.compile(r"\s?[=:]\s?[\"']([^\s\"']{16,}+)[\"']")
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "compte", "cuenta", "customer id")
SECRET_CUES = ("token", "password", "passwd", "api_key", "apikey", "secret")


def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    auto.add_word("@", ("@", 1))
    auto.add_word("+", ("+", 1))
    auto.add_word("://", ("://", 3))
    for d in "0123456789":
        auto.add_word(d, ("0", 1))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                auto.add_word(form, (kind, len(form)))
    auto.make_automaton()
    return auto


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _iban(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find_spans(text: str, auto: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end), by start, then kind."""
    found: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = own_end = last_at = 0
    for last, (what, size) in auto.iter(text):
        if what == "0":
            if last >= ip_end:
                if m := _IP.match(text, last):
                    ip_end = m.end()
                    if all(map(_byte, m.groups())):
                        found.append(("ip", last, ip_end))
                else:  # no later start in this run of digits can match either
                    ip_end = _DIGITS.match(text, last).end()
            if last >= card_end and (m := _CARD.match(text, last)):
                card_end = m.end()
                if card_end - last <= 37:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and _luhn(digits):
                        found.append(("card", last, card_end))
        elif what == "@":
            left = text[max(email_end, last_at):last]
            local = len(left) - len(left.rstrip(_LOCAL))
            if local and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                found.append(("email", last - local, email_end))
            last_at = last + 1
        elif what == "+":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found.append(("phone", last, phone_end))
        elif what == "://":
            if m := _USERINFO.match(text, last + 1):
                start = last - 2
                head = text[max(own_end, start - 32):start]
                start -= len(head) - len(head.rstrip(_SCHEME))
                own_end = m.end()
                found.append(("login", start, own_end))
        else:
            start = last - size + 1
            if start >= own_end and not (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
                m = (_ACCOUNT if what == "account" else _SECRET).match(text, last + 1)
                if m and (what == "secret" or _account(text[start:last + 1], m.group(1))):
                    own_end = m.end()
                    found.append((what, m.start(1), m.end(1)))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return found


def _account(cue: str, code: str) -> bool:
    code = code.replace(" ", "").replace("-", "")
    if cue.lower() == "iban":
        return len(code) >= 15 and code[:2].isalpha() and code[2:4].isdigit() and _iban(code)
    return sum(c.isdigit() for c in code) >= 6


def _cleaned(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at, n = [], 0, 0
    while n < len(spans):
        kind, start, end = spans[n]
        n += 1
        while n < len(spans) and spans[n][1] < end:  # overlapping spans go as one
            end = max(end, spans[n][2])
            n += 1
        out += (text[at:start], f"[{kind.upper()}]")
        at = end
    return "".join((*out, text[at:]))


@F.arrow_udf(SPANS)
@forgetful
def _spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    auto = _automaton()
    for batch in batches:
        rows = ([{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py() or "", auto)] for t in batch)
        yield pa.array(rows, _SPANS_ARROW)


@F.arrow_udf(T.StringType())
@forgetful
def _redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    auto = _automaton()
    for batch in batches:
        texts = (t.as_py() for t in batch)
        yield pa.array((t if t is None else _cleaned(t, find_spans(t, auto)) for t in texts), pa.string())


def pii_spans(text: Column) -> Column:
    """Array of (kind, start, end) of a text column; empty for null."""
    return _spans(text)


def redacted(text: Column) -> Column:
    """The text with each span (overlapping ones as one) replaced by its kind
    in brackets, such as ``[EMAIL]``; null stays null."""
    return _redacted(text)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: counts by base kind, a digest of the base
    spans, and all spans as text."""
    found = df.select(F.col(id_col), pii_spans(F.col(text_col)).alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("s", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(id_col, *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
