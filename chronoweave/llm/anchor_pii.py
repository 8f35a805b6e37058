"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs, digits,
schemes and words that announce an identifier.  A small parser for each kind expands an anchor to
the left and right, and validates what it found.  No other part of the text is looked at.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

BASE = ("email", "ip", "card", "phone")
# Kinds of the method itself: a checked IBAN, an account number, and user data in an address.
ADDED = ("iban", "account", "userinfo")
KINDS = BASE + ADDED
_ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte", "passport")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){0,3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GAP = re.compile(r"(?:[ ]?(?:no|nr|number|num)\b\.?)?[ ]?[:#=]?[ ]?", re.ASCII | re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}")
_NUMBER = re.compile(r"[A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,17}(?![0-9])")
_USER = re.compile(r"[A-Za-z0-9._~%+-]+(?::[^\s/@]*)?(?=@)")


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for mark, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), *((str(d), "digit") for d in range(10))):
        a.add_word(mark, (kind, len(mark)))
    for cue in ("iban", *_ACCOUNT_CUES):
        for form in {cue, cue.title(), cue.upper()}:
            a.add_word(form, ("iban" if cue == "iban" else "account", len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def _iban(text: str, at: int) -> int:
    """End of the longest valid IBAN that begins at ``at``, or -1."""
    m = _IBAN.match(text, at)
    end = m.end() if m else -1
    while m and end - at >= 15:
        code = text[at:end].replace(" ", "")
        if 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return end
        end -= 1
    return -1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind.

    Base kinds are the leftmost non-overlapping matches of their patterns, dropped when they fail
    validation; added kinds come on top and never replace them.  NULL and empty texts have none.
    """
    spans: list[tuple[str, int, int]] = []
    if not text:
        return spans
    # Up to where each kind has used the text.
    email = ip = card = phone = account = 0
    for last, (kind, length) in automaton().iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= card:
                card = _DIGITS.match(text, at).end()
                if card - at >= 14:
                    digits = text[at:card].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        spans.append(("card", at, card))
            if at >= ip:
                ip = _DOTTED.match(text, at).end()
                parts = text[at:ip].split(".")
                if len(parts) == 4 and all(map(_byte, parts)):
                    spans.append(("ip", at, ip))
        elif kind == "at":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                email = m.end()
                spans.append(("email", start, email))
        elif kind == "plus":
            m = _PHONE.match(text, at) if at >= phone else None
            if m:
                phone = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", at, phone))
        elif kind == "scheme":
            m = _USER.match(text, last + 1)
            if m:
                spans.append(("userinfo", m.start(), m.end()))
        elif at >= account and (at == 0 or not text[at - 1].isalnum()):
            begin = _GAP.match(text, last + 1).end()
            if begin > last + 1:
                if (end := _iban(text, begin)) > 0:
                    spans.append(("iban", begin, end))
                    account = end
                elif kind == "account" and (m := _NUMBER.match(text, begin)):
                    spans.append(("account", begin, m.end()))
                    account = m.end()
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base kinds, digest of the base spans, all spans.

    NULL text counts as empty; other columns of ``docs`` are not read.
    """

    def run(c: dict):
        out = {"doc_id": c["doc_id"]} | {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": []}
        for text in c["text"].to_pylist():
            spans = find(text)
            base = [s for s in spans if s[0] in BASE]
            for k in BASE:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, {counts}, base_sha256 string, spans string")


def redacted(text: str | None) -> str | None:
    """``text`` with each run of overlapping spans replaced by the name of its first kind."""
    out, done = [], 0
    spans = find(text)
    for i, (kind, a, b) in enumerate(spans):
        if a < done:
            done = max(done, b)
            continue
        out.append(text[done:a] if i else text[:a])
        out.append(f"<{kind}>")
        done = b
    return "".join([*out, text[done:]]) if spans else text


def redact(docs: DataFrame, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in ``text``; ``chars``, when there, counts anew for changed texts.

    A NULL text stays NULL; all other columns are kept as they are.
    """

    def run(c: dict):
        before = c[text].to_pylist()
        after = [redacted(t) for t in before]
        out = c | {text: after}
        if chars in c:
            out[chars] = [n if a == b else len(b) for n, a, b in zip(c[chars].to_pylist(), before, after, strict=True)]
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(docs.select(*[F.col(f"`{c}`") for c in docs.columns]), run, schema)
