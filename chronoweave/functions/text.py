"""HTML-to-text, boilerplate cleaning, segmenting and key normalising as column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import contains_any, let, strip

# Names that the HTML standard reads without their closing semicolon too.
UNCLOSED = tuple(n for n in html5 if not n.endswith(";"))

# Cut marks and line markers of promotional text.
AD_SEPARATORS = ("+++++", "**********")
FOOTER_MARKERS = (
    "instagram",
    "tiktok",
    "facebook",
    "wenn euch",
    "abonniert",
    "noch mehr",
    "deutschlandfunk app",
    "campfire",
    "werbepartner",
    "werbung",
)
LINE_BREAK = "\\R|[\\x1c-\\x1e]"


def _named_entities() -> Column:
    """name -> character map of the HTML standard, as one constant-folded literal."""
    table = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _unclosed_entities(names: Iterable[str]) -> str:
    return "^(" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + ")"


def _code_point(n: Column) -> Column:
    """Character of a numeric reference; C1 numbers read as Windows-1252, bad ones as U+FFFD."""
    c1 = {
        code: bytes([code]).decode("cp1252", errors="ignore") or chr(code)
        for code in range(0x80, 0xA0)
    }
    c1_map = F.from_json(F.lit(json.dumps(c1)), "map<string,string>")
    bad = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return (
        F.when(bad, F.lit("�"))
        .when(n.between(0x80, 0x9F), F.element_at(c1_map, n.cast("string")))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def unescape_html(c: Column, unclosed: Iterable[str] = UNCLOSED) -> Column:
    """Resolve character references in a single pass, so ``&amp;lt;`` becomes ``&lt;``.

    A reference without its semicolon is resolved if its name is one of ``unclosed``; others stay text.
    """
    numeric = r"^#([0-9]+|[xX][0-9a-fA-F]+);?"

    def piece(seg: Column) -> Column:
        raw = F.regexp_extract(seg, numeric, 0)
        digits = F.regexp_extract(seg, numeric, 1)
        short = F.regexp_replace(digits, "^[xX]?0*", "")
        is_hex = F.lower(digits).startswith("x")
        # more digits than any code point has read as number 0, which is a bad one
        fits = (short != "") & (F.length(short) <= F.when(is_hex, 6).otherwise(7))
        code = (
            F.when(~fits, "0").when(is_hex, F.conv(short, 16, 10)).otherwise(short).try_cast("bigint")
        )
        name = F.regexp_extract(seg, r"^([A-Za-z][A-Za-z0-9]{0,31});", 1)
        known = F.try_element_at(_named_entities(), name)
        open_name = F.regexp_extract(seg, _unclosed_entities(unclosed), 1)
        return (
            F.when(seg.startswith("amp;"), F.concat(F.lit("&"), F.substr(seg, F.lit(5))))
            .when(raw != "", F.concat(_code_point(code), F.substr(seg, F.length(raw) + 1)))
            .when(
                (name != "") & known.isNotNull(),
                F.concat(known, F.substr(seg, F.length(name) + 2)),
            )
            .when(
                open_name != "",
                F.concat(
                    F.element_at(_named_entities(), open_name),
                    F.substr(seg, F.length(open_name) + 1),
                ),
            )
            .otherwise(F.concat(F.lit("&"), seg))
        )

    segments = F.split(c, "&", -1)
    resolved = F.array_join(F.transform(segments, lambda s, i: F.when(i == 0, s).otherwise(piece(s))), "")
    return F.when(c.contains("&"), resolved).otherwise(c)


def _replaced(c: Column, marks: tuple[str, ...], pattern: str, to: str) -> Column:
    """``pattern`` replaced in texts that hold one of ``marks``, without which there is no match."""
    return let(c, lambda t: F.when(contains_any(t, marks), F.regexp_replace(t, pattern, to)).otherwise(t))


def html_to_text(c: Column, unclosed: Iterable[str] = UNCLOSED) -> Column:
    """Readable text: references resolved first, breaks kept as newlines, tags dropped."""
    t = unescape_html(F.coalesce(c, F.lit("")), unclosed)
    t = _replaced(t, ("<",), r"(?iU)<\s*br\s*/?\s*>", "\n")
    t = _replaced(t, ("</",), r"(?iU)</p\s*>", "\n")
    t = _replaced(t, ("<",), r"<[^>]+>", "")
    t = _replaced(t, ("\n\n\n",), r"\n{3,}", "\n\n")
    t = _replaced(t, ("  ", "\t"), r"[ \t]{2,}", " ")
    return strip(t)


def strip_tags(c: Column, unclosed: Iterable[str] = UNCLOSED) -> Column:
    """One-line text: tags become blanks, then references are resolved and blanks collapsed."""
    t = unescape_html(F.regexp_replace(c, r"<[^>]+>", " "), unclosed)
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def sanitize_description(c: Column, unclosed: Iterable[str] = UNCLOSED) -> Column:
    """Reference-resolved text with tags removed and nothing put in their place."""
    return strip(F.regexp_replace(unescape_html(F.coalesce(c, F.lit("")), unclosed), r"<[^>]+>", ""))


def clean_description(c: Column) -> Column:
    """Body text without advertising blocks, footer lines and blank lines."""
    t = html_to_text(c)
    for mark in AD_SEPARATORS:
        t = F.substring_index(t, mark, 1)
    lines = F.transform(F.split(t, LINE_BREAK), strip)
    kept = F.filter(
        lines, lambda s: (s != "") & ~let(F.lower(s), lambda low: contains_any(low, FOOTER_MARKERS))
    )
    return F.array_join(kept, "\n")


def segments(c: Column) -> Column:
    """Blank-line blocks as ``array<struct<section,text>>``."""

    def block(b: Column) -> Column:
        return let(F.lower(b), lambda low: tagged(b, low))

    def tagged(b: Column, low: Column) -> Column:
        section = (
            F.when(low.contains("folgenbild") & low.contains("zeigt"), "caption")
            .when(low.startswith("das erwartet") | low.startswith("ihr hört"), "outline")
            .otherwise("main")
        )
        return F.struct(section.alias("section"), b.alias("text"))

    blocks = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)\n\s*\n"), strip)
    return F.transform(F.filter(blocks, lambda b: b != ""), block)


def norm_key(c: Column) -> Column:
    """Lookup key of a place name."""
    low = F.lower(strip(c))
    t = F.regexp_replace(low, r"(?U)[\s\-_/]+", " ")
    t = F.regexp_replace(t, r"[^a-z0-9äöüß ]+", "")
    # most names are a plain word already
    return F.when(low.rlike(r"^[a-z0-9äöüß]*\z"), low).otherwise(F.regexp_replace(t, r"\s{2,}", " "))


def first_line(c: Column, width: int | None = None) -> Column:
    line = F.regexp_extract(c, r"^[^\n]*", 0)
    return line if width is None else F.substring(line, 1, width)


def word_tokens(c: Column) -> Column:
    """Lower-cased letter/digit runs."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


__all__ = [
    "AD_SEPARATORS",
    "FOOTER_MARKERS",
    "UNCLOSED",
    "clean_description",
    "first_line",
    "html_to_text",
    "let",
    "norm_key",
    "sanitize_description",
    "segments",
    "strip_tags",
    "unescape_html",
    "word_tokens",
]
