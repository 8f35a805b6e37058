"""Small column combinators shared by the text and extraction functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stable_id(*parts) -> Column:
    """128-bit id of a key's parts as hex text; NULL parts differ from empty ones."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\x00")) for p in parts]
    return F.md5(F.concat_ws("\x1f", *texts))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


# Every character of Unicode's White_Space property, which is (?U)\s.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks; only the ends are looked at."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def contains_any(c: Column, words) -> Column:
    """True when ``c`` contains at least one of the literal ``words``."""
    test = F.lit(False)
    for w in words:
        test = test | c.contains(w)
    return test


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of ``pattern``; NULL text gives an empty array."""
    return F.coalesce(
        F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>")
    )


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` or NULL when there is none."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def offset_at(lengths: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body(at)``, where ``at(i)`` is the start offset of piece ``i`` given the piece lengths.

    Lengths are added to block sums once; an offset is one of those plus at most 15 additions, made
    only for the places that are asked for.
    """
    block = 16

    def with_blocks(lens: Column) -> Column:
        n_blocks = F.ceil(F.size(lens) / F.lit(block)).cast("int")
        sums = F.when(
            n_blocks > 0,
            F.transform(
                F.sequence(F.lit(0), n_blocks - 1),
                lambda b: F.aggregate(
                    F.slice(lens, b * block + 1, F.lit(block)), F.lit(0), lambda a, x: a + x
                ),
            ),
        ).otherwise(F.array().cast("array<int>"))

        def with_starts(starts: Column) -> Column:
            def at(i: Column) -> Column:
                b = F.shiftright(i, 4)
                return F.aggregate(F.slice(lens, b * block + 1, i % block), F.get(starts, b), lambda a, x: a + x)

            return body(at)

        return let(
            sums,
            lambda s: let(
                F.transform(
                    s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i), F.lit(0), lambda a, x: a + x)
                ),
                with_starts,
            ),
        )

    return let(lengths, with_blocks)


def running_offsets(lengths: Column) -> Column:
    """Start offset of every piece given the piece lengths, in near-linear time.

    Offsets are block sums plus at most 15 additions, so a text of 100,000 words stays cheap.
    """
    return let(lengths, lambda lens: offset_at(lens, lambda at: F.transform(lens, lambda _, i: at(i))))
