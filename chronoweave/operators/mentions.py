"""Year and year-range mentions with signed years, and the primary time of a text.

Matches and the gaps between them come from two plain scans, so the arrays are as long as the number
of mentions, not as the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import find_all, let, running_offsets
from ..functions.numeric import expand_end_by_century

# Mention patterns.
RANGE = r"\d{3,4}\s*[\-–—]\s*\d{2,4}"
BC_YEAR = r"(?=\d)\b\d{1,4}\s*(?:v\.?\s*Chr\.?|BC|BCE)\b"
PLAIN_YEAR = r"(?=\d)\b\d{3,4}\b"


def _located(text: Column, pattern: str) -> Column:
    """``array<struct<start,end,hit>>`` of all matches; the text between them gives the offsets."""
    pattern = f"(?iU){pattern}"

    def place(hits: Column) -> Column:
        return let(
            F.split(text, pattern, -1),
            lambda gaps: let(
                running_offsets(F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))),
                lambda at: F.transform(
                    hits,
                    lambda h, i: F.struct(
                        (F.get(at, i) + F.length(F.get(gaps, i))).alias("start"),
                        (F.get(at, i) + F.length(F.get(gaps, i)) + F.length(h)).alias("end"),
                        h.alias("hit"),
                    ),
                ),
            ),
        )

    return let(
        find_all(text, pattern),
        lambda hits: F.when(F.size(hits) > 0, place(hits)).otherwise(
            F.array().cast("array<struct<start:int,end:int,hit:string>>")
        ),
    )


def time_mention_array(text: Column) -> Column:
    """Mentions in (start, end) order: ``kind, year, start_year, end_year, start, end``."""
    no_year = F.lit(None).cast("int")

    def as_range(m: Column) -> Column:
        def ends(parts: Column) -> Column:
            return F.struct(F.get(parts, 0).cast("int").alias("first"), F.get(parts, 1).cast("int").alias("last"))

        return let(
            let(F.split(m["hit"], r"(?U)\s*[\-–—]\s*"), ends),
            lambda e: F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                F.lit("range_year").alias("kind"),
                no_year.alias("year"),
                e["first"].alias("start_year"),
                expand_end_by_century(e["first"], e["last"]).cast("int").alias("end_year"),
            ),
        )

    def as_year(m: Column, digits: Column, end: Column, sign: int) -> Column:
        return F.struct(
            m["start"].alias("start"),
            end.alias("end"),
            F.lit("year").alias("kind"),
            (F.lit(sign) * digits.cast("int")).alias("year"),
            no_year.alias("start_year"),
            no_year.alias("end_year"),
        )

    def mentioned(m: Column) -> Column:
        """A range, a plain year, or a year BC, of which the digits alone may be a plain year as well."""
        hit, digits = m["hit"], F.regexp_extract(m["hit"], r"\d+", 0)
        plain, bc = as_year(m, digits, m["start"] + F.length(digits), 1), as_year(m, digits, m["end"], -1)
        years = F.when(hit.rlike(r"(?U)^\d+$"), F.array(plain)).when(hit.rlike(r"(?U)^\d{3,4}\b"), F.array(plain, bc))
        return F.when(hit.rlike(r"[\-–—]"), F.array(as_range(m))).otherwise(years.otherwise(F.array(bc)))

    # no match of the other kinds hides a range or a year that begins later
    return F.flatten(F.transform(_located(text, f"{RANGE}|{BC_YEAR}|{PLAIN_YEAR}"), mentioned))


def extract_time_mentions(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return docs.select(*keys, F.posexplode(time_mention_array(F.col(text))).alias("mention_pos", "m")).select(
        *keys, "mention_pos", "m.*"
    )


def primary_time(text: Column) -> Column:
    """``struct<kind,year,start_year,end_year>``: first year, else first range, else unknown.

    One scan for the three patterns ends at the first match; only where that is a range, all matches
    are read.  No year's match hides a range that begins later, and a plain year goes before a year
    BC of the same place, so the first of them is the first of the sorted mentions.
    """
    pattern = f"(?iU){RANGE}|{PLAIN_YEAR}|{BC_YEAR}"

    def is_range(hit: Column) -> Column:
        return hit.rlike(r"[\-–—]")

    def first_year(hits: Column) -> Column:
        return F.coalesce(F.get(F.filter(hits, lambda h: ~is_range(h)), 0), F.get(hits, 0))

    def pick(hit: Column) -> Column:
        no_year = F.lit(None).cast("int")
        span, found = is_range(hit), hit != ""
        parts = F.split(hit, r"(?U)\s*[\-–—]\s*")
        first, last = F.get(parts, 0).cast("int"), F.get(parts, 1).cast("int")
        year = F.regexp_extract(hit, r"\d+", 0).cast("int")
        return F.struct(
            F.when(span, "range").when(found, "point").otherwise("unknown").alias("kind"),
            F.when(found & ~span, F.when(hit.rlike(r"(?U)^\d+$"), year).otherwise(-year)).otherwise(no_year).alias("year"),
            F.when(span, first).alias("start_year"),
            F.when(span, expand_end_by_century(first, last).cast("int")).alias("end_year"),
        )

    first_hit = F.coalesce(F.regexp_extract(text, pattern, 0), F.lit(""))
    return let(let(first_hit, lambda h: F.when(is_range(h), let(find_all(text, pattern), first_year)).otherwise(h)), pick)
