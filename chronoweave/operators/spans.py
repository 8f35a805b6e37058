"""Scored time spans of a text segment.

Everything happens inside the row: one regex scan per family, in-row de-duplication and ordering.
No shuffle is needed before the spans are exploded, and the best span is the first array element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import contains_any, find_all, let
from ..functions.dates import make_day, year_end, year_start

# Cue words, scores, weights and patterns of the span families.  The look-ahead in front of
# a word boundary changes no match; it skips the costly Unicode boundary test at most positions.
STRONG_CUES = ("im jahr", "im jahre", "während", "zur zeit", "zu dieser zeit")
MONTH_CUES = (
    "im november",
    "im dezember",
    "im februar",
    "im mai",
    "im juni",
    "im juli",
    "im august",
    "im september",
    "im oktober",
    "im märz",
    "im april",
)
STRONG_BOOST, MONTH_BOOST = 1.35, 1.10
CAPTION_WEIGHT, PICTURE_WEIGHT, PORTRAIT_WEIGHT, CAPTION_YEAR_WEIGHT = 0.18, 0.35, 0.22, 0.25
MINUTE_SCORE, DAY_SCORE, RANGE_SCORE, CENTURY_SCORE, YEAR_SCORE = 10.0, 9.0, 7.0, 5.0, 6.0
DAY_TIME_PATTERN = r"(?U)(?=\d)\b\d{1,2}\.\d{1,2}\.\d{4}\s+\d{1,2}:\d{2}\b"
DAY_PATTERN = r"(?U)(?=\d)\b\d{1,2}\.\d{1,2}\.\d{4}\b"
RANGE_PATTERN = r"(?U)(?=\d)\b\d{3,4}\s*[–-]\s*\d{2,4}\b"
CENTURY_PATTERN = r"(?iU)(?=\d)\b(\d{1,2})\.\s*Jahrhundert\b"
YEAR_PATTERN = r"(?U)(?=[12])\b(?:1\d{3}|20\d{2})\b"
CONTEXT_CHARS = 500


def cue_boost(low: Column) -> Column:
    strong = F.when(contains_any(low, STRONG_CUES), STRONG_BOOST).otherwise(1.0)
    return strong * F.when(contains_any(low, MONTH_CUES), MONTH_BOOST).otherwise(1.0)


def section_rules(low: Column, section: Column) -> tuple[Column, Column]:
    """(weight, review flag) of a segment; only captions are damped and flagged."""
    caption = section == "caption"
    picture = caption & low.contains("folgenbild") & low.contains("zeigt")
    portrait = caption & low.contains("portr") & low.contains("jahr")
    weight = (
        F.when(caption, CAPTION_WEIGHT).otherwise(1.0)
        * F.when(picture, PICTURE_WEIGHT).otherwise(1.0)
        * F.when(portrait, PORTRAIT_WEIGHT).otherwise(1.0)
    )
    flag = F.when(portrait, "caption-portrait-year").when(picture, "caption-folgenbild")
    return weight, flag


def span_array(text: Column, section: Column) -> Column:
    """``array<struct>`` of distinct spans, best score first, text order inside a family.

    Scores are constant per family within one segment, so ordering by score is a choice between
    two fixed family orders and needs no sort.
    """
    def segment_rules(low: Column) -> Column:
        weight, flag = section_rules(low, section)
        return F.struct(cue_boost(low).alias("boost"), weight.alias("weight"), flag.alias("flag"))

    def build(rules: Column) -> Column:
        def span(start, end, precision, qualifier, source, base):
            return F.struct(
                start.alias("start_date"),
                end.alias("end_date"),
                F.lit(precision).alias("precision"),
                F.lit(qualifier).alias("qualifier"),
                source.alias("source_text"),
                (base * rules["boost"] * rules["weight"]).alias("score"),
                rules["flag"].alias("review_flag"),
            )

        def day_of(match, then):
            """Bind the parsed parts once, then the date, then build the span from it."""

            def parts(p):
                return F.struct(*[F.get(p, i).cast("int").alias(n) for i, n in enumerate("dmy")])

            return let(
                let(F.split(match, "\\."), parts),
                lambda p: let(make_day(p["y"], p["m"], p["d"]), then),
            )

        def minute(match):
            def with_time(pieces):
                source = F.array_join(pieces, " ")
                return day_of(
                    F.get(pieces, 0),
                    lambda day: span(day, day, "minute", "exact", source, F.lit(MINUTE_SCORE)),
                )

            return let(F.split(match, r"(?U)\s+"), with_time)

        def exact_day(match):
            return day_of(match, lambda day: span(day, day, "day", "exact", match, F.lit(DAY_SCORE)))

        def year_range(match):
            def years(p):
                first, last = F.get(p, 0), F.get(p, 1)
                head = F.substring(first.cast("int").cast("string"), 1, 2)
                end_year = F.when(F.length(last) == 4, last).otherwise(F.concat(head, last)).cast("int")
                return F.struct(
                    first.cast("int").alias("start"),
                    end_year.alias("end"),
                    F.concat(first, F.lit("-"), last).alias("source"),
                )

            return let(
                let(F.split(match, r"(?U)\s*[–-]\s*"), years),
                lambda y: span(
                    year_start(y["start"]), year_end(y["end"]), "year", "range", y["source"], F.lit(RANGE_SCORE)
                ),
            )

        def century(number):
            n = number.cast("int")
            return span(
                year_start((n - 1) * 100 + 1),
                year_end(n * 100),
                "century",
                "range",
                F.concat(number, F.lit(". Jahrhundert")),
                F.lit(CENTURY_SCORE),
            )

        def single_year(match):
            year = match.cast("int")
            base = F.lit(YEAR_SCORE) * F.when(section == "caption", CAPTION_YEAR_WEIGHT).otherwise(1.0)
            return span(
                year_start(year),
                year_end(year),
                "year",
                "year",
                match,
                base,
            )

        def family(pattern, build, group=0):
            found = F.transform(F.array_distinct(find_all(text, pattern, group)), build)
            return F.filter(found, lambda s: s["start_date"].isNotNull() & s["end_date"].isNotNull())

        exact = F.concat(family(DAY_TIME_PATTERN, minute), family(DAY_PATTERN, exact_day))
        ranges = family(RANGE_PATTERN, year_range)
        centuries = family(CENTURY_PATTERN, century, 1)
        years = family(YEAR_PATTERN, single_year)
        return F.array_distinct(
            F.when(section == "caption", F.concat(exact, ranges, centuries, years)).otherwise(
                F.concat(exact, ranges, years, centuries)
            )
        )

    # the lower-cased text and the rule values are computed once per segment, not once per span
    return let(let(F.lower(text), segment_rules), build)


def extract_spans(
    segments: DataFrame, keys: list[str], text: str = "text", section: str = "section", context: int | None = CONTEXT_CHARS,
    best_only: bool = False, found: str | None = None,
) -> DataFrame:
    """One row per distinct span of every segment with its rank ``span_pos`` (best first) and the first
    ``context`` characters of the segment; None: all of it.  ``best_only``: the segment's best span alone.
    ``found``: the column that holds the result of :func:`span_array` already."""
    c = F.col(text)
    spans = span_array(c, F.col(section)) if found is None else F.col(found)
    rows = segments.select(
        *keys,
        F.col(section).alias("source_section"),
        (c if context is None else F.substring(c, 1, context)).alias("source_context"),
        F.posexplode(F.slice(spans, 1, 1) if best_only else spans).alias("span_pos", "span"),
    )
    return rows.select(*keys, "span_pos", "span.*", "source_section", "source_context")


def best_span(spans: DataFrame, key: str, order: list[str], score: str = "score") -> DataFrame:
    """Highest-scored span per key, earliest ``order`` on ties, by one partial aggregation."""
    row = F.struct(*[c for c in spans.columns if c != key])
    rank = F.struct((-F.col(score)).alias("neg"), *order)
    return (
        spans.groupBy(key).agg(F.min_by(row, rank).alias("best")).select(key, "best.*")
    )
