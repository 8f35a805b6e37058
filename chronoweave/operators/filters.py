"""Composable predicates over episodes and spans."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ordered_pair


def ascii_lower(text: str) -> str:
    return text.translate(str.maketrans(ascii_uppercase, ascii_lowercase))


@dataclass(frozen=True)
class EpisodeFilter:
    """Conjunction of optional criteria; an unset criterion keeps every row.

    ``q`` is matched, ASCII letters in either case, inside title or description, with ``%`` and ``_`` acting as
    wildcards.  Dates compare the UTC day and are inclusive; ``bbox`` is
    (min_lon, min_lat, max_lon, max_lat), inclusive, and drops rows without coordinates.
    """

    podcast_id: str | None = None
    q: str | None = None
    date_start: str | None = None
    date_end: str | None = None
    incident_type: str | None = None
    bbox: tuple[float, float, float, float] | None = None

    def predicate(self) -> Column:
        tests: list[Column] = []
        if self.podcast_id:
            tests.append(F.col("podcast_id") == self.podcast_id)
        if self.q:
            # only % and _ are special, and only ASCII letters match in either case
            like = "%" + ascii_lower(self.q).replace("\\", "\\\\") + "%"
            folded = [F.translate(c, ascii_uppercase, ascii_lowercase) for c in ("title", "description")]
            tests.append(folded[0].like(like) | folded[1].like(like))
        # comparing the raw timestamp to day bounds keeps the test pushable to the scan
        if self.date_start:
            tests.append(F.col("published_at") >= F.lit(self.date_start).cast("timestamp_ntz"))
        if self.date_end:
            tests.append(
                F.col("published_at")
                < F.date_add(F.lit(self.date_end).cast("date"), 1).cast("timestamp_ntz")
            )
        if self.incident_type:
            tests.append(F.col("incident_type") == self.incident_type)
        if self.bbox:
            min_lon, min_lat, max_lon, max_lat = self.bbox
            tests.append(F.col("lat").between(min_lat, max_lat))
            tests.append(F.col("lon").between(min_lon, max_lon))
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def apply(self, episodes: DataFrame) -> DataFrame:
        return episodes.filter(self.predicate())


DEFAULT_EPISODES = 2000


def query_episodes(episodes: DataFrame, criteria: EpisodeFilter, limit: int | None = DEFAULT_EPISODES) -> DataFrame:
    """Matching episodes by publication time, the first ``limit`` of them (None: all)."""
    found = criteria.apply(episodes).orderBy("published_at", "guid")
    return found if limit is None else found.limit(limit)


# Saved filter bundles.
PRESETS = {
    "all": {},
    "revolutions": {"incident_type": "revolution"},
    "battles": {"incident_type": "battle"},
    "disasters": {"incident_type": "disaster"},
    "assassinations": {"incident_type": "assassination"},
    "germany": {"q": "Berlin"},
}


def preset_filter(name: str, presets: dict[str, dict] = PRESETS, **explicit) -> EpisodeFilter:
    """Named bundle; explicitly given criteria override those of the bundle."""
    given = {k: v for k, v in explicit.items() if v is not None}
    return EpisodeFilter(**{**presets[name], **given})


def explore_filter(
    episodes: DataFrame,
    *,
    podcast_id=None,
    title_contains: str = "",
    kind: str = "all",
    narrator_contains: str = "",
    cluster_id=None,
    membership: DataFrame | None = None,
) -> DataFrame:
    """Explorer base filter; cluster membership is a semi join."""
    out = episodes
    if podcast_id is not None:
        out = out.filter(F.col("podcast_id") == podcast_id)
    title = title_contains.strip().lower()
    if title:
        out = out.filter(F.lower("title").contains(title))
    if kind != "all":
        out = out.filter(F.coalesce("kind", F.lit("")) == kind)
    reader = narrator_contains.strip().lower()
    if reader:
        out = out.filter(F.lower(F.coalesce("narrator", F.lit(""))).contains(reader))
    if cluster_id is not None:
        members = membership.filter(F.col("cluster_id") == cluster_id).select("episode_id")
        out = out.join(members, out["id"] == members["episode_id"], "left_semi")
    return out


def span_years(spans: DataFrame) -> DataFrame:
    """Adds ``lo``/``hi`` years of spans that have both endpoints, in order."""
    lo, hi = ordered_pair(F.year("start_date"), F.year("end_date"))
    return spans.withColumns({"lo": lo, "hi": hi}).filter("lo IS NOT NULL")


def overlapping_spans(spans: DataFrame, min_year: int, max_year: int) -> DataFrame:
    return span_years(spans).filter((F.col("hi") >= min_year) & (F.col("lo") <= max_year))


def filter_by_year_range(episodes: DataFrame, spans: DataFrame, min_year: int, max_year: int) -> DataFrame:
    """Episodes with at least one span touching the year range."""
    hits = overlapping_spans(spans, min_year, max_year).select(F.col("episode_id").alias("id"))
    return episodes.join(hits, "id", "left_semi")


def spans_in_windows(spans: DataFrame, windows: DataFrame, on: str) -> DataFrame:
    """Range join: spans overlapping the ``[min_year, max_year]`` window of their group."""
    joined = span_years(spans).join(windows, on)
    return joined.filter((F.col("hi") >= F.col("min_year")) & (F.col("lo") <= F.col("max_year")))


def cluster_scope(
    members: DataFrame,
    spans: DataFrame,
    keywords: DataFrame,
    entities: DataFrame,
    *,
    min_year: int,
    max_year: int,
    term: str = "",
) -> DataFrame:
    """Episodes of a cluster inside a year range that mention a term.

    The year test uses the spans when the episode has any (a one-sided span counts by the endpoint
    it has), otherwise the publication year.  The term is looked for in keywords, entity names,
    title and description.
    """
    a, b = F.year("start_date"), F.year("end_date")
    lo, hi = F.least(a, b), F.greatest(a, b)
    needle = term.strip().lower()
    no, yes = F.lit(None).cast("boolean"), F.lit(True)
    inside = F.coalesce((hi >= min_year) & (lo <= max_year), F.lit(False))
    facts = spans.select(F.col("episode_id").alias("id"), inside.alias("span_hit"), no.alias("term_hit"))
    if needle:
        for rows, name in ((keywords, "phrase"), (entities, "name")):
            facts = facts.union(rows.where(F.lower(name).contains(needle)).select("episode_id", no, yes))
    # all facts of an episode in two flags, so the members are joined once
    flags = facts.groupBy("id").agg(F.bool_or("span_hit").alias("span_hit"), F.bool_or("term_hit").alias("term_hit"))
    pub = F.year("pub_date").between(min_year, max_year)
    flagged = members.join(flags, "id", "left").where(F.coalesce("span_hit", pub, F.lit(False)))
    if needle:
        in_text = F.lower("title").contains(needle) | F.lower(F.coalesce("description", F.lit(""))).contains(needle)
        flagged = flagged.where(F.col("term_hit").isNotNull() | in_text)
    return flagged.drop("span_hit", "term_hit")


def valid_spans(spans: DataFrame, start: str = "start_iso", end: str = "end_iso") -> DataFrame:
    """Spans whose text endpoints both parse as instants, endpoints put in order."""
    a, b = F.col(start).try_cast("timestamp"), F.col(end).try_cast("timestamp")
    lo, hi = ordered_pair(a, b)
    return spans.withColumns({"lo": lo, "hi": hi}).filter("lo IS NOT NULL")


__all__ = [
    "EpisodeFilter",
    "PRESETS",
    "cluster_scope",
    "explore_filter",
    "filter_by_year_range",
    "overlapping_spans",
    "preset_filter",
    "span_years",
    "spans_in_windows",
    "valid_spans",
]
