"""Field extraction from episode and listing pages."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import find_all, first_match, strip
from ..functions.dates import make_day
from ..functions.text import UNCLOSED, strip_tags, unescape_html


@dataclass(frozen=True)
class PagePatterns:
    """Patterns of one site layout; the defaults fit the mirrored podcast site."""

    og_title: str = r'(?iU)<meta[^>]+property="og:title"[^>]+content="([^"]+)"'
    headline: str = r"(?isU)<h1[^>]*>(.*?)</h1>"
    block: str = r'(?isU)<div[^>]+class="desc"[^>]*>(.*?)</div>'
    og_description: str = r'(?iU)<meta[^>]+property="og:description"[^>]+content="([^"]+)"'
    audio: str = r"""(?iU)https://podcast-mp3\.dradio\.de/[^\s"'>]+?\.mp3(?:\?[^\s"'>]+)?"""
    minutes: str = r"(?iU)\b(\d{1,3})\s*Minuten\b"
    day: str = r"(?U)\b\d{2}\.\d{2}\.\d{4}\b"
    url_day: str = r"(?iU)/podcast/(\d{4}/\d{2}/\d{2})/"
    episode_url: str = r"""(?iU)https://www\.podcast\.de/episode/\d+/[^\s"'>]+"""
    next_url: str = r'(?iU)<a[^>]+rel="next"[^>]+href="([^"]+)"'


FALLBACK_CHARS = 2000


def page_fields(
    pages: DataFrame,
    keys: list[str],
    html: str = "html",
    patterns: PagePatterns = PagePatterns(),
    fallback: int | None = FALLBACK_CHARS,
    unclosed: Iterable[str] = UNCLOSED,
) -> DataFrame:
    """Title, description, audio link, duration and date with their fallbacks; the page text stands in
    for a description up to ``fallback`` characters, None: whole.  ``unclosed``: see ``unescape_html``."""
    h = F.col(html)
    audio = first_match(h, patterns.audio, 0)
    day = F.split(first_match(h, patterns.day, 0), r"\.")
    path_day = F.split(first_match(audio, patterns.url_day), "/")

    def part(parts: Column, i: int) -> Column:
        return F.get(parts, i).cast("int")

    stated = make_day(part(day, 2), part(day, 1), part(day, 0))
    derived = make_day(part(path_day, 0), part(path_day, 1), part(path_day, 2))
    return pages.select(
        *keys,
        F.coalesce(
            strip(first_match(h, patterns.og_title)), strip_tags(first_match(h, patterns.headline), unclosed), F.lit("(unknown)")
        ).alias("title"),
        F.coalesce(
            strip_tags(first_match(h, patterns.block), unclosed),
            strip(first_match(h, patterns.og_description)),
            strip_tags(h, unclosed) if fallback is None else F.substring(strip_tags(h, unclosed), 1, fallback),
        ).alias("description"),
        audio.alias("audio_url"),
        (first_match(h, patterns.minutes).cast("int") * 60).alias("duration_seconds"),
        F.when(F.size(day) > 0, stated).otherwise(derived).alias("published_date"),
    )


def page_links(pages: DataFrame, keys: list[str], html: str = "html", patterns: PagePatterns = PagePatterns(), group: int = 0) -> DataFrame:
    """Sorted distinct episode links and the next listing page."""
    return pages.select(
        *keys,
        F.array_sort(F.array_distinct(find_all(F.col(html), patterns.episode_url, group))).alias("episode_urls"),
        unescape_html(first_match(F.col(html), patterns.next_url)).alias("next_page_url"),
    )


def frontier(links: DataFrame, key: str, page_no: str, max_pages: int = 10, max_episodes: int = 500) -> DataFrame:
    """First-seen order of links over the pages of an archive, capped per archive.

    The caps are the crawl limits of the listing job.  Both ranks keep at most the cap per task
    before the shuffle.
    """
    by_page = Window.partitionBy(key).orderBy(page_no)
    pages = links.withColumn("page_rank", F.row_number().over(by_page)).filter(F.col("page_rank") <= max_pages)
    seen = (
        pages.select(key, "page_rank", F.posexplode("episode_urls").alias("pos", "url"))
        .groupBy(key, "url")
        .agg(F.min(F.struct("page_rank", "pos")).alias("first_seen"))
    )
    order = Window.partitionBy(key).orderBy("first_seen")
    return (
        seen.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= max_episodes)
        .select(key, "url", "rank")
    )
