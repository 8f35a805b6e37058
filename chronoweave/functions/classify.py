"""Keyword ladders over titles and texts, narrator and link rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import blank_to_null, contains_any, find_all, first_match, let

# Ordered keyword groups.
INCIDENT_LADDER = (
    ("battle", ("schlacht", "battle", "verdun")),
    ("assassination", ("attentat", "assassination", "mord")),
    (
        "disaster",
        ("sturmflut", "katastrophe", "disaster", "flut", "hurricane", "earthquake"),
    ),
    ("revolution", ("revolution", "proteste", "aufstand", "frühling")),
    ("political_change", ("mauerfall", "wiedervereinigung")),
    ("conflict", ("konflikt", "krieg", "streit", "invasion", "besatzung")),
    ("politics", ("politik", "regierung", "parlament")),
)
SPECIAL_WORDS = ("bonus", "live", "spezial", "special")
META_WORDS = ("ankündigung", "update", "meta", "hinweis")
MERGE_SPECIAL_WORDS = ("spezial", "special", "bonus", "trailer")
MERGE_META_WORDS = ("meta", "update", "ankündigung")
ADVERT_MARKERS = (
    "instagram",
    "tiktok",
    "facebook",
    "linktr",
    "seven.one",
    "ardsoundsfestival",
)


def episode_kind(title: Column) -> Column:
    t = F.lower(title)
    return (
        F.when(t.contains("hb") & t.contains("gag"), "book")
        .when(contains_any(t, SPECIAL_WORDS), "special")
        .when(contains_any(t, META_WORDS), "meta")
        .otherwise("regular")
    )


def merged_episode_kind(title: Column) -> Column:
    t = F.lower(title)
    return (
        F.when(contains_any(t, MERGE_SPECIAL_WORDS), "special")
        .when(contains_any(t, MERGE_META_WORDS), "meta")
        .otherwise("regular")
    )


def incident_type(text: Column) -> Column:
    """First group of the ladder with a hit, else ``other``."""

    def ladder(t: Column) -> Column:
        (label, words), *rest = INCIDENT_LADDER
        steps = F.when(contains_any(t, words), label)
        for label, words in rest:
            steps = steps.when(contains_any(t, words), label)
        return steps.otherwise("other")

    return let(F.lower(text), ladder)


def narrator(author: Column, description: Column) -> Column:
    """Stated author, else the sorted readers named in the text, else NULL."""
    readers = find_all(description, r"(?=[RrDd])(?iU)\b(Richard|Daniel)\s+liest\b", 1)
    names = F.array_sort(F.array_distinct(F.transform(readers, lambda n: F.initcap(n))))
    return F.coalesce(blank_to_null(author), F.nullif(F.array_join(names, ", "), F.lit("")))


def plain_links(text: Column) -> Column:
    return find_all(text, r"""(?U)https?://[^\s\])<>"']+""")


def trimmed_links(text: Column) -> Column:
    """Every blank-delimited URL with closing punctuation cut off."""
    return F.transform(
        find_all(text, r"(?U)https?://\S+"), lambda u: F.regexp_replace(u, r'[.,);"]+$', "")
    )


def link_type(url: Column, page_url: Column) -> Column:
    """``advert`` wins over ``internal`` (the page's own host), else ``external``."""
    host = first_match(page_url, r"^https?://([^/]+)/")
    return (
        F.when(contains_any(F.lower(url), ADVERT_MARKERS), "advert")
        .when(host.isNotNull() & url.contains(host), "internal")
        .otherwise("external")
    )


def guid_of_url(url: Column) -> Column:
    """Numeric episode id in the path, else a digest of the URL."""
    number = first_match(url, r"/episode/(\d+)/")
    return F.concat(F.lit("podcastde:"), F.coalesce(number, F.substring(F.sha1(url), 1, 12)))
