"""Merging feed files into an existing podcast and episode store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.mutations import new_by_guid
from ..operators.relational import first_per, number_rows
from ..session import cut_lineage


def podcast_keys(podcasts: DataFrame) -> DataFrame:
    """(key, podcast_id): feed URL, link and lower-cased title share one key space; the podcast
    registered first keeps a key."""
    forms = F.array(F.trim("feed_url"), F.trim("link"), F.lower(F.trim("title")))
    keyed = podcasts.select(F.col("id").alias("podcast_id"), F.posexplode(forms).alias("slot", "key"))
    return first_per(keyed.filter("key <> ''"), ["key"], ["podcast_id", "slot"]).select("key", "podcast_id")


def feed_keys(feeds: DataFrame) -> DataFrame:
    """(feed_pos, slot, key) in lookup order: link, lower-cased title, path."""
    forms = F.array(F.trim("link"), F.lower(F.trim("title")), F.col("path"))
    return feeds.select("feed_pos", F.posexplode(forms).alias("slot", "key")).filter("key <> ''")


def resolve_podcast(feeds: DataFrame, podcasts: DataFrame) -> DataFrame:
    """(feed_pos, podcast_id) against the store; NULL where no key is known."""
    hits = feed_keys(feeds).join(podcast_keys(podcasts), "key")
    best = hits.groupBy("feed_pos").agg(F.min_by("podcast_id", "slot").alias("podcast_id"))
    return feeds.select("feed_pos").join(best, "feed_pos", "left")


@dataclass
class MergeResult:
    podcasts: DataFrame
    episodes: DataFrame


def opening_feeds(keys: DataFrame, taken: DataFrame) -> DataFrame:
    """(feed_pos) of the feeds that open a new podcast: none of their ``keys`` (feed_pos, key) is in
    ``taken`` (key) or held by an earlier feed that opens one.

    A feed whose only open question is one earlier feed, asked directly or by several keys, opens just
    when that one doesn't.  Such feeds point to it and pointers are composed every round, so a chain
    of n feeds takes about log2(n) rounds.  A key tells a feed all it needs by three places: its first
    undecided holder, the first one with another answer than that, and the first with the opposite
    answer; hence hot keys are aggregated and no pairs of holders are formed.
    """
    keys = cut_lineage(keys.select(F.col("feed_pos").cast("bigint").alias("feed_pos"), "key").distinct())
    shut = keys.join(taken.select("key").distinct(), "key", "left_semi").select("feed_pos").distinct().withColumn("opens", F.lit(False))
    state = keys.select("feed_pos").distinct().join(shut, "feed_pos", "left")
    # opens(feed) = opens(root) XOR flip, once opens is known for the root
    state = cut_lineage(state.select("feed_pos", "opens", F.col("feed_pos").alias("root"), F.lit(False).alias("flip")))
    while not state.where("opens IS NULL").isEmpty():
        rows = keys.join(state, "feed_pos").where("opens IS NULL OR opens")
        undecided = F.col("opens").isNull()
        # both values of ``opens`` here are true or unknown
        place = F.when(undecided, F.col("feed_pos"))
        first = rows.groupBy("key").agg(
            F.min(F.when(~undecided, F.col("feed_pos"))).alias("opened"),
            F.min(place).alias("asked"),
            F.min_by("root", place).alias("asked_root"),
            F.min_by("flip", place).alias("asked_flip"),
        )
        told = rows.where(undecided).join(first, "key")
        same_root = F.col("root") == F.col("asked_root")
        same_flip = F.col("flip") == F.col("asked_flip")
        second = told.groupBy("key").agg(
            F.min(F.when(~(same_root & same_flip), F.col("feed_pos"))).alias("other"),
            F.min(F.when(same_root & ~same_flip, F.col("feed_pos"))).alias("opposite"),
        )

        def before(name: str) -> Column:
            return F.coalesce(F.col(name) < F.col("feed_pos"), F.lit(False))

        answer = F.when(before("asked"), F.struct("asked_root", "asked_flip"))
        verdict = (
            told.join(second, "key")
            .groupBy("feed_pos")
            .agg(
                F.bool_or(before("opened") | before("opposite")).alias("blocked"),
                F.bool_or(before("other")).alias("several"),
                F.min(answer).alias("low"),
                F.max(answer).alias("high"),
            )
        )
        one_root = F.col("low.asked_root") == F.col("high.asked_root")
        opposed = one_root & (F.col("low.asked_flip") != F.col("high.asked_flip"))
        single = one_root & (F.col("low.asked_flip") == F.col("high.asked_flip")) & ~F.col("several")
        decided = F.when(F.col("blocked") | opposed, False).when(F.col("low").isNull(), True)
        verdict = verdict.select("feed_pos", decided.alias("decided"), F.when(single, F.col("low.asked_root")).alias("to"), (~F.col("low.asked_flip")).alias("to_flip"))
        # a pointer once set stays true and is only composed
        fresh = (F.col("root") == F.col("feed_pos")) & F.col("to").isNotNull()
        now = state.join(verdict, "feed_pos", "left").select(
            "feed_pos",
            F.coalesce("opens", "decided").alias("opens"),
            F.when(fresh, F.col("to")).otherwise(F.col("root")).alias("root"),
            F.when(fresh, F.col("to_flip")).otherwise(F.col("flip")).alias("flip"),
        )
        now = cut_lineage(now)
        roots = now.select(F.col("feed_pos").alias("root"), F.col("opens").alias("root_opens"), F.col("root").alias("next"), F.col("flip").alias("next_flip"))
        state = cut_lineage(
            now.join(roots, "root").select(
                "feed_pos",
                F.coalesce("opens", F.col("root_opens") != F.col("flip")).alias("opens"),
                F.col("next").alias("root"),
                (F.col("flip") != F.col("next_flip")).alias("flip"),
            )
        )
    return state.where("opens").select("feed_pos")


def assign_podcasts(feeds: DataFrame, podcasts: DataFrame) -> DataFrame:
    """(feed_pos, podcast_id, leader): ``leader`` names the feed that opens a new podcast.

    Feeds count in order, and a new podcast is known to the feeds after it by all its keys.  Only a
    feed that opens one registers keys, so a key has one owner at most, and a feed belongs to the
    owner of its first known key.  Feeds without keys open podcasts that no other feed finds.
    """
    keys = cut_lineage(feed_keys(feeds).withColumn("feed_pos", F.col("feed_pos").cast("bigint")))
    stored = cut_lineage(podcast_keys(podcasts))
    opened = opening_feeds(keys.select("feed_pos", "key"), stored)
    owned = keys.join(opened, "feed_pos", "left_semi").select("key", F.col("feed_pos").alias("leader")).distinct()
    owners = stored.select("key", "podcast_id", F.lit(None).cast("bigint").alias("leader")).unionByName(
        owned.select("key", F.lit(None).cast("bigint").alias("podcast_id"), "leader")
    )
    hits = keys.join(owners, "key").where("leader IS NULL OR leader <= feed_pos")
    best = hits.groupBy("feed_pos").agg(F.min_by(F.struct("podcast_id", "leader"), "slot").alias("best"))
    known = best.select("feed_pos", F.col("best.podcast_id").alias("podcast_id"), F.col("best.leader").alias("leader"))
    every = feeds.select("feed_pos", F.col("feed_pos").cast("bigint").alias("_at")).join(known.withColumnRenamed("feed_pos", "_at"), "_at", "left")
    alone = F.when(F.col("podcast_id").isNull(), F.coalesce("leader", "_at"))
    return every.select("feed_pos", "podcast_id", alone.alias("leader"))


def merge_feeds(podcasts: DataFrame, episodes: DataFrame, feeds: DataFrame, items: DataFrame) -> MergeResult:
    """Stores after the merge; running it twice changes nothing the second time.

    ``podcasts(id, title, description, language, link, image_url, feed_url, feed_type)``,
    ``feeds(feed_pos, path, title, link, description, language, image_url)`` and merge-read
    ``items(feed_pos, item_pos, guid, title, ...)``.  New ids continue the highest one in feed and
    item order.
    """
    assigned = assign_podcasts(feeds, podcasts)
    top_podcast = F.coalesce(podcasts.agg(F.max("id")).scalar(), F.lit(0))
    leaders = feeds.join(assigned.filter("leader = feed_pos").select("feed_pos"), "feed_pos", "left_semi")
    numbered = number_rows(leaders, ["feed_pos"], "no").withColumn("id", F.col("no") + top_podcast)
    created = numbered.select(
        "id",
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Podcast "), F.col("id").cast("string"))).alias("title"),
        F.coalesce(F.trim("description"), F.lit("")).alias("description"),
        F.nullif(F.trim("language"), F.lit("")).alias("language"),
        F.nullif(F.trim("link"), F.lit("")).alias("link"),
        F.nullif(F.trim("image_url"), F.lit("")).alias("image_url"),
        F.col("path").alias("feed_url"),
        F.regexp_extract("path", r"\.([^./]*)$", 1).alias("feed_type"),
    )
    ids = numbered.select(F.col("feed_pos").cast("bigint").alias("leader"), F.col("id").alias("new_id"))
    owner = assigned.join(ids, "leader", "left").select(
        "feed_pos", F.coalesce("podcast_id", "new_id").alias("podcast_id")
    )
    fresh = new_by_guid(items, episodes, ["feed_pos", "item_pos"]).join(owner, "feed_pos")
    top_episode = F.coalesce(episodes.agg(F.max("id")).scalar(), F.lit(0))
    placed = number_rows(fresh, ["feed_pos", "item_pos"], "no").withColumn("id", F.col("no") + top_episode)
    titled = placed.withColumn(
        "title", F.coalesce("title", F.concat(F.lit("Episode "), F.col("id").cast("string")))
    )
    extra = [c for c in episodes.columns if c not in titled.columns]
    types = dict(episodes.dtypes)
    added = titled.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in extra]).select(*episodes.columns)
    return MergeResult(podcasts.unionByName(created.select(*podcasts.columns)), episodes.unionByName(added))
