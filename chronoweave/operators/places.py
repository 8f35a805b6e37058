"""Place candidates, gazetteer geocoding and dictionary location scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import find_all, let, offset_at, stable_id
from ..functions.text import norm_key

# Patterns of place hints and capitalised words, candidate cap per segment.
HINT_PATTERN = r"(?U)(?=[ibnav])\b(in|bei|nach|aus|von|auf)\s+([A-ZÄÖÜ][\wÄÖÜäöüß\-]+)"
WORD_PATTERN = r"(?U)(?=[A-ZÄÖÜ])\b[A-ZÄÖÜ][a-zäöüß]{3,}\b"
MAX_CANDIDATES = 30


def place_candidates(text: Column, limit: int | None = MAX_CANDIDATES) -> Column:
    """Hinted names first (repeats kept), then other capitalised words, at most ``limit``; None: all."""
    hints = find_all(text, HINT_PATTERN, 2)
    words = F.array_except(find_all(text, WORD_PATTERN), hints)
    found = F.concat(hints, words)
    return found if limit is None else F.slice(found, 1, limit)


def geocode(
    segments: DataFrame, keys: list[str], alias_dict: DataFrame, text: str = "text", limit: int | None = None
) -> DataFrame:
    """Gazetteer hits per segment, first position per canonical name; ``limit`` looks up so many
    candidates of a segment only, None: all.

    The join is an equi join on the normalised key.  Candidates are reduced to the first position
    of each key before it, and a large dictionary falls to a shuffled join.
    """
    hits = (
        segments.select(*keys, F.posexplode(place_candidates(F.col(text), limit)).alias("pos", "candidate"))
        .select(*keys, "pos", norm_key(F.col("candidate")).alias("norm_key"))
        .join(alias_dict, "norm_key")
    )
    found = F.struct("place_kind", "lat", "lon", "radius_km")
    return (
        hits.groupBy(*keys, "canonical_name")
        .agg(F.min("pos").alias("pos"), F.min_by(found, "pos").alias("place"))
        .select(*keys, "pos", "canonical_name", "place.*")
    )


def first_place(places: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First place in reading order per key, by one partial aggregation."""
    row = F.struct(*[c for c in places.columns if c != key])
    return places.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("p")).select(key, "p.*")


def place_dimension(places: DataFrame, order: list[str]) -> DataFrame:
    """One row per normalised key; the first canonical name and kind win."""
    keyed = places.withColumn("norm_key", norm_key(F.col("canonical_name")))
    first = F.min_by(F.struct("canonical_name", "place_kind"), F.struct(*order))
    return keyed.groupBy("norm_key").agg(first.alias("p")).select("norm_key", "p.*").withColumn(
        "place_norm_id", stable_id("norm_key")
    )


# \w+, with ASCII letters tested first because the Unicode properties are slow.
WORD_RUN = r"(?U)[a-zA-Z0-9_[\w&&[^\x00-\x7f]]]+"
# Slots of the runtime filter of first words: 1,024 longs, whatever the dictionary's size.
FILTER_SLOTS = 1 << 16


def _slot(word: Column, n_words: Column) -> Column:
    return F.pmod(F.xxhash64(word, n_words.cast("int")), F.lit(FILTER_SLOTS))


def _first_words(forms: DataFrame) -> DataFrame:
    """One row with a bitmap over the (first word, number of words) of all forms, and over the first
    words alone under number 0.

    A clear bit proves that no form starts like this; a set bit proves nothing, so a dictionary that
    fills the bitmap costs time but no hits.
    """
    asked = F.explode(F.array(F.lit(0), F.col("n_words")))
    slots = forms.select("first", asked.alias("n_words")).select(_slot(F.col("first"), F.col("n_words")).alias("slot"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("slot", F.lit(64)).cast("int"))
    bits = slots.groupBy(F.floor(F.col("slot") / 64).alias("id")).agg(F.bit_or(mask).alias("bits"))
    every = forms.sparkSession.range(FILTER_SLOTS // 64).join(bits, "id", "left")
    entries = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(F.transform(entries, lambda e: e["bits"]).alias("bits"))


def dictionary_hits(docs: DataFrame, key: str, names: DataFrame, text: str = "text") -> DataFrame:
    """All case-insensitive whole-word occurrences of dictionary names.

    ``names(name_pos, surface, name, kind, country, lat, lon)``.  A text is cut into words and gaps
    once and every word is hashed once.  Runs of words are formed, and offsets added up, only where the
    word may start a form of as many words, by a bitmap of first words, and meet the forms in one equi
    join on the whole folded run, so a frequent first word is no hot key.  Marks around a form's words
    are compared after it.
    """
    core = F.regexp_extract("surface", r"(?U)(?s)\w(?:.*\w)?", 0)
    lead = F.length(F.regexp_extract("surface", r"(?U)^\W*", 0))
    forms = names.withColumn("core", F.lower(core)).withColumn("lead", lead).filter("core <> ''")
    forms = forms.withColumn("tail", F.length("surface") - F.col("lead") - F.length(core))
    word_list = find_all(F.col("core"), r"(?U)\w+")
    sized = forms.select(F.size(word_list).alias("n_words"), F.get(word_list, F.lit(0)).alias("first"))
    counts = sized.agg(F.array_sort(F.collect_set("n_words"))).scalar()  # a form's word counts: a short list
    bitmap = _first_words(sized).scalar()

    def is_set(slot: Column) -> Column:
        # a shift by more than 63 bits is one by the rest
        long = F.get("_bits", F.shiftright(slot, 6))
        return F.call_function("shiftrightunsigned", long, slot).bitwiseAND(F.lit(1).cast("bigint")) == 1

    def slot_of(word: Column, n_words: Column) -> Column:
        return _slot(F.lower(word), n_words).cast("int")

    def runs(words: Column, gaps: Column) -> Column:
        def sizes_at(i: Column) -> Column:
            return F.filter("_counts", lambda m: (i + m <= F.size(words)) & let(slot_of(F.get(words, i), m), is_set))

        def found(offset: Callable[[Column], Column]) -> Column:
            def run(i: Column, m: Column) -> Column:
                rest = F.zip_with(F.slice(gaps, i + 2, m - 1), F.slice(words, i + 2, m - 1), lambda g, w: F.concat(g, w))
                before_gap = F.when(i > 0, F.get(words, i - 1)).otherwise("")
                behind = F.concat(F.get(gaps, i + m), F.coalesce(F.get(words, i + m), F.lit("")))
                return F.struct(
                    F.concat(F.get(words, i), F.array_join(rest, "")).alias("run"),
                    (offset(i) + F.length(F.get(gaps, i))).alias("at"),
                    F.concat(before_gap, F.get(gaps, i)).alias("ahead"),
                    behind.alias("behind"),
                )

            places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
            slots = F.transform(words, lambda w: slot_of(w, F.lit(0)))
            firsts = let(slots, lambda s: F.filter(places, lambda i: is_set(F.get(s, i))))
            return F.flatten(F.transform(firsts, lambda i: F.transform(sizes_at(i), lambda m: run(i, m))))

        return offset_at(F.transform(words, lambda w, i: F.length(F.get(gaps, i)) + F.length(w)), found)

    none = F.array().cast("array<int>")
    filled = docs.select(key, text).withColumn("_counts", F.coalesce(counts, none)).withColumn("_bits", bitmap)
    body = F.coalesce(F.col(text), F.lit(""))
    cut = let(find_all(body, WORD_RUN), lambda words: let(F.split(body, WORD_RUN), lambda gaps: runs(words, gaps)))
    tokens = filled.select(key, F.explode(cut).alias("w")).select(key, "w.*")
    joined = tokens.withColumn("core", F.lower("run")).join(forms, "core").filter(F.length("ahead") >= F.col("lead"))
    before_form = F.substr("ahead", F.length("ahead") - F.col("lead") + 1, F.col("lead"))
    behind_form = F.substr("behind", F.lit(1), F.col("tail"))
    found = F.concat(before_form, "run", behind_form)
    before = F.when(F.length("ahead") > F.col("lead"), F.substr("ahead", F.length("ahead") - F.col("lead"), F.lit(1))).otherwise("")
    after = F.substr("behind", F.col("tail") + 1, F.lit(1))

    def is_word(ch: Column) -> Column:
        return ch.rlike(r"(?U)^\w")

    size = F.length("surface")
    boundary = (is_word(before) != is_word(found)) & (is_word(after) != is_word(F.substr(found, F.length(found))))
    start = F.col("at") - F.col("lead")
    return joined.filter((F.lower(found) == F.lower("surface")) & boundary).select(
        key,
        start.alias("start"),
        (start + size).alias("end"),
        "name_pos",
        "name",
        "kind",
        "country",
        "lat",
        "lon",
    )


def resolve_overlaps(hits: DataFrame, key: str, priority: list) -> DataFrame:
    """Hits (``key``, start, end, ...) that no overlapping hit of an earlier ``priority`` was kept for.

    One sweep by start cuts the hits of a key where none reaches over; most clusters have a single
    hit.  Only the hits of one cluster are compared with each other, earliest priority first.
    """
    rest = [c for c in hits.columns if c != key]
    by_start = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach > F.col("start"), 0).otherwise(1)
    swept = hits.withColumn("_opens", opens).withColumn("_cluster", F.sum("_opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct(*[p.alias(f"_p{i}") for i, p in enumerate(priority)], *rest)
    clusters = swept.groupBy(key, "_cluster").agg(F.array_sort(F.collect_list(row)).alias("_hits"))
    kept = F.aggregate(
        F.col("_hits"),
        F.filter("_hits", lambda _: F.lit(False)),
        lambda acc, h: F.when(
            F.exists(acc, lambda k: (h["end"] > k["start"]) & (h["start"] < k["end"])), acc
        ).otherwise(F.concat(acc, F.array(h))),
    )
    kept = F.when(F.size("_hits") == 1, F.col("_hits")).otherwise(kept)
    return clusters.select(key, F.explode(kept).alias("_h")).select(key, *[F.col("_h")[c].alias(c) for c in rest])


def dictionary_locations(docs: DataFrame, key: str, names: DataFrame, text: str = "text") -> DataFrame:
    """Dictionary hits with overlaps resolved: longer surface forms first, then the name list's
    order, then text order."""
    hits = dictionary_hits(docs, key, names, text)
    kept = resolve_overlaps(hits, key, [F.col("start") - F.col("end"), F.col("name_pos"), F.col("start")])
    return kept.drop("name_pos")


def primary_location(locations: DataFrame, key: str) -> DataFrame:
    """Location with the smallest (start, end) per document."""
    row = F.struct(*[c for c in locations.columns if c != key])
    return (
        locations.groupBy(key)
        .agg(F.min_by(row, F.struct("start", "end")).alias("p"))
        .select(key, "p.*")
    )
