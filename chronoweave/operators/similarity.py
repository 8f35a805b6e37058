"""Most similar items of every item, without the table of all pairs.

Items are sparse vectors; similarity is the Jaccard index of their features or the cosine of their
weights.  Features are ordered by the number of items that hold them.  Rare features are joined
outright.  Frequent ones only add to pairs that are known already, unless the bound says otherwise:
what the features from some place of an item's list on can add to a similarity is at most their share
of the item's own norm, so an item looks for partners by a frequent feature only while that bound
reaches the similarity of its n-th best partner so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_div
from ..session import cut_lineage
from .relational import top_n

# Items that may share a feature before it counts as frequent, and partners that a frequent feature
# suggests to an item for a first bound.  Both change the time only.
RARE = 200
SUGGESTED = 20
# Similarities are compared as rounded to this many digits.
DIGITS = 6

PAIR = ["a", "b"]


def _score(measure: str, dot: Column, na: Column, nb: Column) -> Column:
    """``na`` and ``nb`` are sums of squared weights, which for sets are their sizes."""
    if measure == "jaccard":
        return safe_div(dot, na + nb - dot)
    return safe_div(dot, F.sqrt(na) * F.sqrt(nb))


def _bound(measure: str, rest: Column, whole: Column) -> Column:
    return rest / whole if measure == "jaccard" else F.sqrt(rest / whole)


def _sides(rows: DataFrame, *features: str) -> tuple[DataFrame, DataFrame]:
    def side(s: str) -> DataFrame:
        return rows.select(*features, F.col("item").alias(s), F.col("weight").alias(f"w{s}"))

    return side("a"), side("b")


def _with_frequent(pairs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(a, b, dot): ``dot`` and what the frequent features of both items add to it."""
    left, right = _sides(frequent, "feature")
    added = pairs.select(*PAIR).join(left, "a").join(right, ["b", "feature"])
    added = added.select(*PAIR, (F.col("wa") * F.col("wb")).alias("dot"))
    return pairs.select(*PAIR, "dot").union(added).groupBy(*PAIR).agg(F.sum("dot").alias("dot"))


def top_similar(
    vectors: DataFrame, n: int = 10, measure: str = "jaccard", rare: int = RARE, suggested: int = SUGGESTED
) -> DataFrame:
    """(item, other, similarity, rank): the ``n`` most similar items with a similarity above 0.

    ``vectors(item, feature, weight)`` has positive weights; a pair (item, feature) counts once, with
    its largest weight, and 1 for ``jaccard``.  Ties of the rounded similarity go to the smaller
    ``other``.  The result is exact: every partner that reaches an item's n-th similarity is found by
    a rare feature or by a frequent one whose bound reaches it.
    """
    if measure not in ("jaccard", "cosine"):
        raise ValueError(f"unknown measure {measure}")
    weight = F.lit(1.0) if measure == "jaccard" else F.max("weight").cast("double")
    rows = vectors.where("item IS NOT NULL AND feature IS NOT NULL").groupBy("item", "feature").agg(weight.alias("weight"))
    rows = cut_lineage(rows)
    spread = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("held"))
    norms = cut_lineage(rows.groupBy("item").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm")))
    ranked = cut_lineage(rows.join(spread.where("held > 1"), "feature"))
    few, frequent = ranked.where(F.col("held") <= rare), ranked.where(F.col("held") > rare)

    left, right = _sides(few, "feature")
    found = left.join(right, "feature").where("a < b").groupBy(*PAIR).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    # groups of about ``suggested`` holders of a frequent feature, one group an item and feature
    chunk = F.pmod(F.xxhash64("item", "feature"), F.ceil(F.col("held") / max(suggested, 3 * n)))
    left, right = _sides(frequent.withColumn("chunk", chunk), "feature", "chunk")
    hints = left.join(right, ["feature", "chunk"]).where("a < b").select(*PAIR, F.lit(0.0).alias("dot"))
    found = found.union(hints).groupBy(*PAIR).agg(F.sum("dot").alias("dot"))
    known = cut_lineage(_scored(_with_frequent(found, frequent), norms, measure))

    best = top_n(_both_ways(known), ["item"], [F.desc("similarity"), F.asc("other")], n)
    least = best.where(F.col("rank") == n).select("item", F.col("similarity").alias("least"))
    asked = _asking(ranked, frequent, norms, least, measure)
    holders = frequent.join(norms, "item").select("feature", F.col("item").alias("other"), F.col("norm").alias("other_norm"))
    fits = F.lit(True)
    if measure == "jaccard":  # sets of too different sizes can't be as similar
        fits = (F.col("other_norm") >= F.col("norm") * F.col("reach")) & (F.col("norm") >= F.col("other_norm") * F.col("reach"))
    more = asked.join(holders, "feature").where((F.col("item") != F.col("other")) & fits)
    more = more.select(F.least("item", "other").alias("a"), F.greatest("item", "other").alias("b")).distinct()
    more = more.join(known, PAIR, "left_anti").withColumn("dot", F.lit(0.0))
    late = _scored(_with_frequent(more, frequent), norms, measure)
    return top_n(_both_ways(known.union(late)), ["item"], [F.desc("similarity"), F.asc("other")], n)


def _asking(ranked: DataFrame, frequent: DataFrame, norms: DataFrame, least: DataFrame, measure: str) -> DataFrame:
    """(item, feature, norm, reach): frequent features by which an item still has to look for partners.

    ``reach`` is the similarity that a new partner needs, a rounding step below the n-th best one.
    """
    up = Window.partitionBy("item").orderBy(F.desc("held"), F.desc("feature"))
    rest = F.sum(F.col("weight") * F.col("weight")).over(up.rowsBetween(Window.unboundedPreceding, 0))
    bounded = frequent.withColumn("rest", rest).join(norms, "item").join(least, "item", "left")
    reach = F.greatest(F.coalesce("least", F.lit(0.0)) - 10.0**-DIGITS, F.lit(0.0))
    bounded = bounded.withColumn("reach", reach).where(_bound(measure, F.col("rest"), F.col("norm")) >= F.col("reach"))
    return bounded.select("item", "feature", "norm", "reach")


def _scored(pairs: DataFrame, norms: DataFrame, measure: str) -> DataFrame:
    """(a, b, similarity) above 0."""
    na = norms.select(F.col("item").alias("a"), F.col("norm").alias("na"))
    nb = norms.select(F.col("item").alias("b"), F.col("norm").alias("nb"))
    score = F.round(_score(measure, F.col("dot"), F.col("na"), F.col("nb")), DIGITS)
    return pairs.join(na, "a").join(nb, "b").select(*PAIR, score.alias("similarity")).where("similarity > 0")


def _both_ways(pairs: DataFrame) -> DataFrame:
    there = pairs.select(F.col("a").alias("item"), F.col("b").alias("other"), "similarity")
    return there.union(pairs.select(F.col("b").alias("item"), F.col("a").alias("other"), "similarity"))
