"""Keyphrase scoring by word degree and frequency.

The text is placed by document key once.  Phrases are cut, scored and ranked inside the row, so no
word ever becomes a row of its own; the word sums of a row are one small Python function.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stable_id

# Stop words and limits.
STOP_WORDS = (
    "der", "die", "das", "und", "oder", "aber", "wenn", "weil", "dass", "ist", "sind", "war", "waren", "eine",
    "ein", "einer", "eines", "einem", "im", "in", "am", "an", "auf", "aus", "bei", "mit", "von", "zu", "für",
    "über", "um", "als", "auch", "noch", "mehr", "nicht", "wir", "ihr", "euch", "uns", "diese", "dieser",
    "dieses",
)
MAX_PHRASE_WORDS = 5
MAX_PHRASES = 25


def phrase_array(text: Column) -> Column:
    """Runs of content words; stop words and words of one or two letters end a run."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    tokens = F.split(F.lower(text), r"[^A-Za-zÄÖÜäöüß0-9]+")
    marked = F.transform(
        tokens, lambda t: F.when((F.length(t) <= 2) | F.array_contains(stop, t), "|").otherwise(t)
    )
    runs = F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda p: F.trim(p))
    return F.filter(runs, lambda p: p != "")


def phrase_scores(phrases: Column, max_words: int | None) -> Column:
    """``array<struct<phrase,score,at>>`` of the distinct phrases of at most ``max_words`` words.

    A word weighs the mean length of the phrases it occurs in, a phrase the sum of its words.
    """

    def scored(row: list[str]) -> list[dict]:
        cut = [p.split(" ") for p in row]
        total, times, first = {}, {}, {}
        for at, words in enumerate(cut):
            for w in words:
                total[w] = total.get(w, 0) + len(words)
                times[w] = times.get(w, 0) + 1
            if max_words is None or len(words) <= max_words:
                first.setdefault(row[at], at)
        return [{"phrase": p, "score": sum(total[w] / times[w] for w in cut[at]), "at": at} for p, at in first.items()]

    def batch(rows: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("phrase", pa.string()), ("score", pa.float64()), ("at", pa.int32())]))
        return pa.concat_arrays([pa.array([scored(r) for r in rows.slice(i, 64).to_pylist()], kind) for i in range(0, len(rows), 64)] or [pa.array([], kind)])

    return F.arrow_udf(batch, "array<struct<phrase:string,score:double,at:int>>")(phrases)


def keyphrases(
    docs: DataFrame, key: str, text: str = "text", max_phrases: int | None = MAX_PHRASES, max_words: int | None = MAX_PHRASE_WORDS
) -> DataFrame:
    """Top phrases per document with score and rank, None: all; ties go to the first occurrence."""
    # an explicit placement merges with one the caller made, so the text is moved once
    placed = docs.select(key, F.col(text).alias("_text")).repartition(key)
    by_doc = placed.groupBy(key).agg(F.collect_list("_text").alias("_texts"))
    cut = by_doc.select(key, F.flatten(F.transform("_texts", phrase_array)).alias("_cut"))
    found = cut.select(key, phrase_scores(F.col("_cut"), max_words).alias("_found"))
    best = F.sort_array(
        F.transform("_found", lambda p: F.struct((-F.round(p["score"], 9)).alias("neg"), p["at"].alias("at"), p["phrase"].alias("phrase")))
    )
    if max_phrases is not None:
        best = F.slice(best, 1, max_phrases)
    return found.select(key, F.posexplode(best).alias("_no", "_p")).select(
        key, F.col("_p.phrase").alias("phrase"), (-F.col("_p.neg")).alias("score"), (F.col("_no") + 1).alias("rank")
    )


def keyword_dimension(episode_keywords: DataFrame) -> DataFrame:
    """Distinct phrases with a stable id."""
    return episode_keywords.select("phrase").distinct().withColumn("keyword_id", stable_id("phrase"))


def keyword_bridge(scored: DataFrame, key: str, order: str) -> DataFrame:
    """(episode, phrase) with the score written last."""
    return scored.groupBy(key, "phrase").agg(F.max_by("score", order).alias("score"))
