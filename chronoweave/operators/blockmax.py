"""Postings in blocks that carry their best score, and ranked queries that skip blocks.

Documents are numbered from the shortest to the longest and cut into blocks of ``size`` documents,
the same ones for all terms.  Short documents have the high scores of a term, so the blocks' best
scores differ a lot.  A (term, field, block) is one head row with its best score; its postings, never
more than ``size`` of them however frequent the term, are rows that lie in one file.  Documents are
moved to their block before they are cut into words (``placed``), so no posting is moved.  Scores are
taken of the postings of terms that are asked for.

A query first reads the best scores alone.  Blocks that miss a query term drop out, the others are
bounded by the sum of their best scores.  The blocks with the highest bounds are scored; the k-th
score found there decides which of the others have to be read at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .relational import number_rows, top_n
from .search import DEFAULT_LIMIT, SearchIndex, base_score, matched_terms

BLOCK_DOCS = 128
# Scores are rounded to six digits; a bound this near to the k-th score may still tie with it.
MARGIN = 1e-5


@dataclass
class BlockIndex:
    """An index whose postings name their block."""

    index: SearchIndex

    @property
    def blocks(self) -> DataFrame:
        """All postings ``(term, field, block, score, doc_id)``."""
        return self.scored(self.index.terms)

    @property
    def heads(self) -> DataFrame:
        """``(term, field, block, top, n)`` of all terms."""
        return self.blocks.groupBy("term", "field", "block").agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("n"))

    def scored(self, terms: DataFrame) -> DataFrame:
        rated = self.index.postings.join(terms, ["term", "field"]).join(self.index.fields, "field")
        return rated.select("term", "field", "block", base_score().alias("score"), "doc_id")

    def of(self, expanded: DataFrame) -> DataFrame:
        """The postings of the terms that are asked for.  These terms are stored, so Spark knows whether they
        are few; then the postings of others are read but neither scored nor moved."""
        return self.scored(cut_lineage(self.index.terms.join(asked_terms(expanded), "term", "left_semi")))


def _blocks_by_length(lengths: DataFrame, size: int) -> DataFrame:
    """(_id, block) of ``lengths(doc_id, _len)``."""
    numbered = number_rows(lengths, ["_len", "doc_id"], "_no", 0)
    return numbered.select(F.col("doc_id").alias("_id"), F.floor(F.col("_no") / size).cast("bigint").alias("block"))


def _with_block(rows: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    return rows.join(_blocks_by_length(lengths, size), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")


def placed(docs: DataFrame, size: int = BLOCK_DOCS) -> DataFrame:
    """``docs(doc_id, title, text)`` with their ``block`` by length in characters, for ``search.build_index``."""
    chars = F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("text", F.lit("")))
    return _with_block(docs, docs.groupBy("doc_id").agg(F.sum(chars).alias("_len")), size)


def block_index(index: SearchIndex, size: int = BLOCK_DOCS) -> BlockIndex:
    """Blocks of an index.  One made of documents that were ``placed`` has them already; the postings of
    another one are given theirs by the number of words and moved to the task of their block."""
    if "block" in index.postings.columns:
        return BlockIndex(index)
    lengths = index.postings.groupBy("doc_id").agg(F.sum("tf").alias("_len"))
    dealt = cut_lineage(_with_block(index.postings, lengths, size).repartition("block"))
    return BlockIndex(SearchIndex(dealt, index.terms, index.fields, index.coded))


def asked_terms(expanded: DataFrame) -> DataFrame:
    """The terms of all queries; as ``expanded`` is stored, Spark knows whether they are few."""
    return expanded.select("term").distinct()


def bounded_blocks(own: DataFrame, expanded: DataFrame) -> DataFrame:
    """``(query_id, n_terms, block, bound)`` of the blocks that hold some form of every query term, from the
    postings ``own`` of these terms."""
    heads = own.groupBy("term", "field", "block").agg(F.max("score").alias("top"))
    met = heads.join(expanded, "term").groupBy("query_id", "n_terms", "block")
    sums = met.agg(F.sum(F.col("weight") * F.col("top")).alias("bound"), F.size(F.collect_set("term_no")).alias("held"))
    return sums.where("held = n_terms").drop("held")


def score_blocks(own: DataFrame, expanded: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)`` of all matching documents in the chosen (query_id, block)."""
    asked = chosen.select("query_id", "block").join(expanded, "query_id")
    hits = asked.join(own, ["term", "block"]).select("query_id", "n_terms", "term_no", "weight", "score", "doc_id")
    return (
        hits.groupBy("query_id", "n_terms", "doc_id")
        .agg(
            F.round(F.sum(F.col("weight") * F.col("score")), 6).alias("score"),
            F.size(F.collect_set("term_no")).alias("matched"),
        )
        .where("matched = n_terms")
        .select("query_id", "doc_id", "score")
    )


def search_in_rounds(
    index: BlockIndex, queries: DataFrame, limit: int = DEFAULT_LIMIT, prefix: bool = True, fuzzy: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Best ``limit`` documents per query, as :func:`search.search` gives them, and the blocks:
    ``(query_id, block, bound, round)`` with round 1 or 2 for those read and NULL for skipped ones.
    """
    expanded = cut_lineage(matched_terms(index.index, queries, prefix, fuzzy))
    own = index.of(expanded)
    bounds = cut_lineage(bounded_blocks(own, expanded))
    # a block has at least one posting, so about ``limit`` documents are met if terms go together
    order = [F.desc("bound"), F.asc("block")]
    first = top_n(bounds, ["query_id"], order, limit).drop("rank")
    found = cut_lineage(top_n(score_blocks(own, expanded, first), ["query_id"], [F.desc("score"), F.asc("doc_id")], limit))
    kth = found.where(F.col("rank") == limit).select("query_id", F.col("score").alias("kth"))
    seen = first.select("query_id", "block", F.lit(1).alias("round"))
    later = bounds.join(seen, ["query_id", "block"], "left").join(kth, "query_id", "left")
    worth = F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - MARGIN)
    rounds = cut_lineage(
        later.select("query_id", "block", "bound", F.coalesce("round", F.when(worth, 2)).alias("round"))
    )
    more = score_blocks(own, expanded, rounds.where("round = 2"))
    both = found.drop("rank").unionByName(more)
    return top_n(both, ["query_id"], [F.desc("score"), F.asc("doc_id")], limit), rounds


def search_blocks(index: BlockIndex, queries: DataFrame, limit: int = DEFAULT_LIMIT, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """Best ``limit`` documents per query from an index in blocks; every query term must match."""
    return search_in_rounds(index, queries, limit, prefix, fuzzy)[0]
