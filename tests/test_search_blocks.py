"""Front-coded vocabulary and postings in blocks, against plain counterparts."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import blockmax, search, vocabulary

TERMS = ["a", "ab", "abc", "abd", "b", "ba", "bab", "ä", "äh", "z", "zz", "10", "1000", "𝒳y", "abdomen", "abd́"]


@pytest.mark.parametrize("size", [1, 3, 100])
def test_front_coded_vocabulary(spark, size):
    df = spark.createDataFrame([(t,) for t in TERMS + ["ab", None]], "term string")
    blocks = vocabulary.front_coded(df, size)
    ordered = sorted(TERMS, key=lambda t: t.encode())
    rows = blocks.orderBy("block").collect()
    assert [r["block"] for r in rows] == list(range(len(rows)))
    assert [r["first"] for r in rows] == ordered[::size]
    assert all(r["n"] == len(r["entries"]) <= size for r in rows)
    assert sorted(r["term"] for r in vocabulary.decoded(blocks).collect()) == sorted(TERMS)
    prefixes = ["a", "ab", "abd", "abdomen", "abdomens", "0", "1", "ä", "zzz", "", "𝒳", "b", "c", "a", None]
    found = vocabulary.starting_with(blocks, spark.createDataFrame([(p,) for p in prefixes], "q string"))
    expected = sorted((p, t) for p in {p for p in prefixes if p is not None} for t in TERMS if t.startswith(p))
    assert sorted(map(tuple, found.collect())) == expected


def test_empty_vocabulary(spark):
    blocks = vocabulary.front_coded(spark.createDataFrame([], "term string"))
    assert blocks.count() == 0
    assert vocabulary.starting_with(blocks, spark.createDataFrame([("a",)], "q string")).count() == 0


def test_a_prefix_reads_only_the_blocks_of_its_range(spark):
    words = sorted(f"{a}{i:03}" for a in "abc" for i in range(200))
    blocks = vocabulary.front_coded(spark.createDataFrame([(w,) for w in words], "term string"), 10)
    asked = spark.createDataFrame([("b05",), ("b",), ("d",), ("A",)], "q string")
    ranges = {r["q"]: (r["low"], r["high"]) for r in vocabulary.block_ranges(blocks, asked).collect()}
    # b050 to b059 are one block; its bound lies in the block before it
    assert ranges == {"b05": (24, 25), "b": (19, 39), "d": (59, 59)}


@pytest.fixture(scope="module")
def made(spark):
    """Documents of very different length over few words, some empty, so that ties are frequent."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("kat", "kater", "hund", "maus") for b in ("", "e", "en", "chen")]
    rows = [(i, rng.choice(words) if i % 3 else None, " ".join(rng.choices(words, range(16, 0, -1), k=rng.choice([0, 1, 3, 9, 40])))) for i in range(400)]
    rows += [(400, None, None), (401, "", "")]
    index = search.build_index(spark.createDataFrame(rows, "doc_id int, title string, text string")).materialised()
    asked = ["kat", "kat hund", "hund maus kater", "katechen", "nichts", "kat nichts", "", None, "mau", "katen katerchen hunde", "kat kat"]
    return index, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")


@pytest.mark.parametrize("size, modes", [(1, (False, False)), (7, (True, True)), (1000, (True, False))])
def test_blocks_give_the_plain_ranking(made, size, modes):
    index, queries = made
    blocks = blockmax.block_index(index, size)
    for limit in (3, 60):
        rows, rounds = blockmax.search_in_rounds(blocks, queries, limit, *modes)
        plain = search.search(index, queries, limit, *modes).collect()
        assert plain
        assert sorted(map(tuple, rows.select("query_id", "doc_id", "score", "rank").collect())) == sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in plain)
        read = rounds.groupBy("query_id", "round").count().collect()
        assert all(r["count"] <= limit for r in read if r["round"] == 1)


def test_blocks_are_bounded_and_skipped(made):
    index, queries = made
    blocks = blockmax.block_index(index, 7)
    heads = blocks.heads.collect()
    assert max(r["n"] for r in heads) <= 7
    assert sum(r["n"] for r in heads) == index.postings.count()
    rounds = blockmax.search_in_rounds(blocks, queries, 3, False, False)[1].where("query_id = 0").collect()
    counts = {k: sum(r["round"] == k for r in rounds) for k in (1, 2, None)}
    assert counts[1] == 3 and counts[None] > counts[1] + counts[2]
    # what was skipped lies under the least bound of what was read
    assert max(r["bound"] for r in rounds if r["round"] is None) <= min(r["bound"] for r in rounds if r["round"])


def test_blocks_of_an_empty_index(spark):
    index = search.build_index(spark.createDataFrame([], "doc_id int, title string, text string")).materialised()
    asked = spark.createDataFrame([(1, "a")], "query_id int, query string")
    assert blockmax.search_blocks(blockmax.block_index(index), asked).count() == 0


def stored_by(monkeypatch, module):
    """The tables that a module stores from now on."""
    seen, cut = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: seen.append(df) or cut(df))
    return seen


def test_words_are_expanded_once_for_all_queries(made, monkeypatch):
    index, queries = made
    seen = stored_by(monkeypatch, search)
    search.search(index, queries, 3)
    assert seen and not any({"query_id", "term"} <= set(df.columns) for df in seen)


def test_blocks_are_made_once_and_not_ranged(made, monkeypatch):
    seen = stored_by(monkeypatch, blockmax)
    blockmax.block_index(made[0], 7)
    plans = [df._jdf.queryExecution().toString() for df in seen]
    assert plans and not any("rangepartitioning(term" in p or "collect_list" in p for p in plans)


def test_field_sizes_count_equal_rows_of_a_document(spark):
    rows = [(1, "a b", "a b c"), (1, "a b", "a a c"), (2, None, "x"), (3, "", "...")]
    sizes = search.build_index(spark.createDataFrame(rows, "doc_id int, title string, text string")).fields
    assert "explode" not in sizes._jdf.queryExecution().optimizedPlan().toString().split("sum(tf")[0]
    assert sorted(map(tuple, sizes.collect())) == [("text", 3, 7 / 3), ("title", 2, 2.0)]


def test_postings_of_placed_documents_are_neither_moved_nor_stored_again(spark, monkeypatch):
    import __spark_entry__ as entry

    seen = stored_by(monkeypatch, blockmax)
    entry.queries()["search_words"](spark, "/root/testdata/sf0.001")
    assert seen and not any({"term", "doc_id"} <= set(df.columns) for df in seen)


def test_placed_documents_give_the_plain_ranking(spark):
    rng = random.Random(8)
    words = ["kat", "kater", "hund", "maus", "see"]
    rows = [(i, rng.choice(words), " ".join(rng.choices(words, k=rng.choice([1, 3, 9, 40])))) for i in range(90)]
    rows += [(5, "kat", "hund"), (5, "kat", "hund maus see"), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, title string, text string")
    queries = spark.createDataFrame([(0, "kat"), (1, "hund maus"), (2, "see kater kat"), (3, "nichts")], "query_id int, query string")
    blocks = blockmax.block_index(search.build_index(blockmax.placed(docs, 4)).materialised())
    assert blocks.index.postings.groupBy("block").agg(F.count_distinct(F.coalesce("doc_id", F.lit(-1))).alias("n")).where("n > 4").isEmpty()
    plain = search.build_index(docs).materialised()
    for limit in (3, 60):
        want = sorted(map(str, search.search(plain, queries, limit, False, False).collect()))
        got = blockmax.search_blocks(blocks, queries, limit, False, False)
        assert sorted(map(str, got.select("query_id", "doc_id", "score", "rank").collect())) == want and want


def test_forms_of_leading_words_are_stored_before_they_meet_the_postings(made, monkeypatch):
    index, queries = made
    seen = stored_by(monkeypatch, search)
    search.search(index, queries, 3)
    forms = [df for df in seen if {"q", "term", "df"} <= set(df.columns)]
    assert len(forms) == 2
    every, leading = ({r.q for r in df.select("q").distinct().collect()} for df in forms)
    assert leading < every
