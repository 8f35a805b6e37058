"""The registered queries on the smallest tables, and their DuckDB statements."""

import re

import pytest

import __spark_entry__ as entry
from chronoweave.llm.queries import ORACLES, QUERIES
from compare import compare, connect

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    2: "doc_id fingerprint component_id",
    3: "doc_id start n_tokens ids_crc32",
    4: "page_id payload_bytes payload_digest record_type refers_to",
    5: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    6: "doc_id n_words n_hit n_items items_sha256 contaminated",
    7: "doc_id n_assign n_access n_hex base_sha256 spans",
    8: "doc_id n_bytes n_removed n_spans kept_sha256",
    9: "doc_id piece start length ids_crc32 sequence_id offset",
    10: "doc_id score expected_grade kept",
    11: "doc_id n_tokens ids_sha256 decoded_sha256",
    12: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    13: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}


def test_each_operator_has_one_query():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, name):
    out = QUERIES[name](spark, SF)
    number = int(re.match(r"op(\d+)_", name)[1])
    assert out.columns[: len(COLUMNS[number].split())] == COLUMNS[number].split() or set(COLUMNS[number].split()) <= set(out.columns)
    key = out.columns[0]
    table = {"page_id": "pages", "conv_id": "conversations"}.get(key, "documents")
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    got = {r[0] for r in out.select(key).collect()}
    assert got <= want if key == "conv_id" else got == want  # a trie names smallest members only


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_statement(spark, name):
    status, note = compare(spark, connect(SF), SF, name)
    assert status == "ok", note


def test_pipeline_query(spark):
    out = entry.queries()["pipeline"](spark, SF)
    sizes = out.groupBy("sequence_id").sum("length").collect()
    assert sizes and all(r[1] <= 1024 for r in sizes)
