"""The operators bound to the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anchor_pii, arrow_tokens, crf_secrets, duck_bpe, golay_dedup, ordinal_quality, periodic_runs, perplexity, prefix_trie, suffix_dedup, vector_packing, warc_index, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_kneser_ney_perplexity")
def kneser_ney(spark, sf_dir):
    return perplexity.rules(table(spark, sf_dir, "documents"))


@query("op2_golay_simhash")
def golay_simhash(spark, sf_dir):
    return golay_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_arrow_tokens")
def arrow(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return arrow_tokens.read(arrow_tokens.write(docs, tokenizer("word_bpe_49k.json")))


REVISITS_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest AND n >= 100
"""


@query("op4_warc_index", REVISITS_SQL)
def warc(spark, sf_dir):
    return warc_index.round_trip(table(spark, sf_dir, "pages"))


@query("op5_anchor_pii")
def anchor(spark, sf_dir):
    return anchor_pii.report(table(spark, sf_dir, "documents"))


WINDOWS_SQL = """
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
    row_number() OVER () AS rid FROM documents),
d AS (SELECT rid, doc_id, regexp_extract_all(t, '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM low),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT dw.rid, dw.n, dw.i, bw.item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


@query("op6_winnowing", WINDOWS_SQL)
def winnow(spark, sf_dir):
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_crf_secrets")
def crf(spark, sf_dir):
    return crf_secrets.scan(table(spark, sf_dir, "documents"))


@query("op8_suffix_dedup")
def suffix(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op9_vector_best_fit")
def vector_best_fit(spark, sf_dir):
    return vector_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op10_ordinal_quality")
def ordinal(spark, sf_dir):
    made = ordinal_quality.select(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return made.select("doc_id", "score", "expected_grade", "p_grade_1", "p_grade_2", "kept")


@query("op11_duckdb_bpe")
def byte_pairs(spark, sf_dir):
    import public_tokenizers

    return duck_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op12_periodic_runs")
def periodic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return periodic_runs.report(periodic_runs.scan(docs, rewrite=periodic_runs.with_periodic_tail))


# CRC-32 of the decimal id: its bytes, then eight steps of the polynomial each.
TRIE_SQL = """
WITH t AS (
  SELECT conv_id, sha256(CAST(strlen(r) AS VARCHAR) || ':' || r || x) AS sha, CAST(strlen(x) AS VARCHAR) AS n_bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
        WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, list(sha || ':' || n_bytes ORDER BY place) AS l FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, l, xor(list_reduce(
    flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: [ascii(s), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, (a & 1) * 3988292384) END,
    CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h
  FROM c),
r AS (
  SELECT h.conv_id, list_concat(coalesce(c.l[1 : h.h], []), h.l[h.h + 1 :]) AS l
  FROM h LEFT JOIN c ON c.conv_id = h.conv_id - h.conv_id % 5),
x AS (SELECT conv_id, len(l) AS n, d AS depth, l[1 : d] AS k FROM r, LATERAL (SELECT unnest(range(0, len(l) + 1)) AS d)),
n AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM x GROUP BY k, depth),
ch AS (SELECT k[1 : depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth > 0 THEN (n_convs - 1) * CAST(split_part(k[depth], ':', 2) AS BIGINT) ELSE 0 END AS own
  FROM n LEFT JOIN ch USING (k)),
s AS (
  SELECT k[1 : d] AS k, CAST(sum(own) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM m, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) GROUP BY 1)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN s USING (k) LEFT JOIN n p ON m.depth > 0 AND p.k = m.k[1 : m.depth - 1]
"""


@query("op13_prefix_trie", TRIE_SQL)
def trie(spark, sf_dir):
    return prefix_trie.regrouped_trie(table(spark, sf_dir, "conversations"))
