"""Byte-level BPE by recursive queries of DuckDB inside every Spark partition.

A word is a match of the pattern.  Its bytes are rows of a token table (word, place, id); a round
joins every row and its successor to the merge table, finds the least rank of each word and
contracts the leftmost pair that has it, until no word has a pair left.  Ids are decoded by a join
to the vocabulary and an ordered aggregation.

Words are encoded once per worker while its cache holds them.  Words that are vocabulary entries
themselves keep their own rank, as in the tiktoken library.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows, texts_of, worker_cache

# White space of the Unicode standard, which the pattern's \s means to the tiktoken library.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Words in each of two generations of a worker's cache, bytes of words in one recursive query and
# tokens in one decoding query: bounds of memory, not of results.
CACHE_WORDS = 300_000
BLOCK_BYTES = 500_000
BLOCK_TOKENS = 1_000_000
# Characters of texts that are handled at a time.
CHUNK_CHARS = 2_000_000
# Words up to this many bytes take the query with one sort a round; see ``recursion``.
SHORT = 64


def recursion(overlapping: bool) -> str:
    """The recursive query over ``start`` (w, p, id, pair): word, place, token, token and successor.

    ``k`` packs a word's least rank with the first place that has it.  Pairs of that rank that don't
    touch are contracted in one round: no new pair can have a rank as low, but for tokens marked
    ``solo``, where only the leftmost pair is.  Of touching pairs only the first is taken
    (``overlapping=False``) or every second one (``True``), which costs another sort a round but
    keeps the rounds few for long repetitions of one character.  A word's last row has no pair, so
    one order over all words serves the first form.  The result keeps the last row of every (w, p);
    rows swallowed by their predecessor are no longer alive.
    """
    ranked = """
      SELECT c.w, c.p, c.id, ended, CAST(k >> 32 AS INTEGER) AS m,
        coalesce(c.m = (k >> 32) AND (NOT solo OR c.p = (k & 4294967295)), false) AS hit
      FROM c JOIN (
        SELECT w, min((CAST(m AS BIGINT) << 32) | p) AS k FROM c WHERE m IS NOT NULL GROUP BY w) USING (w)"""
    if overlapping:
        taken = f"""
      SELECT w, p, id, m, hit AND (n - coalesce(max(CASE WHEN NOT hit THEN n END) OVER o, 0)) % 2 = 1 AS take
      FROM (SELECT *, row_number() OVER o AS n FROM ({ranked}) WINDOW o AS (PARTITION BY w ORDER BY p))
      WINDOW o AS (PARTITION BY w ORDER BY p)"""
        step = f"""
      SELECT w, p, nid, lag(take, 1, false) OVER o AS gone,
        CASE WHEN take THEN lead(nid, 2, 65535) OVER o ELSE lead(nid, 1, 65535) OVER o END AS nxt
      FROM (SELECT w, p, take, CASE WHEN take THEN m ELSE id END AS nid FROM ({taken}))
      WINDOW o AS (PARTITION BY w ORDER BY p)"""
    else:
        step = f"""
      SELECT w, p, CASE WHEN hit AND NOT b1 THEN m ELSE id END AS nid, b1 AND NOT b2 AS gone,
        CASE WHEN hit AND NOT b1 THEN CASE WHEN e1 THEN 65535 WHEN a2 AND NOT a1 THEN m ELSE id2 END
             WHEN ended THEN 65535 WHEN a1 AND NOT hit THEN m ELSE id1 END AS nxt
      FROM (
        SELECT w, p, id, m, hit, ended, lag(hit, 1, false) OVER o AS b1, lag(hit, 2, false) OVER o AS b2,
          lead(hit, 1, false) OVER o AS a1, lead(hit, 2, false) OVER o AS a2, lead(ended, 1) OVER o AS e1,
          lead(id, 1) OVER o AS id1, lead(id, 2) OVER o AS id2
        FROM ({ranked}) WINDOW o AS (ORDER BY w, p))"""
    return f"""
WITH RECURSIVE t(w, p, id, pair, alive) USING KEY (w, p) AS (
  SELECT w, p, id, pair, true FROM start
  UNION ALL
  (WITH c AS MATERIALIZED (
     SELECT w, p, id, m, solo, (pair & 65535) = 65535 AS ended
     FROM t LEFT JOIN merges USING (pair) WHERE alive)
   SELECT w, p, nid, (CAST(nid AS BIGINT) << 16) | nxt, NOT gone FROM ({step}))
)
SELECT w, list(id ORDER BY p) AS ids FROM t WHERE alive GROUP BY w ORDER BY w"""


DECODE = """
SELECT d, from_hex(string_agg(hex, '' ORDER BY p)) AS bytes
FROM tokens JOIN vocabulary USING (id) GROUP BY d ORDER BY d"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(pair, m, solo): both tokens of every way to put an entry together, its rank, and whether the
    made token has a pair of no higher rank."""
    rows = []
    for token, made in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                rows.append((left, right, made))
    left, right, made = np.array(rows, dtype=np.int64).reshape(-1, 3).T
    solo = np.zeros(max(ranks.values()) + 1, dtype=bool)
    solo[left[made <= left]] = True
    solo[right[made <= right]] = True
    return pa.table({"pair": (left << 16) | right, "m": pa.array(made, pa.int32()), "solo": solo[made]})


class DuckBpe:
    """Encoder and decoder of one vocabulary of fewer than 65,535 entries, with every byte in it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values()) >= 65535 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary has all single bytes and ranks below 65535")
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.ranks, self.cache, self.older = ranks, {}, {}
        self.known = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.known[list(ranks.values())] = True
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self._table("merges", merge_table(ranks))
        vocabulary = {"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}
        self._table("vocabulary", pa.table(vocabulary))
        self.short, self.long = recursion(False), recursion(True)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _query(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.con.register(name, rows)
        made = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        return made

    def contract(self, words: list[bytes], sql: str) -> list[bytes]:
        """Ids of non-empty words, each as little-endian 32-bit integers."""
        sizes = np.array([len(w) for w in words])
        begins = np.cumsum(sizes) - sizes
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        following = np.append(ids[1:], 65535)
        following[begins + sizes - 1] = 65535
        start = {
            "w": pa.array(np.repeat(np.arange(len(words)), sizes), pa.int32()),
            "p": pa.array(np.arange(len(ids)) - np.repeat(begins, sizes), pa.int32()),
            "id": pa.array(ids, pa.int32()),
            "pair": (ids << 16) | following,
        }
        lists = self._query(sql, "start", pa.table(start))["ids"].combine_chunks()
        flat = lists.flatten().to_numpy().astype("<u4").tobytes()
        cuts = (np.append(0, np.cumsum(lists.value_lengths().to_numpy())) * 4).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _add(self, new: list[str]) -> None:
        """Encode words into the cache, in blocks."""
        blocks: dict[str, tuple[list[str], list[bytes], list[int]]] = {}
        for word in new:
            raw = word.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.cache[word] = rank.to_bytes(4, "little")
                continue
            sql = self.short if len(raw) <= SHORT else self.long
            names, words, size = blocks.setdefault(sql, ([], [], [0]))
            names.append(word)
            words.append(raw)
            size[0] += len(raw)
            if size[0] >= BLOCK_BYTES:
                self.cache.update(zip(names, self.contract(words, sql), strict=True))
                del blocks[sql]
        for sql, (names, words, _) in blocks.items():
            self.cache.update(zip(names, self.contract(words, sql), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        found = [self.pattern.findall(t) for t in texts]
        distinct = set().union(*found)
        if len(self.cache) + sum(w not in self.cache for w in distinct) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        for w in distinct:
            if w not in self.cache and w in self.older:
                self.cache[w] = self.older[w]
        self._add([w for w in distinct if w not in self.cache])
        look = self.cache.__getitem__
        return [b"".join(map(look, words)) for words in found]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of every sequence of ids; an id that the vocabulary lacks is an error."""
        sizes = np.array([len(s) // 4 for s in ids], dtype=np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        if len(flat) and (flat.max() >= len(self.known) or not self.known[flat].all()):
            raise ValueError("an id is not in the vocabulary")
        tokens = {
            "d": pa.array(np.repeat(np.arange(len(ids)), sizes), pa.int32()),
            "p": pa.array(np.arange(len(flat)), pa.int32()),
            "id": pa.array(flat, pa.int32()),
        }
        made = self._query(DECODE, "tokens", pa.table(tokens))
        out = [b""] * len(ids)
        for d, raw in zip(made["d"].to_pylist(), made["bytes"].to_pylist(), strict=True):
            out[d] = raw
        return out


def codec(path: str, pattern: str) -> DuckBpe:
    """The worker's encoder and decoder of a file of ranks."""
    held = worker_cache(f"duck_bpe {path} {pattern}")
    if not held:
        held["codec"] = DuckBpe(read_ranks(path), pattern)
    return held["codec"]


def chunks(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of consecutive items of at most ``most`` in all, or of one larger item."""
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row.

    NULL is encoded like the empty text, to no ids; repeated rows and NULL ids keep a row each, other
    columns are left out, and an empty table gives no rows.  Texts of any length are encoded whole.
    """

    def run(columns: dict) -> Iterator[dict]:
        made, texts = codec(path, pattern), texts_of(columns["text"])
        for part in chunks([len(t) for t in texts], CHUNK_CHARS):
            ids = made.encode(texts[part])
            ends = np.cumsum([0, *(len(s) // 4 for s in ids)])
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield {"doc_id": columns["doc_id"][part.start : part.stop], "ids": lists}

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of every row (doc_id, ids); NULL ids decode to no bytes."""

    def run(columns: dict) -> Iterator[dict]:
        made = codec(path, pattern)
        lists = columns["ids"].to_pylist()
        for part in chunks([len(s or ()) for s in lists], BLOCK_TOKENS):
            raw = made.decode([np.array(s or (), "<u4").tobytes() for s in lists[part]])
            yield {"doc_id": columns["doc_id"][part.start : part.stop], "bytes": raw}

    return map_rows(rows.select("doc_id", "ids"), run, f"doc_id {dict(rows.dtypes)['doc_id']}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode`` and ``decode`` in one pass, so that
    no ids leave their task.  Nulls, repeated rows and empty tables as in ``encode``.
    """

    def run(columns: dict) -> Iterator[dict]:
        made, texts = codec(path, pattern), texts_of(columns["text"])
        for part in chunks([len(t) for t in texts], CHUNK_CHARS):
            ids = made.encode(texts[part])
            yield {
                "doc_id": columns["doc_id"][part.start : part.stop],
                "n_tokens": [len(s) // 4 for s in ids],
                "ids_sha256": [hashlib.sha256(s).hexdigest() for s in ids],
                "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in made.decode(ids)],
            }

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
