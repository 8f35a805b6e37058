"""SimHash near-duplicates by Golay-code keys.

A 64-bit fingerprint is cut into three segments of at most 22 bits.  A segment, filled up to 23
bits, is decoded to the indices of the codewords of the binary Golay code within distance 4: one
index, or six when its nearest codeword is at distance 3.  Segments that differ in at most two bits
always share an index.  Of four differing bits at most two fall outside the worst segment, so two
of the three segments share an index each: a key is a pair of segments with an index of each.
Fingerprints meet at equal keys and are compared bit by bit.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, in_arrow, map_rows, row_key, stored, unused

LINK_BITS = 4
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and length
PAIRS = ((0, 1), (0, 2), (1, 2))
_GENERATOR = 0b101011100011  # of the binary Golay code
# Fingerprints of one key that are compared with each other; more go by their neighbourhoods.
BUCKET = 2000


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles; 0 when there is no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(width, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp) for every row; th is a hash of the text, fp the fingerprint as a signed long."""

    def run(c: dict):
        prints = np.array([fingerprint(t) for t in c["text"].to_pylist()], dtype=np.uint64)
        return {"doc_id": c["doc_id"], "th": c["th"], "fp": prints.view(np.int64)}

    rows = docs.select("doc_id", row_key(F.col("text")).alias("th"), "text")
    return map_rows(rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, fp long")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Parity of each 12-bit index; for each syndrome up to six error patterns, -1 where none."""

    def remainder(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= _GENERATOR << (i - 11)
        return v

    parity = np.array([remainder(i << 11) for i in range(4096)], dtype=np.int64)
    near: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            v = sum(1 << b for b in bits)
            s = int(parity[v >> 11]) ^ (v & 2047)
            if weight < 4 or near[s][0].bit_count() == 3:
                near[s].append(v)
    patterns = np.full((2048, 6), -1, dtype=np.int64)
    for s, found in enumerate(near):
        patterns[s, : len(found)] = found
    return parity, patterns


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords near 23-bit vectors, -1 where there are fewer."""
    parity, patterns = _tables()
    errors = patterns[parity[segment >> 11] ^ (segment & 2047)]
    return np.where(errors < 0, -1, (segment[:, None] ^ errors) >> 11)


def keys_of(prints: np.ndarray) -> np.ndarray:
    """(n, 108) keys of unsigned fingerprints, -1 where there are fewer."""
    index = [codeword_indices(((prints >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64)) for s, n in SEGMENTS]
    out = []
    for number, (i, j) in enumerate(PAIRS):
        a, b = index[i][:, :, None], index[j][:, None, :]
        out.append(np.where((a < 0) | (b < 0), -1, (number << 24) | (a << 12) | b).reshape(len(prints), 36))
    return np.concatenate(out, axis=1)


def bucket_links(key: int, prints: np.ndarray) -> list[tuple[int, int]]:
    """Forest of links among the fingerprints of one key, at most one fewer than fingerprints.

    A pair is looked at under the least of its common keys only, so every linked pair is connected
    in exactly one bucket and no pair is emitted twice.
    """
    root = list(range(len(prints)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for a in range(len(prints) - 1):
        b = a + 1 + np.flatnonzero(np.bitwise_count(prints[a + 1 :] ^ prints[a]) <= LINK_BITS)
        b = b[[find(int(x)) != find(a) for x in b]] if len(b) else b
        if not len(b):
            continue
        own, others = keys_of(prints[a : a + 1])[0], keys_of(prints[b])
        common = np.where(np.isin(others, own[own >= 0]), others, 1 << 30).min(axis=1)
        for x in b[common == key].tolist():
            if find(x) != find(a):
                root[find(x)] = find(a)
                links.append((a, x))
    return links


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of distinct fingerprints (``fp``) whose graph has the components of all links.

    A key held by more than ``bucket`` fingerprints is not compared inside.  Its fingerprints emit
    all fingerprints within two bits instead; two of them are within four bits exactly if they
    reach a common one, and at most 2,081 fingerprints reach any, so such groups need no pairs.
    """

    def key_rows(c: dict):
        fp = c["fp"].to_numpy()
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096]
            keys = keys_of(part.view(np.uint64))
            row, _ = np.nonzero(keys >= 0)
            yield {"key": keys[keys >= 0], "fp": part[row]}

    keyed = map_rows(prints.select("fp"), key_rows, "key long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, hot = None, [], False

        def flush():
            if key is None or len(held) < 2 and not hot:
                return None
            signed = np.array(held, dtype=np.int64)
            if hot:
                return pa.RecordBatch.from_arrays([pa.array(signed), pa.nulls(len(signed), pa.int64())], ["a", "b"])
            found = bucket_links(key, signed.view(np.uint64))
            if not found:
                return None
            a, b = np.array(found).T
            return pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], ["a", "b"])

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            lengths = np.diff(edges)
            wanted = lengths > 1  # a run inside a batch that is one row long has no partner
            wanted[:1] = wanted[-1:] = True
            for a, b in zip(edges[:-1][wanted].tolist(), edges[1:][wanted].tolist(), strict=True):
                if keys[a] != key:
                    if (out := flush()) is not None:
                        yield out
                    key, held, hot = int(keys[a]), [], False
                held.extend(fps[a:b].tolist())
                if len(held) > bucket:
                    hot = True
                    if len(held) > 4 * bucket:
                        yield flush()
                        held = []
        if (out := flush()) is not None:
            yield out

    found = stored(in_arrow(keyed.repartition("key").sortWithinPartitions("key"), run, "a long, b long"), "links")
    near = found.where("b IS NOT NULL")
    hot = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    masks = np.array([0] + [sum(1 << b for b in bits) for w in (1, 2) for bits in itertools.combinations(range(64), w)], dtype=np.uint64).view(np.int64)

    def around(c: dict):
        for fp in c["fp"].to_numpy():
            yield {"fp": np.full(len(masks), fp), "centre": fp ^ masks}

    stars = map_rows(hot, around, "fp long, centre long").groupBy("centre").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    starred = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return near.union(starred)


def classes(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, th, fp, component_id, component) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most four bits, itself included.
    NULL and empty texts have fingerprint zero and are linked like any other; a NULL doc_id keeps
    its row and never is the smallest.  Components without an id, or with the same smallest one, are
    told apart by ``component``, their least fingerprint.  Repeated rows come out as often as they
    came in.
    """
    fps = stored(fingerprints(docs), "fps")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, bucket))
    member = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "least")
    merged = member.groupBy("root").agg(F.min("least").alias("joint"))
    joint = member.join(merged, "root").select("fp", "root", "joint")
    named = distinct.join(joint, "fp", "left").select("fp", F.coalesce("joint", "least").alias("component_id"), F.coalesce("root", "fp").alias("component"))
    # stored, so that both sides of the join are plain shuffles and hot fingerprints can be split
    return fps.join(stored(named, "classes"), "fp").select("doc_id", "th", "fp", "component_id", "component")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; see ``classes``."""
    return classes(docs, bucket).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, then of the least text hash.

    Rows without a doc_id stay behind all others of their component; a row repeated in full is kept
    once.
    """
    best = classes(docs, bucket).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("w"))
    winners = best.select(F.col("w.doc_id").alias("_id"), F.col("w.th").alias("_th")).distinct()
    row, copy = unused(docs, "_row"), unused(docs, "_copy")
    keyed = docs.withColumn(row, row_key(F.col("text")))
    chosen = keyed.join(winners, keyed["doc_id"].eqNullSafe(winners["_id"]) & (keyed[row] == winners["_th"]), "left_semi")
    first = Window.partitionBy("doc_id", row).orderBy(row)
    return chosen.withColumn(copy, F.row_number().over(first)).where(F.col(copy) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
