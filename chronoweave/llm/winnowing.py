"""Benchmark decontamination by winnowing.

Of every ``WINDOW - K + 1`` neighbouring K-grams of words the one with the least hash is a
fingerprint.  Two texts that share ``WINDOW`` words in a row share the fingerprint of that window,
so no shared window is missed.  Fingerprints of documents and benchmark items meet in an equi join,
and each hit is extended word by word to the run the two contexts share.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sieve, map_rows, row_key, row_number_base, sieve, stored, unused, worker_cache

WINDOW = 10
K = 5
SIDE = WINDOW - K  # words a window has beside its fingerprint
_CHUNK_WORDS = 250_000
_CACHE = 400_000
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of lower-cased A-Z text: digits, a-z and everything beyond ASCII."""
    return (text or "").encode().lower().translate(_WORD_BYTES).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = worker_cache("word hashes")
    if len(known) > _CACHE:
        known.clear()
    get, h = known.get, xxhash.xxh64_intdigest
    out = []
    for w in words:
        v = get(w)
        if v is None:
            v = known[w] = h(w)
        out.append(v)
    return np.array(out, dtype=np.uint64)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram; different k give unrelated hashes."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def selected(grams: np.ndarray) -> np.ndarray:
    """Positions of the rightmost least hash of every SIDE + 1 neighbouring grams."""
    n = len(grams) - SIDE
    if n < 1:
        return np.empty(0, np.int64)
    best, where = grams[SIDE:].copy(), np.arange(SIDE, SIDE + n)
    for back in range(1, SIDE + 1):
        other = grams[SIDE - back : SIDE - back + n]
        less = other < best
        best[less], where[less] = other[less], np.arange(SIDE - back, SIDE - back + n)[less]
    return np.unique(where)


def context(words: list[bytes], at: int, k: int, low: int, high: int) -> tuple[int, str]:
    """Words around a gram that a window with it can reach, and how many stand before it."""
    side = SIDE if k == K else 0
    first = max(low, at - side)
    return at - first, b" ".join(words[first : min(high, at + abs(k) + side)]).decode()


def item_prints(items: DataFrame) -> DataFrame:
    """(item_id, k, h, before, words): fingerprints of items; one of fewer than WINDOW words is one gram."""

    def run(c: dict):
        out = {n: [] for n in ("item_id", "k", "h", "before", "words")}
        for item, text in zip(c["item_id"].to_pylist(), c["text"].to_pylist(), strict=True):
            words = words_of(text)
            k = K if len(words) >= WINDOW else len(words)
            if not words:
                continue
            grams = gram_hashes(word_hashes(words), k)
            for at in selected(grams).tolist() if k == K and len(words) >= WINDOW else [0]:
                # a short item of exactly K words must not meet grams that only longer windows need
                short = len(words) < WINDOW
                before, around = (0, b" ".join(words).decode()) if short else context(words, at, k, 0, len(words))
                for name, v in zip(out, (item, -k if short else k, int(grams[at].astype(np.int64)), before, around), strict=True):
                    out[name].append(v)
        return out

    return map_rows(items.select("item_id", "text"), run, f"item_id {dict(items.dtypes)['item_id']}, k int, h long, before int, words string")


def scan(docs: DataFrame, shared, short: list[int]) -> DataFrame:
    """(rid, doc_id, n_words, hits) for every row; hits are the fingerprints that pass the sieve.

    ``short``: lengths of short items; all grams of those lengths are tried.
    """

    def flush(held: list[tuple[int, list[bytes]]], bits: Sieve, out: dict) -> None:
        words: list[bytes] = []
        starts = []
        for _, w in held:
            starts.append(len(words))
            words += w
            words.append(b"\n")  # no item has such a word, so no gram with it passes in the end
        starts.append(len(words))
        edges = np.array(starts)
        h = word_hashes(words)
        for k in [K, *(-s for s in short)]:
            grams = gram_hashes(h, abs(k))
            at = selected(grams) if k == K else np.arange(len(grams))
            at = at[bits.maybe(grams[at])]
            row = np.searchsorted(edges, at, "right") - 1
            for p, r in zip(at.tolist(), row.tolist(), strict=True):
                low, high = starts[r], starts[r + 1] - 1
                if p + abs(k) <= high:
                    before, around = context(words, p, k, low, high)
                    out["hits"][held[r][0]].append({"k": k, "h": int(grams[p].astype(np.int64)), "at": p - low, "before": before, "words": around})

    def run(c: dict):
        bits, texts = shared.value, c["text"].to_pylist()
        out = {"rid": row_number_base(len(texts)), "doc_id": c["doc_id"], "n_words": [], "hits": [[] for _ in texts]}
        held, size = [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            out["n_words"].append(len(words))
            held.append((i, words))
            size += len(words)
            if size >= _CHUNK_WORDS:
                flush(held, bits, out)
                held, size = [], 0
        if held:
            flush(held, bits, out)
        return out

    hit = "hits array<struct<k int, h long, at int, before int, words string>>"
    return map_rows(docs.select("doc_id", "text"), run, f"rid long, doc_id {dict(docs.dtypes)['doc_id']}, n_words long, {hit}")


def run_around(doc: list[str], before: int, item: list[str], ahead: int, k: int) -> tuple[int, int] | None:
    """Words that two contexts share to the left and right of a common gram, None when too few."""
    if doc[before : before + abs(k)] != item[ahead : ahead + abs(k)]:
        return None
    if k < 0:
        return 0, 0
    left = right = 0
    while left < min(before, ahead) and doc[before - left - 1] == item[ahead - left - 1]:
        left += 1
    while before + k + right < len(doc) and ahead + k + right < len(item) and doc[before + k + right] == item[ahead + k + right]:
        right += 1
    return (left, right) if left + k + right >= WINDOW else None


def spans(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scanned rows (rid, doc_id, n_words), the hit spans (rid, start, end) and the items (rid, item_id).

    Equal contexts are compared once: their number, not that of the documents that hold them,
    bounds the work on a passage that many documents share.
    """
    spark = docs.sparkSession
    prints = stored(item_prints(items), "items")
    short = [-r.k for r in prints.where("k < 0").select("k").distinct().collect()]  # at most WINDOW - 1 lengths
    shared = spark.sparkContext.broadcast(sieve(prints, "h"))
    rows = stored(scan(docs, shared, short), "scan")
    hits = rows.select("rid", F.explode("hits").alias("x")).select("rid", "x.*")
    mine = hits.select("k", "h", "before", "words").distinct()
    theirs = prints.select("k", "h", F.col("before").alias("ahead"), F.col("words").alias("item_words")).distinct()

    def verify(c: dict):
        keep, left, right = [], [], []
        for d, b, i, a, k in zip(*(c[n].to_pylist() for n in ("words", "before", "item_words", "ahead", "k")), strict=True):
            found = run_around(d.split(" "), b, i.split(" "), a, k)
            keep.append(found is not None)
            left.append(found[0] if found else 0)
            right.append(found[1] if found else 0)
        return c | {"same": keep, "left": left, "right": right}

    joined = mine.join(theirs, ["k", "h"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema)
    same = stored(map_rows(joined, verify, f"{kinds}, same boolean, left int, right int").where("same"), "same")
    key = ["k", "h", "before", "words"]
    runs = same.groupBy(*key).agg(F.collect_set(F.struct("left", "right")).alias("runs"))
    found = (
        hits.join(runs, key)
        .select("rid", "at", "k", F.explode("runs").alias("r"))
        .select("rid", (F.col("at") - F.col("r.left")).alias("start"), (F.col("at") + F.abs("k") + F.col("r.right")).alias("end"))
        .distinct()
    )
    owners = same.join(prints.select("k", "h", F.col("before").alias("ahead"), F.col("words").alias("item_words"), "item_id"), ["k", "h", "ahead", "item_words"])
    named = hits.select("rid", *key).distinct().join(owners.select(*key, "item_id").distinct(), key).select("rid", "item_id").distinct()
    return rows.select("rid", "doc_id", "n_words"), found, named


def covered(found: Column) -> Column:
    """Words inside at least one of the sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")
    )
    return F.aggregate(F.array_sort(found), zero, step, lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    NULL and empty texts have no words.  An item without words occurs nowhere; one without an id
    marks words but is not counted.  Repeated rows get a result each; items that repeat an id count
    once.  Other columns are not read.
    """
    rows, found, named = spans(docs, items)
    hit = found.groupBy("rid").agg(covered(F.collect_list(F.struct("start", "end"))).alias("n_hit"))
    ids = named.where("item_id IS NOT NULL").groupBy("rid").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    out = rows.join(hit, "rid", "left").join(ids, "rid", "left")
    listed = F.coalesce("ids", F.array().cast("array<string>"))
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"), (n > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that share a window with an item.

    Rows are told apart by doc_id and text, so rows that repeat both go or stay together.
    """
    row = unused(docs, "_row")
    keyed = docs.withColumn(row, row_key(F.col("text")))
    rows, found, _ = spans(keyed.select(F.struct("doc_id", F.col(row).alias("_row")).alias("doc_id"), "text"), items)
    bad = rows.join(found.select("rid").distinct(), "rid", "left_semi").select("doc_id.*").distinct()
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_bad"))
    kept = keyed.join(bad, keyed["doc_id"].eqNullSafe(bad["_id"]) & (keyed[row] == bad["_bad"]), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
