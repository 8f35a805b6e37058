"""Exact removal of long repeated byte strings by suffix arrays.

Winnowing marks anchors, one at least in every window of ``LENGTH`` bytes; equal windows have equal
anchors at the same place.  Spark gathers the anchors that occur twice, and what surrounds them.
Surroundings that occur twice as a whole are repeated as they are.  The others of an anchor are
cut into blocks, and one suffix array over the blocks of all of them, made by linear grouping,
brings together the places that share enough blocks.  There the bytes themselves are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sieve, in_arrow, map_rows, row_key, sieve, stored, texts_of

LENGTH = 400
GRAM = 64
REACH = LENGTH - GRAM  # bytes a window may have before its anchor
BLOCK = 16
BLOCKS = (LENGTH - BLOCK + 1) // BLOCK  # whole blocks in any window
# Different surroundings of one anchor that one suffix array holds; more are told apart by the
# hashes of their windows, which needs no group in one place.
GROUP = 8192
SIEVE_BITS = 26
_PART = 1 << 17
_ROOT = 0x9E3779B97F4A7C15


# -- linear grouping --------------------------------------------------------------------------


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of ``text``, whose last symbol is less than all others.

    First phase: suffixes stand in groups by their first symbol.  Groups are taken in descending
    order; each suffix of a group gets its previous smaller suffix, the nearest one to the left
    whose group is lower.  Those move into new groups right above their old ones, the higher the
    more suffixes of the taken group follow them.  In the end a group holds the suffixes with one
    Lyndon word as their longest Lyndon prefix.  Second phase: groups are filled in ascending order
    by following the pointers from the symbol before each suffix; nothing is renamed or repeated.
    """
    n = len(text)
    symbols = sorted(set(text))
    number = {symbol: g for g, symbol in enumerate(symbols)}
    group = [number[symbol] for symbol in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    done = [False] * len(symbols)
    previous = [-1] * n
    order: list[int] = []  # groups, highest first
    g = len(symbols) - 1
    while g >= 0:
        own = members[g] = [p for p in members[g] if group[p] == g]  # without those that moved on
        done[g] = True
        order.append(g)
        if len(own) == 1:  # most groups of a text with few repeats
            s = own[0]
            p = s - 1
            while p >= 0 and done[group[p]]:
                p = previous[p]
            previous[s] = p
            if p < 0 or len(members[group[p]]) == 1:  # alone in its group, it need not move
                g = below[g]
                continue
        followed: dict[int, int] = {}  # suffixes of this group behind each previous smaller one
        for s in own:
            p = s - 1
            while p >= 0 and done[group[p]]:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                followed[p] = followed.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, count in followed.items():
            by_count.setdefault(count, []).append(p)
        tops: dict[int, int] = {}
        for count in sorted(by_count):
            fresh: dict[int, int] = {}
            for p in by_count[count]:
                old = group[p]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(members)
                    under = tops.get(old, old)
                    over = above[under]
                    members.append([])
                    done.append(False)
                    below.append(under)
                    above.append(over)
                    above[under] = new
                    if over >= 0:
                        below[over] = new
                members[new].append(p)
            for old, new in fresh.items():
                tops[old] = new
                for p in members[new]:
                    group[p] = new
        g = below[g]
    start, at = [0] * len(members), 0
    for g in reversed(order):
        start[g] = at
        at += len(members[g])
    out, placed = [n - 1] * n, [False] * n
    placed[n - 1] = True
    for rank in range(n):
        s = out[rank] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[start[g]] = s
            start[g] += 1
            placed[s] = True
            s = previous[s]
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Symbols that each suffix shares with the one before it in ``order``."""
    n = len(text)
    rank, out, k = [0] * n, [0] * n, 0
    for r, s in enumerate(order):
        rank[s] = r
    for i in range(n):
        if not rank[i]:
            k = 0
            continue
        j = order[rank[i] - 1]
        while i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        out[rank[i]] = k
        k = max(0, k - 1)
    return out


# -- anchors ----------------------------------------------------------------------------------


def _powers(base: int) -> np.ndarray:
    p = np.full(_PART, np.uint64(base), np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_UP, _DOWN = _powers(_ROOT), _powers(pow(_ROOT, -1, 1 << 64))


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of every GRAM bytes of at most _PART bytes."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _UP[: len(x)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(x) - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the rightmost least gram of every window of LENGTH bytes, and the starts
    of the first and last window that each of them is the anchor of."""
    parts = []
    for low in range(0, max(1, len(data) - LENGTH + 1), _PART - LENGTH + 1):
        part = data[low : low + _PART]
        if len(part) < LENGTH:
            break
        h, width = gram_hashes(part), REACH + 1
        key = (h >> np.uint64(24) << np.uint64(24)) | (np.uint64(0xFFFFFF) - np.arange(len(h), dtype=np.uint64))
        blocks = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - REACH
        least = np.minimum(behind[:n], ahead[REACH : REACH + n])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        at = (np.uint64(0xFFFFFF) - (least[first] & np.uint64(0xFFFFFF))).astype(np.int64)
        parts.append((at + low, h[at], first + low, last + low))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at, hashes, first, last = (np.concatenate(p) for p in zip(*parts, strict=True))
    new = np.concatenate([[True], at[1:] != at[:-1]])  # an anchor may go on in the next part
    return at[new], hashes[new], first[new], last[np.concatenate([new[1:], [True]])]


def around(data: bytes, at: int, first: int, last: int) -> tuple[int, bytes]:
    """The windows of an anchor, and how many bytes stand before it."""
    return at - first, data[first : last + LENGTH]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, before, size, anchor, whole): every anchor, with a hash of its surroundings."""

    def run(c: dict):
        out: dict[str, list] = {n: [] for n in ("doc_id", "th", "pos", "before", "size", "anchor", "whole")}
        for doc, th, text in zip(c["doc_id"].to_pylist(), c["th"].to_pylist(), texts_of(c["text"]), strict=True):
            data = text.encode()
            at, hashes, first, last = anchors(data)
            for p, h, a, b in zip(at.tolist(), hashes.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True):
                before, near = around(data, p, a, b)
                whole = xxhash.xxh3_64_intdigest(near, before)
                for n, v in zip(out, (doc, th, p, before, len(near), h, whole - (whole >> 63 << 64)), strict=True):
                    out[n].append(v)
        return out

    rows = docs.select("doc_id", row_key(F.col("text")).alias("th"), "text")
    return map_rows(rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, pos int, before int, size int, anchor long, whole long")


def place_key(th, pos) -> np.ndarray:
    """64-bit hash of a place in a row's text."""
    x = (np.asarray(th).view(np.uint64) ^ (np.asarray(pos).astype(np.uint64) * np.uint64(_ROOT))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) * np.uint64(_ROOT)


# -- repeated windows -------------------------------------------------------------------------


def repeated(group: list[tuple[object, int, int, bytes]]) -> list[list[tuple[int, int]]]:
    """For different surroundings of one anchor, (row, place in it, bytes before the anchor, bytes):
    the spans of each that are covered by windows which another place repeats.

    Surroundings in one row may overlap; a window is no repeat of itself.
    """
    text: list[int] = []
    place: list[tuple[int, int]] = []  # member and byte offset of each symbol
    ids: dict[bytes, int] = {}
    n = len(group)
    for m, (_, _, before, data) in enumerate(group):
        for o in range(before % BLOCK, len(data) - BLOCK + 1, BLOCK):
            text.append(n + 1 + ids.setdefault(data[o : o + BLOCK], len(ids)))
            place.append((m, o))
        text.append(m + 1)  # ends differ, so no shared run crosses from one member to the next
        place.append((m, -1))
    text.append(0)
    place.append((-1, -1))
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    starts: list[set[int]] = [set() for _ in group]

    def compare(cluster: list[tuple[int, int]]) -> None:
        for back in range(BLOCK):
            seen: dict[bytes, list[tuple[int, int]]] = {}
            for m, o in cluster:
                w = o - back
                data = group[m][3]
                if 0 <= w and w + LENGTH <= len(data):
                    seen.setdefault(data[w : w + LENGTH], []).append((m, w))
            for places in seen.values():
                if len({(group[m][0], group[m][1] + w) for m, w in places}) > 1:
                    for m, w in places:
                        starts[m].add(w)

    cluster: list[tuple[int, int]] = []
    for r in range(1, len(order)):
        if shared[r] >= BLOCKS:
            if not cluster:
                cluster = [place[order[r - 1]]]
            cluster.append(place[order[r]])
        elif cluster:
            compare(cluster)
            cluster = []
    if cluster:
        compare(cluster)
    return [joined(sorted(s)) for s in starts]


def joined(starts: list[int]) -> list[tuple[int, int]]:
    """Windows as maximal spans."""
    out: list[list[int]] = []
    for w in starts:
        if out and w <= out[-1][1]:
            out[-1][1] = w + LENGTH
        else:
            out.append([w, w + LENGTH])
    return [(a, b) for a, b in out]


def spans(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, th, start, end) of repeated bytes in rows of that id and text hash; spans may overlap."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    found = stored(scan(docs), "anchors")
    # stored, so that both sides of the next join are plain and a hot anchor can be split
    twice = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "twice")
    shared = stored(found.join(twice, "anchor", "left_semi"), "shared")
    first = F.min(F.struct("th", "pos"))
    classes = stored(shared.groupBy("anchor", "whole").agg(F.count("*").alias("n"), first.alias("at")), "classes")
    several = classes.where("n > 1").select("anchor", "whole")
    low = F.col("pos") - F.col("before")
    whole = shared.join(several, ["anchor", "whole"], "left_semi").select("doc_id", "th", low.alias("start"), (low + F.col("size")).alias("end"))
    by_anchor = classes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    open_classes = classes.join(by_anchor, "anchor").select("anchor", "kinds", "at.th", "at.pos")

    def keyed(c: dict):
        return {"key": place_key(c["th"].to_numpy(), c["pos"].to_numpy()).view(np.int64)}

    wanted = spark.sparkContext.broadcast(sieve(map_rows(open_classes.select("th", "pos"), keyed, "key long"), "key", SIEVE_BITS))
    large = by_anchor.where(F.col("kinds") > group)
    # Anchors go one way or the other as a whole, by the sieve, so members of a group stay together.
    routes = spark.sparkContext.broadcast(sieve(large, "anchor", 16))

    def cut(c: dict):
        picks, apart = wanted.value, routes.value
        for doc, th, text in zip(c["doc_id"].to_pylist(), c["th"].to_pylist(), texts_of(c["text"]), strict=True):
            data = text.encode()
            at, hashes, first, last = anchors(data)
            if not len(at):
                continue
            chosen = picks.maybe(place_key(np.full(len(at), th, np.int64), at))
            at, hashes = at[chosen], hashes[chosen]
            if not len(at):
                continue
            near = [around(data, *x) for x in zip(at.tolist(), first[chosen].tolist(), last[chosen].tolist(), strict=True)]
            n = len(at)
            yield {
                "doc_id": [doc] * n, "th": [th] * n, "pos": at, "before": [x[0] for x in near], "anchor": hashes.view(np.int64),
                "apart": apart.maybe(hashes), "data": [x[1] for x in near],
            }

    rows = docs.select("doc_id", row_key(F.col("text")).alias("th"), "text")
    contexts = stored(map_rows(rows, cut, f"doc_id {kind}, th long, pos int, before int, anchor long, apart boolean, data binary"), "contexts")

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, held = None, []
        out: dict[str, list] = {"doc_id": [], "th": [], "start": [], "end": []}

        def flush() -> None:
            kinds: dict[tuple[int, bytes], list[tuple]] = {}
            for doc, th, pos, before, data in held:
                kinds.setdefault((before, data), []).append((doc, th, pos - before))
            if len(kinds) < 2:
                return
            members = [(places[0][:2], places[0][2], *kind) for kind, places in kinds.items()]
            for places, got in zip(kinds.values(), repeated(members), strict=True):
                for doc, th, low in places:
                    for a, b in got:
                        for n, v in zip(out, (doc, th, low + a, low + b), strict=True):
                            out[n].append(v)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != anchor:
                    flush()
                    anchor, held = row[0], []
                held.append(row[1:])
            if len(out["th"]):
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                out = {"doc_id": [], "th": [], "start": [], "end": []}
        flush()
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("th", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
    ddl = f"doc_id {kind}, th long, start int, end int"
    # Surroundings that are equal as a whole are done, so one place of each is enough for the others:
    # at most ``group`` rows of an anchor meet, however many copies there are.
    near = contexts.where("NOT apart").dropDuplicates(["anchor", "th", "pos"]).join(open_classes, ["anchor", "th", "pos"], "left_semi")
    near = near.select("anchor", "doc_id", "th", "pos", "before", "data")
    arranged = in_arrow(near.repartition("anchor").sortWithinPartitions("anchor", "th", "pos"), arrange, ddl)

    def window_hashes(c: dict):
        for doc, th, pos, before, data in zip(*(c[n].to_pylist() for n in ("doc_id", "th", "pos", "before", "data")), strict=True):
            at = range(len(data) - LENGTH + 1)
            hashes = [xxhash.xxh3_128_digest(data[w : w + LENGTH]) for w in at]
            n = len(hashes)
            yield {"doc_id": [doc] * n, "th": [th] * n, "start": [pos - before + w for w in at], "window": hashes}

    windows = map_rows(contexts.where("apart"), window_hashes, f"doc_id {kind}, th long, start int, window binary").distinct()
    known = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    single = windows.join(known, "window", "left_semi").select("doc_id", "th", "start", (F.col("start") + LENGTH).alias("end"))
    return whole.union(arranged).union(single)


# -- removal ----------------------------------------------------------------------------------


def removed(data: bytes, found: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What remains, how many bytes went and in how many maximal runs."""
    kept, at, runs = [], 0, 0
    upto = -1
    for a, b in sorted(found):
        if a > upto:
            runs += 1
            kept.append(data[at:a])
        at = upto = max(upto, b)
    rest = b"".join([*kept, data[at:]])
    return rest, len(data) - len(rest), runs


def dedup(docs: DataFrame, group: int = GROUP, content: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; ``content`` adds the kept bytes.

    NULL and texts below LENGTH bytes keep all; rows that repeat a text lose all of it that is long
    enough.  Only rows with something to remove are moved, to meet their spans.
    """
    kind = dict(docs.dtypes)["doc_id"]
    made = stored(spans(docs, group), "spans").groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    made = stored(made, "by_row")
    touched: Sieve = sieve(made, "th", SIEVE_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(touched)
    rows = docs.select("doc_id", row_key(F.col("text")).alias("th"), "text")
    extra = ", kept binary" if content else ""
    ddl = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}"

    def result(ids, texts: list[str], found: list) -> dict:
        out: dict = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for text, s in zip(texts, found, strict=True):
            data = text.encode()
            rest, gone, runs = removed(data, [(x["start"], x["end"]) for x in s or ()])
            for n, v in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), (len(data), gone, runs, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                out[n].append(v)
        return out

    def plain(c: dict):
        other = pa.array(~shared.value.maybe(c["th"].to_numpy().view(np.uint64)))
        texts = texts_of(c["text"].filter(other))
        return result(c["doc_id"].filter(other), texts, [None] * len(texts))

    def moved(c: dict):
        mine = pa.array(shared.value.maybe(c["th"].to_numpy().view(np.uint64)))
        return {n: c[n].filter(mine) for n in ("doc_id", "th", "text")}

    def cut(c: dict):
        return result(c["doc_id"], texts_of(c["text"]), c["spans"].to_pylist())

    joined_rows = map_rows(rows, moved, f"doc_id {kind}, th long, text string").alias("r").join(
        made.alias("s"), F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.th") == F.col("s.th")), "left"
    )
    changed = map_rows(joined_rows.select("r.doc_id", "r.text", "s.spans"), cut, ddl)
    return map_rows(rows, plain, ddl).union(changed)
