"""Periodic runs of words, found in an enhanced suffix array by branching tandem repeats.

A run is a stretch of consecutive words with smallest period ``q`` that no neighbouring word extends.
Its last square (two equal halves of ``q`` words) ends where the run ends: both halves start the same
``q`` words and go on differently, so their suffixes lie in different children of the LCP interval of
depth ``q``.  For every interval the suffixes of all children but the largest are looked up ``q``
words ahead and behind by the inverse suffix array; squares found there are rotated to the left as
far as the period holds, which gives the whole run.  Intervals come from a stack over the LCP array;
no tree is built.

Only words that can lie in a run enter the arrays: all parts of a run of at least ``min_words`` words
and ``times`` periods repeat ``min_words - min_words // times`` words later, so words outside such
repeated windows are left out beforehand.  Windows are compared by hashes, which can only let
through too much.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Characters of texts that are handled at a time: a bound of memory, not of results.
CHUNK_CHARS = 2_000_000


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse and the LCP array (``lcp[i]`` of the suffixes ``i - 1`` and ``i``).

    The last code occurs once.  Ranks by the first 1, 2, 4 ... codes are kept, and the common prefix
    of two neighbours is put together from them, longest first.
    """
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while rank[order[-1]] < n - 1:
        behind = np.zeros(n, dtype=np.int64)
        behind[:-width] = rank[width:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        by_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.append(0, np.cumsum(by_key[1:] != by_key[:-1]))
        levels.append(rank.astype(np.int32))
        width *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step, level = 1 << k, levels[k]
        inside = (a < n) & (b < n)
        same = inside & (level[np.where(inside, a, 0)] == level[np.where(inside, b, 0)])
        lcp[1:][same] += step
        a[same] += step
        b[same] += step
    return order, rank, lcp


def small_children(lcp: np.ndarray, deepest: int) -> np.ndarray:
    """Rows (from, to, low, high, depth): all children but the largest of every LCP interval.

    ``from`` to ``to`` (exclusive) are the places of a child in the suffix array, ``low`` to ``high``
    (inclusive) those of its interval.  Intervals of depth 0 or more than ``deepest`` are left out.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    depths, lows, splits = [0], [0], [[]]
    values = lcp.tolist()
    values.append(0)
    for i in range(1, len(values)):
        depth, low = values[i], i - 1
        while depth < depths[-1]:
            d, low, cuts = depths.pop(), lows.pop(), splits.pop()
            if d <= deepest:
                bounds = [low, *cuts, i]
                largest = max(range(len(bounds) - 1), key=lambda c: bounds[c + 1] - bounds[c])
                rows += [(bounds[c], bounds[c + 1], low, i - 1, d) for c in range(len(bounds) - 1) if c != largest]
        if depth > depths[-1]:
            depths.append(depth)
            lows.append(low)
            splits.append([i])
        elif depth:
            splits[-1].append(i)
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def branching_squares(codes: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of all squares that the code behind them doesn't continue."""
    order, place, lcp = suffix_array(codes)
    begin, end, low, high, depth = small_children(lcp, deepest).T
    sizes = end - begin
    each = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    suffix = order[begin[each] + inner]
    low, high, depth, n = low[each], high[each], depth[each], len(codes)
    found = []
    for first in (suffix, suffix - depth):  # the suffix is the first half, then the second one
        other = first + depth if first is suffix else first
        ok = (other >= 0) & (other < n)
        at = place[np.where(ok, other, 0)]
        ok &= (at >= low) & (at <= high)
        i, d = first[ok], depth[ok]
        differs = codes[i + d] != codes[i + 2 * d]
        found.append((i[differs], d[differs]))
    both = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
    return both[0], both[1]


def rotated(codes: np.ndarray, start: int, period: int) -> int:
    """First place from which ``period`` holds up to ``start``."""
    step = 64
    while start:
        low = max(0, start - step)
        differs = np.flatnonzero(codes[low:start] != codes[low + period : start + period])
        if len(differs):
            return low + int(differs[-1]) + 1
        start, step = low, step * 2
    return 0


def runs_of(codes: np.ndarray, min_words: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in ``codes``, whose last one occurs once."""
    starts, periods = branching_squares(codes, len(codes) // times)
    known: dict[int, list[tuple[int, int]]] = {}
    for k in np.argsort(periods, kind="stable").tolist():
        i, q = int(starts[k]), int(periods[k])
        same_end = known.setdefault(i + 2 * q, [])
        # a square of several shorter periods belongs to the run of the shorter one
        if not any(q % p == 0 and s <= i for s, p in same_end):
            same_end.append((rotated(codes, i, q), q))
    found = [(s, end - s, q) for end, runs in known.items() for s, q in runs]
    return sorted(r for r in found if r[1] >= max(min_words, times * r[2]))


def repeated(words: list[list[str]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of all words of all texts that lie in a window found twice in its text, and offsets."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    covered = np.zeros(total + 1, dtype=np.int64)
    if total > window:
        hashes = np.fromiter((hash(w) for text in words for w in text), np.int64, total).view(np.uint64)
        base = 0x9E3779B97F4A7C15
        power = np.cumprod(np.append(np.uint64(1), np.full(total - 1, base, np.uint64)))
        back = np.cumprod(np.append(np.uint64(1), np.full(total - 1, pow(base, -1, 1 << 64), np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(hashes * power))
        rolled = (sums[window:] - sums[:-window]) * back[: total - window + 1]
        text = np.repeat(np.arange(len(words)), sizes)
        whole = text[: len(rolled)] == text[window - 1 :]
        at = np.flatnonzero(whole)
        key = (rolled[at] ^ (rolled[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + text[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        order = np.argsort(key, kind="stable")
        equal = np.flatnonzero(key[order][1:] == key[order][:-1])
        twice = at[np.unique(np.concatenate([order[equal], order[equal + 1]]))]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + window, -1)
    return np.cumsum(covered)[:total] > 0, ends - sizes


def find_runs(words: list[list[str]], min_words: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of every text, by start and then period."""
    flags, begins = repeated(words, min_words - min_words // times)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    owner = np.searchsorted(begins, edges[::2], side="right") - 1
    made: list[list[tuple[int, int, int]]] = [[] for _ in words]
    stretches = []  # (text, first word, number of words); a stretch over two texts is cut
    for text, low, high in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        while low < high:
            upto = min(high, int(begins[text]) + len(words[text]))
            if upto - low >= min_words:
                stretches.append((text, low - int(begins[text]), upto - low))
            low, text = upto, text + 1
    lines, starts, owners, at, used = [], [], [], 0, 0
    for text, mine in groupby(stretches, key=lambda s: s[0]):
        numbers: dict[str, int] = {}  # words of different texts have different codes
        for _, first, n in mine:
            lines.append([numbers.setdefault(w, used + len(numbers)) for w in words[text][first : first + n]])
            starts.append(at)
            owners.append((text, first))
            at += n + 1
        used += len(numbers)
    if not lines:
        return made
    # a code of its own behind every stretch
    flat = np.concatenate([x for k, line in enumerate(lines) for x in (np.array(line), [used + k])])
    for s, n, q in runs_of(flat, min_words, times):
        k = int(np.searchsorted(starts, s, side="right")) - 1
        text, first = owners[k]
        made[text].append((first + s - starts[k], n, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in made]


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    inside = np.cumsum(change)[:-1] > 0
    return [w for w, gone in zip(words, inside.tolist(), strict=True) if not gone]


def scan(
    docs: DataFrame, min_words: int = 24, times: int = 3, rewrite: Callable[[object, list[str]], list[str]] | None = None
) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start,length,period>>, collapsed) of every row.

    Runs have at least ``min_words`` words and ``times`` periods and stand by start, then period.
    ``collapsed`` has the words outside the repetitions, joined by blanks.  ``rewrite(doc_id, words)``
    may change the words first.  NULL is like the empty text: no words, no runs and an empty result;
    repeated rows and NULL ids keep a row each, other columns are left out, an empty table gives no
    rows.  Every text is scanned whole and by itself, whatever its length.
    """

    def run(columns: dict) -> Iterator[dict]:
        ids, texts = columns["doc_id"], texts_of(columns["text"])
        at = 0
        while at < len(texts):
            upto, size, words = at, 0, []
            while upto < len(texts) and (not words or size + len(texts[upto]) <= CHUNK_CHARS):
                size += len(texts[upto])
                line = WORD.findall(texts[upto])
                words.append(rewrite(ids[upto].as_py(), line) if rewrite else line)
                upto += 1
            runs = find_runs(words, min_words, times)
            yield {
                "doc_id": ids[at:upto],
                "n_words": [len(w) for w in words],
                "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs],
                "collapsed": [" ".join(kept_words(w, r)) for w, r in zip(words, runs, strict=True)],
            }
            at = upto

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_rows(docs.select("doc_id", "text"), run, schema)


def with_periodic_tail(doc_id: int | None, words: list[str]) -> list[str]:
    """Every tenth document's words from some place on repeat with a period that fits three times or
    more, both by a hash of the id; other documents, and those without an id, stay as they are."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % period] for k in range(n - a)]


def report(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): digest of
    ``scan``'s rows with the run of the greatest length by period; ties go to the smaller start, then
    the smaller period.  Without runs the run's columns are NULL and the first digest is that of an
    empty text.
    """

    def better(a: Column, b: Column) -> Column:
        x, y = b["length"] * a["period"], a["length"] * b["period"]
        earlier = F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"])
        return (x > y) | ((x == y) & earlier)

    first = F.get("runs", F.lit(0))
    best = F.aggregate(F.col("runs"), first, lambda a, b: F.when(better(a, b), b).otherwise(a))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return scanned.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
