"""Periodic runs against a definition-by-definition search."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from chronoweave.llm import periodic_runs
from test_llm_spark import SCHEMA, made_rows


def plain_runs(words, min_words=24, times=3):
    """All runs straight from the definition: for every period the maximal stretches that keep it,
    without those that a shorter period explains."""
    numbers = {}
    codes, found = np.array([numbers.setdefault(w, len(numbers)) for w in words]), {}
    for q in range(1, len(words) // times + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (codes[q:] == codes[:-q]).astype(int), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            n = e - s + q
            if n >= max(min_words, times * q) and (s, n) not in found:
                found[s, n] = q
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, milli, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_text(rng, letters="abcd"):
    words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 4)):
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 25))]
        n = rng.randint(0, 4 * len(unit) + 20)
        words += [unit[i % len(unit)] for i in range(n)] + [rng.choice(letters) for _ in range(rng.randint(0, 8))]
    return words


def test_arrays_by_hand():
    codes = np.array([1, 2, 1, 2, 1, 3])
    order, place, lcp = periodic_runs.suffix_array(codes)
    assert order.tolist() == [0, 2, 4, 1, 3, 5] and lcp.tolist() == [0, 3, 1, 0, 2, 0]
    assert place[order].tolist() == list(range(6))
    starts, halves = periodic_runs.branching_squares(codes, 6)
    assert list(zip(starts.tolist(), halves.tolist())) == [(1, 2)]
    assert periodic_runs.rotated(codes, 1, 2) == 0


@pytest.mark.parametrize(("min_words", "times"), [(24, 3), (4, 2), (1, 2), (10, 5)])
def test_runs_equal_the_definition(min_words, times):
    rng = random.Random(min_words)
    for letters in ("a", "ab", "abcd", "abcdefghijklmnop"):
        texts = [periodic_text(rng, letters) for _ in range(60)] + [[], ["a"], ["a"] * 24, ["a"] * 23, list("ab") * 40]
        got = periodic_runs.find_runs(texts, min_words, times)
        assert got == [plain_runs(t, min_words, times) for t in texts]


def test_runs_of_long_texts():
    rng = random.Random(3)
    noise = [str(rng.random()) for _ in range(5000)]
    unit = noise[:1500]
    texts = [noise + unit * 4 + noise[::-1], ["a", "b", "a"] * 4000, ["x"] * 9000]
    assert periodic_runs.find_runs(texts) == [[(5000, 6000, 1500)], [(0, 12000, 3)], [(0, 9000, 1)]]


def test_collapsed_words():
    words = "x y a b a b a b z".split()
    assert periodic_runs.kept_words(words, [(2, 6, 2)]) == "x y a b z".split()
    assert periodic_runs.kept_words(words, []) == words


def test_operator_over_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(i, (t or "")[:40_000] if t is not None else None, *rest) for i, t, *rest in made_rows()]
    rows += [(1000 + i, " \n".join(periodic_text(rng)), "en", "s", 1) for i in range(80)] + [(2000, "é x\xa0y " * 50, "fr", "s", 1)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS runs", "0 AS period", "'y' AS collapsed").repartition(3)
    scanned = periodic_runs.scan(docs, rewrite=periodic_runs.with_periodic_tail)
    got = periodic_runs.report(scanned)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_row(i, t) for i, t, *_ in rows)
    assert got.filter("n_runs > 0").count() > 20
    assert periodic_runs.report(periodic_runs.scan(docs.limit(0))).count() == 0
