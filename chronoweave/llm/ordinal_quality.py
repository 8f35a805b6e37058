"""Ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - w.x): one weight vector over hashed text features is shared
by ordered thresholds.  The expected grade and the tail probability P(grade >= g) select documents.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, texts_of, worker_cache

# Labelled rows the model is fitted on: those with the least hash of their id, so any larger set of
# labels gives a spread sample of this size.
SAMPLE_ROWS = 20_000
HASH_BITS = 20
# A feature gets a weight if its presence depends on the grade by this chi-square statistic (two
# degrees of freedom); chance alone reaches it for one of some millions of features.
CHI_SQUARE = 30.0
# ... and if documents with it miss the best grade so many times as often as all do.  Words that
# good texts merely have more of are left out: their sum would grow with the length of a text.
LIFT = 2.0
_CACHE = 200_000
_UPPER, _MARKS = bytes(range(65, 91)), b"#*$%&<>|!"


def _slot(text: bytes) -> int:
    return zlib.crc32(text) >> (32 - HASH_BITS)


def _of_word(word: bytes) -> tuple[int, ...]:
    core = word.strip(b".,!?;:|\"'()")
    text = core.decode("utf-8", "ignore")
    return tuple({_slot(b"w" + core), _slot(b"4" + text[:4].encode()), _slot(b"5" + text[:5].encode()), _slot(b"s" + word[-2:])})


def features(text: str) -> np.ndarray:
    """Slots of the features a text has, each once: words, word beginnings and endings, and binned
    shares of capitals, marks and distinct words.  The empty text has the bins only."""
    raw = text.encode()
    words = raw.lower().split()
    n = max(1, len(words))
    distinct = set(words)
    known = worker_cache("word features")
    if len(known) > _CACHE:
        known.clear()
    found: set[int] = set()
    for w in distinct:
        f = known.get(w)
        if f is None:
            f = known[w] = _of_word(w)
        found.update(f)
    capitals = (len(raw) - len(raw.translate(None, _UPPER))) / max(1, len(raw))
    marks = (len(raw) - len(raw.translate(None, _MARKS))) / n
    size = int(math.log2(n))
    for name, value in (("c", min(9, int(capitals * 10))), ("m", min(9, int(marks * 4))), (f"d{size}", int(10 * len(distinct) / n))):
        found.add(_slot(f"#{name}={value}".encode()))
    return np.fromiter(found, np.int64, len(found))


def grade(quality, toxic):
    """Graded rating: 0 low quality, 1 good prose but toxic, 2 good and clean."""
    return F.when(quality == 0, 0).when(F.coalesce(toxic, F.lit(0)) != 0, 1).otherwise(2)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # one for each hash slot
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """Rows of P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))

    def score(self, text: str) -> float:
        return float(self.weights[features(text)].sum())


def presence(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, chunk: int = 500) -> np.ndarray:
    """(grades, slots): in how many texts of a grade each slot occurs; a few texts are held at a time."""
    seen = np.zeros((n_grades, 1 << HASH_BITS), dtype=np.int32)
    for g in range(n_grades):
        mine = np.flatnonzero(grades == g)
        for at in range(0, len(mine), chunk):
            seen[g] += np.bincount(np.concatenate([rows[i] for i in mine[at : at + chunk]]), minlength=1 << HASH_BITS).astype(np.int32)
    return seen


def chi_square(seen: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Dependence of each slot's presence on the grade."""
    n, there = counts.sum(), seen.sum(axis=0)
    total = np.zeros(seen.shape[1])
    for g, m in enumerate(counts):
        if m:
            total += (seen[g] - there * (m / n)) ** 2 / m
    share = there / n
    return total / np.maximum(share * (1 - share), 1e-12)


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = 300, l2: float = 1e-6) -> OrdinalModel:
    """Maximum penalised likelihood over the features that tell grades apart."""
    weights = np.zeros(1 << HASH_BITS)
    counts = np.bincount(grades, minlength=n_grades)
    if not len(rows) or (counts > 0).sum() < 2:  # nothing to tell apart: every text gets the priors
        share = np.clip(counts.cumsum()[:-1] / max(1, len(rows)), 1e-6, 1 - 1e-6)
        return OrdinalModel(weights, np.log(share / (1 - share)))
    seen = presence(rows, grades, n_grades)
    there = np.maximum(seen.sum(axis=0), 1)
    worse = 1 - seen[-1] / there
    known = (chi_square(seen, counts) >= CHI_SQUARE) & (worse >= LIFT * (1 - counts[-1] / len(rows)))
    rows = [r[known[r]] for r in rows]
    flat, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, flat = np.unique(flat, return_inverse=True)
    n, k, m = len(rows), n_grades - 1, len(used)
    share = np.clip(counts.cumsum()[:-1] / n, 1e-3, 1 - 1e-3)
    levels = np.log(share / (1 - share))
    start = np.concatenate([np.zeros(m), levels[:1], np.log(np.maximum(np.diff(levels), 1e-2))])

    def cuts_of(x: np.ndarray) -> np.ndarray:
        return x[m] + np.concatenate([[0], np.exp(x[m + 1 :]).cumsum()])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        edges = np.concatenate([[-60.0], cuts_of(x), [60.0]])
        score = np.clip(np.bincount(doc, weights=x[:m][flat], minlength=n), -50, 50)
        hi, lo = 1 / (1 + np.exp(score - edges[grades + 1])), 1 / (1 + np.exp(score - edges[grades]))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        by_cut = np.array([d_lo[grades == j + 1].sum() - d_hi[grades == j].sum() for j in range(k)]) / n
        tail = by_cut[::-1].cumsum()[::-1]
        by_weight = np.bincount(flat, weights=(d_hi - d_lo)[doc], minlength=m) / n + l2 * x[:m]
        grad = np.concatenate([by_weight, tail[:1], tail[1:] * np.exp(x[m + 1 :])])
        return float(-np.log(p).mean() + l2 / 2 * (x[:m] ** 2).sum()), grad

    x = minimise(loss, start, rounds)
    weights[used] = x[:m]
    return OrdinalModel(weights, cuts_of(x))


def minimise(loss, x: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton steps with a backtracking line search."""
    value, grad = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, used = grad.copy(), []
        for s, y, r in reversed(steps):
            used.append(a := r * (s @ d))
            d -= a * y
        if steps:
            s, y, _ = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(steps, reversed(used), strict=True):
            d += s * (a - r * (y @ d))
        slope, size = grad @ d, 1.0 if steps else 1 / max(1.0, np.abs(grad).sum())
        if slope < 1e-10:
            break
        while size > 1e-8:
            new, (new_value, new_grad) = x - size * d, loss(x - size * d)
            if new_value <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            steps = [*steps[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = value - new_value < 1e-9
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most ``sample_rows`` labelled documents.

    ``labels`` (doc_id, quality, toxic): rows without quality are left out, several ratings of a
    document count as the lowest.  Several documents of one id are all used.
    """
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min(grade(F.col("quality"), F.col("toxic"))).alias("_grade")
    )
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(c: dict):
        return {"grade": c["_grade"], "slots": [features(t).astype(np.int32).tobytes() for t in texts_of(c["text"])]}

    table = map_rows(rows.select("text", "_grade"), run, "grade int, slots binary").toArrow()
    got = sorted(zip(table["grade"].to_pylist(), table["slots"].to_pylist(), strict=True))  # the same fit for any row order
    del table
    return fit_rows([np.frombuffer(s, np.int32) for _, s in got], np.array([g for g, _ in got], dtype=np.int64), 3)


def classify(docs: DataFrame, model: OrdinalModel, least: int = 2, probability: float = 0.8) -> DataFrame:
    """``docs`` plus score, expected_grade, p_grade_1, p_grade_2 and kept: P(grade >= least) >= probability.

    NULL and empty texts are scored by their bins; every row gets one result.  Columns of ``docs``
    with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    made = ["score", "expected_grade", "p_grade_1", "p_grade_2", "kept"]
    old = [c for c in docs.columns if c.lower() not in made]
    docs = docs.select(*[F.col(f"`{c}`") for c in old])

    def run(c: dict):
        local = OrdinalModel(*shared.value)
        scores = np.array([local.score(t) for t in texts_of(c["text"])])
        tails = local.tails(scores)
        return c | {
            "score": scores, "expected_grade": tails.sum(axis=1), "p_grade_1": tails[:, 0], "p_grade_2": tails[:, 1],
            "kept": tails[:, least - 1] >= probability,
        }

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(docs, run, f"{kinds}, score double, expected_grade double, p_grade_1 double, p_grade_2 double, kept boolean")


def keep(docs: DataFrame, model: OrdinalModel, least: int = 2, probability: float = 0.8) -> DataFrame:
    """Rows of ``docs`` with P(grade >= least) >= probability, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(c: dict):
        local = OrdinalModel(*shared.value)
        tails = local.tails(np.array([local.score(t) for t in texts_of(c["text"])]))
        good = pa.array(tails[:, least - 1] >= probability)
        return {n: a.filter(good) for n, a in c.items()}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(docs, run, kinds)


def select(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels and classify every document."""
    return classify(docs, fit(docs, labels))
