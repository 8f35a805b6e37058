"""Bounded top-k similarity against all pairs."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import metrics, similarity


def plain_top(rows, n, measure):
    vectors = defaultdict(dict)
    for item, feature, weight in rows:
        if item is not None and feature is not None:
            w = 1.0 if measure == "jaccard" else weight
            vectors[item][feature] = max(w, vectors[item].get(feature, 0))
    out = []
    for a, x in vectors.items():
        scored = []
        for b, y in vectors.items():
            dot = sum(w * y[f] for f, w in x.items() if f in y)
            na, nb = sum(w * w for w in x.values()), sum(w * w for w in y.values())
            s = round(dot / (na + nb - dot) if measure == "jaccard" else dot / math.sqrt(na) / math.sqrt(nb), 6)
            if a != b and s > 0:
                scored.append((-s, b))
        out += [(a, b, -s, r + 1) for r, (s, b) in enumerate(sorted(scored)[:n])]
    return sorted(out)


def made(seed, items=70, features=40):
    rng = random.Random(seed)
    rows = []
    for i in range(items):
        # a few features that most items hold, and many that few do
        held = {rng.randrange(3) for _ in range(rng.randint(0, 3))} | {rng.randrange(features) for _ in range(rng.randint(0, 6))}
        rows += [(i, f, rng.choice([0.5, 1.0, 2.0, 3.0])) for f in held]
    return rows + [(0, 1, 1.0), (0, 1, 1.0), (None, 1, 1.0), (3, None, 1.0), (500, 999, 1.0)]


@pytest.mark.parametrize("measure", ["jaccard", "cosine"])
@pytest.mark.parametrize(("rare", "suggested"), [(200, 20), (4, 2), (0, 1)])
def test_top_equals_all_pairs(spark, measure, rare, suggested):
    rows = made(rare)
    vectors = spark.createDataFrame(rows, "item long, feature long, weight double")
    got = similarity.top_similar(vectors, 4, measure, rare, suggested)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 4, measure)


def test_frequent_features_are_only_asked_while_their_bound_holds(spark):
    # everybody holds feature 0; twins also share two of their own, so nobody has to ask by it
    rows = [(i, 0, 1.0) for i in range(60)] + [(i, 1000 + i // 4 * 10 + k, 1.0) for i in range(60) for k in range(2)]
    ranked = spark.createDataFrame(rows, "item long, feature long, weight double")
    held = ranked.groupBy("feature").agg(F.count(F.lit(1)).alias("held"))
    ranked = ranked.join(held, "feature")
    norms = ranked.groupBy("item").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm"))
    frequent = ranked.where("held > 10")
    for least, asking in ((1.0, 0), (0.2, 60)):
        known = norms.select("item", F.lit(least).alias("least"))
        assert similarity._asking(ranked, frequent, norms, known, "jaccard").count() == asking
    assert similarity.top_similar(ranked, 3, "jaccard", rare=10, suggested=2).where("similarity < 1").count() == 0


def test_empty_and_unknown_measure(spark):
    none = spark.createDataFrame([], "item long, feature long, weight double")
    assert similarity.top_similar(none).count() == 0
    with pytest.raises(ValueError, match="measure"):
        similarity.top_similar(none, measure="dice")


def test_pairs_looked_up_equal_the_complete_table(spark):
    rng = random.Random(8)
    vectors = spark.createDataFrame([(c, f"t{t}", float(rng.randint(1, 9))) for c in range(8) for t in rng.sample(range(12), 5)], "cluster_id long, term string, weight double")
    pairs = spark.createDataFrame([(0, 1), (2, 5)], "cluster_a long, cluster_b long")
    keep = "(cluster_a = 0 AND cluster_b = 1) OR (cluster_a = 2 AND cluster_b = 5)"
    for every, some in ((metrics.pair_cosine(vectors), metrics.pair_cosine(vectors, pairs)), (metrics.bridge_terms(vectors), metrics.bridge_terms(vectors, pairs=pairs))):
        assert sorted(map(tuple, every.where(keep).collect())) == sorted(map(tuple, some.collect()))
