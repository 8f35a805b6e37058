"""Dictionary scan and overlap resolution against a scan name by name."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from chronoweave.operators import places

NAMES = "name_pos int, surface string, name string, kind string, country string, lat double, lon double"


def plain_locations(text, names):
    used, hits = [], []
    for surface in sorted(names, key=len, reverse=True):
        for m in re.finditer(r"\b" + re.escape(surface) + r"\b", text, re.IGNORECASE):
            if not any(m.end() > a and m.start() < b for a, b in used):
                used.append(m.span())
                hits.append((*m.span(), surface))
    return hits


def name_rows(names):
    return [(i, n, n, "city", "X", 1.0, 2.0) for i, n in enumerate(names)]


def test_hits_and_overlaps_equal_a_scan_by_name(spark):
    rng = random.Random(4)
    words = ["bad", "Bad", "Berg", "neu", "Neu-Berg", "am", "see", "St.", "über", "x"]
    names = ["Bad Berg", "berg", "Neu Berg am See", "am see", "See bad", "Bad Berg neu", "neu", "St. Berg", "Neu-Berg", "über x über", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += ["", None, "berg", "Berg,bad  berg;Bad Berg", "Bad\nBerg", "bergig unberg berg_ berg"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = places.dictionary_locations(docs, "id", spark.createDataFrame(name_rows(names), NAMES))
    assert got.columns == ["id", "start", "end", "name", "kind", "country", "lat", "lon"]
    want = Counter((i, *h) for i, t in enumerate(texts) for h in plain_locations(t or "", names))
    assert Counter((r.id, r.start, r.end, r.name) for r in got.collect()) == want


def test_a_full_bitmap_and_an_empty_dictionary(spark, monkeypatch):
    names = [f"w{i}" for i in range(200)] + ["w1 w2", "w2 w3 w4"]
    text = " ".join(f"w{i % 230}" for i in range(1000))
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    given = spark.createDataFrame(name_rows(names), NAMES)
    want = sorted(plain_locations(text, names))
    for slots in (64, places.FILTER_SLOTS):  # in the first every bit is set
        monkeypatch.setattr(places, "FILTER_SLOTS", slots)
        assert sorted((r.start, r.end, r.name) for r in places.dictionary_locations(docs, "id", given).collect()) == want
    assert places.dictionary_locations(docs, "id", given.limit(0)).count() == 0


def test_clusters_of_a_sweep_keep_chained_hits(spark):
    # the middle one loses to the first, so the last stays; each pair overlaps its neighbour only
    rows = [(1, 0, 10, 0), (1, 8, 16, 1), (1, 15, 20, 2), (1, 20, 22, 3), (2, 0, 3, 0), (2, 0, 3, 1)]
    hits = spark.createDataFrame(rows, "id int, start int, end int, name_pos int")
    got = places.resolve_overlaps(hits, "id", [F.col("start") - F.col("end"), F.col("name_pos")])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 10, 0), (1, 15, 20, 2), (1, 20, 22, 3), (2, 0, 3, 0)]


def test_a_long_text_of_words_that_start_no_form(spark):
    docs = spark.range(1).selectExpr("id", "repeat('word ', 5000) || 'Bad Berg' AS text")
    hits = places.dictionary_hits(docs, "id", spark.createDataFrame(name_rows(["Bad Berg"]), NAMES))
    assert [tuple(r)[1:3] for r in hits.collect()] == [(25000, 25008)]


def test_word_runs_are_unicode_words(spark):
    """ASCII first gives the same words as the Unicode class, for every code point."""
    points = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343")
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    differ = points.where(c.rlike(r"(?U)^\w+$") != c.rlike(f"^{places.WORD_RUN}$"))
    assert differ.count() == 0


def test_first_words_are_marked_without_their_number_too(spark):
    """A word is hashed once: the bitmap tells under number 0 whether any form starts with it."""
    forms = spark.createDataFrame([("bad", 2), ("neu", 1)], "first string, n_words int")
    bits = places._first_words(forms).first()["bits"]
    slots = {r[0] for r in forms.select(places._slot(F.col("first"), F.lit(0))).collect()}
    slots |= {r[0] for r in forms.select(places._slot(F.col("first"), F.col("n_words"))).collect()}
    assert {64 * i + b for i, long in enumerate(bits) for b in range(64) if long >> b & 1} == slots
