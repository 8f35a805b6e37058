"""Scalar functions and extraction on hand-made rows."""

import datetime as dt
import html
import random
import re

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import classify, dates, numeric, text
from chronoweave.operators import keyphrases, mentions, people, places, spans


def one(spark, build, *values):
    df = spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))])
    return df.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def many(spark, build, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["x"] for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


REFERENCES = [
    "plain",
    "a &amp; b",
    "&amp;lt;b&amp;gt;",
    "&lt;b&gt;",
    "&auml;&Ouml;&szlig;&nbsp;&hellip;",
    "&#65;&#x42;&#x1F600;",
    "&#128;&#150;&#0;&#xD800;",
    "AT&T & co",
    "&copy 2020 &notit; &bogus;",
    "x &amp &lt",
    "?a=1&copy=2&x=&",
    "&#38;lt; &;&",
]


def test_unescape_matches_the_standard_table(spark):
    assert many(spark, text.unescape_html, REFERENCES) == [html.unescape(v) for v in REFERENCES]


def test_html_to_text_keeps_paragraphs(spark):
    raw = "<p>Eins</p><p>Zwei<br/>Drei</p>\n\n\n&lt;i&gt;vier&lt;/i&gt;   f&uuml;nf "
    assert one(spark, text.html_to_text, raw) == "Eins\nZwei\nDrei\n\nvier fünf"


def test_clean_description_drops_footer_and_ads(spark):
    raw = "Erste Zeile<br>Folgt uns auf Instagram!<br> <br>Zweite +++++ Werbung"
    assert one(spark, text.clean_description, raw) == "Erste Zeile\nZweite"


def test_segments_of_raw_text(spark):
    raw = "Das erwartet euch: A\n \nMain\n\nDas Folgenbild zeigt X\n\n\n"
    got = [(s["section"], s["text"]) for s in one(spark, text.segments, raw)]
    assert got == [("outline", "Das erwartet euch: A"), ("main", "Main"), ("caption", "Das Folgenbild zeigt X")]


def test_norm_key(spark):
    got = many(spark, text.norm_key, [" Frankfurt-am_Main/West ", "Köln (Dom)", "São Paulo"])
    assert got == ["frankfurt am main west", "köln dom", "so paulo"]


def test_durations(spark):
    got = many(spark, dates.duration_seconds, ["3600", "1:02:03", "02:03", "x", "1:x", "", None])
    assert got == [3600, 3723, 123, None, None, None, None]


def test_publication_dates(spark):
    got = many(spark, dates.pub_timestamp, ["Mon, 05 Feb 2024 10:00:00 GMT", "5 Feb 2024 10:00:00 +0200", "bad", ""])
    assert got == [dt.datetime(2024, 2, 5, 10), dt.datetime(2024, 2, 5, 8), None, None]


def test_mid_years_differ_on_purpose(spark):
    df = spark.createDataFrame([(dt.date(1910, 1, 1), dt.date(1911, 12, 31))], "a date, b date")
    r = df.select(dates.mid_year("a", "b").alias("d"), dates.mid_year_by_month(F.col("a"), F.col("b")).alias("m")).first()
    assert r["d"] == pytest.approx(1910 + 365 / 366)
    assert r["m"] == pytest.approx(1910 + 11 / 12)


def test_cluster_count_rounds_half_even(spark):
    df = spark.createDataFrame([(0,), (4,), (30,), (42,), (1000,)], "n int")
    assert [r[0] for r in df.select(numeric.cluster_count(F.col("n"))).collect()] == [0, 4, 5, 6, 16]


@pytest.mark.parametrize(
    "sentence,label",
    [
        ("Die Schlacht und der Mord", "battle"),
        ("Das Attentat", "assassination"),
        ("Die Sturmflut", "disaster"),
        ("Prager Frühling", "revolution"),
        ("Der Mauerfall", "political_change"),
        ("Der Krieg", "conflict"),
        ("Die Regierung", "politics"),
        ("Ein Tag", "other"),
    ],
)
def test_incident_ladder(spark, sentence, label):
    assert one(spark, classify.incident_type, sentence) == label


def test_links_and_types(spark):
    raw = "siehe (https://a.de/x), https://www.instagram.com/y. und http://b.de/z"
    assert one(spark, classify.plain_links, raw) == ["https://a.de/x", "https://www.instagram.com/y.", "http://b.de/z"]
    urls = one(spark, classify.trimmed_links, raw)
    assert urls == ["https://a.de/x", "https://www.instagram.com/y", "http://b.de/z"]
    kinds = [one(spark, classify.link_type, u, "https://a.de/ep/1") for u in urls]
    assert kinds == ["internal", "advert", "external"]


def test_guid_of_url(spark):
    assert one(spark, classify.guid_of_url, "https://h/episode/123/t") == "podcastde:123"
    assert len(one(spark, classify.guid_of_url, "https://h/x")) == len("podcastde:") + 12


def span_rows(spark, raw, section="main"):
    df = spark.createDataFrame([(1, raw, section)], "id int, text string, section string")
    return spans.extract_spans(df, ["id"]).orderBy("span_pos").collect()


def test_spans_emit_all_families_in_score_order(spark):
    got = span_rows(spark, "Am 3.10.1990 12:30, 1914-18, im 19. Jahrhundert, 31.2.1999")
    assert [(r["precision"], r["source_text"]) for r in got] == [
        ("minute", "3.10.1990 12:30"),
        ("day", "3.10.1990"),
        ("year", "1914-18"),
        ("year", "1990"),
        ("year", "1914"),
        ("year", "1999"),
        ("century", "19. Jahrhundert"),
    ]
    century = got[-1]
    assert (century["start_date"], century["end_date"]) == (dt.date(1801, 1, 1), dt.date(1900, 12, 31))


def test_short_range_end_follows_the_start_digits(spark):
    row = span_rows(spark, "Reich 708-19")[0]
    assert (row["start_date"].year, row["end_date"].year) == (708, 7019)


def test_cue_boost_and_caption_penalty(spark):
    plain, cue = span_rows(spark, "Es war 1950.")[0], span_rows(spark, "Im Jahr 1950.")[0]
    assert cue["score"] == pytest.approx(plain["score"] * 1.35)
    caption = span_rows(spark, "Das Folgenbild zeigt ein Porträt aus dem Jahr 1850", "caption")[0]
    assert caption["review_flag"] == "caption-portrait-year"
    assert caption["score"] == pytest.approx(6 * 0.25 * 0.18 * 0.35 * 0.22)


def test_repeated_spans_collapse_and_bad_dates_drop(spark):
    got = span_rows(spark, "1950 und 1950, 99.99.1950")
    assert [r["source_text"] for r in got] == ["1950"]


def test_place_candidates(spark):
    got = one(spark, places.place_candidates, "Er reiste nach Köln und nach Köln. Westsahara, Uhr")
    assert got == ["Köln", "Köln", "Westsahara"]


def test_time_mentions_order_and_bc(spark):
    got = [(m["kind"], m["year"], m["start_year"], m["end_year"]) for m in one(spark, mentions.time_mention_array, "Von 1914-18, dann 480 v. Chr. und 1920")]
    assert got == [("range_year", None, 1914, 1918), ("year", 480, None, None), ("year", -480, None, None), ("year", 1920, None, None)]


def test_mention_positions_are_character_offsets(spark):
    raw = "Über 1914–18 — äöü 1950"
    for m in one(spark, mentions.time_mention_array, raw):
        assert raw[m["start"] : m["end"]] in ("1914–18", "1950")


def test_primary_time_prefers_years(spark):
    assert one(spark, mentions.primary_time, "1914-18 und 1920")["year"] == 1920
    assert one(spark, mentions.primary_time, "nur 1914-18")["kind"] == "range"
    assert one(spark, mentions.primary_time, "nichts")["kind"] == "unknown"
    assert one(spark, mentions.primary_time, "44 v. Chr.")["year"] == -44


def test_person_names(spark):
    raw = "Personen: Otto von Bismarck und Anna Maria Schmidt. Ludwig van Beethoven, Erster Krieg"
    assert one(spark, people.person_names, raw) == ["Otto von Bismarck", "Anna Maria Schmidt", "Ludwig van Beethoven"]


def test_entities(spark):
    raw = "Schlacht von Verdun. Die Freie Universität lud Karl Marx und Karl  Marx ein."
    got = [(e["kind"], e["name"]) for e in one(spark, people.entity_array, raw)]
    assert got == [
        ("event", "Schlacht von Verdun"),
        ("org", "Die Freie Universität"),
        ("person", "Schlacht von Verdun"),
        ("person", "Die Freie"),
        ("person", "Karl Marx"),
    ]


def test_keyphrases(spark):
    df = spark.createDataFrame([(1, "Der große Krieg und der große Sturm, großer Krieg")], "id int, text string")
    got = [(r["phrase"], r["score"]) for r in keyphrases.keyphrases(df, "id").orderBy("rank").collect()]
    # große: runs 2+2 of 2 uses; krieg: 2+3 of 2 uses; "sturm großer krieg" is one run of three
    assert got[0] == ("große sturm großer krieg", pytest.approx(3 + 4 + 4 + 3))
    assert got[1] == ("große krieg", pytest.approx(6))


def test_spans_do_not_depend_on_partitioning(spark):
    rows = [(i, f"Im Jahr {1000 + i} und {1100 + i}-{i % 90 + 10}", "main") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, text string, section string")
    a = spans.extract_spans(df.repartition(1), ["id"]).orderBy("id", "span_pos").collect()
    b = spans.extract_spans(df.repartition(7), ["id"]).orderBy("id", "span_pos").collect()
    assert a == b


def test_keyphrases_equal_a_plain_count(spark):
    import random
    from collections import Counter

    rng = random.Random(6)
    words = ["krieg", "kaiser", "reich", "und", "der", "ab", "stadt", "könig", "1848", "Revolution"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None, "ab der und"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in keyphrases.keyphrases(df, "id", max_phrases=5).orderBy("rank").collect():
        got.setdefault(r.id, []).append((r.phrase, round(r.score, 6), r["rank"]))
    for i, text in enumerate(texts):
        runs, run = [], []
        for w in [*re.split(r"[^A-Za-zÄÖÜäöüß0-9]+", (text or "").lower()), ""]:
            if len(w) <= 2 or w in keyphrases.STOP_WORDS:
                runs, run = runs + ([run] if run else []), []
            else:
                run.append(w)
        degree, count = Counter(), Counter()
        for r in runs:
            for w in r:
                degree[w] += len(r)
                count[w] += 1
        scored = {}
        for at, r in enumerate(runs):
            if len(r) <= keyphrases.MAX_PHRASE_WORDS:
                scored.setdefault(" ".join(r), (-round(sum(degree[w] / count[w] for w in r), 9), at))
        best = sorted(scored, key=scored.get)[:5]
        assert got.get(i, []) == [(p, round(-scored[p][0], 6), k + 1) for k, p in enumerate(best)]


def test_words_do_not_become_rows(spark):
    docs = spark.createDataFrame([(1, "Kaiser Reich, Stadt"), (1, "Stadt"), (None, "König")], "id int, text string")
    found = keyphrases.keyphrases(docs, "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Window" not in plan and plan.count("RepartitionByExpression") == 1
    assert {(r.id, r.phrase) for r in found.collect()} == {(1, "kaiser reich stadt"), (1, "stadt"), (None, "könig")}


def test_best_span_of_a_segment_alone(spark):
    df = spark.createDataFrame([(1, "Im Jahr 1914, am 1.2.1915 und 1200-1300", "main"), (2, "Portrait 1900 im 3. Jahrhundert", "caption"), (3, "nie", "main")], "id int, text string, section string")
    best = spans.extract_spans(df, ["id"], best_only=True)
    every = spans.extract_spans(df, ["id"])
    assert best.count() == 2
    assert best.orderBy("id").collect() == every.where("span_pos = 0").orderBy("id").collect()


def test_primary_time_is_the_first_mention_by_one_scan(spark):
    rng = random.Random(47)
    parts = ["1", "12", "480", "1914", "20000", "-", "–", " - ", " ", ".", " v. Chr.", "BC", " bce", "x", "_", "ä", "\n", "1914-18", "708-19", "44 BC"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [None, "", "480 v. Chr.", "480v.Chr.", "100-2000 BC", "100-20000 BC", "1914-18, 44 BC, 1920", "12345-50 und 1990", "1914-18 und 1939-45"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = df.select("id", mentions.primary_time(F.col("text")).alias("t"), mentions.time_mention_array(F.col("text")).alias("m"))
    for r in got.collect():
        years, ranges = ([m for m in r["m"] or [] if m["kind"] == kind] for kind in ("year", "range_year"))
        want = ("point", years[0]["year"], None, None) if years else ("range", None, ranges[0]["start_year"], ranges[0]["end_year"]) if ranges else ("unknown", None, None, None)
        assert tuple(r["t"]) == want, repr(texts[r["id"]])
    plan = df.select(mentions.primary_time(F.col("text")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("split(text") == 0


def test_mentions_of_one_scan_are_those_of_a_scan_for_each_kind(spark):
    rng = random.Random(53)
    parts = ["1", "12", "480", "1914", "20000", "-", "—", " - ", " ", ".", " v. Chr.", "v Chr", "BC", " bce", "x", "_", "ä", "\n", "1914-18", "708-19", "44 BC", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    range_, bc, plain = (re.compile(p, re.IGNORECASE) for p in (mentions.RANGE, mentions.BC_YEAR, mentions.PLAIN_YEAR))
    for t, got in zip(texts, many(spark, mentions.time_mention_array, texts), strict=True):
        ranges = [m.span() for m in range_.finditer(t)]
        years = [(*m.span(), sign * int(re.match(r"\d+", m[0])[0])) for p, sign in ((bc, -1), (plain, 1)) for m in p.finditer(t)]
        want = [(*r, None) for r in ranges] + [y for y in years if not any(a <= y[0] < b for a, b in ranges)]
        assert [(m["start"], m["end"], m["year"]) for m in got] == sorted(want, key=lambda w: w[:2]), repr(t)
    plan = spark.createDataFrame([("",)], "text string").select(mentions.time_mention_array(F.col("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_strip_and_norm_key_equal_their_patterns_for_every_code_point(spark):
    points = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343")
    c = F.concat(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"), F.lit(" a "))
    c = F.concat(c, F.reverse(c))
    assert points.where(text.strip(c) != F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).count() == 0
    t = F.regexp_replace(F.lower(text.strip(c)), r"(?U)[\s\-_/]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9äöüß ]+", ""), r"\s{2,}", " ")
    assert points.where(text.norm_key(c) != t).count() == 0


def test_strip_looks_at_the_ends_only(spark):
    plan = spark.range(1).select(text.strip(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace" not in plan
