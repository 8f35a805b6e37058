"""File sources, sinks, the feed build and live mode."""

import json

import pytest
from pyspark.sql import functions as F

from chronoweave.plans.build_all import build_all
from chronoweave.plans.ingest_flat import ingest_flat
from chronoweave.sources import documents, feeds, gazetteers, pages, sinks
from chronoweave.streaming.live import watch_feeds

FEED = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:atom="http://www.w3.org/2005/Atom">
<channel><title>Zeit</title><link>https://zeit.example</link><description>Alte &amp; neue Zeit</description><language>de</language>
<atom:link href="https://zeit.example/feed" rel="self"/><itunes:image href="https://zeit.example/i.png"/>
<item><title>Eins</title><guid>g1</guid><link>https://zeit.example/1</link><pubDate>Mon, 05 Feb 2024 10:00:00 +0100</pubDate>
<description><![CDATA[<p>Im Jahr 1916 in Verdun.</p><p>Mehr: https://zeit.example/a, https://www.instagram.com/b</p>]]></description>
<enclosure url="https://zeit.example/1.mp3" length="10" type="audio/mpeg"/><itunes:duration>01:02:03</itunes:duration></item>
<item><title>Bonus zwei</title><link>https://zeit.example/2</link><pubDate>soon</pubDate><description>Nichts</description>
<content:encoded><![CDATA[Karl Marx in Berlin, 1848-49]]></content:encoded><enclosure url="https://zeit.example/2.mp4" length="" type="video/mp4"/></item>
<item><title>Eins nochmal</title><guid>g1</guid><description>doppelt</description></item>
</channel></rss>"""
GAZ = "name,kind,lat,lon,radius_km,aliases\nBerlin,city,52.5,13.4,20,Spree-Athen|\nVerdun,,49.1,5.4,,\n ,city,1,1,1,x\nNeu,city,1,2,3,Berlin\n"


@pytest.fixture
def feed(tmp_path):
    path = tmp_path / "feeds" / "a.xml"
    path.parent.mkdir()
    path.write_text(FEED, encoding="utf-8")
    return str(path)


@pytest.fixture
def gazetteer(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text(GAZ, encoding="utf-8")
    return gazetteers.pipe_gazetteer(gazetteers.read_gazetteer(spark, str(path), gazetteers.PIPE_COLUMNS))


def test_channel(spark, feed):
    r = feeds.channels(feeds.read_channels(spark, feed)).first()
    assert (r["title"], r["description"], r["feed_url"], r["image_url"]) == ("Zeit", "Alte & neue Zeit", "https://zeit.example/feed", "https://zeit.example/i.png")


def test_three_readings_of_one_feed(spark, feed):
    raw = feeds.read_items(spark, feed)
    # the first instant of year 1 stands for a bad date; Python cannot hold it as a local time
    rich = feeds.rich_items(raw, ["item_pos"]).orderBy("item_pos").withColumn("pub_date", F.col("pub_date").cast("string")).collect()
    assert [r["guid"] for r in rich] == ["g1", "https://zeit.example/2", "g1"]
    assert [r["duration_sec"] for r in rich] == [3723, None, None]
    assert rich[1]["description_raw"] == "Karl Marx in Berlin, 1848-49" and rich[1]["pub_date"] == "0001-01-01 00:00:00"
    strict = feeds.strict_items(raw, ["item_pos"]).orderBy("item_pos").collect()
    assert [bool(r["problem"]) for r in strict] == [False, True, True]
    with pytest.raises(Exception, match="pubDate"):
        feeds.strict_items(raw, ["item_pos"], fail_fast=True).collect()
    merged = feeds.merge_items(raw, ["item_pos"]).orderBy("item_pos").collect()
    assert [r["audio_url"] for r in merged] == ["https://zeit.example/1.mp3", None, None]
    assert merged[1]["kind"] == "special"


def test_gazetteer_rules(spark, gazetteer):
    rows = {r["canonical_name"]: r for r in gazetteer.collect()}
    assert set(rows) == {"Berlin", "Verdun", "Neu"}
    assert (rows["Verdun"]["place_kind"], rows["Verdun"]["radius_km"]) == ("unknown", 50.0)
    keys = {r["norm_key"]: r["canonical_name"] for r in gazetteers.alias_dictionary(gazetteer).collect()}
    assert keys == {"berlin": "Neu", "spree athen": "Berlin", "verdun": "Verdun", "neu": "Neu"}


def test_build_all_end_to_end(spark, feed, gazetteer):
    items = feeds.rich_items(feeds.read_items(spark, feed), ["item_pos"]).withColumn("podcast_id", F.lit("p"))
    t = build_all(items, gazetteer, spark.createDataFrame([], "guid string"))
    eps = {r["guid"]: r for r in t["episodes"].drop("pub_date").collect()}
    assert set(eps) == {"g1", "https://zeit.example/2"}
    assert eps["g1"]["description_pure"] == "Im Jahr 1916 in Verdun."
    assert eps["https://zeit.example/2"]["kind"] == "special"
    spans = {r["span_id"]: r["source_text"] for r in t["time_spans"].collect()}
    assert spans[eps["g1"]["best_span_id"]] == "1916"
    assert spans[eps["https://zeit.example/2"]["best_span_id"]] == "1848-49"
    names = {r["place_id"]: r["canonical_name"] for r in t["places"].collect()}
    assert names[eps["g1"]["best_place_id"]] == "Verdun"
    assert {r["link_type"] for r in t["links"].collect()} == {"internal", "advert"}
    assert ("Karl Marx", "person") in {(r["name"], r["kind"]) for r in t["entities"].collect()}
    assert t["clusters"].count() == 0
    limited = build_all(items, gazetteer, spark.createDataFrame([("g1",)], "guid string"), limit=1, clusters=False)
    assert [r["guid"] for r in limited["episodes"].select("guid").collect()] == ["https://zeit.example/2"]


def test_flat_ingest_with_overrides(spark, tmp_path):
    rows = [("p", "a", "Verdun 1916", None, "Schlacht in Verdun"), ("p", "b", "Nichts", None, "leer")]
    items = spark.createDataFrame(rows, "podcast_id string, guid string, title string, published_at timestamp, description string").select(
        "*", F.lit(None).cast("string").alias("audio_url"), F.lit(None).cast("bigint").alias("audio_length"), F.lit("1:00").alias("duration_raw")
    )
    (tmp_path / "g.csv").write_text("name,kind,country,lat,lon,aliases\nVerdun,city,FR,49.1,5.4,\nParis,city,FR,48.8,2.3,\"Lutetia, Paname\"\n", encoding="utf-8")
    gaz = gazetteers.comma_gazetteer(gazetteers.read_gazetteer(spark, str(tmp_path / "g.csv"), gazetteers.COMMA_COLUMNS))
    records = [{"guid": "b", "primary_location": {"name": "lutetia"}, "persons": None, "primary_time": {"kind": "point", "year": -44}}]
    (tmp_path / "o.jsonl").write_text("\n".join(map(json.dumps, records)), encoding="utf-8")
    out = {r["guid"]: r for r in ingest_flat(items, gaz, documents.read_overrides(spark, str(tmp_path / "o.jsonl"))).collect()}
    assert (out["a"]["incident_type"], out["a"]["primary_time_year"], out["a"]["primary_location_name"]) == ("battle", 1916, "Verdun")
    assert (out["b"]["primary_location_name"], out["b"]["primary_time_year"], out["b"]["persons"]) == ("Paris", -44, [])
    assert out["a"]["duration_seconds"] == 60


PAGE = """<html><head><meta property="og:title" content="Bayern"></head><body><h1>X</h1><div class="duration">45 Minuten</div>
<a href="https://podcast-mp3.dradio.de/podcast/2020/11/05/a.mp3?x=1">mp3</a><div class="desc">Text &amp; <b>mehr</b></div></body></html>"""
LISTING = """<a href="https://www.podcast.de/episode/2/b">b</a><a href="https://www.podcast.de/episode/1/a">a</a>
<a href="https://www.podcast.de/episode/1/a">a</a><a rel="next" href="/p?x=1&amp;page=2">next</a>"""


def test_page_fields_and_links(spark):
    df = spark.createDataFrame([(1, PAGE), (2, LISTING)], "id int, html string")
    r = pages.page_fields(df, ["id"]).orderBy("id").collect()
    assert (r[0]["title"], r[0]["description"], r[0]["duration_seconds"], str(r[0]["published_date"])) == ("Bayern", "Text & mehr", 2700, "2020-11-05")
    assert r[1]["title"] == "(unknown)"
    links = pages.page_links(df, ["id"]).orderBy("id").collect()[1]
    assert links["episode_urls"] == ["https://www.podcast.de/episode/1/a", "https://www.podcast.de/episode/2/b"]
    assert links["next_page_url"] == "/p?x=1&page=2"


@pytest.mark.parametrize("wrap", [False, True])
def test_operation_logs(spark, tmp_path, wrap):
    ops = [
        {"op_id": "a", "op_type": "update", "entity_type": "episode", "entity_id": 5, "payload": {"fields": {"title": "T", "score": 1}, "table": "eps"}, "status": "queued"},
        {"op_id": "b", "op_type": "link", "entity_type": "relation", "entity_id": "1", "payload": {"left_id": 1, "right_id": 2}, "preconditions": {"k": 3}},
    ]
    (tmp_path / "q.json").write_text(json.dumps({"operations": ops} if wrap else ops, indent=1), encoding="utf-8")
    a, b = documents.read_ops(spark, str(tmp_path / "q.json")).orderBy("seq").collect()
    assert (a["entity_id"], a["payload"]) == ("5", {"title": "T", "score": "1", "table": "eps"})
    assert (b["payload"], b["preconditions"]) == ({"left_id": "1", "right_id": "2"}, {"k": "3"})


def test_json_sink_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    sinks.write_sections({"s": df}, str(tmp_path))
    assert spark.read.text(str(tmp_path / "s")).first()[0] == '{"a":1,"b":null}'
    with pytest.raises(KeyError):
        sinks.require_row(spark.createDataFrame([("x",)], "guid string"), "y")


def test_live_mode_merges_only_new_files(spark, feed, tmp_path):
    folder, store, mark = (str(tmp_path / n) for n in ("feeds", "store", "mark"))
    watch_feeds(spark, folder, store, mark).awaitTermination()
    assert spark.read.parquet(store).count() == 2
    (tmp_path / "feeds" / "b.xml").write_text(FEED.replace("<guid>g1</guid>", "<guid>g9</guid>"), encoding="utf-8")
    watch_feeds(spark, folder, store, mark).awaitTermination()
    assert {r["guid"] for r in spark.read.parquet(store).collect()} == {
        "g1",
        "g9",
        "https://zeit.example/2Bonus zwei",
    }


def test_merge_reading_takes_a_namespaced_guid(spark, tmp_path):
    item = "<item><title>T</title><link>L</link>{}</item>"
    xml = '<rss xmlns:podcast="https://podcastindex.org/namespace/1.0"><channel>{}</channel></rss>'
    guids = ("<guid>a</guid><podcast:guid>b</podcast:guid>", "<podcast:guid>b</podcast:guid>", "")
    (tmp_path / "f.xml").write_text(xml.format("".join(item.format(g) for g in guids)), encoding="utf-8")
    out = feeds.merge_items(feeds.read_items(spark, str(tmp_path / "f.xml")), ["item_pos"])
    assert [r.guid for r in out.orderBy("item_pos").collect()] == ["a", "b", "LT"]
