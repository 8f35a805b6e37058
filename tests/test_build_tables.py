"""The full build moves only what decides the best span and place."""

from chronoweave.plans import build_all as build
from chronoweave.sources import gazetteers


def test_best_rows_are_found_without_the_texts(spark):
    items = spark.createDataFrame(
        [("p", 1, "g", "T", "https://a.b/c", "2020-01-01", None, "Im Jahr 1914 in Verdun.<br>Am 1.2.1915 bei Wien.")],
        "podcast_id string, item_pos long, guid string, title string, page_url string, pub_date string, author string, description_raw string",
    )
    raw = spark.createDataFrame([(1, "Verdun", "city", "49", "5", "", "")], "entry_pos long, name string, kind string, lat string, lon string, radius_km string, aliases string")
    tables = build.build_all(items, gazetteers.pipe_gazetteer(raw), items.select("guid").where("false"), clusters=False)
    plan = tables["episodes"]._jdf.queryExecution().executedPlan().toString()
    assert "source_context" not in plan and "radius_km" not in plan
    row = tables["episodes"].first()
    assert tables["time_spans"].where(tables["time_spans"].span_id == row.best_span_id).first().source_text == "1.2.1915"
    assert tables["places"].where(tables["places"].place_id == row.best_place_id).first().canonical_name == "Verdun"


def test_a_place_behind_thirty_candidates_is_found(spark):
    words = " ".join(f"Wort{a}{b}" for a in "abcdefg" for b in "abcdefg")
    items = spark.createDataFrame(
        [("p", 1, "g", "T", "https://a.b/c", "2020-01-01", None, f"{words} Verdun.")],
        "podcast_id string, item_pos long, guid string, title string, page_url string, pub_date string, author string, description_raw string",
    )
    raw = spark.createDataFrame([(1, "Verdun", "city", "49", "5", "", "")], "entry_pos long, name string, kind string, lat string, lon string, radius_km string, aliases string")
    tables = build.build_all(items, gazetteers.pipe_gazetteer(raw), items.select("guid").where("false"), clusters=False)
    assert [(r.canonical_name, r.pos) for r in tables["places"].collect()] == [("Verdun", 49)]
    assert [r.canonical_name for r in tables["places_norm"].collect()] == ["Verdun"]


def test_places_are_looked_up_and_segments_cut_once(spark):
    items = spark.createDataFrame(
        [("p", 1, "g", "T", "https://a.b/c", "2020-01-01", None, "Im Jahr 1914 in Verdun.")],
        "podcast_id string, item_pos long, guid string, title string, page_url string, pub_date string, author string, description_raw string",
    )
    raw = spark.createDataFrame([(1, "Verdun", "city", "49", "5", "", "")], "entry_pos long, name string, kind string, lat string, lon string, radius_km string, aliases string")
    tables = build.build_all(items, gazetteers.pipe_gazetteer(raw), items.select("guid").where("false"), clusters=False)
    for name in ("segments", "time_spans", "places", "places_norm"):
        plan = tables[name]._jdf.queryExecution().executedPlan().toString()
        assert "description_pure" not in plan and "regexp_extract_all" not in plan, name
