"""Filters, facets, bounds and density over flat episodes and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.dates import clamp_year_range
from chronoweave.operators import explore, facets, filters
from chronoweave.operators.filters import EpisodeFilter

from .registry import query

FILTERED = EpisodeFilter(q="user1_", date_start="2024-01-05", date_end="2024-01-25", bbox=(-50.0, -25.0, 50.0, 40.0))
WHERE = """WHERE (title ILIKE '%user1_%' OR description ILIKE '%user1_%')
    AND cast(published_at AS date) BETWEEN date '2024-01-05' AND date '2024-01-25'
    AND lat BETWEEN -25 AND 40 AND lon BETWEEN -50 AND 50"""


@query("filter_all", f"""
    SELECT guid, title, podcast_id FROM {{fac}} {WHERE} AND podcast_id = 'p3' AND incident_type = 'click'""")
def filter_all(d):
    f = EpisodeFilter("p3", "user1_", "2024-01-05", "2024-01-25", "click", (-50.0, -25.0, 50.0, 40.0))
    return f.apply(d.fac).select("guid", "title", "podcast_id")


@query("filter_eq", "SELECT guid, podcast_id, incident_type FROM {fac} WHERE podcast_id = 'p2' AND incident_type = 'view'")
def filter_eq(d):
    return EpisodeFilter(podcast_id="p2", incident_type="view").apply(d.fac).select("guid", "podcast_id", "incident_type")


@query("filter_like", "SELECT guid, title, description FROM {fac} WHERE title ILIKE '%CLICK by user_7%' OR description ILIKE '%CLICK by user_7%'")
def filter_like(d):
    return EpisodeFilter(q="CLICK by user_7").apply(d.fac).select("guid", "title", "description")


@query("filter_like_marks", """
    SELECT doc_id AS guid FROM {documents}
    WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%de\\1_d%'
       OR translate(concat(lang, chr(92), substr(source, 4), '_', lang), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%de\\1_d%'
    UNION ALL SELECT doc_id FROM {documents}
    WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%Ü%ung %'""")
def filter_like_marks(d):
    marked = F.concat("lang", F.lit("\\"), F.substring("source", 4, 9), F.lit("_"), "lang")
    rows = d.documents.select(F.col("doc_id").alias("guid"), F.col("text").alias("title"), marked.alias("description"))
    plain = rows.withColumn("description", F.lit(""))
    return EpisodeFilter(q="DE\\1_D").apply(rows).select("guid").unionByName(EpisodeFilter(q="Ü%UNG ").apply(plain).select("guid"))


@query("filter_dates", """
    SELECT guid, published_at FROM {fac}
    WHERE cast(published_at AS date) >= date '2024-01-10' AND cast(published_at AS date) <= date '2024-01-12'""")
def filter_dates(d):
    return EpisodeFilter(date_start="2024-01-10", date_end="2024-01-12").apply(d.fac).select("guid", "published_at")


@query("filter_bbox", """
    SELECT guid, lat, lon FROM {fac} WHERE lat IS NOT NULL AND lon IS NOT NULL
      AND lat BETWEEN -10.5 AND 12 AND lon BETWEEN -30 AND 10""")
def filter_bbox(d):
    return EpisodeFilter(bbox=(-30.0, -10.5, 10.0, 12.0)).apply(d.fac).select("guid", "lat", "lon")


@query("preset_filter", "SELECT guid, incident_type, title FROM {fac} WHERE (title ILIKE '%User14%' OR description ILIKE '%User14%') AND incident_type = 'signup'")
def preset_filter(d):
    presets = {"user": {"q": "User14", "incident_type": "click"}}
    return filters.preset_filter("user", presets, incident_type="signup").apply(d.fac).select("guid", "incident_type", "title")


@query("explore_filter", """
    SELECT e.episode_id, e.title FROM {cep} e
    WHERE e.podcast_id = 'BUILDING' AND lower(e.title) LIKE '%customer#00000%' AND coalesce(e.kind, '') = 'special'
      AND lower(coalesce(e.narrator, '')) LIKE '%rich%' AND e.episode_id IN (SELECT episode_id FROM {clu} WHERE cluster_id = 2)""")
def explore_filter(d):
    return filters.explore_filter(
        d.cep.withColumnRenamed("episode_id", "id"), podcast_id="BUILDING", title_contains=" Customer#00000", kind="special",
        narrator_contains="RICH", cluster_id=2, membership=d.clu,
    ).select(F.col("id").alias("episode_id"), "title")


@query("span_overlap", """
    SELECT e.episode_id, e.title FROM {cep} e WHERE e.episode_id IN (
      SELECT episode_id FROM {span} WHERE start_date IS NOT NULL AND end_date IS NOT NULL
        AND greatest(year(start_date), year(end_date)) >= 1500 AND least(year(start_date), year(end_date)) <= 1550)""")
def span_overlap(d):
    ep = d.cep.withColumnRenamed("episode_id", "id")
    return filters.filter_by_year_range(ep, d.span, 1500, 1550).select(F.col("id").alias("episode_id"), "title")


@query("cluster_scope", """
    WITH m AS (SELECT e.* FROM {cep} e JOIN {clu} c USING (episode_id) WHERE c.cluster_id = 3),
    y AS (SELECT episode_id, max(CASE WHEN greatest(coalesce(year(start_date), year(end_date)), coalesce(year(end_date), year(start_date))) >= 1200
             AND least(coalesce(year(start_date), year(end_date)), coalesce(year(end_date), year(start_date))) <= 1450 THEN 1 ELSE 0 END) AS hit
          FROM {span} GROUP BY 1)
    SELECT m.episode_id, m.title FROM m LEFT JOIN y USING (episode_id)
    WHERE coalesce(y.hit = 1, year(m.pub_date) BETWEEN 1200 AND 1450)
      AND (EXISTS (SELECT 1 FROM {kw} k WHERE k.episode_id = m.episode_id AND lower(k.phrase) LIKE '%brand#1%')
        OR EXISTS (SELECT 1 FROM {ent} n WHERE n.episode_id = m.episode_id AND lower(n.name) LIKE '%brand#1%')
        OR lower(m.title) LIKE '%brand#1%' OR lower(m.description) LIKE '%brand#1%')""")
def cluster_scope(d):
    members = d.cep.join(d.clu.filter("cluster_id = 3"), "episode_id").withColumnRenamed("episode_id", "id")
    spans = d.dealt("lineitem", "l_orderkey").span
    out = filters.cluster_scope(members, spans, d.kw, d.ent, min_year=1200, max_year=1450, term=" Brand#1")
    return out.select(F.col("id").alias("episode_id"), "title")


@query("valid_spans", """
    SELECT span_id, CAST(least(a, b) AS varchar) AS lo, CAST(greatest(a, b) AS varchar) AS hi
    FROM (SELECT span_id, start_date AS a, CASE WHEN line_no = 3 THEN NULL ELSE end_date END AS b FROM {span})
    WHERE a IS NOT NULL AND b IS NOT NULL""")
def valid_spans(d):
    end = F.when(F.col("line_no") == 3, "not a date").otherwise(F.col("end_date").cast("string"))
    texts = d.span.select("span_id", F.col("start_date").cast("string").alias("start_iso"), end.alias("end_iso"))
    return filters.valid_spans(texts).select(
        "span_id", F.date_format("lo", "yyyy-MM-dd").alias("lo"), F.date_format("hi", "yyyy-MM-dd").alias("hi")
    )


@query("episode_list", "SELECT guid, title, published_at FROM {fac} WHERE podcast_id = 'p4'")
def episode_list(d):
    one = EpisodeFilter(podcast_id="p4").apply(d.fac)
    return one.orderBy(F.desc_nulls_last("published_at")).select("guid", "title", "published_at")


@query("range_join", """
    WITH w AS (SELECT c_mktsegment AS podcast_id, 1000 + 100 * cast(min(c_custkey) % 9 AS int) AS min_year FROM {customer} GROUP BY 1)
    SELECT s.span_id, e.podcast_id, w.min_year, w.min_year + 120 AS max_year
    FROM {span} s JOIN {cep} e USING (episode_id) JOIN w USING (podcast_id)
    WHERE s.start_date IS NOT NULL AND s.end_date IS NOT NULL
      AND greatest(year(start_date), year(end_date)) >= w.min_year AND least(year(start_date), year(end_date)) <= w.min_year + 120""")
def range_join(d):
    low = (1000 + 100 * (F.min("c_custkey") % 9)).cast("int")
    w = d.customer.groupBy(F.col("c_mktsegment").alias("podcast_id")).agg(low.alias("min_year"))
    w = w.withColumn("max_year", F.col("min_year") + 120)
    spans = d.span.join(d.cep.select("episode_id", "podcast_id"), "episode_id")
    return filters.spans_in_windows(spans, w, "podcast_id").select("span_id", "podcast_id", "min_year", "max_year")


@query("facet_total", f"SELECT count(*) AS total_count FROM {{fac}} {WHERE}")
def facet_total(d):
    return facets.facet_total(FILTERED.apply(d.fac))


@query("facet_type", f"SELECT coalesce(incident_type, 'other') AS incident_type, count(*) AS count FROM {{fac}} {WHERE} GROUP BY 1")
def facet_type(d):
    return facets.facet_type(FILTERED.apply(d.fac))


@query("facet_location", """
    SELECT * FROM (SELECT name, country, lat, lon, count(*) AS count FROM {fac} WHERE lat IS NOT NULL AND lon IS NOT NULL
      GROUP BY ALL ORDER BY count DESC, name, country, lat, lon LIMIT 200)
    UNION ALL SELECT NULL, NULL, NULL, NULL, count(*) FROM {fac} WHERE lat IS NULL OR lon IS NULL HAVING count(*) > 0""")
def facet_location(d):
    return facets.facet_location(d.fac)


@query("facet_decade", """
    SELECT (coalesce(primary_time_year, primary_time_start_year, primary_time_end_year) // 10) * 10 AS decade, count(*) AS count
    FROM {fac} GROUP BY 1""")
def facet_decade(d):
    return facets.facet_decade(d.fac)


@query("facets_all", f"""
    WITH f AS (SELECT * FROM {{fac}} {WHERE})
    SELECT 'total' AS facet, NULL AS incident_type, NULL AS name, NULL AS country, NULL AS lat, NULL AS lon, NULL AS decade, count(*) AS count FROM f
    UNION ALL SELECT 'type', coalesce(incident_type, 'other'), NULL, NULL, NULL, NULL, NULL, count(*) FROM f GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'location', NULL, name, country, lat, lon, NULL, count(*) AS c FROM f WHERE lat IS NOT NULL
        GROUP BY 3, 4, 5, 6 ORDER BY c DESC, name, country, lat, lon LIMIT 200)
    UNION ALL SELECT 'decade', NULL, NULL, NULL, NULL, NULL,
        (coalesce(primary_time_year, primary_time_start_year, primary_time_end_year) // 10) * 10, count(*) FROM f GROUP BY 7""")
def facets_all(d):
    return facets.facets_all(FILTERED.apply(d.fac))


@query("meta_bounds", """
    WITH r AS (SELECT 'all' AS kind, CAST(NULL AS varchar) AS value, published_at FROM {fac}
      UNION ALL SELECT 'incident_type', incident_type, published_at FROM {fac} WHERE incident_type IS NOT NULL
      UNION ALL SELECT 'podcast', podcast_id, published_at FROM {fac})
    SELECT kind, value, cast(cast(min(published_at) AS date) AS varchar) AS min_date, cast(cast(max(published_at) AS date) AS varchar) AS max_date
    FROM r GROUP BY kind, value""")
def meta_bounds(d):
    return facets.meta_bounds(d.fac).select("kind", "value", F.col("min_date").cast("string"), F.col("max_date").cast("string"))


BOUNDS = """SELECT e.podcast_id, min(least(year(start_date), year(end_date))) AS min_year, max(greatest(year(start_date), year(end_date))) AS max_year
    FROM {span} s JOIN {cep} e USING (episode_id) WHERE start_date IS NOT NULL AND end_date IS NOT NULL GROUP BY 1"""


@query("year_bounds", f"""SELECT podcast_id, cast(min_year AS int) AS min_year, cast(max_year AS int) AS max_year FROM ({BOUNDS})""")
def year_bounds(d):
    return facets.year_bounds(d.span.join(d.cep.select("episode_id", "podcast_id"), "episode_id"), "podcast_id")


@query("clamp_range", f"""
    WITH b AS ({BOUNDS}), r AS (SELECT *, length(podcast_id) * 200 AS want_min FROM b),
    c AS (SELECT *, greatest(min_year, least(want_min, max_year - 1)) AS lo FROM r)
    SELECT podcast_id, cast(lo AS int) AS lo, cast(least(max_year, greatest(want_min + 50, lo + 1)) AS int) AS hi FROM c""")
def clamp_range(d):
    bounds = year_bounds(d)
    want = F.length("podcast_id") * 200
    lo, hi = clamp_year_range(F.col("min_year"), F.col("max_year"), want, want + 50)
    return bounds.select("podcast_id", lo.alias("lo"), hi.alias("hi"))


@query("coverage_density", """
    WITH s AS (SELECT least(year(start_date), year(end_date)) AS a, greatest(year(start_date), year(end_date)) AS b FROM {span}
               WHERE start_date IS NOT NULL AND end_date IS NOT NULL),
    y AS (SELECT unnest(range(1300, 1801))::int AS year)
    SELECT y.year, count(s.a) AS count, round(coalesce(avg(s.b - s.a + 1), 0), 6)::double AS avg_duration
    FROM y LEFT JOIN s ON y.year BETWEEN s.a AND s.b GROUP BY 1""")
def coverage_density(d):
    return facets.coverage_density(d.span, 1300, 1800).withColumn("avg_duration", F.round("avg_duration", 6))


@query("coverage_average", """
    WITH s AS (SELECT least(year(start_date), year(end_date)) AS a, greatest(year(start_date), year(end_date)) AS b FROM {span}
               WHERE start_date IS NOT NULL AND end_date IS NOT NULL),
    y AS (SELECT unnest(range(1300, 1801))::int AS year),
    p AS (SELECT y.year, avg(s.b - s.a + 1) AS m FROM y JOIN s ON y.year BETWEEN s.a AND s.b GROUP BY 1)
    SELECT round(coalesce(avg(m), 0), 6)::double AS overall_avg FROM p WHERE year BETWEEN 1400 AND 1500""")
def coverage_average(d):
    out = facets.window_average(facets.coverage_density(d.span, 1300, 1800), 1400, 1500)
    return out.select(F.round("overall_avg", 6).alias("overall_avg"))


@query("category_counts", "SELECT coalesce(nullif(incident_type, ''), 'other') AS incident_type, count(*) AS count FROM {fac} GROUP BY 1")
def category_counts(d):
    return facets.category_counts(d.fac)


@query("category_series", """
    SELECT guid, coalesce(incident_type, 'other') AS incident_type, dense_rank() OVER (ORDER BY podcast_id) - 1 AS podcast_index FROM {fac}""")
def category_series(d):
    return explore.podcast_series(d.fac).select("guid", "incident_type", "podcast_index")


@query("query_episodes", f"SELECT guid, published_at FROM {{fac}} {WHERE} ORDER BY published_at, guid LIMIT 2000")
def query_episodes(d):
    return filters.query_episodes(d.fac, FILTERED).select("guid", "published_at")


@query("table_profile_types", """
    SELECT 'episodes' AS table_name, coalesce(incident_type, 'other') AS type, count(*) AS row_count FROM {fac} GROUP BY 2
    UNION ALL SELECT 'orders', o_orderstatus, count(*) FROM {orders} GROUP BY 2""")
def table_profile_types(d):
    return facets.type_profile("episodes", d.fac).unionByName(facets.type_profile("orders", d.orders, "o_orderstatus"))


@query("table_profile", """
    SELECT 'episodes' AS table_name, count(*) AS row_count, cast(min(published_at) AS varchar) AS min_date, cast(max(published_at) AS varchar) AS max_date FROM {fac}
    UNION ALL SELECT 'orders', count(*), cast(cast(min(o_orderdate) AS date) AS varchar), cast(cast(max(o_orderdate) AS date) AS varchar) FROM {orders}
    UNION ALL SELECT 'podcasts', count(*), NULL, NULL FROM {nation}""")
def table_profile(d):
    orders = d.orders.withColumn("day", F.col("o_orderdate").cast("date"))
    return (
        facets.table_profile("episodes", d.fac, "published_at")
        .unionByName(facets.table_profile("orders", orders, "day"))
        .unionByName(facets.table_profile("podcasts", d.nation))
    )
