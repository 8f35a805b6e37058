"""Joins, cluster analytics, ranked views and k-means."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import clusters as km
from chronoweave.operators import explore, metrics, relational, similarity
from chronoweave.operators.metrics import ClusterInputs
from chronoweave.plans import build_all, export_dataset

from .registry import query

SPAN_ORDER = ["line_no", "span_id"]
PLACE_ORDER = ["line_no", "place_id"]


def inputs(d, membership=None):
    return ClusterInputs(membership if membership is not None else d.clu, d.cep, d.span, d.place, d.ent, d.kw)


BEST_DUCK = """bs AS (SELECT episode_id, span_id AS best_span_id FROM {span} QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, span_id) = 1),
    bp AS (SELECT episode_id, place_id AS best_place_id FROM {place} QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY line_no, place_id) = 1),
    best AS (SELECT e.podcast_id, e.episode_id, s.start_date, s.end_date, p.lat, p.lon FROM {cep} e JOIN bs USING (episode_id) JOIN bp USING (episode_id)
      JOIN {span} s ON s.span_id = bs.best_span_id JOIN {place} p ON p.place_id = bp.best_place_id
      WHERE s.start_date IS NOT NULL AND s.end_date IS NOT NULL AND p.lat IS NOT NULL AND p.lon IS NOT NULL),
    mid AS (SELECT *, start_date + cast(floor((end_date - start_date) / 2.0) AS int) AS m FROM best),
    pts0 AS (SELECT podcast_id, episode_id, year(m) + dayofyear(m) / 366.0::double AS mid_year, lat, lon FROM mid),
    pts AS (SELECT * FROM pts0 WHERE podcast_id IN (SELECT podcast_id FROM pts0 GROUP BY 1 HAVING count(*) >= 4))"""


def best_episodes(d):
    spans = relational.first_per(d.span.select("episode_id", "span_id", "score"), ["episode_id"], [-F.col("score"), "span_id"])
    places = relational.first_per(d.place.select("episode_id", "place_id", "line_no"), ["episode_id"], PLACE_ORDER)
    ep = d.cep.join(spans.select("episode_id", F.col("span_id").alias("best_span_id")), "episode_id").join(
        places.select("episode_id", F.col("place_id").alias("best_place_id")), "episode_id"
    )
    return ep


def best_rows(d):
    return km.join_best(best_episodes(d), d.span.select("episode_id", "span_id", "start_date", "end_date"), d.place.select("episode_id", "place_id", "lat", "lon"))


@query("join_best", f"WITH {BEST_DUCK} SELECT podcast_id, episode_id, cast(start_date AS varchar) AS s, cast(end_date AS varchar) AS e, lat, lon FROM best")
def join_best(d):
    return best_rows(d).select(
        "podcast_id", "episode_id", F.col("start_date").cast("string").alias("s"), F.col("end_date").cast("string").alias("e"), "lat", "lon"
    )


@query("cluster_points", f"WITH {BEST_DUCK} SELECT podcast_id, episode_id, round(mid_year, 9)::double AS mid_year, lat, lon FROM pts")
def cluster_points(d):
    return km.cluster_points(best_rows(d)).withColumn("mid_year", F.round("mid_year", 9))


def kmeans_duck(rounds: int = 25) -> str:
    """All iterations unrolled; once nothing moves, further rounds repeat the same result."""
    parts = [
        BEST_DUCK,
        """b AS (SELECT podcast_id, count(*) AS n, min(mid_year) AS y0, max(mid_year) AS y1, min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM pts GROUP BY 1)""",
        """sc AS MATERIALIZED (SELECT p.*, b.n, least(greatest(4, least(16, cast(round_even(sqrt(b.n), 0) AS int))), b.n)::int AS k,
            round((mid_year - y0) / CASE WHEN y1 = y0 THEN 1.0 ELSE y1 - y0 END, 12)::double AS sy, round((lat - a0) / CASE WHEN a1 = a0 THEN 1.0 ELSE a1 - a0 END, 12)::double AS sa,
            round((lon - o0) / CASE WHEN o1 = o0 THEN 1.0 ELSE o1 - o0 END, 12)::double AS so FROM pts p JOIN b USING (podcast_id))""",
        "rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY podcast_id ORDER BY sy, episode_id) - 1 AS r FROM sc)",
        """c0 AS MATERIALIZED (SELECT podcast_id, j::int AS j, sy, sa, so FROM rk, range(0, 16) t(j)
            WHERE j < k AND r = cast(round_even(j * (n - 1) / greatest(1, k - 1)::double, 0) AS bigint))""",
    ]
    near = """SELECT p.podcast_id, p.episode_id, p.sy, p.sa, p.so, c.j FROM sc p JOIN {c} c USING (podcast_id)
        QUALIFY row_number() OVER (PARTITION BY p.podcast_id, p.episode_id ORDER BY round(pow(p.sy - c.sy, 2) + pow(p.sa - c.sa, 2) + pow(p.so - c.so, 2), 12), c.j) = 1"""
    for i in range(1, rounds):
        c = f"c{i - 1}"
        parts.append(f"a{i} AS MATERIALIZED ({near.format(c=c)})")
        parts.append(
            f"""c{i} AS MATERIALIZED (SELECT c.podcast_id, c.j, coalesce(m.sy, c.sy) AS sy, coalesce(m.sa, c.sa) AS sa, coalesce(m.so, c.so) AS so FROM {c} c LEFT JOIN
            (SELECT podcast_id, j, round(avg(sy), 12)::double AS sy, round(avg(sa), 12)::double AS sa, round(avg(so), 12)::double AS so FROM a{i} GROUP BY 1, 2) m USING (podcast_id, j))"""
        )
    parts.append(f"fin AS (SELECT s.*, a.j FROM sc s JOIN ({near.format(c=f'c{rounds - 1}')}) a USING (podcast_id, episode_id))")
    return ", ".join(parts)


@query("kmeans_assign", f"WITH {kmeans_duck()} SELECT podcast_id, episode_id, k, j, 'C' || (j + 1) AS label FROM fin")
def kmeans_assign(d):
    return km.kmeans(km.cluster_points(best_rows(d))).select("podcast_id", "episode_id", "k", "j", "label")


@query("kmeans_centroids", f"""WITH {kmeans_duck()}, g AS (SELECT podcast_id, any_value(k) AS k FROM fin GROUP BY 1)
    SELECT g.podcast_id, g.k, t.j::int AS j, 'C' || (t.j + 1) AS label, round(coalesce(avg(mid_year), 0), 6)::double AS centroid_mid_year,
      round(coalesce(avg(lat), 0), 6)::double AS centroid_lat, round(coalesce(avg(lon), 0), 6)::double AS centroid_lon, count(f.episode_id) AS n_members
    FROM g JOIN range(0, 16) t(j) ON t.j < g.k LEFT JOIN fin f ON f.podcast_id = g.podcast_id AND f.j = t.j GROUP BY 1, 2, 3, 4""")
def kmeans_centroids(d):
    table = km.cluster_table(km.kmeans(km.cluster_points(best_rows(d)))).drop("cluster_id")
    return table.withColumns({f"centroid_{a}": F.round(f"centroid_{a}", 6) for a in km.AXES})


@query("recompute_clusters", f"""WITH {kmeans_duck()}, m AS (SELECT episode_id, md5(podcast_id || chr(31) || j) AS cluster_id FROM fin), g AS (SELECT podcast_id, any_value(k) AS k FROM fin GROUP BY 1),
    kc AS (SELECT cluster_id, phrase, round(sum(score), 6)::double AS s FROM m JOIN {{kw}} USING (episode_id) GROUP BY 1, 2), ec AS (SELECT cluster_id, name, kind, count(*) AS n FROM m JOIN {{ent}} USING (episode_id) GROUP BY 1, 2, 3)
    SELECT 'cluster' AS section, md5(g.podcast_id || chr(31) || t.j) AS cluster_id, 'C' || (t.j + 1) AS item, count(f.episode_id)::double AS value
      FROM g JOIN range(0, 16) t(j) ON t.j < g.k LEFT JOIN fin f ON f.podcast_id = g.podcast_id AND f.j = t.j GROUP BY ALL
    UNION ALL SELECT 'member', cluster_id, cast(episode_id AS varchar), 1.0::double FROM m
    UNION ALL SELECT 'keyword', cluster_id, phrase, s FROM kc QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, phrase) <= 25
    UNION ALL SELECT 'entity', cluster_id, name || '/' || coalesce(kind, '-'), n::double FROM ec QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, name, kind NULLS FIRST) <= 25""".replace("{{", "{").replace("}}", "}"))
def recompute_clusters(d):
    tables = {"episodes": best_episodes(d), "time_spans": d.span.select("episode_id", "span_id", "start_date", "end_date"), "places": d.place.select("episode_id", "place_id", "lat", "lon"), "episode_keywords": d.kw, "entities": d.ent}
    made = build_all.recompute_clusters(tables)
    rows = (
        made["clusters"].select("cluster_id", F.lit("cluster").alias("section"), F.col("label").alias("item"), F.col("n_members").cast("double").alias("value")),
        made["episode_clusters"].select("cluster_id", F.lit("member"), F.col("episode_id").cast("string"), F.lit(1.0)),
        made["cluster_keywords"].select("cluster_id", F.lit("keyword"), "phrase", F.round("score", 6)),
        made["cluster_entities"].select("cluster_id", F.lit("entity"), F.concat("name", F.lit("/"), F.coalesce("kind", F.lit("-"))), F.col("count").cast("double")),
    )
    out = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    return out.select("section", "cluster_id", "item", "value")


@query("kmeans_step", f"""WITH {kmeans_duck(2)} SELECT podcast_id, j, round(sy, 9)::double AS sy, round(sa, 9)::double AS sa, round(so, 9)::double AS so FROM c1""")
def kmeans_step(d):
    scaled = km.scale_points(km.cluster_points(best_rows(d)))
    moved = km.kmeans_step(scaled, km.seed_spots(scaled, km.spots_of(scaled)))
    return moved.select("podcast_id", F.posexplode("centroids").alias("j", "c")).select(
        "podcast_id", "j", F.round("c.mid_year", 9).alias("sy"), F.round("c.lat", 9).alias("sa"), F.round("c.lon", 9).alias("so")
    )


@query("join_keywords", """
    SELECT l.l_orderkey AS episode_id, p.p_brand AS phrase, l.l_quantity AS score FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey
    WHERE p.p_partkey % 7 <> 0""")
def join_keywords(d):
    dim = d.part.select(
        F.col("p_partkey").alias("keyword_id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).otherwise("").alias("phrase")
    )
    bridge = d.lineitem.select(F.col("l_orderkey").alias("episode_id"), F.col("l_partkey").alias("keyword_id"), F.col("l_quantity").alias("score"))
    bridge = bridge.unionByName(bridge.withColumn("keyword_id", -F.col("keyword_id") - 1))  # ids that no keyword has
    return export_dataset.join_keyword_phrases(bridge, dim)


@query("semi_members", "SELECT c.cluster_id, e.name, count(*) AS n FROM {ent} e JOIN {clu} c USING (episode_id) GROUP BY 1, 2")
def semi_members(d):
    return metrics.member_facts(d.clu, d.ent, "name")


@query("pair_join", """
    WITH v AS (SELECT cluster_id, phrase AS term, sum(score) AS weight FROM {multi} JOIN {kw} USING (episode_id) GROUP BY 1, 2),
    t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) <= 25)
    SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, a.term FROM t a JOIN t b ON a.term = b.term AND a.cluster_id < b.cluster_id""")
def pair_join(d):
    return metrics.pair_terms(vectors_multi(d)).select("cluster_a", "cluster_b", "term")


def vectors_multi(d, n=25):
    top = metrics.cluster_keywords(d.multi, d.kw, n)
    return top.select("cluster_id", F.col("phrase").alias("term"), F.col("score").alias("weight"))


VEC_DUCK = """v0 AS (SELECT cluster_id, phrase AS term, round(sum(score), 6)::double AS weight FROM {clu} JOIN {kw} USING (episode_id) GROUP BY 1, 2),
    v AS (SELECT * FROM v0 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) <= 25)"""
MVEC_DUCK = VEC_DUCK.replace("{clu}", "{multi}")


@query("cluster_keywords", f"WITH {VEC_DUCK} SELECT cluster_id, term AS phrase, weight AS score, cast(row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) AS int) AS rank FROM v")
def cluster_keywords(d):
    return metrics.cluster_keywords(d.clu, d.kw)


@query("cluster_entities", """
    WITH c AS (SELECT cluster_id, name, kind, count(*) AS count FROM {clu} JOIN {ent} USING (episode_id) GROUP BY 1, 2, 3)
    SELECT *, cast(row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, name, kind NULLS FIRST) AS int) AS rank FROM c QUALIFY rank <= 25""")
def cluster_entities(d):
    return metrics.cluster_entities(d.clu, d.ent)


STATS_DUCK = f"""{VEC_DUCK},
    m AS (SELECT c.cluster_id, e.* FROM {{clu}} c JOIN {{cep}} e USING (episode_id)),
    sh AS (SELECT cluster_id, max(n) AS largest, count(*) AS pods, sum(n) AS n FROM (SELECT cluster_id, podcast_id, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
    md AS (SELECT cluster_id, cast(trunc(median(year(pub_date))) AS int) AS y FROM m GROUP BY 1),
    sp AS (SELECT c.cluster_id, max(greatest(coalesce(year(start_date), year(end_date)), coalesce(year(end_date), year(start_date)))) -
        min(least(coalesce(year(start_date), year(end_date)), coalesce(year(end_date), year(start_date)))) AS span, avg(score) AS sc FROM {{clu}} c JOIN {{span}} s USING (episode_id) GROUP BY 1),
    pl AS (SELECT c.cluster_id, (stddev_pop(lat) + stddev_pop(lon)) / 2 AS g FROM {{clu}} c JOIN {{place}} p USING (episode_id) GROUP BY 1),
    co AS (SELECT cluster_id, max(weight) / sum(weight) AS c FROM v GROUP BY 1),
    stats AS (SELECT sh.cluster_id, sh.n::bigint AS episode_count, sh.pods AS unique_podcast_count, round(sh.largest / sh.n, 6)::double AS dominant_podcast_share, md.y AS median_pub_year,
      sp.span::int AS temporal_span_years, round(sp.sc, 6)::double AS mean_span_confidence, round(pl.g, 6)::double AS geo_dispersion, round(co.c, 6)::double AS cohesion_proxy
      FROM sh LEFT JOIN md USING (cluster_id) LEFT JOIN sp USING (cluster_id) LEFT JOIN pl USING (cluster_id) LEFT JOIN co USING (cluster_id))""".replace("{{", "{").replace("}}", "}")


def stats_table(d):
    return metrics.cluster_stats(inputs(d), metrics.term_vectors(d.clu, d.kw))


@query("cluster_stats", f"WITH {STATS_DUCK} SELECT * FROM stats")
def cluster_stats(d):
    return stats_table(d)


@query("cluster_histogram", """
    WITH y AS (SELECT episode_id, year(start_date) AS y FROM {span} WHERE start_date IS NOT NULL UNION ALL SELECT episode_id, year(end_date) FROM {span} WHERE end_date IS NOT NULL)
    SELECT cluster_id, cast(floor(y / 10.0) * 10 AS int) AS start_year, cast(floor(y / 10.0) * 10 + 9 AS int) AS end_year, count(*) AS count FROM {clu} JOIN y USING (episode_id) GROUP BY 1, 2, 3""")
def cluster_histogram(d):
    return metrics.timeline_histogram(d.clu, d.span)


@query("term_support", "SELECT phrase, count(DISTINCT episode_id) AS support FROM {kw} GROUP BY 1")
def term_support(d):
    return metrics.term_support(d.kw)


TERM_DUCK = f"""{VEC_DUCK}, n AS (SELECT cluster_id, count(*) AS n FROM {{clu}} GROUP BY 1), g AS (SELECT phrase AS term, count(DISTINCT episode_id) AS gs FROM {{kw}} GROUP BY 1),
    s AS (SELECT cluster_id, phrase AS term, count(DISTINCT episode_id) AS s FROM {{clu}} JOIN {{kw}} USING (episode_id) GROUP BY 1, 2),
    tm AS (SELECT cluster_id, term, weight AS tfidf, s AS support, gs AS global_support, (s / n.n) / (gs / (SELECT count(*) FROM {{orders}})) AS l FROM v JOIN n USING (cluster_id) JOIN g USING (term) JOIN s USING (cluster_id, term)),
    tms AS (SELECT cluster_id, term, tfidf, support, global_support, round(l, 6)::double AS lift, round(abs(tfidf) * l, 6)::double AS drop_impact FROM tm)""".replace("{{", "{").replace("}}", "}")


def term_table(d):
    return metrics.term_metrics(inputs(d), metrics.term_vectors(d.clu, d.kw))


@query("term_metrics", f"WITH {TERM_DUCK} SELECT * FROM tms")
def term_metrics(d):
    return term_table(d)


ENT_LIFT_DUCK = """e AS (SELECT episode_id, name, coalesce(kind, 'unknown') AS kind FROM {ent}),
    c AS (SELECT cluster_id, name, kind, count(*) AS count FROM {clu} JOIN e USING (episode_id) GROUP BY 1, 2, 3), t AS (SELECT cluster_id, sum(count) AS t FROM c GROUP BY 1),
    g AS (SELECT name, kind, count(*) AS g FROM e GROUP BY 1, 2),
    top AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, name, kind) <= 50),
    el AS (SELECT cluster_id, name, kind, count, round((count / t.t) / (g.g / (SELECT count(*) FROM e)), 6)::double AS lift FROM top JOIN t USING (cluster_id) JOIN g USING (name, kind))"""


@query("entity_lift", f"WITH {ENT_LIFT_DUCK} SELECT * FROM el")
def entity_lift(d):
    return metrics.entity_lift(d.clu, d.ent)


PLACE_LIFT_DUCK = """c AS (SELECT cluster_id, canonical_name, count(*) AS count FROM {clu} JOIN {place} USING (episode_id) GROUP BY 1, 2), t AS (SELECT cluster_id, sum(count) AS t FROM c GROUP BY 1),
    g AS (SELECT canonical_name, count(*) AS g, any_value(lat) AS lat, any_value(lon) AS lon FROM {place} GROUP BY 1),
    pl AS (SELECT cluster_id, canonical_name, count, round((count / t.t) / (g.g / (SELECT count(*) FROM {lineitem})), 6)::double AS lift, lat, lon FROM c JOIN t USING (cluster_id) JOIN g USING (canonical_name))"""


@query("place_lift", f"WITH {PLACE_LIFT_DUCK} SELECT * FROM pl")
def place_lift(d):
    return metrics.place_lift(d.clu, d.place, PLACE_ORDER)


JAC_DUCK = """n AS (SELECT cluster_id, count(*) AS n FROM {multi} GROUP BY 1),
    sj AS (SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, count(*) AS s FROM {multi} a JOIN {multi} b ON a.episode_id = b.episode_id AND a.cluster_id < b.cluster_id GROUP BY 1, 2),
    jac AS (SELECT cluster_a, cluster_b, s / (x.n + y.n - s) AS j FROM sj JOIN n x ON x.cluster_id = cluster_a JOIN n y ON y.cluster_id = cluster_b)"""
COS_DUCK = f"""{MVEC_DUCK}, nr AS (SELECT cluster_id, sqrt(sum(weight * weight)) AS w FROM v GROUP BY 1),
    cs AS (SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, sum(a.weight * b.weight) AS d FROM v a JOIN v b ON a.term = b.term AND a.cluster_id < b.cluster_id GROUP BY 1, 2),
    cosine AS (SELECT cluster_a, cluster_b, d / (x.w * y.w) AS c FROM cs JOIN nr x ON x.cluster_id = cluster_a JOIN nr y ON y.cluster_id = cluster_b)"""


@query("pair_jaccard", f"WITH {JAC_DUCK} SELECT cluster_a, cluster_b, round(j, 6)::double AS jaccard FROM jac")
def pair_jaccard(d):
    return metrics.pair_jaccard(d.multi).withColumn("jaccard", F.round("jaccard", 6))


@query("pair_cosine", f"WITH {COS_DUCK} SELECT cluster_a, cluster_b, round(c, 6)::double AS cosine FROM cosine")
def pair_cosine(d):
    return metrics.pair_cosine(vectors_multi(d)).withColumn("cosine", F.round("cosine", 6))


BRIDGE_DUCK = """br AS (SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, array_to_string(list(a.term ORDER BY a.weight + b.weight DESC, a.term)[1:5], ',') AS bridge_terms
      FROM v a JOIN v b ON a.term = b.term AND a.cluster_id < b.cluster_id GROUP BY 1, 2)"""


@query("bridge_terms", f"WITH {MVEC_DUCK}, {BRIDGE_DUCK} SELECT * FROM br")
def bridge_terms(d):
    return metrics.bridge_terms(vectors_multi(d)).withColumn("bridge_terms", F.array_join("bridge_terms", ","))


@query("cluster_correlations", f"""WITH {JAC_DUCK}, {COS_DUCK}, {BRIDGE_DUCK}
    SELECT cluster_a, cluster_b, round(coalesce(j, 0), 6)::double AS jaccard_episode_overlap, round(coalesce(c, 0), 6)::double AS cosine_term_similarity, coalesce(bridge_terms, '') AS bridge_terms
    FROM jac FULL JOIN cosine USING (cluster_a, cluster_b) LEFT JOIN br USING (cluster_a, cluster_b)""")
def cluster_correlations(d):
    return metrics.cluster_correlations(d.multi, vectors_multi(d)).withColumn("bridge_terms", F.array_join("bridge_terms", ","))


@query("next_steps", f"""WITH {TERM_DUCK}, b AS (SELECT * FROM tms QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY lift DESC, tfidf DESC, term) = 1)
    SELECT cluster_id, 'Investigate high-lift term: ' || term AS title, 'This term is unusually concentrated in this cluster.' AS rationale, 'apply_term_filter' AS action_type,
      '{{"term":"' || term || '","cluster_id":' || cluster_id || '}}' AS action_payload FROM b""")
def next_steps(d):
    return metrics.next_steps(term_table(d))


@query("member_counts", "SELECT cluster_id, count(*) AS n_members FROM {multi} GROUP BY 1")
def member_counts(d):
    return metrics.member_counts(d.multi)


@query("cooccur", """
    WITH t AS (SELECT episode_id, lower(phrase) AS term, row_number() OVER (PARTITION BY episode_id ORDER BY phrase) AS r FROM {kw}), k AS (SELECT * FROM t WHERE r <= 8)
    SELECT a.episode_id, a.term AS a, b.term AS b FROM k a JOIN k b ON a.episode_id = b.episode_id AND a.term < b.term""")
def cooccur(d):
    terms = d.kw.select(F.lit(0).alias("cluster_id"), "episode_id", F.lower("phrase").alias("term"), F.col("phrase").alias("pos"))
    return explore.cooccurrence_pairs(terms).select("episode_id", "a", "b")


@query("term_graph", f"""WITH {VEC_DUCK}, n AS (SELECT cluster_id, lower(term) AS term FROM v QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) <= 10),
    k AS (SELECT c.cluster_id, w.episode_id, lower(w.phrase) AS term, row_number() OVER (PARTITION BY w.episode_id ORDER BY w.phrase) AS r
          FROM {{clu}} c JOIN {{kw}} w USING (episode_id) JOIN n ON n.cluster_id = c.cluster_id AND n.term = lower(w.phrase) QUALIFY r <= 8),
    e AS (SELECT a.cluster_id, a.term AS a, b.term AS b, count(*) AS weight FROM k a JOIN k b ON a.cluster_id = b.cluster_id AND a.episode_id = b.episode_id AND a.term < b.term GROUP BY 1, 2, 3)
    SELECT *, cast(row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, a, b) AS int) AS rank FROM e QUALIFY rank <= 20""".replace("{{", "{").replace("}}", "}"))
def term_graph(d):
    ranked = metrics.cluster_keywords(d.clu, d.kw).select("cluster_id", F.col("phrase").alias("term"), "rank")
    terms = d.clu.join(d.kw, "episode_id").select("cluster_id", "episode_id", F.col("phrase").alias("term"), F.col("phrase").alias("pos"))
    return explore.term_graph(ranked, terms)


@query("episode_summary", """
    WITH s AS (SELECT * FROM {span} QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, span_id) <= 20),
    a AS (SELECT episode_id, min(least(coalesce(year(start_date), year(end_date)), coalesce(year(end_date), year(start_date)))) AS lo,
      max(greatest(coalesce(year(start_date), year(end_date)), coalesce(year(end_date), year(start_date)))) AS hi, avg(score) AS sc FROM s GROUP BY 1),
    e AS (SELECT * FROM {ent} QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY confidence DESC, entity_id) <= 40), b AS (SELECT episode_id, avg(confidence) AS c FROM e GROUP BY 1)
    SELECT episode_id, lo::int AS cover_min, hi::int AS cover_max, round(coalesce(sc, 0), 5)::double AS avg_span_score, round(coalesce(c, 0), 5)::double AS avg_entity_confidence FROM a FULL JOIN b USING (episode_id)""")
def episode_summary(d):
    out = explore.episode_summary(d.span, d.ent, ["span_id"], ["entity_id"])
    return out.withColumns({c: F.round(c, 5) for c in ("avg_span_score", "avg_entity_confidence")})


@query("nested_keywords", """SELECT episode_id, array_to_string(list(phrase || '=' || cast(cast(score AS int) AS varchar) ORDER BY score DESC, phrase), ';') AS keywords FROM {kw} GROUP BY 1""")
def nested_keywords(d):
    out = export_dataset.nested_keywords(d.kw)
    text = F.transform("keywords", lambda k: F.concat(k["phrase"], F.lit("="), k["score"].cast("int").cast("string")))
    return out.select("episode_id", F.array_join(text, ";").alias("keywords"))


@query("export_order", "SELECT episode_id, podcast_id, pub_date FROM {cep}")
def export_order(d):
    return d.cep.orderBy("podcast_id", "pub_date", "episode_id").select("episode_id", "podcast_id", "pub_date")


@query("topn_spans", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, span_id) AS rank FROM {span} QUALIFY rank <= 3),
    m AS (SELECT *, make_timestamp((epoch_us(start_date::timestamp) + epoch_us(end_date::timestamp)) >> 1) AS m FROM r WHERE start_date IS NOT NULL AND end_date IS NOT NULL)
    SELECT episode_id, span_id, cast(rank AS int) AS rank, score, round(year(m) + (month(m) - 1) / 12.0::double, 9)::double AS mid_year FROM m
    WHERE year(m) + (month(m) - 1) / 12.0::double BETWEEN 1200 AND 1800""")
def topn_spans(d):
    out = explore.timeline_points(d.span, 3, (1200.0, 1800.0), ["span_id"])
    return out.select("episode_id", "span_id", "rank", "score", F.round("mid_year", 9).alias("mid_year"))


@query("first_place", """SELECT episode_id, place_id, canonical_name, lat, lon FROM {place} WHERE lat IS NOT NULL AND lon IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY line_no, place_id) = 1""")
def first_place(d):
    return explore.first_geocoded_place(d.place, PLACE_ORDER).select("episode_id", "place_id", "canonical_name", "lat", "lon")


@query("episode_topk", """
    SELECT * FROM (SELECT episode_id, 'span' AS section, span_id AS item, score AS value, cast(row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, span_id) AS int) AS rank FROM {span}) WHERE rank <= 20
    UNION ALL SELECT * FROM (SELECT episode_id, 'entity', entity_id, round(confidence, 6)::double, cast(row_number() OVER (PARTITION BY episode_id ORDER BY confidence DESC, entity_id) AS int) AS rank FROM {ent}) WHERE rank <= 40
    UNION ALL SELECT * FROM (SELECT episode_id, 'keyword', phrase, score, cast(row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, phrase) AS int) AS rank FROM {kw}) WHERE rank <= 30""")
def episode_topk(d):
    def part(df, section, item, value, n):
        top = relational.top_n(df, ["episode_id"], [F.desc(value), F.asc(item)], n)
        return top.select("episode_id", F.lit(section).alias("section"), F.col(item).alias("item"), F.round(value, 6).alias("value"), "rank")

    return (
        part(d.span, "span", "span_id", "score", explore.TOP_SPANS)
        .unionByName(part(d.ent, "entity", "entity_id", "confidence", explore.TOP_ENTITIES))
        .unionByName(part(d.kw, "keyword", "phrase", "score", explore.TOP_KEYWORDS))
    )


@query("ranked_terms", f"""WITH {TERM_DUCK} SELECT cluster_id, term, lift, tfidf, cast(row_number() OVER (PARTITION BY cluster_id ORDER BY lift DESC, tfidf DESC, term) AS int) AS rank FROM tms QUALIFY rank <= 20""")
def ranked_terms(d):
    return explore.ranked_terms(term_table(d), "lift", 20).select("cluster_id", "term", "lift", "tfidf", "rank")


@query("ranked_entities", f"WITH {ENT_LIFT_DUCK} SELECT *, cast(row_number() OVER (PARTITION BY cluster_id ORDER BY lift DESC, count DESC, name, kind) AS int) AS rank FROM el QUALIFY rank <= 24")
def ranked_entities(d):
    rows = metrics.entity_lift(d.clu, d.ent).withColumn("key", F.struct("name", "kind"))
    return explore.ranked_by_lift(rows, "key").drop("key")


@query("ranked_places", f"WITH {PLACE_LIFT_DUCK} SELECT cluster_id, canonical_name, count, lift, cast(row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, lift DESC, canonical_name) AS int) AS rank FROM pl QUALIFY rank <= 24")
def ranked_places(d):
    rows = metrics.place_lift(d.clu, d.place, PLACE_ORDER)
    return explore.ranked_by_lift(rows, "canonical_name", "count").select("cluster_id", "canonical_name", "count", "lift", "rank")


CI_DUCK = f"""{STATS_DUCK}, cl AS (SELECT cluster_id, CASE WHEN cluster_id % 2 = 0 THEN ' ' ELSE 'P' || cluster_id END AS label, count(*) AS n_members FROM {{clu}} GROUP BY 1, 2
      UNION ALL SELECT 99, 'empty', 0)""".replace("{{", "{").replace("}}", "}")


@query("cluster_index", f"""WITH {CI_DUCK} SELECT cl.cluster_id, coalesce(nullif(trim(label), ''), 'Cluster ' || cl.cluster_id) AS label, n_members, coalesce(cohesion_proxy, 0) AS cohesion,
    CASE WHEN s.cluster_id IS NULL THEN 0 ELSE round(1 - coalesce(dominant_podcast_share, 1), 6)::double END AS novelty, coalesce(temporal_span_years, 0) AS spread FROM cl LEFT JOIN stats s USING (cluster_id)""")
def cluster_index(d):
    label = F.when(F.col("cluster_id") % 2 == 0, " ").otherwise(F.concat(F.lit("P"), F.col("cluster_id").cast("string")))
    rows = metrics.member_counts(d.clu).withColumn("label", label)
    empty = rows.agg(F.lit(99).cast("bigint").alias("cluster_id"), F.lit(0).cast("bigint").alias("n_members"), F.lit("empty").alias("label"))
    return explore.cluster_index(rows.unionByName(empty), stats_table(d), "novelty")


@query("cluster_list", "SELECT cluster_id, n_members FROM (SELECT cluster_id, count(*) AS n_members FROM {multi} GROUP BY 1) ORDER BY n_members DESC, cluster_id LIMIT 24")
def cluster_list(d):
    return explore.cluster_list(metrics.member_counts(d.multi)).select("cluster_id", "n_members")


@query("cluster_neighbors", f"""WITH {JAC_DUCK}, b AS (SELECT cluster_a AS cluster_id, cluster_b AS other_id, round(j, 6)::double AS jaccard FROM jac UNION ALL SELECT cluster_b, cluster_a, round(j, 6)::double FROM jac)
    SELECT *, cast(row_number() OVER (PARTITION BY cluster_id ORDER BY jaccard DESC, other_id) AS int) AS rank FROM b QUALIFY rank <= 10""")
def cluster_neighbors(d):
    members = d.multi.select(F.col("cluster_id").alias("item"), F.col("episode_id").alias("feature"), F.lit(1).alias("weight"))
    near = similarity.top_similar(members, 10, "jaccard")
    return near.select(F.col("item").alias("cluster_id"), F.col("other").alias("other_id"), F.col("similarity").alias("jaccard"), "rank")


@query("similar_clusters", f"""WITH {COS_DUCK}, b AS (SELECT cluster_a AS cluster_id, cluster_b AS other_id, round(c, 6)::double AS cosine FROM cosine UNION ALL SELECT cluster_b, cluster_a, round(c, 6)::double FROM cosine)
    SELECT *, cast(row_number() OVER (PARTITION BY cluster_id ORDER BY cosine DESC, other_id) AS int) AS rank FROM b QUALIFY rank <= 5""")
def similar_clusters(d):
    terms = vectors_multi(d).select(F.col("cluster_id").alias("item"), F.col("term").alias("feature"), "weight")
    near = similarity.top_similar(terms, 5, "cosine")
    return near.select(F.col("item").alias("cluster_id"), F.col("other").alias("other_id"), F.col("similarity").alias("cosine"), "rank")


@query("top_correlations", f"""WITH {JAC_DUCK}, {COS_DUCK}, {BRIDGE_DUCK}, b AS (SELECT cluster_a AS x, cluster_b AS y, * FROM jac UNION ALL SELECT cluster_b, cluster_a, * FROM jac),
    r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(j, 6) DESC, y) AS rank FROM b QUALIFY rank <= 3)
    SELECT x AS cluster_id, y AS other_id, cast(rank AS int) AS rank, round(j, 6)::double AS jaccard_episode_overlap, round(coalesce(c, 0), 6)::double AS cosine_term_similarity,
      coalesce(bridge_terms, '') AS bridge_terms FROM r LEFT JOIN cosine USING (cluster_a, cluster_b) LEFT JOIN br USING (cluster_a, cluster_b)""")
def top_correlations(d):
    return metrics.top_correlations(d.multi, vectors_multi(d), 3).withColumn("bridge_terms", F.array_join("bridge_terms", ","))


@query("cluster_summary", """
    WITH k AS (SELECT cluster_id, phrase, sum(score) AS s FROM {clu} JOIN {kw} USING (episode_id) GROUP BY 1, 2), e AS (SELECT cluster_id, name, kind, count(*) AS n FROM {clu} JOIN {ent} USING (episode_id) GROUP BY 1, 2, 3)
    SELECT m.cluster_id, m.n_members, (SELECT array_to_string(list(phrase ORDER BY s DESC, phrase)[1:25], ',') FROM k WHERE k.cluster_id = m.cluster_id) AS keywords,
      (SELECT array_to_string(list(name || '/' || coalesce(kind, '-') ORDER BY n DESC, name, kind NULLS FIRST)[1:25], ',') FROM e WHERE e.cluster_id = m.cluster_id) AS entities
    FROM (SELECT cluster_id, count(*) AS n_members FROM {clu} GROUP BY 1) m""")
def cluster_summary(d):
    clusters = d.clu.select("cluster_id").distinct()
    kw = metrics.cluster_keywords(d.clu, d.kw).drop("rank")
    en = metrics.cluster_entities(d.clu, d.ent).drop("rank")
    out = export_dataset.cluster_summaries(clusters, d.clu, kw, en)
    names = F.transform("top_entities", lambda e: F.concat(e["name"], F.lit("/"), F.coalesce(e["kind"], F.lit("-"))))
    return out.select(
        "cluster_id", "n_members", F.array_join(F.transform("top_keywords", lambda k: k["phrase"]), ",").alias("keywords"), F.array_join(names, ",").alias("entities")
    )


STACK_DUCK = """pod AS (SELECT DISTINCT c_mktsegment AS podcast_id, 'The ' || c_mktsegment AS podcast_title FROM {customer}),
    st AS (SELECT e.podcast_id, pod.podcast_title, e.episode_id, e.title, e.pub_date, c.cluster_id, s.span_id, least(s.start_date, s.end_date) AS a, greatest(s.start_date, s.end_date) AS b
      FROM {cep} e JOIN pod USING (podcast_id) LEFT JOIN {clu} c USING (episode_id)
      LEFT JOIN (SELECT * FROM {span} WHERE start_date IS NOT NULL AND end_date IS NOT NULL) s USING (episode_id))"""


def stack(d):
    pods = d.customer.select(F.col("c_mktsegment").alias("podcast_id")).distinct()
    pods = pods.union(d.region.select("r_name"))  # podcasts without an episode
    pods = pods.withColumn("podcast_title", F.concat(F.lit("The "), "podcast_id"))
    return explore.stack_rows(pods, d.cep.select("episode_id", "podcast_id", "title", "pub_date"), d.span, d.clu)


@query("stack_join", f"WITH {STACK_DUCK} SELECT podcast_title, episode_id, cluster_id, span_id, cast(a AS varchar) AS s, cast(b AS varchar) AS e FROM st")
def stack_join(d):
    return stack(d).select("podcast_title", "episode_id", "cluster_id", "span_id", F.col("start_date").cast("string").alias("s"), F.col("end_date").cast("string").alias("e"))


@query("stack_timeline", f"""WITH {STACK_DUCK} SELECT podcast_id, podcast_title, episode_id, title, count(span_id) AS n_spans,
    coalesce(string_agg(span_id, ' ' ORDER BY a, b, span_id), '') AS span_ids FROM st GROUP BY 1, 2, 3, 4""")
def stack_timeline(d):
    out = explore.stack_timeline(stack(d))
    return out.select(
        "podcast_id", "podcast_title", "episode_id", "title", F.size("spans").cast("bigint").alias("n_spans"),
        F.array_join(F.transform("spans", lambda s: s["span_id"]), " ").alias("span_ids"),
    )


@query("stack_order", f"WITH {STACK_DUCK} SELECT podcast_title, span_id, cast(a AS varchar) AS s FROM st WHERE span_id IS NOT NULL")
def stack_order(d):
    return explore.stack_order(stack(d)).select("podcast_title", "span_id", F.col("start_date").cast("string").alias("s"))
