"""Sources and sinks, merges, change log, curation, enrichment, quality and export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoweave.operators import curation, enrichment, explore, metrics, mutations, oplog, quality
from chronoweave.plans import build_all as build
from chronoweave.plans import export_dataset, ingest_flat as flat, merge_feeds as mf, overrides
from chronoweave.session import shared_folder
from chronoweave.sources import documents, feeds, gazetteers, sinks

from .q_cluster import PLACE_ORDER, VEC_DUCK, inputs
from .q_text import INCIDENT, LOC_DUCK, TM_DUCK, coded, decoded
from .registry import query

# ---------------------------------------------------------------- feed items as XML


def item_xml(d):
    """Feed items as XML text, one per sentence row."""
    n = F.col("episode_id")
    sid = n.cast("string")

    def tag(name, value, attrs=""):
        return F.concat(F.lit(f"<{name}{attrs}>"), value, F.lit(f"</{name}>"))

    day = F.when(n % 7 == 0, "soon").otherwise(F.date_format("pub_date", "EEE, dd MMM yyyy 12:00:00 '+0200'"))
    text = F.concat(F.lit("<![CDATA[ "), F.col("text"), F.lit(" ]]>"))
    duration = (
        F.when(n % 4 == 0, tag("itunes:duration", F.lit("3600")))
        .when(n % 4 == 1, tag("itunes:duration", F.lit("1:02:03")))
        .when(n % 4 == 2, tag("itunes:duration", F.lit(" 02:03 ")))
        .otherwise("")
    )
    kind = F.when(n % 2 == 0, "audio/mpeg").otherwise("video/mp4")
    xml = F.concat(
        F.lit("<item>"),
        tag("title", F.concat(F.lit("Folge "), sid, F.lit(" &amp; Bonus "))),
        tag("link", F.col("page_url")),
        F.when(n % 3 != 0, tag("guid", F.concat(F.lit("g-"), sid), ' isPermaLink="false"')).otherwise(""),
        F.when(n % 11 == 0, F.lit("")).otherwise(tag("pubDate", day)),
        tag("description", text),
        F.when(n % 5 == 0, tag("content:encoded", F.lit("<![CDATA[<p>Lang</p>]]>"))).otherwise(""),
        F.concat(F.lit('<enclosure url="https://a.example/'), sid, F.lit('.mp3" length="'), sid, F.lit('" type="'), kind, F.lit('"/>')),
        F.when(n % 6 == 1, F.concat(F.lit('<media:content url="https://m.example/'), sid, F.lit('" type="audio/ogg"/>'))).otherwise(""),
        duration,
        F.lit("<itunes:author> Ada </itunes:author></item>"),
    )
    return feeds.parse_item_xml(d.txt.select("episode_id", "podcast_id", xml.alias("item_xml")))


@query("rss_items", """
    SELECT episode_id, CASE WHEN episode_id % 3 <> 0 THEN 'g-' || episode_id ELSE page_url END AS guid, 'Folge ' || episode_id || ' & Bonus' AS title, page_url,
      CASE WHEN episode_id % 7 = 0 OR episode_id % 11 = 0 THEN '0001-01-01 00:00:00' ELSE cast(pub_date + interval 10 hour AS varchar) END AS pub_date,
      CASE episode_id % 4 WHEN 0 THEN 3600 WHEN 1 THEN 3723 WHEN 2 THEN 123 END AS duration_sec, 'https://a.example/' || episode_id || '.mp3' AS audio_url, 'Ada' AS author,
      CASE WHEN episode_id % 5 = 0 THEN '<p>Lang</p>' ELSE text END AS description_raw FROM {txt}""")
def rss_items(d):
    out = feeds.rich_items(item_xml(d), ["episode_id"])
    return out.withColumn("pub_date", F.col("pub_date").cast("string")).drop("episode_type")


@query("rss_items_strict", """
    SELECT episode_id, CASE WHEN episode_id % 3 <> 0 THEN 'g-' || episode_id ELSE 'Folge ' || episode_id || ' & Bonus' END AS guid,
      CASE WHEN episode_id % 7 <> 0 AND episode_id % 11 <> 0 THEN cast(pub_date + interval 10 hour AS varchar) END AS published_at, text AS description,
      episode_id AS audio_length, CASE episode_id % 4 WHEN 0 THEN '3600' WHEN 1 THEN '1:02:03' WHEN 2 THEN '02:03' END AS duration_raw,
      CASE WHEN episode_id % 11 = 0 THEN 'missing' WHEN episode_id % 7 = 0 THEN 'unreadable' END AS problem FROM {txt}""")
def rss_items_strict(d):
    out = feeds.strict_items(item_xml(d), ["episode_id"])
    return out.select(
        "episode_id", "guid", F.col("published_at").cast("string").alias("published_at"), "description", "audio_length", "duration_raw",
        F.substring_index("problem", " ", 1).alias("problem"),
    )


@query("rss_items_audio", """
    SELECT episode_id, CASE WHEN episode_id % 3 <> 0 THEN 'g-' || episode_id ELSE page_url || 'Folge ' || episode_id || ' & Bonus' END AS guid, 'special' AS kind,
      CASE WHEN episode_id % 2 = 0 THEN 'https://a.example/' || episode_id || '.mp3' WHEN episode_id % 6 = 1 THEN 'https://m.example/' || episode_id END AS audio_url, text AS description_pure FROM {txt}""")
def rss_items_audio(d):
    out = feeds.merge_items(item_xml(d), ["episode_id"])
    guid = F.regexp_replace("guid", r" +$", "")
    return out.select("episode_id", guid.alias("guid"), "kind", "audio_url", "description_pure")


# ---------------------------------------------------------------- lists, lookups, sinks


@query("list_ordered", "SELECT guid, published_at FROM {fac}")
def list_ordered(d):
    return sinks.ordered_list(d.fac.select("guid", "published_at"), "published_at", "guid")


@query("point_lookup", "SELECT guid, title, podcast_id FROM {fac} WHERE guid = 'ev-77'")
def point_lookup(d):
    return sinks.point_lookup(d.fac, "ev-77").select("guid", "title", "podcast_id")


@query("json_arrays", """
    WITH n AS (SELECT episode_id, list(name ORDER BY entity_id) AS names FROM {ent} GROUP BY 1)
    SELECT o.o_orderkey AS episode_id, coalesce('["' || array_to_string(names, '","') || '"]', '[]') AS names_json, coalesce(len(names), 0) AS n, names[1] AS first_name FROM {orders} o LEFT JOIN n ON n.episode_id = o.o_orderkey""")
def json_arrays(d):
    lists = d.ent.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "name"))).alias("l"))
    names = F.transform("l", lambda e: e["name"])
    rows = d.orders.select(F.col("o_orderkey").alias("episode_id")).join(lists, "episode_id", "left")
    text = rows.select("episode_id", F.coalesce(F.to_json(names), F.lit("[]")).alias("names_json"))
    back = F.from_json("names_json", "array<string>")
    return text.select("episode_id", "names_json", F.size(back).cast("bigint").alias("n"), F.get(back, 0).alias("first_name"))


def flat_events(d):
    """Flat episodes of the event table in the API column names."""
    return d.fac.select(
        "podcast_id", "guid", "title", "published_at", "description", F.lit(None).cast("string").alias("audio_url"),
        F.lit(60).cast("bigint").alias("duration_seconds"), "incident_type", "primary_time_kind", "primary_time_year", "primary_time_start_year", "primary_time_end_year",
        F.col("name").alias("primary_location_name"), F.col("country").alias("primary_location_country"),
        F.col("lat").alias("primary_location_lat"), F.col("lon").alias("primary_location_lon"),
        F.array("title", "podcast_id").alias("persons"), F.array().cast("array<string>").alias("links"),
    )


@query("episode_shape", """
    SELECT guid, coalesce(incident_type, 'other') AS incident_type, primary_time_kind AS time_kind, primary_time_year AS time_year, lat IS NOT NULL AND lon IS NOT NULL AS located,
      name AS location_name, lat AS location_lat FROM {fac}""")
def episode_shape(d):
    out = flat.episode_out(flat_events(d))
    return out.select(
        "guid", "incident_type", F.col("primary_time.kind").alias("time_kind"), F.col("primary_time.year").alias("time_year"),
        F.col("primary_location").isNotNull().alias("located"), F.col("primary_location.name").alias("location_name"), F.col("primary_location.lat").alias("location_lat"),
    )


@query("review_sheet", """
    SELECT guid, '## ' || guid || ' — ' || title || chr(10) || chr(10) || '- podcast: ' || podcast_id || chr(10) || '- published_at: ' || strftime(published_at, '%Y-%m-%d') || chr(10)
      || '- incident_type: ' || coalesce(incident_type, 'None') || chr(10) || '- primary_time: ' || primary_time_kind || ' ' || coalesce(cast(primary_time_year AS varchar), '')
      || CASE WHEN primary_time_kind = 'range' THEN ' ' || concat_ws('-', primary_time_start_year, primary_time_end_year) ELSE '' END || chr(10)
      || '- primary_location: ' || CASE WHEN name IS NULL THEN '—' ELSE name || ' (' || country || ') [' || lat || ',' || lon || ']' END || chr(10)
      || '- persons: ' || title || ', ' || podcast_id || chr(10) || '- links: —' || chr(10) AS block FROM {fac}""")
def review_sheet(d):
    rows = flat_events(d).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd"))
    return rows.select("guid", sinks.review_block().alias("block"))


# ---------------------------------------------------------------- change log


def ops_table(d):
    row = F.map_filter(F.create_map(F.lit("title"), F.col("p_title"), F.lit("score"), F.col("p_score")), lambda _, v: v.isNotNull())
    link = F.create_map(F.lit("left_id"), F.col("left_id"), F.lit("right_id"), F.col("right_id"))
    return d.op.select(
        "seq", "op_id", "op_type", "entity_type", "entity_id", F.when(F.col("entity_type") == "relation", link).otherwise(row).alias("payload"),
        "status", F.lit(None).cast("string").alias("status_reason"),
    )


@query("ops_load", """SELECT seq, op_id, op_type, entity_type, entity_id, status, CASE WHEN entity_type = 'relation' THEN left_id ELSE p_title END AS first_value FROM {op}""")
def ops_load(d):
    """Logs of about 50 operations each, half bare arrays and half wrapped objects."""
    ops = ops_table(d)
    part = F.floor(F.col("seq") / 50).alias("log")
    entry = F.struct(
        "seq", "op_id", "op_type", "entity_type", "entity_id", "status",
        F.when(F.col("seq") % 2 == 0, F.concat(F.lit('{"fields":'), F.to_json("payload"), F.lit("}"))).otherwise(F.to_json("payload")).alias("payload"),
    )
    text = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda o: F.concat(
            F.lit('{"op_id":"'), o["op_id"], F.lit('","op_type":"'), o["op_type"], F.lit('","entity_type":"'), o["entity_type"], F.lit('","entity_id":"'), o["entity_id"],
            F.lit('","status":"'), o["status"], F.lit('","payload":'), o["payload"], F.lit("}"),
        ),
    )
    array = F.concat(F.lit("["), F.array_join(text, ","), F.lit("]"))
    logs = ops.groupBy(part).agg(array.alias("a")).select(
        "log", F.when(F.col("log") % 2 == 0, F.col("a")).otherwise(F.concat(F.lit('{"operations":'), F.col("a"), F.lit("}"))).alias("value")
    )
    out = documents.parse_ops(logs, keys=["log"])
    first = F.coalesce(F.try_element_at("payload", F.lit("left_id")), F.try_element_at("payload", F.lit("title")))
    return out.select((F.col("log") * 50 + F.col("seq")).cast("bigint").alias("seq"), "op_id", "op_type", "entity_type", "entity_id", "status", first.alias("first_value"))


@query("apply_ops", """
    WITH o AS (SELECT *, entity_id AS id FROM {op} WHERE entity_type = 'episode' AND op_type IN ('insert', 'update', 'delete')),
    l AS (SELECT id, list({'op': op_type, 'alive': true, 'title': p_title, 'kind': NULL::varchar, 'score': p_score::bigint} ORDER BY seq) AS ops FROM o GROUP BY 1),
    b AS (SELECT coalesce(cast(c.id AS varchar), l.id) AS id, {'op': 'base', 'alive': c.id IS NOT NULL, 'title': c.title, 'kind': c.kind, 'score': c.score} AS s, coalesce(l.ops, []) AS ops
          FROM {cust} c FULL JOIN l ON l.id = cast(c.id AS varchar)),
    r AS (SELECT id, list_reduce(list_prepend(s, ops), lambda a, x: CASE WHEN x.op = 'delete' THEN {'op': 'x', 'alive': false, 'title': NULL, 'kind': NULL, 'score': NULL}
        WHEN x.op = 'insert' THEN {'op': 'x', 'alive': true, 'title': x.title, 'kind': NULL, 'score': x.score}
        WHEN a.alive THEN {'op': 'x', 'alive': true, 'title': x.title, 'kind': a.kind, 'score': coalesce(x.score, a.score)} ELSE a END) AS f FROM b)
    SELECT cast(id AS bigint) AS id, f.title AS title, f.kind AS kind, f.score AS score FROM r WHERE f.alive""")
def apply_ops(d):
    return oplog.apply_row_ops(ops_table(d), "episodes", d.cust)


@query("apply_links", """
    WITH o AS (SELECT cast(left_id AS bigint) AS episode_id, cast(right_id AS bigint) AS cluster_id, op_type FROM {op} WHERE op_type IN ('link', 'unlink') AND entity_type = 'relation'
      QUALIFY row_number() OVER (PARTITION BY left_id, right_id ORDER BY seq DESC) = 1)
    SELECT episode_id, cluster_id FROM {rel} WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.episode_id = rel.episode_id AND o.cluster_id = rel.cluster_id AND op_type = 'unlink')
    UNION SELECT episode_id, cluster_id FROM o WHERE op_type = 'link'""")
def apply_links(d):
    return oplog.apply_link_ops(ops_table(d), "episode_clusters", d.rel)


@query("rejected_ops", "SELECT op_id, 'unsupported op_type: merge' AS reason FROM {op} WHERE op_type = 'merge'")
def rejected_ops(d):
    return oplog.rejected_ops(ops_table(d)).select("op_id", "reason")


REC_DUCK = """ec AS (SELECT cast(c_custkey AS varchar) AS id, 'T' || (c_custkey % 100) AS title, cast(c_custkey % 100 AS varchar) AS score FROM {customer}),
    j AS (SELECT o.*, CASE WHEN entity_type = 'relation' THEN r.episode_id IS NOT NULL ELSE entity_type = 'episode' AND e.id IS NOT NULL END AS here,
      entity_type = 'episode' AND e.title = p_title AND (p_score IS NULL OR p_score = e.score) AS same
      FROM {op} o LEFT JOIN ec e ON e.id = o.entity_id LEFT JOIN {rel} r ON cast(r.episode_id AS varchar) = o.entity_id),
    rec AS (SELECT op_id, CASE WHEN status = 'cancelled' THEN 'cancelled' WHEN op_type = 'update' THEN CASE WHEN same THEN 'applied' WHEN NOT here THEN 'invalid' ELSE 'queued' END
        WHEN op_type IN ('delete', 'unlink') THEN CASE WHEN here THEN 'queued' ELSE 'applied' END WHEN op_type IN ('insert', 'link') THEN CASE WHEN here THEN 'applied' ELSE 'queued' END
        ELSE 'invalid' END AS status,
      CASE WHEN status = 'cancelled' THEN NULL WHEN op_type = 'update' THEN CASE WHEN same THEN 'values already match' WHEN NOT here THEN 'target row missing' ELSE 'not yet applied' END
        WHEN op_type = 'delete' THEN CASE WHEN here THEN 'row still present' ELSE 'row absent' END WHEN op_type = 'unlink' THEN CASE WHEN here THEN 'relation still exists' ELSE 'relation removed' END
        WHEN op_type IN ('insert', 'link') THEN CASE WHEN here THEN 'target exists' ELSE 'target not found yet' END ELSE 'unsupported op type' END AS status_reason FROM j)"""


def reconciled(d):
    ident = F.col("c_custkey").cast("string")
    records = d.customer.select(
        F.lit("episode").alias("entity_type"), ident.alias("entity_id"),
        F.create_map(F.lit("title"), F.concat(F.lit("T"), (F.col("c_custkey") % 100).cast("string")), F.lit("score"), (F.col("c_custkey") % 100).cast("string")).alias("fields"),
    )
    relations = d.rel.select(
        F.lit("relation").alias("entity_type"), F.col("episode_id").cast("string").alias("entity_id"),
        F.create_map(F.lit("episode_id"), F.col("episode_id").cast("string"), F.lit("cluster_id"), F.col("cluster_id").cast("string")).alias("fields"),
    )
    return oplog.reconcile(ops_table(d), records.unionByName(relations))


@query("reconcile_ops", f"WITH {REC_DUCK} SELECT * FROM rec")
def reconcile_ops(d):
    return reconciled(d).select("op_id", "status", "status_reason")


@query("ops_cleanup", f"WITH {REC_DUCK} SELECT op_id, status FROM rec WHERE status = 'queued' AND op_id NOT IN (SELECT op_id FROM {{op}} WHERE entity_type = 'keyword') AND op_id NOT IN (SELECT op_id FROM {{op}} WHERE op_type = 'link')".replace("{{", "{").replace("}}", "}"))
def ops_cleanup(d):
    ops = reconciled(d)
    cancelled = oplog.cancel_ops(ops, ops.filter("entity_type = 'keyword'"))
    left = oplog.remove_ops(cancelled, cancelled.filter("op_type = 'link'"))
    return oplog.cleanup_ops(left).select("op_id", "status")


@query("op_status_counts", f"""WITH {REC_DUCK} SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'applied') AS applied,
    count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'cancelled') AS cancelled FROM rec""")
def op_status_counts(d):
    return oplog.status_counts(reconciled(d))


# ---------------------------------------------------------------- merges


BATCH_DUCK = """batch AS (SELECT user_id + 100 AS id, 'New' || event_id AS title, CASE WHEN k % 2 = 0 THEN event_type END AS kind, k::bigint AS score, event_id AS ord FROM {fac_k})"""


def batch(d):
    return d.fac_k.select(
        (F.col("user_id") + 100).alias("id"), F.concat(F.lit("New"), F.col("event_id").cast("string")).alias("title"),
        F.when(F.col("k") % 2 == 0, F.col("event_type")).alias("kind"), F.col("k").cast("bigint").alias("score"), F.col("event_id").alias("ord"),
    )


@query("upsert_replace", f"""WITH {BATCH_DUCK}, n AS (SELECT id, title, kind, score FROM batch QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1)
    SELECT * FROM {{cust}} WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n""".replace("{{", "{").replace("}}", "}"))
def upsert_replace(d):
    return mutations.upsert_replace(d.cust, batch(d), ["id"], ["ord"])


@query("upsert_coalesce", f"""WITH {BATCH_DUCK}, n AS (SELECT id, title, kind, score FROM batch QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1)
    SELECT coalesce(n.id, c.id) AS id, coalesce(n.title, c.title) AS title, coalesce(n.kind, c.kind) AS kind, coalesce(n.score, c.score) AS score FROM {{cust}} c FULL JOIN n ON n.id = c.id""".replace("{{", "{").replace("}}", "}"))
def upsert_coalesce(d):
    return mutations.upsert_coalesce(d.cust, batch(d), ["id"], ["ord"], ["kind"])


@query("insert_ignore", f"""WITH {BATCH_DUCK} SELECT * FROM {{cust}} UNION ALL
    (SELECT id, title, kind, score FROM batch WHERE id NOT IN (SELECT id FROM {{cust}}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1)""".replace("{{", "{").replace("}}", "}"))
def insert_ignore(d):
    return mutations.insert_ignore(d.cust, batch(d), ["id"], ["ord"])


@query("anti_guid", """
    SELECT 'c-' || l_partkey AS guid, min((l_orderkey, l_linenumber, l_suppkey, l_quantity))[1] AS order_id FROM {lineitem} WHERE l_partkey NOT IN (SELECT c_custkey FROM {customer}) GROUP BY 1""")
def anti_guid(d):
    items = d.lineitem.select(
        F.concat(F.lit("c-"), F.col("l_partkey").cast("string")).alias("guid"), F.col("l_orderkey").alias("order_id"), "l_linenumber", "l_suppkey", "l_quantity"
    )
    known = d.customer.select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("guid"))
    return mutations.new_by_guid(items, known, ["order_id", "l_linenumber", "l_suppkey", "l_quantity"]).select("guid", "order_id")


POD_SQL = """SELECT cast(n_nationkey + 1 AS bigint) AS id, n_name AS title, '' AS description, 'de' AS language, concat('https://n', cast(n_nationkey AS string), '.example') AS link,
    cast(NULL AS string) AS image_url, concat('feed-', cast(n_nationkey AS string), '.xml') AS feed_url, 'xml' AS feed_type FROM {nation}"""
FEED_SQL = """SELECT s_suppkey AS feed_pos, concat('feed-', cast(s_suppkey + 20 AS string), '.xml') AS path,
    CASE s_suppkey % 4 WHEN 0 THEN concat('https://n', cast(s_nationkey * 2 AS string), '.example') WHEN 1 THEN ' https://only.example ' WHEN 2 THEN '' END AS link,
    CASE s_suppkey % 3 WHEN 0 THEN concat('Show ', cast(s_suppkey % 20 AS string)) WHEN 1 THEN concat('nation_', cast(s_nationkey + 10 AS string)) END AS title,
    'About' AS description, 'en' AS language, '' AS image_url FROM {supplier}"""
ITEM_SQL = """SELECT o_custkey % 10 AS feed_pos, o_orderkey AS item_pos, concat('g', cast((o_orderkey * 7) % 9001 AS string)) AS guid,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('Folge ', cast(o_orderkey AS string)) END AS title FROM {orders}"""
KNOWN_SQL = "SELECT c_custkey + 1 AS id, concat('g', cast(c_custkey * 3 AS string)) AS guid, c_name AS title, cast(c_nationkey + 1 AS bigint) AS podcast_id FROM {customer}"


def duck_of(sql):
    return sql.replace("{", "").replace("}", "")


RESOLVE_DUCK = f"""p AS ({duck_of(POD_SQL)}), f AS ({duck_of(FEED_SQL)}),
    reg0 AS (SELECT map_from_entries(list((k, id))) AS reg FROM (SELECT id, unnest([feed_url, link, lower(title)]) AS k FROM p))"""
MERGE_DUCK = f"""{RESOLVE_DUCK}, st AS (
      SELECT cast(-1 AS bigint) AS i, reg, (SELECT max(id) FROM p) AS top, cast(NULL AS bigint) AS pid, false AS fresh FROM reg0
      UNION ALL
      SELECT f.feed_pos, CASE WHEN hit IS NULL THEN map_concat(x.reg, map_from_entries(list_filter([(nullif(trim(f.link), ''), x.top + 1), (lower(f.title), x.top + 1), (f.path, x.top + 1)], lambda e: e[1] IS NOT NULL))) ELSE x.reg END,
        x.top + (hit IS NULL)::int, coalesce(hit, x.top + 1), hit IS NULL
      FROM (SELECT st.*, f.*, coalesce(st.reg[coalesce(nullif(trim(f.link), ''), '-')], st.reg[coalesce(lower(f.title), '-')], st.reg[f.path]) AS hit FROM st JOIN f ON f.feed_pos = st.i + 1) x JOIN f ON f.feed_pos = x.i + 1),
    own AS (SELECT i AS feed_pos, pid, fresh FROM st WHERE i >= 0)"""


def merge_tables(d):
    run = d.spark.sql
    return run(POD_SQL, nation=d.nation), run(FEED_SQL, supplier=d.supplier), run(ITEM_SQL, orders=d.orders), run(KNOWN_SQL, customer=d.customer)


@query("resolve_podcast", f"""WITH {RESOLVE_DUCK} SELECT feed_pos, coalesce(reg[coalesce(nullif(trim(link), ''), '-')], reg[coalesce(lower(title), '-')], reg[path]) AS podcast_id FROM f, reg0""")
def resolve_podcast(d):
    podcasts, feed, _, _ = merge_tables(d)
    return mf.resolve_podcast(feed, podcasts)


@query("merge_podcasts", f"""WITH RECURSIVE {MERGE_DUCK} SELECT id, title, link, feed_url FROM p
    UNION ALL SELECT o.pid, coalesce(f.title, 'Podcast ' || o.pid), nullif(trim(f.link), ''), f.path FROM own o JOIN f USING (feed_pos) WHERE o.fresh""")
def merge_podcasts(d):
    podcasts, feed, items, known = merge_tables(d)
    return mf.merge_feeds(podcasts, known, feed, items).podcasts.select("id", "title", "link", "feed_url")


@query("merge_feeds", f"""WITH RECURSIVE {MERGE_DUCK}, i AS ({duck_of(ITEM_SQL)}), k AS ({duck_of(KNOWN_SQL)}),
    n AS (SELECT * FROM i WHERE guid NOT IN (SELECT guid FROM k) QUALIFY row_number() OVER (PARTITION BY guid ORDER BY feed_pos, item_pos) = 1),
    r AS (SELECT *, (SELECT max(id) FROM k) + row_number() OVER (ORDER BY feed_pos, item_pos) AS id FROM n)
    SELECT id, guid, title, podcast_id FROM k UNION ALL SELECT r.id, guid, coalesce(title, 'Episode ' || r.id), own.pid FROM r JOIN own USING (feed_pos)""")
def merge_feeds(d):
    podcasts, feed, items, known = merge_tables(d)
    return mf.merge_feeds(podcasts, known, feed, items).episodes


# ---------------------------------------------------------------- curation

CUR_DUCK = """rq AS (SELECT o_orderkey AS episode_id FROM {orders} WHERE o_orderstatus = 'F'), kp AS (SELECT episode_id, span_id FROM {span} JOIN rq USING (episode_id) WHERE qualifier = 'R'
      UNION ALL SELECT episode_id, 'none-' || episode_id FROM rq),
    gone AS (SELECT s.* FROM {span} s JOIN rq USING (episode_id) WHERE s.span_id NOT IN (SELECT span_id FROM kp)),
    bst AS (SELECT episode_id, span_id AS best_span_id FROM {span} QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, span_id) = 1)"""


def curated(d):
    from .q_cluster import relational

    asked = d.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("episode_id"))
    keep = d.span.filter("qualifier = 'R'").join(asked, "episode_id").select("episode_id", "span_id")
    keep = keep.union(asked.select("episode_id", F.concat(F.lit("none-"), F.col("episode_id").cast("string"))))
    best = relational.first_per(d.span.select("episode_id", "span_id", "score"), ["episode_id"], [-F.col("score"), "span_id"])
    episodes = best.select("episode_id", F.col("span_id").alias("best_span_id"))
    links = d.span.select("span_id", F.col("line_no").alias("entity_id"))
    return curation.delete_episode_spans(asked, keep, d.span, episodes, links, links.filter("entity_id > 3").withColumnRenamed("entity_id", "place_id"))


@query("cascade_delete", f"""WITH {CUR_DUCK}, g AS (SELECT episode_id, count(*) AS n, count(*) FILTER (line_no > 3) AS p FROM gone GROUP BY 1),
    k AS (SELECT episode_id, count(*) - 1 AS n FROM kp GROUP BY 1)
    SELECT rq.episode_id, coalesce(g.n, 0) AS deleted_span_count, k.n AS kept_span_count, 1::bigint AS missing_keep_count, coalesce(g.n, 0) AS deleted_span_entity_count,
      coalesce(g.p, 0) AS deleted_span_place_count, coalesce(b.best_span_id IN (SELECT span_id FROM gone), false) AS best_span_cleared
    FROM rq LEFT JOIN g USING (episode_id) LEFT JOIN k USING (episode_id) LEFT JOIN bst b USING (episode_id)""")
def cascade_delete(d):
    return curated(d).report


@query("cascade_spans", f"""WITH {CUR_DUCK} SELECT 'span' AS kind, span_id AS id FROM {{span}} WHERE span_id NOT IN (SELECT span_id FROM gone)
    UNION ALL SELECT 'link', span_id FROM {{span}} WHERE line_no > 3 AND span_id NOT IN (SELECT span_id FROM gone)
    UNION ALL SELECT 'best', cast(episode_id AS varchar) || '=' || coalesce(CASE WHEN best_span_id NOT IN (SELECT span_id FROM gone) THEN best_span_id END, '') FROM bst""".replace("{{", "{").replace("}}", "}"))
def cascade_spans(d):
    r = curated(d)
    best = F.concat(F.col("episode_id").cast("string"), F.lit("="), F.coalesce("best_span_id", F.lit("")))
    return (
        r.spans.select(F.lit("span").alias("kind"), F.col("span_id").alias("id"))
        .union(r.span_place.select(F.lit("link"), "span_id"))
        .union(r.episodes.select(F.lit("best"), best))
    )


@query("keep_diff", """WITH a AS (SELECT DISTINCT l_partkey AS id FROM {lineitem}), k AS (SELECT DISTINCT c_custkey + 100 AS id FROM {customer})
    SELECT coalesce(a.id, k.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN k.id IS NULL THEN 'deleted' ELSE 'kept' END AS state FROM a FULL JOIN k ON a.id = k.id""")
def keep_diff(d):
    return mutations.keep_diff(d.lineitem.select(F.col("l_partkey").alias("id")), d.customer.select((F.col("c_custkey") + 100).alias("id")), ["id"])


# ---------------------------------------------------------------- flat ingest and overrides

OV_SQL = """SELECT concat('ev-', cast(event_id AS string)) AS guid, CASE event_id % 8 WHEN 0 THEN '{{"incident_type":"battle","persons":null}}' WHEN 1 THEN '{{"persons":["Ada","Bo"],"links":[]}}'
    WHEN 2 THEN '{{"primary_time":{{"kind":"point","year":-44}}}}' WHEN 3 THEN '{{"primary_time":{{"kind":"range","start_year":1914,"end_year":"x"}}}}'
    WHEN 4 THEN '{{"primary_location":{{"name":"nation_3"}}}}' WHEN 5 THEN '{{"primary_location":{{"name":"Atlantis"}}}}' ELSE '{{"primary_time":{{"kind":"unknown"}}}}' END AS value
    FROM {events} UNION ALL SELECT 'ev-none', '{{"incident_type":"battle"}}' FROM {events} WHERE event_id = 1"""


@query("override_patch", """
    SELECT guid, CASE WHEN m = 0 THEN 'battle' ELSE incident_type END AS incident_type, CASE m WHEN 0 THEN '' WHEN 1 THEN 'Ada|Bo' ELSE title || '|' || podcast_id END AS persons,
      CASE m WHEN 2 THEN 'point' WHEN 3 THEN 'range' ELSE primary_time_kind END AS kind, CASE m WHEN 2 THEN -44 WHEN 3 THEN NULL ELSE primary_time_year END AS year,
      CASE m WHEN 2 THEN NULL WHEN 3 THEN 1914 ELSE primary_time_start_year END AS start_year, CASE m WHEN 2 THEN NULL WHEN 3 THEN 0 ELSE primary_time_end_year END AS end_year,
      CASE m WHEN 4 THEN 'NATION_3' ELSE name END AS place, CASE m WHEN 4 THEN -39.0::double ELSE lat END AS lat
    FROM (SELECT *, event_id % 8 AS m FROM {fac})""")
def override_patch(d):
    records = documents.parse_overrides(d.spark.sql(OV_SQL, events=d.events))
    names = gazetteers.lower_dictionary(gazetteers.comma_gazetteer(d.gaz_comma))
    out = overrides.apply_overrides(flat_events(d), records, names)
    return out.select(
        "guid", "incident_type", F.array_join("persons", "|").alias("persons"), F.col("primary_time_kind").alias("kind"), F.col("primary_time_year").alias("year"),
        F.col("primary_time_start_year").alias("start_year"), F.col("primary_time_end_year").alias("end_year"),
        F.col("primary_location_name").alias("place"), F.col("primary_location_lat").alias("lat"),
    )


FLAT_TXT = TM_DUCK.replace("t0 AS (SELECT episode_id, text FROM {txt} UNION ALL SELECT 10000000 + doc_id, text FROM {documents})", "t0 AS (SELECT episode_id, 'Folge' || chr(10) || chr(10) || text AS text FROM {txt})")
FLAT_LOC = LOC_DUCK.replace("FROM {txt} t", "FROM t0 t")


@query("ingest_flat", f"""WITH {FLAT_TXT}, f AS (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY kind DESC, "start", "end") = 1), {FLAT_LOC},
    pl AS (SELECT * FROM loc QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY st, size) = 1),
    n AS (SELECT episode_id, list_distinct(list_filter(regexp_extract_all({coded('text')}, '\\b([A-Z567][a-z1-4]+\\s+(?:(?:von|van|de|del|der|den|da|di)\\s+)?[A-Z567][a-z1-4]+(?:\\s+[A-Z567][a-z1-4]+){{0,2}})\\b', 1),
      lambda x: NOT list_has_any(regexp_split_to_array(x, '\\s+'), ['Ort','Zeit','Thema','Personen','Kontext','Mehr','Folge','Jahr','Krieg','Revolution','Politik','Frankreich','Deutschland']))) AS p FROM t0)
    SELECT t0.episode_id, {INCIDENT.replace('(t)', '(t0.text)')} AS incident_type, CASE f.kind WHEN 'year' THEN 'point' ELSE 'range' END AS kind, f.year, pl.name AS place, pl.lat,
      {decoded("array_to_string(list_sort(n.p), ';')")} AS persons, 3 AS n_links FROM t0 LEFT JOIN f USING (episode_id) LEFT JOIN pl USING (episode_id) LEFT JOIN n USING (episode_id)""")
def ingest_flat(d):
    items = d.txt.select(
        "podcast_id", F.col("episode_id").cast("string").alias("guid"), F.lit("Folge").alias("title"), F.col("pub_date").alias("published_at"), F.col("text").alias("description"),
        F.lit(None).cast("string").alias("audio_url"), F.lit(None).cast("bigint").alias("audio_length"), F.lit("1:00").alias("duration_raw"),
    )
    out = flat.ingest_flat(items, gazetteers.comma_gazetteer(d.gaz_comma))
    return out.select(
        F.col("guid").cast("bigint").alias("episode_id"), "incident_type", F.col("primary_time_kind").alias("kind"), F.col("primary_time_year").alias("year"),
        F.col("primary_location_name").alias("place"), F.col("primary_location_lat").alias("lat"), F.array_join(F.array_sort("persons"), ";").alias("persons"),
        F.size("links").alias("n_links"),
    )


# ---------------------------------------------------------------- full build


@query("build_all", """
    SELECT 'episodes' AS table_name, count(*) AS row_count FROM {txt} WHERE episode_id NOT IN (SELECT c_custkey FROM {customer})
    UNION ALL SELECT 'segments', count(*) FROM {txt} WHERE episode_id NOT IN (SELECT c_custkey FROM {customer})
    UNION ALL SELECT 'links', 3 * count(*) FROM {txt} WHERE episode_id NOT IN (SELECT c_custkey FROM {customer})
    UNION ALL SELECT 'episodes_with_span', count(*) FROM {txt} WHERE episode_id NOT IN (SELECT c_custkey FROM {customer})
    UNION ALL SELECT 'place_names', count(DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 20 + n_regionkey ELSE n_nationkey END) + max(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END)
      FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey WHERE o_orderkey NOT IN (SELECT c_custkey FROM {customer})""")
def build_all(d):
    items = d.txt.select(
        "podcast_id", F.col("episode_id").alias("item_pos"), F.concat(F.lit("g-"), F.col("episode_id").cast("string")).alias("guid"), F.lit("Folge").alias("title"), "page_url", "pub_date",
        F.lit(None).cast("string").alias("author"), F.replace("text", F.lit(" Mehr:"), F.lit("<br>Mehr:")).alias("description_raw"),
    )
    known = d.customer.select(F.concat(F.lit("g-"), F.col("c_custkey").cast("string")).alias("guid"))
    tables = build.build_all(items, gazetteers.pipe_gazetteer(d.gaz_pipe), known, clusters=False)
    with_span = tables["episodes"].filter("best_span_id IS NOT NULL")
    return export_dataset.section_counts(
        {"episodes": tables["episodes"], "segments": tables["segments"], "links": tables["links"], "episodes_with_span": with_span, "place_names": tables["places_norm"]}
    ).withColumnRenamed("section", "table_name")


# ---------------------------------------------------------------- enrichment

NAME_SQL = "SELECT p_name AS name, min(p_partkey) AS k FROM {part} GROUP BY p_name"
HIT_SQL = """SELECT name, 'de' AS language, 0 AS rank, CASE k % 4 WHEN 0 THEN concat('P', cast(k AS string)) ELSE concat('Q', cast(k + 100000 AS string)) END AS id, concat('de ', name) AS description FROM {names} WHERE k % 5 <> 0
    UNION ALL SELECT name, 'en', 0, concat('Q', cast(k AS string)), NULL FROM {names} WHERE k % 3 <> 0
    UNION ALL SELECT name, 'de', 1, 'Q999999', 'second hit' FROM {names}"""
ENTITY_SQL = """SELECT name, k, concat('{{"claims":{{"P31":[', array_join_p31, '],"P569":[', v, '{{"time":"+1815-04-01T00:00:00Z"}}', e, '],"P17":[', v, '{{"text":"', name, '"}}', e, '],"P131":[', v, '{{"amount":"+', cast(k AS string), '"}}', e,
      '],"P361":[', v, '[1,2,3,4,5]', e, '],"P571":[', v, '"plain"', e, ',', v, '"plain"', e, ',', v, 'true', e, ',', v, '', '7', e, '],"P580":[', v, '{{"x":1}}', e, ']}},"sitelinks":{{"', CASE WHEN k % 2 = 0 THEN 'dewiki' ELSE 'enwiki' END, '":{{"url":"https://w.example/', cast(k AS string), '"}}}}}}') AS value
    FROM (SELECT *, '{{"mainsnak":{{"snaktype":"value","datavalue":{{"value":' AS v, '}}}}}}' AS e,
      concat('{{"mainsnak":{{"snaktype":"novalue"}}}},', '{{"mainsnak":{{"snaktype":"value","datavalue":{{"value":{{"id":"Q1"}}}}}}}},{{"mainsnak":{{"snaktype":"value","datavalue":{{"value":{{"id":"Q2"}}}}}}}},{{"mainsnak":{{"snaktype":"somevalue"}}}},',
        '{{"mainsnak":{{"snaktype":"value","datavalue":{{"value":{{"id":"Q1"}}}}}}}},{{"mainsnak":{{"snaktype":"value","datavalue":{{"value":{{"id":"Q3"}}}}}}}},{{"mainsnak":{{"snaktype":"value","datavalue":{{"value":{{"id":"Q7"}}}}}}}}') AS array_join_p31 FROM {names}) x"""
CLAIM_DUCK = f"""nm AS ({duck_of(NAME_SQL)}), cr AS (SELECT k, unnest([('P31','Q1'),('P31','Q2'),('P31','Q3'),('P569','1815-04-01'),('P17',name),('P131','+' || k),('P361','[1,2,3,4]'),('P571','plain'),('P571','True'),('P571','7'),('P580','{{"x":1}}')]) AS c FROM nm),
    claims AS (SELECT k, c[1] AS property, c[2] AS value FROM cr)"""


def names(d):
    return d.spark.sql(NAME_SQL, part=d.part)


def entity_docs(d):
    return d.spark.sql(ENTITY_SQL, names=names(d))


@query("claim_rows", f"WITH {CLAIM_DUCK} SELECT k, property, value FROM claims")
def claim_rows(d):
    docs = documents.parse_entity_documents(entity_docs(d), "k")
    return enrichment.claim_rows(docs, "k")


CAND_DUCK = """cd AS (SELECT trim(name) AS name, coalesce(kind, 'unknown') AS kind, count(*) AS entity_count, round(avg(coalesce(confidence, 0)), 9)::double AS avg_confidence FROM {ent}
      WHERE trim(name) <> '' GROUP BY 1, 2 HAVING count(*) >= 2 AND avg_confidence >= 0.6 ORDER BY entity_count DESC, avg_confidence DESC, name, kind LIMIT 400)"""


@query("entity_candidates", f"WITH {CAND_DUCK} SELECT name, kind, entity_count, round(avg_confidence, 6)::double AS avg_confidence FROM cd")
def entity_candidates(d):
    return enrichment.entity_candidates(d.ent).withColumn("avg_confidence", F.round("avg_confidence", 6))


RES_DUCK = f"""{CAND_DUCK}, nm AS ({duck_of(NAME_SQL)}), rs AS (SELECT cd.*, nm.k, CASE WHEN nm.k % 5 <> 0 AND nm.k % 4 <> 0 THEN 'Q' || (nm.k + 100000) WHEN nm.k % 5 = 0 THEN 'Q999999' WHEN nm.k % 3 <> 0 THEN 'Q' || nm.k END AS qid FROM cd JOIN nm USING (name))"""


def resolved(d):
    hits = d.spark.sql(HIT_SQL, names=names(d))
    return enrichment.resolve_concepts(enrichment.entity_candidates(d.ent), hits)


@query("resolve_concepts", f"WITH {RES_DUCK} SELECT name, kind, qid FROM rs WHERE qid IS NOT NULL")
def resolve_concepts(d):
    return resolved(d).select("name", "kind", "qid")


@query("map_concepts", f"WITH {CAND_DUCK} SELECT DISTINCT e.episode_id, cd.name, cd.kind, round(cd.avg_confidence, 6)::double AS score FROM {{ent}} e JOIN cd ON trim(e.name) = cd.name AND coalesce(e.kind, 'unknown') = cd.kind".replace("{{", "{").replace("}}", "}"))
def map_concepts(d):
    concepts = enrichment.entity_candidates(d.ent).withColumn("concept_id", F.struct("name", "kind"))
    return enrichment.map_concepts(concepts, d.ent).select("episode_id", "concept_id.name", "concept_id.kind", F.round("score", 6).alias("score"))


ENRICH_DUCK = f"""{RES_DUCK}, ok AS (SELECT *, 'Q' || (k + 100000) AS doc FROM rs WHERE k % 5 <> 0 AND k % 4 <> 0 AND qid IS NOT NULL),
    con AS (SELECT qid, arg_max(name, (-entity_count, -avg_confidence, kind)) AS any_name FROM ok GROUP BY 1)"""


def enriched(d):
    docs = documents.parse_entity_documents(entity_docs(d).withColumn("qid", F.concat(F.lit("Q"), (F.col("k") + 100000).cast("string"))))
    run = d.spark
    concepts = run.createDataFrame([], "qid string, name string, kind string, url string, description string, entity_count bigint, avg_confidence double")
    bridge = run.createDataFrame([], "episode_id bigint, concept_id string, score double")
    claims = run.createDataFrame([], "concept_id string, property string, value string")
    hits = d.spark.sql(HIT_SQL, names=names(d))
    return enrichment.enrich(d.ent, hits, docs, concepts, bridge, claims)


@query("enrich_concepts", f"""WITH {ENRICH_DUCK} SELECT (SELECT count(*) FROM cd) AS candidates, (SELECT count(*) FROM ok) AS concepts_upserted,
    (SELECT count(*) FROM (SELECT DISTINCT e.episode_id, ok.qid FROM {{ent}} e JOIN ok ON e.name = ok.name AND coalesce(e.kind, 'unknown') = ok.kind)) AS episode_links_upserted,
    (SELECT 11 * count(DISTINCT qid) FROM ok) AS claims_upserted""".replace("{{", "{").replace("}}", "}"))
def enrich_concepts(d):
    return enriched(d)["counts"]


@query("concept_claims", f"""WITH {CLAIM_DUCK}, w AS (SELECT DISTINCT e.episode_id, nm.k, nm.name FROM {{ent}} e JOIN nm USING (name))
    SELECT episode_id, k AS concept_id, name AS concept_name, property, value FROM w JOIN claims USING (k)""".replace("{{ent}}", "{ent}"))
def concept_claims(d):
    n = names(d)
    bridge = d.ent.select("episode_id", "name").distinct().join(n, "name").select("episode_id", F.col("k").alias("concept_id"))
    concepts = n.select(F.col("k").alias("id"), "name")
    return explore.concept_drilldown(bridge, concepts, claim_rows(d).withColumnRenamed("k", "concept_id"))


# ---------------------------------------------------------------- quality and export


@query("validate_rows", """
    WITH r AS (SELECT CASE WHEN l_linenumber = 7 THEN 'x' ELSE cast(l_orderkey AS varchar) END AS id, CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_name END AS name, lower(p_type) AS kind FROM {lineitem} JOIN {part} ON p_partkey = l_partkey)
    SELECT 'id: not bigint' AS violation, count(*) AS count FROM r WHERE id = 'x' HAVING count(*) > 0 UNION ALL SELECT 'name: missing', count(*) FROM r WHERE name IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'kind: not allowed', count(*) FROM r WHERE kind NOT IN ('person', 'org', 'event', 'place', 'unknown') HAVING count(*) > 0 UNION ALL SELECT 'source_text: missing', count(*) FROM r""")
def validate_rows(d):
    rows = d.lineitem.join(d.part, d.lineitem.l_partkey == d.part.p_partkey).select(
        F.when(F.col("l_linenumber") == 7, "x").otherwise(F.col("l_orderkey").cast("string")).alias("id"), F.col("l_orderkey").alias("episode_id"),
        F.when(F.col("p_type") != "SMALL", F.col("p_name")).alias("name"), F.lower("p_type").alias("kind"), (1 + F.col("l_discount")).alias("confidence"),
    )
    return quality.violation_counts(rows, "entities")


@query("validate_metrics", f"""WITH {VEC_DUCK}, e AS (SELECT cluster_id, name, kind, count(*) AS n FROM {{clu}} JOIN {{ent}} USING (episode_id) GROUP BY 1, 2, 3
      QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, name, kind NULLS FIRST) <= 25)
    SELECT 'cluster_keywords' AS section, count(*) AS valid_rows, CAST(0 AS bigint) AS bad_rows FROM v
    UNION ALL SELECT 'cluster_entity_stats', count(*) FILTER (kind IS NOT NULL), count(*) FILTER (kind IS NULL) FROM e""".replace("{{", "{").replace("}}", "}"))
def validate_metrics(d):
    words = metrics.cluster_keywords(d.clu, d.kw)
    people = metrics.cluster_entities(d.clu, d.ent).withColumn("lift", F.lit(1.0))
    out = None
    for section, model, df in (("cluster_keywords", "keywords", words), ("cluster_entity_stats", "cluster_entity_stats", people)):
        good, bad = quality.validate(df, model)
        one = good.agg(F.count(F.lit(1)).alias("valid_rows")).select(F.lit(section).alias("section"), "valid_rows", bad.agg(F.count(F.lit(1))).scalar().alias("bad_rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("sink_json", "SELECT entity_id AS id, episode_id, name, kind, round(confidence, 6)::double AS confidence FROM {ent}")
def sink_json(d):
    """The entity section written as JSON lines and read back."""
    section = d.ent.select(F.col("entity_id").alias("id"), "episode_id", "name", "kind", F.round("confidence", 6).alias("confidence"))
    folder = f"{shared_folder(d.spark)}/sections-{uuid.uuid4().hex}"
    sinks.write_sections({"entities": section}, folder)
    return d.spark.read.schema(section.schema).json(f"{folder}/entities")


@query("sink_table", "SELECT guid, podcast_id, title, published_at FROM {fac}")
def sink_table(d):
    """The flat episodes written as a table partitioned by podcast and read back."""
    rows = d.fac.select("guid", "podcast_id", "title", "published_at")
    folder = f"{shared_folder(d.spark)}/store-{uuid.uuid4().hex}"
    sinks.write_snapshot(rows, folder, "podcast_id")
    return d.spark.read.parquet(folder).select(*rows.columns)


@query("adaptive_select", """SELECT event_id AS id, podcast_id, guid, title, published_at AS pub_date, incident_type AS kind, description AS description_pure, NULL AS page_url FROM {fac}""")
def adaptive_select(d):
    out = quality.adaptive_episodes(d.fac.withColumnRenamed("event_id", "id"))
    return out.select("id", "podcast_id", "guid", "title", "pub_date", "kind", "description_pure", "page_url")


DIGEST_SQL = """
    WITH f AS (SELECT sha256('{{"confidence":' || format('{{:.6f}}', confidence) || ',"episode_id":' || episode_id || ',"id":"' || entity_id || '","kind":' || coalesce('"' || {kind} || '"', 'null') || ',"name":"' || name || '"}}') AS h FROM {{ent}})
    SELECT count(*) AS row_count, concat_ws('-', cast(sum(cast('0x' || substr(h, 1, 16) AS ubigint)) AS varchar),
      cast(sum(cast('0x' || substr(h, 17, 16) AS ubigint)) AS varchar),
      cast(sum(cast('0x' || substr(h, 33, 16) AS ubigint)) AS varchar),
      cast(sum(cast('0x' || substr(h, 49, 16) AS ubigint)) AS varchar),
      lpad(lower(to_hex(bit_xor(cast('0x' || substr(h, 1, 16) AS ubigint)))), 16, '0'),
      lpad(lower(to_hex(bit_xor(cast('0x' || substr(h, 17, 16) AS ubigint)))), 16, '0'),
      lpad(lower(to_hex(bit_xor(cast('0x' || substr(h, 33, 16) AS ubigint)))), 16, '0'),
      lpad(lower(to_hex(bit_xor(cast('0x' || substr(h, 49, 16) AS ubigint)))), 16, '0')) AS digest FROM f"""


@query("dataset_digest", DIGEST_SQL.format(kind="kind"))
def dataset_digest(d):
    rows = d.ent.withColumnRenamed("entity_id", "id")
    return quality.dataset_digest(export_dataset.with_fingerprint(rows, "entities"))


@query("digest_update", DIGEST_SQL.format(kind="CASE kind WHEN 'place' THEN 'location' ELSE kind END"))
def digest_update(d):
    """Digest after places are renamed, from the state before and the changed rows only."""
    rows = d.ent.withColumnRenamed("entity_id", "id")
    changed = rows.where("kind = 'place'")

    def state(x):
        return quality.digest_state(export_dataset.with_fingerprint(x, "entities"))

    return quality.digest_of(quality.updated_state(state(rows), state(changed.withColumn("kind", F.lit("location"))), state(changed)))


@query("export_revision", f"""WITH g AS ({DIGEST_SQL.format(kind="kind")}) SELECT '{export_dataset.SCHEMA_VERSION}' AS schema_version, 'driver tables' AS source_db,
    sha256(cast(row_count AS varchar) || ':' || digest) AS dataset_revision, false AS wiki_enriched, true AS wikidata_enriched FROM g""")
def export_revision(d):
    sections = {"entities": export_dataset.with_fingerprint(d.ent.withColumnRenamed("entity_id", "id"), "entities"), "podcasts": d.cep, "concept_claims": d.cep}
    return export_dataset.export_meta(sections, "driver tables").drop("generated_at_iso")


@query("export_sections", f"""WITH {VEC_DUCK}, e AS (SELECT episode_id, name, coalesce(kind, 'unknown') AS kind FROM {{ent}}),
    ec AS (SELECT cluster_id, name, kind, count(*) AS n FROM {{clu}} JOIN e USING (episode_id) GROUP BY 1, 2, 3), y AS (SELECT episode_id, year(start_date) AS y FROM {{span}} UNION ALL SELECT episode_id, year(end_date) FROM {{span}} WHERE end_date IS NOT NULL)
    SELECT 'meta' AS section, 1 AS row_count UNION ALL SELECT 'podcasts', count(DISTINCT podcast_id) FROM {{cep}} UNION ALL SELECT 'episodes', count(*) FROM {{cep}} UNION ALL SELECT 'spans', count(*) FROM {{span}} UNION ALL SELECT 'places', count(*) FROM {{place}}
    UNION ALL SELECT 'entities', count(*) FROM {{ent}} UNION ALL SELECT 'episode_keywords', count(DISTINCT episode_id) FROM {{kw}} UNION ALL SELECT 'episode_clusters', count(*) FROM {{clu}}
    UNION ALL SELECT 'clusters', count(DISTINCT cluster_id) FROM {{clu}} UNION ALL SELECT 'cluster_stats', count(DISTINCT cluster_id) FROM {{clu}} UNION ALL SELECT 'cluster_term_metrics', count(*) FROM v
    UNION ALL SELECT 'cluster_correlations', count(DISTINCT (a.cluster_id, b.cluster_id)) FROM v a JOIN v b ON a.term = b.term AND a.cluster_id < b.cluster_id
    UNION ALL SELECT 'cluster_entity_stats', sum(least(n, 50))::bigint FROM (SELECT count(*) AS n FROM ec GROUP BY cluster_id)
    UNION ALL SELECT 'cluster_place_stats', sum(least(n, 50))::bigint FROM (SELECT count(DISTINCT canonical_name) AS n FROM {{clu}} JOIN {{place}} USING (episode_id) GROUP BY cluster_id)
    UNION ALL SELECT 'cluster_timeline_histogram', count(*) FROM (SELECT DISTINCT cluster_id, y // 10 FROM {{clu}} JOIN y USING (episode_id)) UNION ALL SELECT 'cluster_next_steps', count(DISTINCT cluster_id) FROM {{clu}}""".replace("{{", "{").replace("}}", "}"))
def export_sections(d):
    x = inputs(d)
    kw, en = metrics.cluster_keywords(d.clu, d.kw).drop("rank"), metrics.cluster_entities(d.clu, d.ent).drop("rank")
    none = F.lit(None).cast("string")
    tables = {
        "podcasts": d.cep.select(F.col("podcast_id").alias("id")).distinct(),
        "episodes": d.cep.select(F.col("episode_id").alias("id"), "podcast_id", "title", F.col("pub_date").cast("string").alias("pub_date_iso"), "kind", "narrator", none.alias("best_span_id"), none.alias("best_place_id")),
        "spans": d.span.select(F.col("span_id").alias("id"), "episode_id", F.col("start_date").alias("start_iso"), F.col("end_date").alias("end_iso"), F.lit("year").alias("precision"), "qualifier", "score"),
        "places": d.place.select(F.col("place_id").alias("id"), "episode_id", "canonical_name", F.lower("canonical_name").alias("norm_key"), "place_kind", "lat", "lon"),
        "entities": d.ent.withColumnRenamed("entity_id", "id"),
        "clusters": d.clu.select("cluster_id").distinct(),
        "cluster_keywords": kw,
        "cluster_entities": en,
    }
    return export_dataset.section_counts(export_dataset.export_dataset(tables, x, PLACE_ORDER, d.sf_dir))
