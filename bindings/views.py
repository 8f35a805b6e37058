"""Domain relations over the driver tables, written once in the SQL both engines share.

Braces name the relations a view reads: another view or a driver table.
"""

from __future__ import annotations

import re

_SQL = {
    # episodes with long texts
    "ep": """
        SELECT d.doc_id AS episode_id, d.source AS podcast_id, concat('doc-', cast(d.doc_id AS string)) AS guid,
               split_part(d.text, chr(10), 1) AS title, o.o_orderdate AS pub_date,
               d.text AS description, d.lang AS lang,
               CASE d.lang WHEN 'de' THEN 'Richard Wolf' WHEN 'fr' THEN 'Daniel Roy' END AS author
        FROM {documents} d LEFT JOIN {orders} o ON o.o_orderkey = d.doc_id""",
    # sentences with dates, places, people and links
    "txt_parts": """
        SELECT o.o_orderkey AS id, c.c_mktsegment AS podcast_id, o.o_orderdate AS pub_date, o.o_orderkey % 6 AS form,
               cast(o.o_orderkey AS string) AS sid,
               cast(1000 + o.o_custkey % 900 AS string) AS y1, cast(10 + o.o_orderkey % 90 AS string) AS yy,
               cast(700 + o.o_custkey % 200 AS string) AS y3, cast(850 + o.o_custkey % 100 AS string) AS y4,
               cast(1 + o.o_custkey % 21 AS string) AS century, cast(1 + o.o_orderkey % 480 AS string) AS bc,
               concat(cast(day(o.o_orderdate) AS string), '.', cast(month(o.o_orderdate) AS string), '.',
                      cast(year(o.o_orderdate) AS string)) AS dmy,
               CASE WHEN o.o_orderkey % 5 = 0 THEN concat('Region_', cast(n.n_regionkey AS string))
                    ELSE n.n_name END AS place,
               CASE o.o_orderkey % 7 WHEN 0 THEN 'Schlacht von Verdun' WHEN 1 THEN 'Attentat auf Rathenau'
                    WHEN 2 THEN 'Sturmflut am Meer' WHEN 3 THEN 'Revolution Wien' WHEN 4 THEN 'Zeit vor dem Mauerfall'
                    WHEN 5 THEN 'Frage vom Krieg' ELSE 'Gründung der Partei' END AS event,
               CASE o.o_custkey % 5 WHEN 0 THEN 'Anna Maria Schmidt' WHEN 1 THEN 'Otto von Bismarck'
                    WHEN 2 THEN 'Jean de Valois' WHEN 3 THEN 'Rosa Luxemburg' ELSE 'Karl Marx' END AS person,
               CASE o.o_orderkey % 4 WHEN 0 THEN 'Freie Universität' WHEN 1 THEN 'Partei KPD'
                    WHEN 2 THEN 'Deutsche Stiftung' ELSE 'Siemens AG' END AS org
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey""",
    "txt": """
        SELECT id AS episode_id, podcast_id, pub_date, concat('https://www.example.org/episode/', sid, '/x') AS page_url,
               concat(CASE form WHEN 0 THEN 'Das Folgenbild zeigt ein Portrait: ' WHEN 1 THEN 'Das erwartet euch: '
                                WHEN 2 THEN 'Im November. ' ELSE '' END,
                      CASE form WHEN 3 THEN 'Einst ' ELSE 'Im Jahr ' END, y1, ' kam es in ', place, ' zur ', event, '. ',
                      'Am ', dmy, ' 12:30 sprach ', person, ' bei der ', org, '. ',
                      CASE WHEN id % 9 = 0 THEN 'Nie am 31.2.1999. ' ELSE '' END,
                      'Von ', y1, '-', yy, ' und ', y3, ' – ', y4, ', ', y3, '-19 im ', century, '. Jahrhundert, ', bc,
                      ' v. Chr. Mehr: https://www.example.org/episode/', sid, '/x), https://www.instagram.com/p', sid,
                      '. Quelle: http://archive.example.net/', y1, '.') AS text
        FROM {txt_parts}""",
    "gaz_pipe": """
        SELECT cast(n_nationkey AS bigint) AS entry_pos, n_name AS name,
               CASE n_nationkey % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'region' WHEN 2 THEN '' ELSE 'country' END AS kind,
               CASE n_nationkey % 6 WHEN 5 THEN NULL ELSE cast((n_nationkey * 7) % 120 - 60 AS string) END AS lat,
               CASE n_nationkey % 6 WHEN 5 THEN NULL ELSE cast((n_nationkey * 13) % 300 - 150 AS string) END AS lon,
               CASE n_nationkey % 3 WHEN 0 THEN '' ELSE cast(n_nationkey * 10 AS string) END AS radius_km,
               concat('Region ', cast(n_regionkey AS string), '|NK-', cast(n_nationkey AS string), '| ') AS aliases
        FROM {nation}
        UNION ALL SELECT cast(1000 AS bigint), 'Verdun', 'city', '49.159', '5.386', '20', ''
        UNION ALL SELECT cast(1001 AS bigint), ' ', 'city', '1', '1', '', 'Nowhere'""",
    "gaz_comma": """
        SELECT cast(n_nationkey AS bigint) AS entry_pos, n_name AS name,
               CASE n_nationkey % 4 WHEN 2 THEN NULL ELSE 'city' END AS kind,
               concat('R', cast(n_regionkey AS string)) AS country,
               cast((n_nationkey * 7) % 120 - 60 AS string) AS lat, cast((n_nationkey * 13) % 300 - 150 AS string) AS lon,
               concat('Region_', cast(n_regionkey AS string), ', , NK', cast(n_nationkey AS string)) AS aliases
        FROM {nation}
        UNION ALL SELECT cast(1000 AS bigint), 'Verdun', 'city', 'FR', '49', '5', ''
        UNION ALL SELECT cast(1001 AS bigint), 'Schlacht von Verdun', 'event', 'FR', '49', '6', 'rathenau, der Partei'
        UNION ALL SELECT cast(1002 AS bigint), 'Wien', 'city', 'AT', '48', '16', 'revolution wien'""",
    # spans of episodes; the key columns of a line item make a unique id
    "span": """
        SELECT l.l_orderkey AS episode_id,
               concat_ws('-', cast(l.l_orderkey AS string), cast(l.l_linenumber AS string), cast(l.l_partkey AS string),
                         cast(l.l_suppkey AS string), cast(cast(l.l_quantity AS int) AS string)) AS span_id,
               make_date(year(o.o_orderdate) - cast(o.o_custkey % 40 AS int) * 25, month(o.o_orderdate),
                         least(day(o.o_orderdate), 28)) AS start_date,
               CASE WHEN l.l_linenumber = 7 THEN NULL ELSE
                    make_date(year(l.l_shipdate) - cast(o.o_custkey % 40 AS int) * 25, month(l.l_shipdate),
                              least(day(l.l_shipdate), 28)) END AS end_date,
               l.l_extendedprice AS score, l.l_returnflag AS qualifier, l.l_linenumber AS line_no
        FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey""",
    "ent": """
        SELECT l.l_orderkey AS episode_id,
               concat_ws('-', cast(l.l_orderkey AS string), cast(l.l_linenumber AS string), cast(l.l_partkey AS string),
                         cast(l.l_suppkey AS string), cast(cast(l.l_quantity AS int) AS string)) AS entity_id,
               p.p_name AS name,
               CASE p.p_type WHEN 'ECONOMY' THEN 'person' WHEN 'STANDARD' THEN 'org' WHEN 'PROMO' THEN 'event'
                    WHEN 'SMALL' THEN 'place' WHEN 'LARGE' THEN 'unknown' END AS kind,
               1 - l.l_discount AS confidence
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "kw": """
        SELECT l.l_orderkey AS episode_id, p.p_brand AS phrase, max(l.l_quantity) AS score
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey GROUP BY l.l_orderkey, p.p_brand""",
    "place": """
        SELECT l.l_orderkey AS episode_id,
               concat_ws('-', cast(l.l_orderkey AS string), cast(l.l_linenumber AS string), cast(l.l_partkey AS string),
                         cast(l.l_suppkey AS string), cast(cast(l.l_quantity AS int) AS string)) AS place_id,
               l.l_linenumber AS line_no, n.n_name AS canonical_name,
               CASE n.n_nationkey % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'region' WHEN 2 THEN 'unknown' ELSE 'country' END AS place_kind,
               CASE n.n_nationkey % 6 WHEN 5 THEN NULL ELSE cast((n.n_nationkey * 7) % 120 - 60 AS double) END AS lat,
               CASE n.n_nationkey % 6 WHEN 5 THEN NULL ELSE cast((n.n_nationkey * 13) % 300 - 150 AS double) END AS lon
        FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN {nation} n ON n.n_nationkey = s.s_nationkey""",
    "clu": "SELECT o_orderkey AS episode_id, cast(substr(o_orderpriority, 1, 1) AS bigint) AS cluster_id FROM {orders}",
    "multi": """
        SELECT DISTINCT l.l_orderkey AS episode_id, cast(s.s_nationkey AS bigint) AS cluster_id
        FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey""",
    "cep": """
        SELECT o.o_orderkey AS episode_id, c.c_mktsegment AS podcast_id, o.o_orderdate AS pub_date,
               concat('Order ', cast(o.o_orderkey AS string), ' ', c.c_name) AS title,
               concat('Status ', o.o_orderstatus) AS description,
               CASE o.o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'special' ELSE 'regular' END AS kind,
               CASE WHEN o.o_custkey % 3 = 0 THEN 'Richard' WHEN o.o_custkey % 3 = 1 THEN 'Daniel' END AS narrator
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey""",
    # flat episodes with signed years
    "fac_k": "SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM {events}",
    "fac": """
        SELECT event_id, concat('p', cast(user_id % 7 AS string)) AS podcast_id, concat('ev-', cast(event_id AS string)) AS guid,
               concat(event_type, ' by User', cast(user_id AS string)) AS title, ts AS published_at,
               concat('Value_', cast(k AS string), '% of ', event_type) AS description,
               CASE event_type WHEN 'error' THEN NULL ELSE event_type END AS incident_type,
               CASE WHEN k % 10 = 0 THEN 'range' ELSE 'point' END AS primary_time_kind,
               CASE WHEN k % 10 <> 0 THEN k * 41 - 2003 END AS primary_time_year,
               CASE WHEN k % 20 = 0 THEN k * 41 - 2010 END AS primary_time_start_year,
               CASE WHEN k % 20 = 0 THEN k * 41 - 1990 END AS primary_time_end_year,
               CASE WHEN user_id % 9 = 0 THEN NULL ELSE concat('L', cast(user_id % 50 AS string)) END AS name,
               CASE WHEN user_id % 9 = 0 THEN NULL ELSE concat('C', cast(user_id % 5 AS string)) END AS country,
               CASE WHEN user_id % 9 = 0 THEN NULL ELSE cast(user_id % 50 AS double) * 1.5 - 30 END AS lat,
               CASE WHEN user_id % 9 = 0 THEN NULL ELSE cast(user_id % 50 AS double) * 2.5 - 60 END AS lon
        FROM {fac_k}""",
    # change log over customers
    "op": """
        SELECT event_id AS seq, concat('op', cast(event_id AS string)) AS op_id,
               CASE WHEN event_id % 97 = 0 THEN 'merge' WHEN event_type = 'click' THEN 'update' WHEN event_type = 'view' THEN 'link'
                    WHEN event_type = 'purchase' THEN 'insert' WHEN event_type = 'signup' THEN 'delete' ELSE 'unlink' END AS op_type,
               CASE WHEN event_type IN ('view', 'error') THEN 'relation' WHEN event_id % 11 = 0 THEN 'keyword' ELSE 'episode' END AS entity_type,
               cast(user_id + (CASE WHEN event_type = 'purchase' THEN 100 ELSE 0 END) AS string) AS entity_id,
               concat('T', cast(k AS string)) AS p_title,
               CASE WHEN k % 3 = 0 THEN cast(k AS string) END AS p_score,
               cast(user_id AS string) AS left_id, cast(k % 5 AS string) AS right_id,
               CASE WHEN event_id % 5 = 0 THEN 'cancelled' ELSE 'queued' END AS status
        FROM {fac_k}""",
    "cust": "SELECT c_custkey AS id, c_name AS title, c_mktsegment AS kind, cast(c_nationkey AS bigint) AS score FROM {customer}",
    "rel": "SELECT c_custkey AS episode_id, cast(c_nationkey % 5 AS bigint) AS cluster_id FROM {customer}",
}


def _deps(body: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", body)))


VIEWS = {name: (_deps(body), body) for name, body in _SQL.items()}


def oracle(sql: str) -> str:
    """Stand-alone DuckDB statement: the views ``sql`` names in braces become leading CTEs."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for dep in VIEWS[name][0]:
                need(dep)
            ordered.append(name)

    for name in re.findall(r"\{([a-z]\w*)\}", sql):
        need(name)
    plain = {n: re.sub(r"\{([a-z]\w*)\}", r"\1", VIEWS[n][1]) for n in ordered}
    ctes = [f"{n} AS ({body})" for n, body in plain.items()]
    body = re.sub(r"\{([a-z]\w*)\}", r"\1", sql).strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        recursive = rest[:10].upper() == "RECURSIVE "
        head = "WITH RECURSIVE " if recursive else "WITH "
        rest = rest[10:] if recursive else rest
        return head + ", ".join([*ctes, rest]) if ctes else body
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body
