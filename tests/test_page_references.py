"""Page queries against their statements on references cut off before the semicolon."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows_of

TEXTS = ["token = &quot", "a &ampb &amp", "&copy 2020 &lt &gt;", "&middot x &middot;", "&quo &am &amp;quot &amp;quot;"]
PAGES = [
    (i, f"https://h.example/{i}", f"<html><h1>T{i} {t}</h1><article><p>{t}<b>x</b> {t}</p></article></html>")
    for i, t in enumerate(TEXTS * 6)
]


@pytest.mark.parametrize("name", ["strip_tags", "sanitize_html", "html_to_text", "page_fields"])
def test_unclosed_references_as_in_the_statement(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want
