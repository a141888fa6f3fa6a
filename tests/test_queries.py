"""Every named query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tallyspark.queries import ORACLE_SQL, QUERIES, flagship

DATA = Path("/root/testdata/sf0.001")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, str(DATA))
    told = duck.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(told.columns)
    kinds = dict(zip(told.columns, map(str, told.types), strict=True))
    assert all(KINDS.get(k, kinds[c]) == kinds[c] for c, k in found.dtypes)
    at = [told.columns.index(c) for c in columns]
    rows = sorted([tuple(map(plain, r)) for r in found.select(*columns).collect()])
    assert rows == sorted([tuple(plain(r[i]) for i in at) for r in told.fetchall()])
    assert rows


def test_flagship_is_sorted_and_sums(spark):
    rows = flagship(spark, str(DATA)).collect()
    assert rows[0]["priority"] is None
    assert sum(r["n"] for r in rows if r["priority"] is None) == sum(r["n"] for r in rows if r["priority"]) == 1500


def test_page_titles_are_decoded_in_sql_too(spark, tmp_path):
    """Entities of all kinds, tags and spaces in titles, and a title that isn't said again outside of a comment."""
    titles = ["a &quot;b&quot; &amp;amp; c", "caf&eacute;&nbsp;&#8217;&#x1F389; &#0; &nosuch; &copy", " x <b>y</b>\n z ", "", "A<!-- b --> &lt;i&gt;", "&apos;&#xD800;&#99999999;"]
    rows = [(i, f'<html><title class="t">{x}</title><p>k</p><script>var a="<p>";</script>&mdash;</html>') for i, x in enumerate(titles)] + [(50, None), (51, "<p>no title</p>"), (52, "<!-- <title>gone</title> -->")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r["page_id"]: (r["has_ad"], r["paragraphs"], r["quoted"]) for r in QUERIES["page_quotes"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    told = {r[0]: r[1:] for r in c.sql(ORACLE_SQL["page_quotes"]).select("page_id", "has_ad", "paragraphs", "quoted").fetchall()}
    assert found == told
    assert found[0][2] == 'a "b" &amp; c'
    assert found[1][2] == "café ’🎉 &#0; &nosuch; &copy"
    assert found[52][2] is None
