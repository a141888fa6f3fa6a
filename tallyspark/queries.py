"""Named queries over the driver tables, built from the operators, each with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.functions import dates, numbers, text
from tallyspark.operators import aggregates, gates, joins, nested, windows
from tallyspark.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A small dimension of tenures (closed spans, the last one open), as rows of SQL that both engines read.
TENURES = """(VALUES ('Adams', DATE '1995-01-01', DATE '1996-06-30'), ('Baker', DATE '1996-07-01', DATE '1998-12-31'),
 ('Clark', DATE '1999-01-01', DATE '2000-03-14'), ('Adams', DATE '2000-03-15', NULL)) AS tenures(holder, since, until)"""


def tenures(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {TENURES}")


def price_band(price):
    return numbers.band_of(price, [50_000, 100_000, 200_000, 300_000])


@query("""
WITH b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS priority,
  CASE WHEN o_totalprice >= 300000 THEN 4 WHEN o_totalprice >= 200000 THEN 3 WHEN o_totalprice >= 100000 THEN 2 WHEN o_totalprice >= 50000 THEN 1 ELSE 0 END AS band FROM orders)
SELECT year, priority, count(*) AS n, count(*) FILTER (band = 0) AS d0, count(*) FILTER (band = 1) AS d1, count(*) FILTER (band = 2) AS d2,
  count(*) FILTER (band = 3) AS d3, count(*) FILTER (band = 4) AS d4 FROM b GROUP BY GROUPING SETS ((year), (year, priority))""")
def band_counts_with_all(spark, d):
    orders = t(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    counts = aggregates.band_counts(orders, ["year", "priority"], price_band(F.col("o_totalprice")), 5)
    return aggregates.with_all_row(counts, ["year"], "priority", ["n", *(f"d{b}" for b in range(5))])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band counts of each year and priority with an All row, once keys and sums have passed their gates."""
    out = band_counts_with_all(spark, sf_dir)
    gates.require(gates.unique(out, ["year", "priority"]), gates.valid(out, "bands add up", F.expr("n = d0 + d1 + d2 + d3 + d4")))
    return out.orderBy("year", F.col("priority").asc_nulls_first())


@query("""
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_discount * l_extendedprice) / sum(l_extendedprice) AS rate, count(*) AS n
FROM lineitem GROUP BY 1""")
def ratio_of_sums(spark, d):
    ratio, n = aggregates.ratio_of_sums(F.col("l_discount") * F.col("l_extendedprice"), F.col("l_extendedprice"))
    return t(spark, d, "lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month")).agg(ratio.alias("rate"), n.alias("n"))


@query("""
WITH s AS (SELECT l_returnflag, sum(l_quantity) FILTER (l_shipdate >= '1999-01-01' AND l_shipdate < '2000-01-01') AS before,
  count(*) FILTER (l_shipdate >= '1999-01-01' AND l_shipdate < '2000-01-01') AS n_before,
  sum(l_quantity) FILTER (l_shipdate >= '2000-01-01' AND l_shipdate < '2001-01-01') AS after,
  count(*) FILTER (l_shipdate >= '2000-01-01' AND l_shipdate < '2001-01-01') AS n_after FROM lineitem GROUP BY 1)
SELECT l_returnflag, before, n_before, after, n_after, CASE WHEN n_before >= 12 AND n_after >= 12 AND before > 0 THEN 100 * (after - before) / before END AS change FROM s""")
def window_change(spark, d):
    return aggregates.window_change(t(spark, d, "lineitem"), ["l_returnflag"], "l_shipdate", "l_quantity", ("1999-01-01", "2000-01-01"), ("2000-01-01", "2001-01-01"), 12)


@query("SELECT c_mktsegment, median(c_acctbal) AS median, avg(c_acctbal) AS mean, count(c_acctbal) AS n FROM customer GROUP BY 1")
def median_stats(spark, d):
    return aggregates.median_stats(t(spark, d, "customer"), ["c_mktsegment"], "c_acctbal")


@query("""
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS p
  FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE p = 1""")
def mode_with_ties(spark, d):
    return aggregates.most_common(t(spark, d, "events"), ["user_id"], "event_type")


@query("""
WITH top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 6)
SELECT p_type, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'Other' END AS p_brand, count(*) AS n FROM part GROUP BY 1, 2""")
def top_and_other(spark, d):
    return aggregates.top_and_other(t(spark, d, "part"), "p_brand", 6).groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS length, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM r GROUP BY 1, 2, 3""")
def event_runs(spark, d):
    found = windows.runs(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", by_range=True)
    return found.select("user_id", "run", "event_type", "length", F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"))


MONTHLY = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"


def monthly(spark, d) -> DataFrame:
    return t(spark, d, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""
WITH m AS ({MONTHLY}) SELECT m.month, m.total, p.total AS year_before, m.total / p.total - 1 AS change
FROM m LEFT JOIN m p ON p.month + INTERVAL 1 YEAR = m.month""")
def calendar_lookback(spark, d):
    m = monthly(spark, d)
    return joins.months_before(m, [], "month", "total", 12, "year_before").withColumn("change", F.col("total") / F.col("year_before") - 1)


@query("""
WITH y AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS total, year(o_orderdate) = 2001 AS part_year, 'orders' AS basis
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT y.nation, y.year, y.total, CASE WHEN NOT y.part_year AND NOT p.part_year AND p.total > 0 THEN y.total / p.total - 1 END AS change
FROM y LEFT JOIN y p ON p.nation = y.nation AND p.year = y.year - 1""")
def guarded_change(spark, d):
    orders = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    yearly = orders.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    yearly = yearly.withColumns({"part_year": F.col("year") == 2001, "basis": F.lit("orders")})
    return windows.like_for_like(yearly, ["nation"], "year", "total", "part_year", "basis").select("nation", "year", "total", "change")


SPEND = "SELECT c_nationkey, c_custkey, round(sum(o_totalprice), 2) AS spend FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"


@query(f"SELECT c_nationkey, c_custkey, spend, CAST(p AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY spend DESC, c_custkey) AS p FROM ({SPEND})) WHERE p <= 3")
def top_customers(spark, d):
    spend = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spend"))
    return windows.top_k(spend, ["c_nationkey"], 3, F.desc("spend"), F.asc("c_custkey"))


@query(f"""
SELECT holder, since, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN {TENURES}
ON CAST(o_orderdate AS DATE) >= since AND (until IS NULL OR CAST(o_orderdate AS DATE) <= until) GROUP BY 1, 2""")
def interval_join(spark, d):
    orders = t(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return joins.interval_join(orders, tenures(spark), "day", "since", "until", closed=True).groupBy("holder", "since").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""
WITH y AS (SELECT CAST(y AS INTEGER) AS fiscal, make_date(CAST(y - 1 AS BIGINT), 10, 1) AS a, make_date(CAST(y AS BIGINT), 9, 30) AS b FROM (SELECT DISTINCT year(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH) AS y FROM orders)),
o AS (SELECT fiscal, holder, sum(date_diff('day', greatest(a, since), least(b, coalesce(until, DATE '2001-12-31'))) + 1) AS days
  FROM y JOIN {TENURES} ON a <= coalesce(until, DATE '2001-12-31') AND since <= b GROUP BY 1, 2)
SELECT fiscal, holder, CAST(days AS BIGINT) AS days, share FROM (SELECT *, CAST(days AS DOUBLE) / sum(days) OVER (PARTITION BY fiscal) AS share,
  row_number() OVER (PARTITION BY fiscal ORDER BY days DESC, holder) AS p FROM o) WHERE p = 1""")
def most_days(spark, d):
    years = t(spark, d, "orders").select(dates.fiscal_year(F.col("o_orderdate").cast("date")).alias("fiscal")).distinct()
    a, b = dates.fiscal_bounds(F.col("fiscal"))
    spans = tenures(spark).withColumn("until", F.coalesce("until", F.lit("2001-12-31").cast("date")))
    return joins.most_days(years.withColumns({"a": a, "b": b}), spans, "fiscal", "holder", ("a", "b"), ("since", "until"))


@query("""
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, p.user_id, CASE WHEN epoch(p.ts) - epoch(v.ts) <= 86400 THEN v.event_id END AS view_id
FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def as_of_view(spark, d):
    events = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bought, seen = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), events.filter("event_type = 'view' AND user_id IS NOT NULL").select("user_id", "ts", F.col("event_id").alias("view_id"))
    found = joins.as_of(bought, seen, ["user_id"], "ts", "ts", ["view_id"], "view_id", 86_400, by_range=True)
    return found.select("event_id", "user_id", F.col("matched_view_id").alias("view_id"))


@query("""
WITH c AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1)
SELECT coalesce(c.nation, s.nation) AS nation, 'n' AS field, CAST(c.n AS VARCHAR) AS left_value, CAST(s.n AS VARCHAR) AS right_value
FROM c FULL JOIN s ON c.nation = s.nation WHERE c.n IS DISTINCT FROM s.n""")
def full_outer_compare(spark, d):
    left = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    right = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return joins.differences(left, right, ["nation"], ["n"])


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").join(orders, "c_custkey", "left_semi")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang", "source").join(t(spark, d, "labels"), "doc_id", "left_anti")


@query("""
WITH p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), u AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 4 = 0)
SELECT 'left' AS only_in, k FROM (SELECT k FROM p EXCEPT SELECT k FROM u) UNION ALL SELECT 'right', k FROM (SELECT k FROM u EXCEPT SELECT k FROM p)""")
def keys_missing_both_ways(spark, d):
    side = lambda condition: t(spark, d, "orders").filter(condition).select(F.col("o_custkey").alias("k"))
    return joins.both_ways_missing(side("o_orderstatus = 'P'"), side("o_orderkey % 4 = 0"), ["k"])


@query("""
SELECT c.c_custkey, coalesce(o.n, 0) AS n, coalesce(o.total, 0.0) AS total FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def left_with_defaults(spark, d):
    spend = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return joins.left_with_defaults(t(spark, d, "customer").select("c_custkey"), spend, ["c_custkey"], {"n": 0, "total": 0.0})


KEY = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""
WITH d AS (SELECT doc_id, text, {KEY} AS k FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS item_id, text, {KEY} AS k FROM documents WHERE doc_id % 2 = 1),
x AS (SELECT doc_id, min(item_id) AS item_id FROM d JOIN b USING (text) GROUP BY 1 HAVING count(DISTINCT item_id) = 1),
y AS (SELECT doc_id, min(item_id) AS item_id FROM d JOIN b USING (k) WHERE doc_id NOT IN (SELECT doc_id FROM x) GROUP BY 1 HAVING count(DISTINCT item_id) = 1)
SELECT doc_id, item_id, 'text' AS via FROM x UNION ALL SELECT doc_id, item_id, 'key' FROM y""")
def cascading_match(spark, d):
    """Documents of even number with their copies of odd number: by the text, then by its letters."""
    rows = t(spark, d, "documents").select("doc_id", "text", F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("k"))
    docs, items = rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "item_id")
    return joins.cascade(docs, items, "doc_id", "item_id", [("text", lambda a, b: a.join(b, "text")), ("key", lambda a, b: a.join(b.drop("text"), "k"))])


@query("""
WITH p AS (SELECT n_nationkey AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)::DOUBLE AS x, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)::DOUBLE AS y FROM nation)
SELECT nation, neighbour, distance, CAST(p AS INTEGER) AS rank FROM (SELECT a.nation, b.nation AS neighbour, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS distance,
  row_number() OVER (PARTITION BY a.nation ORDER BY distance, b.nation) AS p FROM p a JOIN p b ON a.nation <> b.nation) WHERE p <= 5""")
def nearest_nations(spark, d):
    count = lambda name, key, out: t(spark, d, name).groupBy(F.col(key).alias("nation")).agg(F.count("*").cast("double").alias(out))
    nations = t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    points = nations.join(count("customer", "c_nationkey", "x"), "nation", "left").join(count("supplier", "s_nationkey", "y"), "nation", "left").fillna(0.0, ["x", "y"])
    return joins.nearest_points(points, points, "nation", ["x", "y"], 5)


@query("""
SELECT c_nationkey, c_custkey, peer, distance, CAST(p AS INTEGER) AS rank FROM (SELECT a.c_nationkey, a.c_custkey, b.c_custkey AS peer, abs(a.c_acctbal - b.c_acctbal) AS distance,
  row_number() OVER (PARTITION BY a.c_custkey ORDER BY distance, b.c_custkey) AS p FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey) WHERE p <= 4""")
def nearest_peers(spark, d):
    return joins.nearest_peers(t(spark, d, "customer"), ["c_nationkey"], "c_custkey", "c_acctbal", 4)


@query("""
SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
UNPIVOT (value FOR name IN (l_quantity, l_discount, l_tax))""")
def melt(spark, d):
    return nested.melted(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 * 10 AS decade, count(*) AS n FROM events GROUP BY 1, 2")
def json_decades(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, d, "events").groupBy("event_type", (F.floor(k / 10) * 10).alias("decade")).agg(F.count("*").alias("n"))


@query("""
SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""")
def page_titles(spark, d):
    return t(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS name_key, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def name_keys(spark, d):
    return t(spark, d, "documents").select("doc_id", text.letters_key(F.col("text")).alias("name_key"), text.slug(F.col("text")).alias("slug"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def gate_unique(spark, d):
    found = gates.unique(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    return found.select(F.from_json("detail", "l_orderkey bigint, l_linenumber int, count bigint").alias("x")).select("x.*")


@query("SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')")
def gate_references(spark, d):
    regions = t(spark, d, "region").filter("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    return gates.references(t(spark, d, "nation"), regions, ["n_regionkey"]).select(F.get_json_object("detail", "$.n_regionkey").cast("int").alias("n_regionkey"))


@query(f"""
WITH m AS (SELECT CAST(year(month) AS INTEGER) AS year, sum(total) AS s FROM ({MONTHLY}) GROUP BY 1),
o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) * (1 + year % 2) AS w FROM orders GROUP BY 1)
SELECT year FROM m FULL JOIN o USING (year) WHERE coalesce(abs(s - w) > 1e-6 * abs(w), true)""")
def gate_sums(spark, d):
    parts = monthly(spark, d).withColumn("year", F.year("month"))
    totals = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("w")).select("year", (F.col("w") * (1 + F.col("year") % 2)).alias("whole"))
    return gates.sums_match(parts, totals, ["year"], "total", "whole", 1e-6).select(F.get_json_object("detail", "$.year").cast("int").alias("year"))


@query("""
WITH p AS (SELECT o_orderpriority AS p, o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), s AS (SELECT p, min(k) AS a, max(k) AS b FROM p GROUP BY 1)
SELECT p AS priority, n AS missing FROM s, LATERAL (SELECT unnest(range(a, b + 1)) AS n) WHERE (p, n) NOT IN (SELECT (p, k) FROM p)""")
def gate_contiguous(spark, d):
    rows = t(spark, d, "orders").filter("o_orderstatus = 'P'")
    return gates.contiguous(rows, "o_custkey", ["o_orderpriority"], 64).select(F.get_json_object("detail", "$.o_orderpriority").alias("priority"), F.get_json_object("detail", "$.n").cast("long").alias("missing"))


@query("""
WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_operations(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct()
    b = t(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    named = lambda name, df: df.select(F.lit(name).alias("op"), "k")
    return named("union", a.union(b).distinct()).unionByName(named("intersect", a.intersect(b))).unionByName(named("except", a.exceptAll(b)))


@query("""
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2),
s AS (SELECT o_custkey, min(year) AS first_year, max(year) AS last_year, arg_min(total, year) AS first, arg_max(total, year) AS last FROM y GROUP BY 1)
SELECT *, last - first AS change, CASE WHEN last_year > first_year THEN (last - first) / (last_year - first_year) END AS a_year FROM s""")
def first_and_latest(spark, d):
    yearly = t(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return windows.first_and_latest(yearly, ["o_custkey"], "year", "total")


@query("""
WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(m AS DATE) AS month, coalesce(n, 0) AS n FROM generate_series((SELECT min(month) FROM c), (SELECT max(month) FROM c), INTERVAL 1 MONTH) s(m) LEFT JOIN c ON c.month = CAST(m AS DATE)""")
def dense_months(spark, d):
    return aggregates.dense_months(t(spark, d, "orders"), "o_orderdate")


@query("""
WITH p AS (SELECT p_brand, p_size, count(*) AS stopped FROM part GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT DISTINCT p_brand FROM part) CROSS JOIN (SELECT CAST(s AS INTEGER) AS p_size FROM range(0, 51) r(s))),
f AS (SELECT g.p_brand, g.p_size, coalesce(stopped, 0) AS stopped FROM g LEFT JOIN p ON p.p_brand = g.p_brand AND p.p_size = g.p_size)
SELECT *, CAST(sum(stopped) OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS reached FROM f""")
def stage_reach(spark, d):
    return aggregates.stage_counts(t(spark, d, "part"), ["p_brand"], "p_size", 50)


@query("""
SELECT c_custkey, CAST(c_acctbal * 10 AS DOUBLE) AS x, floor(c_acctbal * 10 + 0.5) / 10 AS one_place, CASE WHEN c_acctbal > 0 THEN 100 / c_acctbal END AS rate,
  asinh(c_acctbal / 100000) AS log_value, greatest(-500.0, least(500.0, c_acctbal)) AS clamped FROM customer""")
def number_rules(spark, d):
    x = F.col("c_acctbal")
    return t(spark, d, "customer").select("c_custkey", (x * 10).alias("x"), numbers.half_up(x, 1).alias("one_place"), numbers.rate(F.lit(100.0), x).alias("rate"), numbers.signed_log(x).alias("log_value"), numbers.clamp(x, -500.0, 500.0).alias("clamped"))


@query("""
SELECT o_orderkey, CAST(year(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH) AS INTEGER) AS fiscal, CAST((year(o_orderdate) - 1991) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month_index,
  CAST(last_day(o_orderdate) AS DATE) AS month_end, CAST(year(o_orderdate) - 1964 - CASE WHEN strftime(o_orderdate, '%m%d') < '0229' THEN 1 ELSE 0 END AS INTEGER) AS age,
  CAST((year(o_orderdate) - 1787) // 2 - CASE WHEN CAST(o_orderdate AS DATE) < make_date(CAST((year(o_orderdate) - 1787) // 2 * 2 + 1787 AS BIGINT), 1, 3) THEN 1 ELSE 0 END AS INTEGER) AS session FROM orders""")
def date_rules(spark, d):
    day = F.col("o_orderdate").cast("date")
    return t(spark, d, "orders").select(
        "o_orderkey", dates.fiscal_year(day).alias("fiscal"), dates.month_index(day, 1991).cast("int").alias("month_index"), F.last_day(day).alias("month_end"), dates.age(F.lit("1964-02-29").cast("date"), day).alias("age"), dates.session_of(day).cast("int").alias("session")
    )


@query("""
WITH y AS (SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, year, n, CAST(sum(n) OVER (PARTITION BY year ORDER BY l_returnflag) AS BIGINT) AS upper, CAST(sum(n) OVER (PARTITION BY year ORDER BY l_returnflag) - n AS BIGINT) AS lower FROM y""")
def stack_edges(spark, d):
    counts = t(spark, d, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    return windows.stack_edges(counts, ["year"], "l_returnflag", "n")


@query("""
SELECT o_custkey, year, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY year) AS BIGINT) AS served FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)""")
def periods_served(spark, d):
    return aggregates.periods_served(t(spark, d, "orders").withColumn("year", F.year("o_orderdate")), "o_custkey", "year")


@query("""
WITH y AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders), i AS (SELECT *, year - row_number() OVER (PARTITION BY o_custkey ORDER BY year) AS i FROM y)
SELECT o_custkey, min(year) AS first, max(year) AS last FROM i GROUP BY o_custkey, i""")
def year_runs(spark, d):
    return windows.year_runs(t(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year")).distinct(), ["o_custkey"], "year")


@query("""
SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS gap, avg(c_acctbal) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_custkey) AS p
  FROM (SELECT c_nationkey, c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3)) WHERE p <= 2 GROUP BY 1 HAVING count(*) = 2""")
def pair_gap(spark, d):
    rows = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_custkey", "c_acctbal").agg(F.count("*").alias("n"))
    return aggregates.pair_gap(rows, "c_nationkey", "c_custkey", "c_acctbal", "n")


@query("""
SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2""")
def hourly_windows(spark, d):
    return streams.windowed_counts(t(spark, d, "events"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 6 HOUR AS TIMESTAMP) AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark, d):
    return streams.sessions(t(spark, d, "events"))


@query("""
SELECT l_shipdate AS day, l_returnflag, sum(l_quantity) AS quantity FROM (SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS l_shipdate, l_returnflag, l_quantity FROM lineitem) GROUP BY CUBE (l_shipdate, l_returnflag)""")
def cube_totals(spark, d):
    return t(spark, d, "lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "year").alias("day"), "l_returnflag", "l_quantity").cube("day", "l_returnflag").agg(F.sum("l_quantity").alias("quantity"))


@query("""
SELECT o_orderstatus, sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent, sum(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1""")
def measures_by_kind(spark, d):
    return aggregates.measures_by_kind(t(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority", "o_totalprice", {"1-URGENT": "urgent", "5-LOW": "low"})


@query("""
WITH m AS (SELECT DISTINCT c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS year, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey),
y AS (SELECT c_mktsegment, year, lag(year) OVER w AS before, lead(year) OVER w AS after FROM (SELECT DISTINCT c_mktsegment, year FROM m) WINDOW w AS (PARTITION BY c_mktsegment ORDER BY year))
SELECT c_mktsegment, year, c_custkey, 'joined' AS change FROM m JOIN y USING (c_mktsegment, year) WHERE before IS NOT NULL AND (c_mktsegment, before, c_custkey) NOT IN (SELECT (c_mktsegment, year, c_custkey) FROM m)
UNION ALL SELECT c_mktsegment, after, c_custkey, 'left' FROM m JOIN y USING (c_mktsegment, year) WHERE after IS NOT NULL AND (c_mktsegment, after, c_custkey) NOT IN (SELECT (c_mktsegment, year, c_custkey) FROM m)""")
def joined_and_left(spark, d):
    rows = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("o_orderdate"))
    return joins.joined_and_left(rows, "c_mktsegment", "year", "c_custkey")


@query(f"""
WITH m AS ({MONTHLY}), s AS (SELECT min(total) AS lo, max(total) AS hi FROM m)
SELECT month, (total - lo) / (hi - lo) AS scaled FROM m, s""")
def scaled_months(spark, d):
    m = monthly(spark, d).withColumn("all", F.lit(1))
    index = dates.month_index(F.col("month"), 1990)
    return windows.scaled_segments(m.withColumn("i", index), ["all"], "i", "total").select("month", "scaled")


@query("""
SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, arg_min(c_custkey, (c_acctbal, c_custkey)) AS at_low, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS at_high FROM customer GROUP BY 1""")
def peak_and_low(spark, d):
    rows = t(spark, d, "customer")
    return aggregates.peak_and_low(rows, ["c_mktsegment"], "c_custkey", "c_acctbal").join(rows.groupBy("c_mktsegment").agg(F.count("*").alias("n")), "c_mktsegment").select("c_mktsegment", "n", "low", "high", "at_low", "at_high")


@query("""
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM orders""")
def ranked_shares(spark, d):
    rows = windows.ranked(t(spark, d, "orders"), ["o_custkey"], F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", "rank", (F.col("o_totalprice") / F.sum("o_totalprice").over(W.partitionBy("o_custkey"))).alias("share"))


@query("""
SELECT event_type, max(value) AS high, min(value) AS low, CAST(min(ts) FILTER (value = hi) AS DATE) AS at_high, CAST(min(ts) FILTER (value = lo) AS DATE) AS at_low
FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS hi, min(value) OVER (PARTITION BY event_type) AS lo FROM events) GROUP BY 1""")
def peak_by_date(spark, d):
    found = aggregates.peak_and_low(t(spark, d, "events"), ["event_type"], "ts", "value")
    return found.select("event_type", "high", "low", F.col("at_high").cast("date").alias("at_high"), F.col("at_low").cast("date").alias("at_low"))


from tallyspark import record_queries  # noqa: E402, F401  registers more queries
