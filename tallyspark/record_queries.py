"""More named queries, one or a few operators each, over the driver tables, with the DuckDB SQL that says the same."""

from __future__ import annotations

import html.entities

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import dates, numbers, rules, text
from tallyspark.operators import aggregates, documents, filters, gates, joins, nested, places, rosters, similar, unions, windows
from tallyspark.plans import lineage
from tallyspark.plans.lineage import checkpointed
from tallyspark.queries import TENURES, query, t, tenures
from tallyspark.sources import grids, sinks

DAY = "CAST(o_orderdate AS DATE)"


def day() -> F.Column:
    return F.col("o_orderdate").cast("date")


def cents(column: str) -> F.Column:
    """Money as whole cents, so that sums do not depend on their order."""
    return F.round(F.col(column) * 100).cast("long")


def details(violations: DataFrame, **fields: str) -> DataFrame:
    """The details of a gate's violations as columns (name=type)."""
    return violations.select(*(F.get_json_object("detail", f"$.{name}").cast(kind).alias(name) for name, kind in fields.items()))


# Filters


@query("""
SELECT p_partkey, p_size % 4 <> 0 AND NOT p_retailprice > 1000 AND 1980 + p_size BETWEEN 1985 AND 2020 AS usable,
  p_brand IN ('Brand#1', 'Brand#2') AND p_type = 'PROMO' AS shown,
  contains(lower(p_name || ' ' || p_type), 'cold') AND contains(lower(p_name || ' ' || p_type), 'promo') AS found, 1980 + p_size BETWEEN 1990 AND 2010 AS in_years FROM part""")
def filter_rules(spark, d):
    year = F.col("p_size") + 1980
    confidence = F.when(F.col("p_size") % 4 == 0, "low").otherwise("high")
    shown = filters.facets({"brand": F.col("p_brand").isin("Brand#1", "Brand#2"), "type": F.col("p_type") == "PROMO"})
    return t(spark, d, "part").select(
        "p_partkey", filters.usable(confidence, F.col("p_retailprice") > 1000, year, 1985, 2020).alias("usable"), shown.alias("shown"),
        text.has_all_words("PROMO cold", F.col("p_name"), F.col("p_type")).alias("found"), filters.clamped_years(year, 1970, 2010, F.lit(1990), F.lit(2030)).alias("in_years"),
    )


@query("""
SELECT 'brand' AS facet, p_brand AS value, count(*) FILTER (p_type = 'PROMO') AS n FROM part GROUP BY 2 HAVING n > 0
UNION ALL SELECT 'type', p_type, count(*) FILTER (p_brand IN ('Brand#1', 'Brand#2')) AS n FROM part GROUP BY 2 HAVING n > 0""")
def facet_counts(spark, d):
    return filters.facet_counts(t(spark, d, "part"), {"brand": "p_brand", "type": "p_type"}, {"brand": F.col("p_brand").isin("Brand#1", "Brand#2"), "type": F.col("p_type") == "PROMO"})


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS kept, count(*) FILTER (NOT o_orderstatus = 'F') AS left_out FROM orders")
def scope_report(spark, d):
    return filters.in_scope(t(spark, d, "orders"), F.col("o_orderstatus") == "F")[1]


@query("""
SELECT n_nationkey, i AS session, NOT n_name IN ('NATION_3', 'NATION_4') AND NOT (n_name = 'NATION_5' AND i = 7) AND NOT (n_name = 'NATION_6' AND i < 12) AS votes
FROM nation, (SELECT CAST(x AS INTEGER) AS i FROM range(1, 21) r(x))""")
def voting_seats(spark, d):
    seats = t(spark, d, "nation").withColumn("session", F.explode(F.sequence(F.lit(1), F.lit(20))))
    return seats.select("n_nationkey", "session", filters.has_vote(F.col("n_name"), F.col("session"), ["NATION_3", "NATION_4"], [("NATION_5", 7)], {"NATION_6": 12}).alias("votes"))


@query("""
SELECT c_custkey, c_acctbal AS x, count(*) / 4.0 AS y, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10""")
def plottable_customers(spark, d):
    rows = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", F.col("c_acctbal").alias("x")).agg(F.count("*").alias("n"))
    return filters.plottable(rows.withColumn("y", F.col("n") / 4.0), "x", "y", "n").select("c_custkey", "x", "y", "n")


@query("""
SELECT o_custkey, o_orderpriority AS title, short FROM orders JOIN (VALUES ('1-URGENT', 'U'), ('5-LOW', 'L')) AS v(title, short) ON title = o_orderpriority WHERE o_orderstatus = 'O'""")
def roles_held(spark, d):
    role = F.struct(F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") != "O", day()).alias("end"))
    roles = t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(role).alias("roles"))
    return filters.held_today(roles, ["o_custkey"], "roles", spark.sql("SELECT * FROM (VALUES ('1-URGENT', 'U'), ('5-LOW', 'L')) AS v(title, short)"))


@query("""
SELECT user_id, CAST(ts AS DATE) AS date, event_type AS type, CAST(event_id % 3 AS VARCHAR) AS src, props AS text, min(event_id) AS place
FROM events WHERE event_type = 'error' OR regexp_matches(props, '"k": 7') GROUP BY ALL""")
def kept_actions(spark, d):
    rows = t(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("date"), F.col("event_type").alias("type"), (F.col("event_id") % 3).cast("string").alias("src"), F.col("props").alias("text"), F.col("event_id").alias("place"))
    return nested.kept_actions(rows, ["user_id"], ["error"], '"k": 7')


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'bolt') ORDER BY p_retailprice, p_partkey LIMIT 25")
def member_search(spark, d):
    return filters.find(t(spark, d, "part"), "BOLT", ["p_name", "p_type"], ["p_retailprice", "p_partkey"], 25).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false)")
def area_other(spark, d):
    return filters.of_area(t(spark, d, "customer"), "c_mktsegment", "OTHER", ["BUILDING", "MACHINERY"]).select("c_custkey")


@query("""
SELECT 'all' AS kind, count(*) FILTER (l_returnflag IN ('A', 'N')) AS n FROM lineitem UNION ALL SELECT 'majority', count(*) FILTER (l_returnflag = 'A') FROM lineitem
UNION ALL SELECT 'dissent', count(*) FILTER (l_returnflag = 'N') FROM lineitem UNION ALL SELECT 'wrote', count(*) FILTER (l_returnflag IN ('A', 'N') AND l_linenumber >= 2) FROM lineitem""")
def votes_by_filter(spark, d):
    rows = _votes(spark, d)
    kinds = ("all", "majority", "dissent", "wrote")
    counts = rows.agg(*(F.count_if(filters.votes_of(k, F.col("role.side"), F.col("role.wrote"))).alias(k) for k in kinds))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds))))


def _votes(spark, d) -> DataFrame:
    majority = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 1)
    return t(spark, d, "lineitem").withColumn("role", nested.vote_role(majority, F.col("l_linenumber")))


@query("""
SELECT l_suppkey, count(*) FILTER (l_returnflag IN ('A', 'N')) AS took, count(*) FILTER (l_returnflag = 'A') AS majority, count(*) FILTER (l_returnflag = 'N') AS dissent,
  count(*) FILTER (l_returnflag IN ('A', 'N') AND l_quantity >= 45) AS close, count(*) FILTER (l_returnflag = 'A' AND l_quantity >= 45) AS close_majority,
  count(*) FILTER (l_returnflag = 'A') / nullif(count(*) FILTER (l_returnflag IN ('A', 'N')), 0) AS share FROM lineitem GROUP BY 1""")
def vote_statistics(spark, d):
    return aggregates.vote_stats(_votes(spark, d).withColumn("side", F.col("role.side")), ["l_suppkey"], "side", F.col("l_quantity") >= 45)


# Joins


@query("""
SELECT 'matched' AS part, count(*) AS n FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'missed', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def matched_and_missed(spark, d):
    matched, missed = joins.matched_and_missed(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), ["doc_id"])
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count("matched", matched).unionByName(count("missed", missed))


@query("""
SELECT lang AS reason, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1
UNION ALL SELECT 'right only', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def missed_by_reason(spark, d):
    return aggregates.missed_by_reason(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), ["doc_id"], F.col("lang"))


@query("SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_or_fail(spark, d):
    return joins.inner_or_fail(t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), t(spark, d, "customer"), ["c_custkey"]).select("o_orderkey", "c_nationkey")


@query("""
SELECT o_custkey, o_orderkey, place, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place FROM orders) JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'""")
def probe_order(spark, d):
    build = t(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return joins.in_probe_order(t(spark, d, "orders").select("o_custkey", "o_orderkey"), build, ["o_custkey"], ["o_custkey", "o_orderkey"])


@query("""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END END AS b FROM orders)
SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL THEN 'unmapped' WHEN a IS NULL THEN 'second' WHEN b IS NULL THEN 'first' WHEN a = b THEN 'agree' ELSE 'mismatch' END AS id_status,
  CASE WHEN a IS NULL OR b IS NULL OR a = b THEN coalesce(a, b) END AS resolved_id FROM x""")
def resolved_ids(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    second = F.when(key % 5 != 0, F.when(key % 11 == 0, cust + 1).otherwise(cust))
    return joins.resolve_ids(t(spark, d, "orders"), F.when(key % 7 != 0, cust), second).select("o_orderkey", "id_status", "resolved_id")


@query("""
WITH x AS (SELECT DISTINCT s_suppkey % 40 AS code, s_nationkey FROM supplier)
SELECT code, CASE WHEN count(*) = 1 THEN min(s_nationkey) END AS s_nationkey, count(*) > 1 AS conflict FROM x GROUP BY 1""")
def crosswalk(spark, d):
    rows = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_set(F.col("s_suppkey") % 40).alias("codes"))
    clean, several = joins.crosswalk(rows, "s_nationkey", "codes")
    return clean.select("code", "s_nationkey", F.lit(False).alias("conflict")).unionByName(several.select("code", F.lit(None).cast("int").alias("s_nationkey"), F.lit(True).alias("conflict")))


@query("""
SELECT 'one c_mktsegment for each c_nationkey' AS rule, CAST(c_nationkey AS VARCHAR) AS key, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 2 HAVING n > 1
UNION ALL SELECT 'one c_nationkey for each c_mktsegment', c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 2 HAVING n > 1""")
def one_to_one(spark, d):
    found = gates.one_to_one(t(spark, d, "customer"), "c_nationkey", "c_mktsegment")
    return found.select("rule", F.coalesce(F.get_json_object("detail", "$.c_nationkey"), F.get_json_object("detail", "$.c_mktsegment")).alias("key"), F.get_json_object("detail", "$.n").cast("long").alias("n"))


@query(f"""
WITH a AS (SELECT o_orderpriority, o_custkey, min({DAY}) AS s1, max({DAY}) AS e1 FROM orders GROUP BY 1, 2),
b AS (SELECT o_orderpriority, o_orderstatus, min({DAY}) + 100 AS s2, CASE WHEN o_orderstatus <> 'O' THEN max({DAY}) - 700 END AS e2 FROM orders GROUP BY 1, 2)
SELECT o_custkey, a.o_orderpriority AS o_orderpriority, o_orderstatus, CAST(date_diff('day', greatest(s1, s2), least(e1, e2)) + 1 AS INTEGER) AS days
FROM a JOIN b ON a.o_orderpriority = b.o_orderpriority AND (e2 IS NULL OR s1 <= e2) AND s2 <= e1""")
def overlapping_spans(spark, d):
    rows = t(spark, d, "orders")
    a = rows.groupBy("o_orderpriority", "o_custkey").agg(F.min(day()).alias("s1"), F.max(day()).alias("e1"))
    b = rows.groupBy("o_orderpriority", "o_orderstatus").agg(F.date_add(F.min(day()), 100).alias("s2"), F.when(F.col("o_orderstatus") != "O", F.date_sub(F.max(day()), 700)).alias("e2"))
    return joins.overlaps(a, b, ["o_orderpriority"], ("s1", "e1"), ("s2", "e2")).select("o_custkey", "o_orderpriority", "o_orderstatus", "days")


FISCAL = f"SELECT DISTINCT CAST(year({DAY} + INTERVAL 3 MONTH) AS INTEGER) AS y FROM orders"
SHARES = f"""
WITH y AS (SELECT y AS fiscal, make_date(CAST(y - 1 AS BIGINT), 10, 1) AS a, make_date(CAST(y AS BIGINT), 9, 30) AS b FROM ({FISCAL})),
o AS (SELECT fiscal, holder, CAST(sum(date_diff('day', greatest(a, since), least(b, until)) + 1) AS BIGINT) AS days, bool_or(until IS NULL OR until >= b) AS has_last_day
  FROM y JOIN {TENURES} ON (until IS NULL OR a <= until) AND since <= b GROUP BY 1, 2)"""


def fiscal_years(spark, d) -> DataFrame:
    """The fiscal years that orders fall into, with their bounds."""
    years = t(spark, d, "orders").select(dates.fiscal_year(day()).alias("fiscal")).distinct()
    a, b = dates.fiscal_bounds(F.col("fiscal"))
    return years.withColumns({"a": a, "b": b})


@query(SHARES + "SELECT *, days / sum(days) OVER (PARTITION BY fiscal) AS share, count(*) OVER (PARTITION BY fiscal) > 1 AS blended FROM o")
def day_shares(spark, d):
    return unions.day_shares(fiscal_years(spark, d), tenures(spark), "fiscal", "holder", ("a", "b"), ("since", "until"))


@query(SHARES + """SELECT fiscal, holder, days, share FROM (SELECT *, days / sum(days) OVER (PARTITION BY fiscal) AS share, row_number() OVER (PARTITION BY fiscal ORDER BY days DESC, holder) AS p FROM o) WHERE p = 1""")
def most_days_open(spark, d):
    return joins.most_days(fiscal_years(spark, d), tenures(spark), "fiscal", "holder", ("a", "b"), ("since", "until"))


@query(f"""
WITH s AS (SELECT o_custkey, o_orderkey, {DAY} AS a, CASE WHEN o_orderkey % 50 > 0 THEN {DAY} + CAST(o_orderkey % 90 AS INTEGER) END AS b FROM orders),
p AS (SELECT x.o_custkey, x.o_orderkey, y.o_orderkey AS peer, greatest(x.a, y.a) AS first, least(x.b, y.b) AS last, x.b FROM s x JOIN s y
  ON x.o_custkey = y.o_custkey AND x.o_orderkey <> y.o_orderkey AND (y.b IS NULL OR x.a <= y.b) AND (x.b IS NULL OR y.a <= x.b))
SELECT o_custkey, o_orderkey, peer, CAST(last - first + 1 AS BIGINT) AS shared, first, last, CAST(1 AS BIGINT) AS n_spans, last IS NOT DISTINCT FROM b AS ends_at_edge FROM p""")
def orders_open_together(spark, d):
    """Which orders of a customer are open on the same days, an order being open some days from its date, or for good."""
    until = F.when(F.col("o_orderkey") % 50 > 0, F.date_add(day(), (F.col("o_orderkey") % 90).cast("int")))
    rows = t(spark, d, "orders").select("o_custkey", "o_orderkey", day().alias("a"), until.alias("b"))
    return joins.shared_spans(rows, "o_orderkey", "a", "b", ["o_custkey"])


@query("""
WITH c AS (SELECT c_nationkey, c_mktsegment, c_custkey, c_acctbal, CAST(min(year(o_orderdate)) AS INTEGER) AS t0, CAST(max(year(o_orderdate)) AS INTEGER) AS t1 FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4),
p AS (SELECT a.c_nationkey, a.c_mktsegment, a.c_custkey, b.c_custkey AS peer, greatest(a.t0, b.t0) AS first, least(a.t1, b.t1) AS last, a.t1,
  row_number() OVER (PARTITION BY a.c_custkey ORDER BY abs(a.c_acctbal - b.c_acctbal), b.c_custkey) <= 4 AS is_neighbor
  FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey <> b.c_custkey)
SELECT c_nationkey, c_mktsegment, c_custkey, peer, CAST(last - first + 1 AS BIGINT) AS shared, first, last, CAST(1 AS BIGINT) AS n_spans, last = t1 AS ends_at_edge, is_neighbor FROM p WHERE first <= last""")
def peers_alongside(spark, d):
    """Customers of a nation and segment with orders in the same years, and which of them are nearest by balance."""
    both = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    years = both.groupBy("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal").agg(F.min(F.year("o_orderdate")).alias("t0"), F.max(F.year("o_orderdate")).alias("t1"))
    return joins.peers_alongside(years, ["c_nationkey", "c_mktsegment"], "c_custkey", "c_acctbal", "t0", "t1", 4)


HALF_OPEN = "(VALUES ('Early', DATE '1995-06-01', DATE '1997-01-01'), ('Middle', DATE '1997-01-01', DATE '1999-07-01'), ('Late', DATE '1999-07-01', DATE '2000-02-01')) AS h(name, since, until)"


@query(f"""
WITH x AS (SELECT {DAY} AS day, (SELECT name FROM {HALF_OPEN} WHERE {DAY} >= since AND {DAY} < until) AS name FROM orders)
SELECT coalesce(name, CASE WHEN day >= DATE '1999-07-01' THEN 'Late' END) AS name, count(*) AS n FROM x GROUP BY 1""")
def tenure_or_last(spark, d):
    rows = t(spark, d, "orders").select(day().alias("day"))
    return unions.tenure_or_last(rows, spark.sql(f"SELECT * FROM {HALF_OPEN}"), "day", "since", "until", "name").groupBy("name").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderpriority, holder, count(*) AS n FROM orders ASOF JOIN {TENURES} ON {DAY} >= since GROUP BY 1, 2")
def as_of_tenure(spark, d):
    rows = t(spark, d, "orders").select("o_orderpriority", day().alias("day"))
    each = tenures(spark).withColumn("o_orderpriority", F.explode(F.array(*(F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))))
    return joins.as_of_strict(rows, each, "day", "since", "until", "holder", "o_orderpriority").groupBy("o_orderpriority", "holder").agg(F.count("*").alias("n"))


@query(f"""
SELECT day, name FROM (SELECT DISTINCT make_date(CAST(year(o_orderdate) AS BIGINT), 1, 20) AS day FROM orders) JOIN {HALF_OPEN} ON day >= since AND day < until""")
def held_on_anchor_day(spark, d):
    anchors = t(spark, d, "orders").select(F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(20)).alias("day")).distinct()
    return joins.at_anchor(spark.sql(f"SELECT * FROM {HALF_OPEN}"), anchors, "since", "until", "day").select("day", "name")


@query(f"""
WITH s AS (SELECT o_custkey, min({DAY}) AS a, CASE WHEN o_custkey % 3 > 0 THEN max({DAY}) END AS b FROM orders GROUP BY 1)
SELECT o_custkey, CAST(y AS INTEGER) AS year FROM (SELECT o_custkey, unnest(range(year(a), least(coalesce(year(b - 1), 2000), 2000) + 1)) AS y FROM s)""")
def years_of_spans(spark, d):
    spans = t(spark, d, "orders").groupBy("o_custkey").agg(F.min(day()).alias("a"), F.when(F.col("o_custkey") % 3 > 0, F.max(day())).alias("b"))
    return joins.expand_years(spans, "a", "b", 2000).select("o_custkey", "year")


@query(f"""
SELECT o_custkey, greatest(min({DAY}), DATE '1997-01-01') AS a, least(max({DAY}), DATE '1999-01-01') AS b FROM orders GROUP BY 1 HAVING a < b""")
def clipped_spans(spark, d):
    spans = t(spark, d, "orders").groupBy("o_custkey").agg(F.min(day()).alias("a"), F.max(day()).alias("b"))
    return joins.clip(spans, "a", "b", F.lit("1997-01-01").cast("date"), F.lit("1999-01-01").cast("date"))


@query("""
SELECT n_name, coalesce(r_name, 'ISLE ' || n_name) AS area FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND n_nationkey < 10 WHERE n_nationkey < 20
UNION ALL SELECT n_name, NULL FROM nation WHERE n_nationkey >= 20""")
def first_known_code(spark, d):
    nations = t(spark, d, "nation")
    one = nations.filter("n_nationkey < 10").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    two = nations.filter("n_nationkey < 20").select("n_name", F.concat(F.lit("ISLE "), "n_name").alias("isle"))
    return joins.first_known(nations.select("n_name"), "n_name", [(one, "r_name"), (two, "isle")], "area")


@query("""
WITH v AS (SELECT o_orderkey AS k, o_orderpriority AS topic FROM orders WHERE o_orderkey % 5 = 0), o AS (SELECT o_orderkey AS k FROM orders)
SELECT k, topic, k AS from_key, false AS review FROM v
UNION ALL SELECT o.k, a.topic, a.k, a.topic <> b.topic FROM o JOIN v a ON a.k = o.k - o.k % 5 JOIN v b ON b.k = o.k - o.k % 10 WHERE o.k % 5 IN (1, 2, 3)
UNION ALL SELECT o.k, a.topic, a.k, coalesce(a.topic <> b.topic, false) FROM o JOIN v a ON a.k = o.k - 4 LEFT JOIN v b ON b.k = o.k - 9 WHERE o.k % 5 = 4""")
def inherited_topics(spark, d):
    key = F.col("o_orderkey")
    parents = F.when(key % 5 == 4, F.array(key - 1, key - 9)).when(key % 5 > 0, F.array(key - key % 5, key - key % 10))
    rows = t(spark, d, "orders").select(key.alias("k"), parents.alias("parents"), F.when(key % 5 == 0, F.col("o_orderpriority")).alias("topic"))
    return joins.inherit(rows, "k", "parents", "topic")


WRITTEN = """CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN concat(substring_index(p_name, ' ', -1), '  ', substring_index(p_name, ' ', 1)) ELSE upper(substring_index(p_name, ' ', -1)) END"""


@query("""
WITH m AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(p_type[1:3]) AS start, 'A' || chr(65 + p_size % 25) AS state FROM part),
v AS (SELECT p_partkey, state, start, unnest([a || b, a, b, b || a]) AS variant FROM m),
r AS (SELECT p_partkey AS filing, start, CASE WHEN p_partkey % 17 > 0 THEN state END AS state, unnest(CASE p_partkey % 4 WHEN 1 THEN [a || b] WHEN 3 THEN [b] ELSE [a || b, a, b, b || a] END) AS variant FROM m),
c AS (SELECT filing, max(r.state) AS state, count(DISTINCT v.p_partkey) AS n, min(v.p_partkey) AS one, count(DISTINCT v.p_partkey) FILTER (v.start = r.start) AS n_start, min(v.p_partkey) FILTER (v.start = r.start) AS one_start
  FROM r LEFT JOIN v ON v.variant = r.variant AND v.state = r.state GROUP BY 1)
SELECT filing, CASE WHEN state IS NULL THEN NULL WHEN n = 1 THEN one WHEN n > 1 AND n_start = 1 THEN one_start END AS member,
  CASE WHEN state IS NULL THEN 'bad_state' WHEN n = 0 THEN 'no_candidate' WHEN n = 1 THEN 'ok' WHEN n_start = 1 THEN 'ok_disambiguated' ELSE 'ambiguous' END AS reason FROM c""")
def roster_match(spark, d):
    """Parts found again by their names as others write them, within a state made of their size, and by the start of their type."""
    state = F.concat(F.lit("A"), F.chr(F.lit(65) + F.col("p_size") % 25))
    rows = t(spark, d, "part").withColumns({"state": state, "written": F.expr(WRITTEN)})
    filings = rows.select(F.col("p_partkey").alias("filing"), "written", F.col("p_type").alias("first"), F.when(F.col("p_partkey") % 17 == 0, "At large").otherwise(F.concat("state", F.lit("01"))).alias("place"))
    return rosters.roster_match(filings, rows.withColumnRenamed("p_partkey", "member"), "filing", "written", "first", "place", "member", "p_name", "p_type", "state")


@query("""
WITH p AS (SELECT p_partkey, p_brand || p_type AS block, list_distinct(string_split(p_name, ' ')) AS w FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) AS overlap
FROM p a JOIN p b ON a.block = b.block AND a.p_partkey < b.p_partkey WHERE overlap >= 0.5""")
def token_overlap(spark, d):
    words = t(spark, d, "part").select("p_partkey", F.concat("p_brand", "p_type").alias("block"), F.split("p_name", " ").alias("w"))
    right = words.select(F.col("p_partkey").alias("b"), "block", F.col("w").alias("v"))
    return similar.token_overlap(words.withColumnRenamed("p_partkey", "a"), right, "block", "w", "v", 0.5).filter("a < b").select("a", "b", "overlap")


@query("""
WITH x AS (SELECT o_custkey, o_orderstatus, min(o_orderpriority) AS role FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(o_orderstatus || ':' || role, ',' ORDER BY o_orderstatus) AS items FROM x GROUP BY 1""")
def inverted_index(spark, d):
    found = joins.inverted(t(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority")
    return found.select("o_custkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["o_orderstatus"], x["role"])), ",").alias("items"))


@query("""
SELECT CAST(sum(c) AS BIGINT) AS total, CAST(sum(c) FILTER (n < 15) AS BIGINT) AS drawn, CAST(sum(c) FILTER (n >= 15) AS BIGINT) AS undrawn
FROM (SELECT CAST(round(c_acctbal * 100) AS BIGINT) AS c, c_nationkey AS n FROM customer)""")
def drawn_totals(spark, d):
    shapes = t(spark, d, "nation").filter("n_nationkey < 15").select(F.col("n_nationkey").alias("c_nationkey"))
    return joins.drawn_and_totals(t(spark, d, "customer").withColumn("c", cents("c_acctbal")), shapes, "c_nationkey", "c")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, CAST(min(l_shipdate) AS DATE) AS day, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), o AS (SELECT l_orderkey, l_linenumber, day, s FROM a WHERE l_linenumber = 1),
r AS (SELECT l_orderkey AS m, day + CAST(l_orderkey % 5 AS INTEGER) AS w, s FROM a WHERE l_linenumber = 2),
x AS (SELECT o.l_orderkey AS k, count(DISTINCT m) AS n, min(m) AS m FROM o JOIN r ON o.s = r.s AND o.day = r.w GROUP BY 1 HAVING n = 1),
y AS (SELECT o.l_orderkey AS k, count(DISTINCT m) AS n, min(m) AS m FROM o JOIN r ON o.s = r.s AND abs(date_diff('day', o.day, r.w)) <= 1 WHERE o.l_orderkey NOT IN (SELECT k FROM x) GROUP BY 1 HAVING n = 1)
SELECT k, m, 'exact' AS via FROM x UNION ALL SELECT k, m, 'near' FROM y""")
def exact_then_near(spark, d):
    a = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_shipdate").cast("date")).alias("day"), F.min("l_suppkey").alias("s"))
    left = a.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), "day", "s")
    right = a.filter("l_linenumber = 2").select(F.col("l_orderkey").alias("m"), F.date_add("day", (F.col("l_orderkey") % 5).cast("int")).alias("w"), "s")
    return joins.exact_then_near(left, right, ["s"], "k", "m", "day", "w", 1)


# Aggregations


@query("""
SELECT l_suppkey, CAST(sum(l_quantity) FILTER (l_returnflag = 'R' AND l_linenumber = 6) AS DOUBLE) AS returned, CASE WHEN count(l_discount) >= 2 THEN max(l_discount) - min(l_discount) END AS spread,
  min(least(l_discount, l_tax)) AS least FROM lineitem GROUP BY 1""")
def sums_and_spread(spark, d):
    rows = t(spark, d, "lineitem")
    returned = aggregates.sum_or_null(F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 6), F.col("l_quantity")))
    some = rows.groupBy("l_suppkey").agg(returned.alias("returned"), aggregates.spread(F.col("l_discount")).alias("spread"))
    return some.join(aggregates.least_of(rows, ["l_suppkey"], "least", ["l_discount", "l_tax"]), "l_suppkey")


CODES = "(VALUES ('ECONOMY', 'plain'), ('STANDARD', 'plain'), ('PROMO', 'special'), ('LARGE', 'size'), ('SMALL', 'size'), ('MEDIUM', 'size')) AS c(p_type, target)"


@query(f"SELECT target, p_brand, CAST(sum(p_size) AS BIGINT) AS p_size, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS names FROM part JOIN {CODES} USING (p_type) GROUP BY 1, 2")
def merged_codes(spark, d):
    rows = t(spark, d, "part").select("p_type", "p_brand", "p_size", F.col("p_type").alias("name"))
    return aggregates.merged_codes(rows, spark.sql(f"SELECT * FROM {CODES}"), ["p_brand"], "p_type", "target", ["p_size"], "name").withColumn("names", F.array_join("names", ","))


@query("SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS p FROM orders) WHERE p = 1")
def latest_order(spark, d):
    return aggregates.best_per_key(t(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", day().alias("day"))


@query("""
WITH r AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 END AS r FROM events), b AS (SELECT *, min(r) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS b FROM r)
SELECT user_id, event_id, event_type FROM b WHERE r = b""")
def preferred_source(spark, d):
    rows = t(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return windows.preferred_source(rows, ["user_id", "day"], "event_type", ["signup", "purchase", "click"]).select("user_id", "event_id", "event_type")


@query("SELECT event_type, CAST(year(ts) AS INTEGER) AS year, min(value) AS low, max(value) AS high, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1, 2")
def year_range(spark, d):
    rows = t(spark, d, "events").groupBy("event_type", "ts").agg(F.max_by("value", "event_id").alias("last"), F.min("value").alias("low"), F.max("value").alias("high"))
    found = aggregates.year_range(rows, ["event_type"], "ts", "last").select("event_type", "year", "last")
    ends = aggregates.year_range(t(spark, d, "events"), ["event_type"], "ts", "value").select("event_type", "year", "low", "high")
    return ends.join(found, ["event_type", "year"])


@query("SELECT user_id, CAST(ts AS DATE) AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS chambers FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2")
def persons_by_day(spark, d):
    side = lambda name: t(spark, d, "events").filter(F.col("event_type") == name).select("user_id", F.col("ts").cast("date").alias("day"), F.lit(name).alias("chamber"))
    return unions.persons(side("purchase"), side("view"), key="user_id", period="day").withColumn("chambers", F.array_join("chambers", ","))


YEARLY = "SELECT c_mktsegment AS segment, c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3"
CHANGED = f"""WITH y AS ({YEARLY}), c AS (SELECT y.*, CASE WHEN EXISTS (SELECT 1 FROM y z WHERE z.year = y.year - 1) THEN y.total - coalesce(p.total, 0) END AS change
  FROM y LEFT JOIN y p ON p.segment = y.segment AND p.nation = y.nation AND p.year = y.year - 1)"""


def _yearly(spark, d) -> DataFrame:
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    totals = rows.groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year")).agg(F.sum(cents("o_totalprice")).alias("total"))
    return windows.change_or_new(totals, ["segment", "nation"], "year", "total")


@query(CHANGED + " SELECT * FROM c")
def change_or_new(spark, d):
    return _yearly(spark, d).select("segment", "nation", "year", "total", "change")


@query(CHANGED + " SELECT segment, avg(CASE WHEN change > 0 THEN 1.0 WHEN change IS NOT NULL THEN 0.0 END) AS share_risen, median(change) AS median_change FROM c GROUP BY 1")
def share_risen(spark, d):
    return aggregates.share_risen(_yearly(spark, d), ["segment"], "change")


STATUS_MONTHS = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus AS series, count(*) AS n FROM orders GROUP BY 1, 2"


def _status_months(spark, d) -> DataFrame:
    return t(spark, d, "orders").groupBy(F.trunc(day(), "month").alias("month"), F.col("o_orderstatus").alias("series")).agg(F.count("*").alias("n"))


@query(f"""
WITH m AS ({STATUS_MONTHS}), w AS (SELECT month, sum(n) AS w, sum(n) FILTER (series = 'F') AS f, sum(n) FILTER (series = 'O') AS o FROM m GROUP BY 1)
SELECT month, CAST(w - (f + o) AS DOUBLE) AS residual FROM w WHERE f IS NOT NULL AND o IS NOT NULL""")
def residual_series(spark, d):
    m = _status_months(spark, d)
    whole = m.groupBy("month").agg(F.sum("n").alias("n")).withColumn("series", F.lit("ALL"))
    return aggregates.residual(m.unionByName(whole), ["month"], "series", "n", "ALL", ["F", "O"])


@query(f"WITH m AS ({STATUS_MONTHS}) SELECT month, a.n + b.n AS n FROM m a JOIN m b USING (month) WHERE a.series = 'F' AND b.series = 'O'")
def summed_series(spark, d):
    m = _status_months(spark, d)
    return unions.summed(m.filter("series = 'F'"), m.filter("series = 'O'"), ["month"], "n")


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (o_orderpriority = '1-URGENT') AS p1, count(*) FILTER (o_orderpriority = '5-LOW') AS p5 FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def regional_stack(spark, d):
    region = F.when(F.col("o_orderpriority") == "1-URGENT", "p1").when(F.col("o_orderpriority") == "5-LOW", "p5")
    rows = t(spark, d, "orders").select(F.year("o_orderdate").alias("year"), region.alias("region"), F.lit(1).alias("n"), F.when(F.col("o_orderstatus") == "P", "suppressed").otherwise("value").alias("state"))
    return unions.stacked_by(rows, ["year"], "region", ["p1", "p5"], "n", "state").fillna(0, ["p1", "p5"])


@query("""
SELECT c_mktsegment, CAST(sum(v) AS BIGINT) AS net, CAST(sum(greatest(v, 0)) AS BIGINT) AS drawn FROM (SELECT c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) - 300000 AS v FROM customer) GROUP BY 1""")
def net_and_drawn(spark, d):
    return aggregates.net_and_drawn(t(spark, d, "customer").withColumn("v", cents("c_acctbal") - 300_000), ["c_mktsegment"], "v")


@query("""
SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS p_size, 'x' AS unit FROM part GROUP BY 1""")
def folded_labels(spark, d):
    return aggregates.folded(t(spark, d, "part").withColumn("unit", F.lit("x")), ["p_brand"], ["p_size"], ["unit"])


BANDS = "(VALUES ('1-URGENT', 5.0::DOUBLE, false), ('2-HIGH', 20.0, false), ('3-MEDIUM', 75.0, false), ('5-LOW', 1000.0, true)) AS b(band, middle, open)"


@query(f"""
SELECT o_custkey, sum(n * middle) AS total, bool_or(open) AS open_ended, count(*) FILTER (middle IS NULL) AS unknown_bands
FROM (SELECT o_custkey, o_orderpriority AS band, count(*) AS n FROM orders GROUP BY 1, 2) LEFT JOIN {BANDS} USING (band) GROUP BY 1""")
def banded_values(spark, d):
    counts = t(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").count().groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "count"))).alias("counts"))
    return aggregates.banded_value(counts, "o_custkey", "counts", spark.sql("SELECT band, CAST(middle AS DOUBLE) AS middle, open FROM " + BANDS.replace("5.0::DOUBLE", "5.0")))


@query("""
WITH a AS (SELECT l_suppkey, l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem WHERE l_suppkey % 10 <> 3 GROUP BY 1, 2),
b AS (SELECT l_suppkey, l_returnflag, CASE WHEN l_suppkey % 10 = 7 THEN NULL ELSE v * (1 + (l_suppkey % 4) / 100) END AS v, CASE WHEN l_returnflag = 'A' THEN 'final' ELSE 'preliminary' END AS status
  FROM (SELECT l_suppkey, l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem WHERE l_suppkey % 10 <> 5 GROUP BY 1, 2))
SELECT l_suppkey, l_returnflag, CASE WHEN a.l_suppkey IS NULL THEN 'new' WHEN b.l_suppkey IS NULL THEN 'removed' WHEN (a.v IS NULL) <> (b.v IS NULL) THEN 'missing'
  WHEN abs(b.v - a.v) > 0 AND (status = 'final' OR abs(b.v - a.v) > 0.015 * abs(a.v)) THEN 'revised' END AS change
FROM a FULL JOIN b USING (l_suppkey, l_returnflag) WHERE change IS NOT NULL""")
def revised_values(spark, d):
    sums = t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    new = sums.filter("l_suppkey % 10 <> 5").withColumns({"v": F.when(F.col("l_suppkey") % 10 != 7, F.col("v") * (1 + (F.col("l_suppkey") % 4) / 100)), "status": F.when(F.col("l_returnflag") == "A", "final").otherwise("preliminary")})
    return aggregates.revisions(sums.filter("l_suppkey % 10 <> 3"), new, ["l_suppkey", "l_returnflag"], "v", "status", 0.015).select("l_suppkey", "l_returnflag", "change")


@query("""
WITH s AS (SELECT source, doc_id, n_chars, count(*) OVER (PARTITION BY source) AS size, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS p FROM documents)
SELECT source, doc_id, size FROM s WHERE p = 1 ORDER BY size DESC, source LIMIT 8""")
def representatives(spark, d):
    return unions.representatives(t(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id", 8).select("source", "doc_id", "size")


@query("""
WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, max(o_orderkey) AS last_item FROM orders GROUP BY 1),
s AS (SELECT year, string_agg(s || ':' || n, ',' ORDER BY s) AS topics FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)
SELECT year, n, last_item, topics, 5 AS n_terms FROM y JOIN s USING (year)""")
def totals_and_items(spark, d):
    found = unions.totals_and_items(t(spark, d, "orders").withColumn("year", F.year("o_orderdate")), "year", "o_orderpriority", "o_orderstatus", "o_orderkey")
    topics = F.array_join(F.transform("topics", lambda x: F.concat_ws(":", x["o_orderstatus"], x["count"].cast("string"))), ",")
    return found.select("year", "n", F.element_at("items", -1).alias("last_item"), topics.alias("topics"), F.size("terms").alias("n_terms"))


@query("""
SELECT p_type, CAST(p_size // 10 * 10 AS INTEGER) AS decade, greatest(p_size // 10 * 10, 5) AS "from", least(p_size // 10 * 10 + 9, 43) AS "to", count(*) AS n FROM part WHERE p_size BETWEEN 5 AND 43 GROUP BY 1, 2, 3, 4""")
def clipped_decades(spark, d):
    span = aggregates.clipped_decades(F.col("p_size"), 5, 43)
    rows = t(spark, d, "part").select("p_type", aggregates.decades(F.col("p_size")).alias("decade"), span.alias("span")).filter("span IS NOT NULL")
    return rows.groupBy("p_type", "decade", "span.from", "span.to").agg(F.count("*").alias("n"))


# Windows and orders


@query("""
WITH s AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(30 * (o_custkey % 3) + 10 AS INTEGER) AS b FROM orders),
c AS (SELECT o_custkey, greatest(a, DATE '1996-01-01') AS a, least(b, DATE '2000-06-01') AS b FROM s WHERE greatest(a, DATE '1996-01-01') < least(b, DATE '2000-06-01'))
SELECT *, CAST(date_diff('day', max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS INTEGER) AS gap FROM c""")
def contiguous_spans(spark, d):
    spans = t(spark, d, "orders").select("o_custkey", day().alias("a"), F.date_add(day(), (30 * (F.col("o_custkey") % 3) + 10).cast("int")).alias("b")).distinct()
    return windows.contiguous_spans(spans, ["o_custkey"], "a", "b", F.lit("1996-01-01").cast("date"), F.lit("2000-06-01").cast("date"))


@query("""
WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)
SELECT * FROM (SELECT *, CAST(date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS INTEGER) AS gap FROM e) WHERE gap > 2""")
def long_gaps(spark, d):
    return windows.long_gaps(t(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day")).distinct(), ["user_id"], "day", 1)


@query("SELECT o_orderkey FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE o_orderdate < before")
def out_of_order(spark, d):
    return windows.out_of_order(t(spark, d, "orders"), "o_orderkey", "o_orderdate", ["o_custkey"]).select("o_orderkey")


@query(f"""
WITH m AS ({STATUS_MONTHS}) SELECT series, month, CASE WHEN month > max(month) OVER (PARTITION BY series) - INTERVAL 3 MONTH THEN 'preliminary' ELSE 'final' END AS status FROM m""")
def trailing_status(spark, d):
    return windows.trailing_status(_status_months(spark, d), ["series"], "month", 3).select("series", "month", "status")


@query(f"""
WITH m AS ({STATUS_MONTHS}), l AS (SELECT series, CAST(max(month) + INTERVAL 1 MONTH - INTERVAL 1 YEAR AS DATE) AS b FROM m GROUP BY 1)
SELECT series, CAST(b - INTERVAL 6 MONTH AS DATE) AS a, b FROM l""")
def trailing_windows(spark, d):
    a, b = windows.trailing_window(F.max("month"), 6, 1)
    return _status_months(spark, d).groupBy("series").agg(a.alias("a"), b.alias("b"))


@query("SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus <> 'O') AS o_totalprice FROM orders GROUP BY 1")
def latest_known(spark, d):
    rows = t(spark, d, "orders").withColumn("o_totalprice", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")))
    return windows.latest_known(rows, ["o_custkey"], "o_orderkey", "o_totalprice")


@query("""
SELECT p_partkey, CASE WHEN n > 1 THEN p_name || '-' || n ELSE p_name END AS p_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def numbered_names(spark, d):
    return windows.numbered(t(spark, d, "part").select("p_partkey", "p_name"), "p_name", F.asc("p_partkey"))


@query("""
SELECT * FROM (SELECT c_custkey, 'top' AS "end" FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)
UNION ALL SELECT * FROM (SELECT c_custkey, 'bottom' FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) ORDER BY c_acctbal, c_custkey LIMIT 10)""")
def highest_and_lowest(spark, d):
    return windows.ends(t(spark, d, "customer"), "c_acctbal", "c_custkey", 10).select("c_custkey", "end")


@query("""
WITH p AS (SELECT p_partkey, p_brand, p_name, CASE WHEN p_size % 5 > 0 THEN p_size END AS size FROM part)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY size DESC NULLS LAST, p_name ASC NULLS LAST, p_partkey) AS INTEGER) AS forward,
  CAST(row_number() OVER (PARTITION BY p_brand ORDER BY size ASC NULLS LAST, p_name DESC NULLS LAST, p_partkey DESC) AS INTEGER) AS backward FROM p""")
def reversible_order(spark, d):
    rows = t(spark, d, "part").select("p_partkey", "p_brand", "p_name", F.when(F.col("p_size") % 5 > 0, F.col("p_size")).alias("size"))
    order = [("size", True), ("p_name", False), ("p_partkey", False)]
    one = windows.ranked(rows, ["p_brand"], *windows.reversible(order, False)).withColumnRenamed("rank", "forward")
    return windows.ranked(one, ["p_brand"], *windows.reversible(order, True)).select("p_partkey", "forward", F.col("rank").alias("backward"))


@query("""
WITH m AS (SELECT c_nationkey AS nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS flag FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN lag(flag) OVER w = flag THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY nation ORDER BY month)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY nation ORDER BY month ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT nation, min(month) AS start, CAST(max(month) + INTERVAL 1 MONTH AS DATE) AS "end" FROM r WHERE flag = 1 GROUP BY nation, run""")
def flag_spans(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    monthly = rows.groupBy(F.col("c_nationkey").alias("nation"), F.trunc(day(), "month").alias("month")).agg(F.max(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("flag"))
    return windows.flag_spans(monthly, ["nation"], "month", "flag")


@query("""
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, max(o_orderstatus) AS s FROM orders GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN lag(s) OVER w = s AND year - lag(year) OVER w <= 1 THEN 0 ELSE 1 END AS fresh FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY year)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY year ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT o_custkey, s, min(year) AS first, max(year) AS last, count(*) AS length FROM r GROUP BY o_custkey, s, run""")
def runs_with_gaps(spark, d):
    yearly = t(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.max("o_orderstatus").alias("s"))
    found = windows.runs(yearly, ["o_custkey"], ["year"], "s", apart=F.col("year") - F.col("_before.year") > 1)
    return found.select("o_custkey", "s", F.col("first.year").alias("first"), F.col("last.year").alias("last"), "length")


@query("""
WITH s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b, o_orderstatus AS label, o_orderkey FROM orders),
u AS (SELECT * FROM s WHERE b IS NULL OR b > a), n AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(label) OVER w = label THEN 0 ELSE 1 END AS fresh FROM u WINDOW w AS (PARTITION BY o_custkey ORDER BY a)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY a ROWS UNBOUNDED PRECEDING) AS i FROM n)
SELECT o_custkey, label, min(a) AS a, CASE WHEN bool_or(b IS NULL) THEN NULL ELSE max(b) END AS b FROM r GROUP BY o_custkey, i, label""")
def merged_spans(spark, d):
    rows = t(spark, d, "orders").withColumn("a", day())
    spans = rows.withColumn("b", F.lead("a").over(windows.W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).filter("b IS NULL OR b > a")
    return windows.merged_spans(spans.select("o_custkey", "a", "b", F.col("o_orderstatus").alias("label")), ["o_custkey"], "a", "b", "label")


@query("""
WITH x AS (SELECT 'orders with lines' AS label, (SELECT count(DISTINCT l_orderkey) FROM lineitem)::DOUBLE AS expected, count(*)::DOUBLE AS actual, false AS sane FROM orders
UNION ALL SELECT 'customers', (SELECT count(*) FROM customer)::DOUBLE, count(DISTINCT o_custkey)::DOUBLE, false FROM orders
UNION ALL SELECT 'urgent', (SELECT count(*) FROM lineitem)::DOUBLE, count(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE, true FROM orders),
d AS (SELECT *, (actual - expected) / expected * 100 AS diff_pct FROM x)
SELECT label, expected, actual, diff_pct, CASE WHEN sane THEN 'sanity' WHEN abs(diff_pct) >= 20 THEN 'stop' WHEN abs(diff_pct) >= 1 THEN 'investigate' ELSE 'pass' END AS status FROM d""")
def targets_met(spark, d):
    """Numbers told by other tables against the orders."""
    told = t(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("orders"), F.count("*").alias("lines")).first()
    found = {
        "orders with lines": (F.count("*"), told["orders"]), "customers": (F.count_distinct("o_custkey"), t(spark, d, "customer").count()),
        "urgent": (F.count_if(F.col("o_orderpriority") == "1-URGENT"), told["lines"]),
    }
    return gates.reconciled(t(spark, d, "orders"), found, 1, 20, sanity=("urgent",))


@query("""
WITH c AS (SELECT o_orderkey, count(l_orderkey) FILTER (l_returnflag = 'A') AS maj, count(l_orderkey) FILTER (l_returnflag = 'R') AS min, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
p AS (SELECT *, maj + CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END AS told FROM c)
SELECT CASE WHEN n = 0 THEN 'case without votes' ELSE 'tally' END AS rule, o_orderkey AS "case", CASE WHEN n > 0 THEN told - maj END AS "over" FROM p WHERE n = 0 OR told <> maj""")
def gate_tallies(spark, d):
    """Lines as votes of their orders, whose printed majority is one too many now and then."""
    side = F.when(F.col("l_returnflag") == "A", "majority").when(F.col("l_returnflag") == "R", "dissent").otherwise("none")
    lines, orders = t(spark, d, "lineitem"), t(spark, d, "orders")
    votes = lines.select(F.col("l_orderkey").alias("case"), F.monotonically_increasing_id().alias("member"), side.alias("side"))
    parts = lineage.parts(spark, lines.count() + orders.count())
    printed = votes.select("case", "side").repartition(parts, "case").groupBy("case").agg(F.count_if(F.col("side") == "majority").alias("maj"), F.count_if(F.col("side") == "dissent").alias("min"))
    cases = orders.select(F.col("o_orderkey").alias("case")).join(printed, "case", "left").fillna(0, ["maj", "min"])
    cases = cases.withColumn("maj", F.col("maj") + (F.col("case") % 40 == 0).cast("int"))
    found = gates.tallies(votes, cases, "case", "member", "side", "maj", "min", parts)
    number = lambda name: F.get_json_object("detail", f"$.{name}").cast("long")
    return found.select("rule", number("case").alias("case"), (number("told") - number("maj")).alias("over"))


@query(f"""
WITH c AS (SELECT o_custkey, CAST(date_trunc('quarter', {DAY}) AS DATE) AS period, count(*) AS n FROM orders GROUP BY 1, 2),
s AS (SELECT o_custkey, unnest(generate_series(min(period), max(period), INTERVAL 3 MONTH)) AS p FROM c GROUP BY 1)
SELECT s.o_custkey, CAST(p AS DATE) AS period, coalesce(n, 0) AS n FROM s LEFT JOIN c ON c.o_custkey = s.o_custkey AND c.period = CAST(p AS DATE)""")
def dense_quarters(spark, d):
    return aggregates.dense_periods(t(spark, d, "orders"), ["o_custkey"], "o_orderdate", "quarter")


@query("""
WITH b AS (SELECT c_nationkey, min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer GROUP BY 1), u AS (SELECT *, (b - a) / 5 AS raw, power(10.0, floor(log10((b - a) / 5))) AS unit FROM b WHERE b > a),
s AS (SELECT *, CASE WHEN raw <= unit THEN unit WHEN raw <= 2 * unit THEN 2 * unit WHEN raw <= 2.5 * unit THEN 2.5 * unit WHEN raw <= 5 * unit THEN 5 * unit ELSE 10 * unit END AS step FROM u)
SELECT c_nationkey, floor(a / step) * step AS low, ceil(b / step) * step AS high, step FROM s""")
def nice_domains(spark, d):
    spans = t(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("a"), F.max("c_acctbal").alias("b")).filter("b > a")
    return spans.select("c_nationkey", numbers.nice_domain(F.col("a"), F.col("b")).alias("d")).select("c_nationkey", "d.*")


# Functions


@query("""
SELECT n_nationkey, trim(regexp_replace(regexp_replace(regexp_replace(lower('St. ' || n_name || ' & Co.'), '\\bst\\.? ', 'saint ', 'g'), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS country,
  '"' || n_name || '" - it''s' AS plain, 'State of the ' || upper(n_name[1]) || lower(n_name[2:]) || ' v. Smith' AS title, 'Zone of ' || n_name AS short,
  CASE WHEN n_nationkey % 3 = 0 THEN 'Nick' WHEN n_nationkey % 3 = 1 THEN 'Bob' ELSE 'Lee' END AS display, CASE n_regionkey WHEN 0 THEN 'H.R. ' WHEN 1 THEN 'S. ' WHEN 2 THEN 'H.J.Res. ' ELSE 'S.J.Res. ' END || n_nationkey AS bill,
  'D' AS caucus, CASE WHEN n_nationkey >= 33 THEN 'R' ELSE 'O' END AS party, 'jr,jrnation,nation,nationjr' AS variants FROM nation""")
def name_rules(spark, d):
    name, key = F.col("n_name"), F.col("n_nationkey")
    lit = F.lit
    kind = F.element_at(F.array(lit("hr"), lit("s"), lit("hjres"), lit("sjres"), lit("sjres")), F.col("n_regionkey") + 1)
    display = text.display_name(F.when(key % 3 == 0, "Nick"), F.when(key % 3 == 1, "Robert (Bob) Lee"), F.when(key % 3 == 2, "J."), lit("Lee"), lit(None).cast("string"))
    variants = text.last_name_variants(F.concat(F.regexp_replace(name, "_.*", ""), lit(" Jr")))
    return t(spark, d, "nation").select(
        "n_nationkey", text.country_key(F.concat(lit("St. "), name, lit(" & Co."))).alias("country"), text.plain_typography(F.concat(lit(" “"), name, lit("” –  it’s"))).alias("plain"),
        text.case_title(F.concat(lit("STATE OF THE "), name, lit(" V. SMITH"))).alias("title"), text.committee_short(F.concat(lit("House Select Committee on the Zone of "), name)).alias("short"), display.alias("display"),
        text.bill_label(kind, key).alias("bill"), text.caucus_group(lit("Democratic")).alias("caucus"), text.party_group(lit("Republican"), key).alias("party"),
        F.array_join(F.transform(F.array_sort(variants), lambda x: x), ",").alias("variants"),
    )


VOTE_TEXT = """CASE event_type WHEN 'click' THEN 'Passed by Voice Vote.' WHEN 'view' THEN 'Agreed by Unanimous Consent' WHEN 'purchase' THEN 'On passage Passed by the Yeas and Nays: ' || user_id || ' - ' || event_id % 400 || ' (Roll no. ' || event_id || ').' ELSE 'Considered' END"""


@query(f"""
WITH e AS (SELECT event_id, user_id, event_type, {VOTE_TEXT} AS text FROM events)
SELECT event_id, CASE event_type WHEN 'click' THEN 'voice' WHEN 'view' THEN 'consent' WHEN 'purchase' THEN 'roll' ELSE 'unstated' END AS method, CAST(CASE WHEN event_type = 'purchase' THEN event_id END AS INTEGER) AS roll,
  CAST(CASE WHEN event_type = 'purchase' THEN user_id END AS INTEGER) AS yes, CAST(CASE WHEN event_type = 'purchase' THEN event_id % 400 END AS INTEGER) AS no, CAST((length(text) - length(replace(text, 'as', ''))) // 2 AS INTEGER) AS n_as FROM e""")
def vote_texts(spark, d):
    rows = t(spark, d, "events").withColumn("text", F.expr(VOTE_TEXT))
    tally = text.tally(F.col("text"))
    return rows.select("event_id", text.passing_method(F.col("text")).alias("method"), text.roll_number(F.col("text")).alias("roll"), tally["yes"].alias("yes"), tally["no"].alias("no"), text.occurrences(F.col("text"), "as").alias("n_as"))


TITLE = """CASE p_size % 7 WHEN 0 THEN 'To name the bridge at ' || p_name || ' after J. Smith' WHEN 1 THEN 'To set aside ' || p_name || ' Week' WHEN 2 THEN 'To strike a coin for ' || p_name
 WHEN 3 THEN 'To put up a stone for ' || p_name WHEN 4 THEN 'To change the ' || p_name || ' stone act' WHEN 5 THEN 'To name the head of ' || p_name || ' as keeper of the park' ELSE 'To pay for ' || p_name || ' in the last week of a quarter' END"""

TITLE_RULES = (
    rules.Rule("naming", r"(?i)\bname\b", (rules.Guard(r"(?i)\bpark\b", after=r"(?i)\bas\b"),)),
    rules.Rule("observance", r"(?i)\b(week|day)\b", (rules.Guard(r"(?i)\bquarter\b"),)),
    rules.Rule("honor", r"(?i)\bcoin\b"),
    rules.Rule("memorial", r"(?i)\bstone\b", (rules.Guard(r"(?i)\bchange\b"), rules.Guard(r"(?i)\bact$"))),
)


@query("""
SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'naming' WHEN 1 THEN 'observance' WHEN 2 THEN 'honor' WHEN 3 THEN 'memorial' END AS class,
  CASE p_size % 7 WHEN 0 THEN 'naming' WHEN 1 THEN 'observance' WHEN 2 THEN 'honor' WHEN 3 THEN 'memorial' WHEN 4 THEN 'memorial-0' WHEN 5 THEN 'naming-0' ELSE 'observance-0' END AS report FROM part""")
def title_classes(spark, d):
    """Titles made of names, by a table of rules with exclusions, and which exclusion decided."""
    title = F.expr(TITLE)
    report = F.transform(rules.rule_report(title, TITLE_RULES), lambda x: F.concat_ws("-", x["name"], x["excluded_by"].cast("string")))
    return t(spark, d, "part").select("p_partkey", rules.first_rule(title, TITLE_RULES).alias("class"), F.array_join(report, ",").alias("report"))


FUNNEL = (rules.Step(None, "^error$", "start"), rules.Step("start", "^view$", "seen"), rules.Step("seen", "^click$", "chosen"), rules.Step("chosen", "^purchase$", "bought"))
STEP = "CASE WHEN e = 4 THEN 0 WHEN e = 1 AND s % 10 = 0 THEN 1 WHEN e = 2 AND s % 10 = 1 THEN 2 WHEN e = 3 AND s % 10 = 2 THEN 3 ELSE s % 10 END"


@query(f"""
WITH c AS (SELECT user_id, list(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 5 END ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
r AS (SELECT user_id, list_reduce(list_prepend(0, l), lambda s, e: greatest(s // 10, {STEP}) * 10 + {STEP}) AS x FROM c)
SELECT user_id, ['start', 'seen', 'chosen', 'bought'][x % 10 + 1] AS state, ['start', 'seen', 'chosen', 'bought'][x // 10 + 1] AS furthest FROM r""")
def funnel_states(spark, d):
    """Each user's events through a table of transitions: the state they end in, and the furthest they were in."""
    actions = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    rows = t(spark, d, "events").groupBy("user_id").agg(actions.alias("actions"))
    order = ("start", "seen", "chosen", "bought")
    return rows.select("user_id", rules.final_state(F.col("actions"), "start", FUNNEL).alias("state"), rules.furthest_state(F.col("actions"), "start", FUNNEL, order).alias("furthest"))


@query("SELECT o_custkey, o_orderkey AS key, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS total FROM orders WHERE o_orderstatus = 'P'")
def nested_objects(spark, d):
    """Objects of one status out of documents that hold a customer's orders by year."""
    rows = t(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    order = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("total"), "year").alias("of"), F.col("o_totalprice").alias("total"), "year")
    years = rows.groupBy("o_custkey", "year").agg(F.collect_list(order).alias("orders")).groupBy("o_custkey").agg(F.collect_list(F.struct("year", "orders")).alias("years"))
    docs = years.select("o_custkey", F.to_json(F.struct(F.struct("years").alias("file"))).alias("doc"))
    return documents.objects_where(docs, ["o_custkey"], "doc", "status", F.lit("P"), {"key": "bigint", "year": "int", "total": "double"}).drop("path")


@query("SELECT o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS BIGINT) AS place, o_custkey, o_orderstatus, o_orderkey FROM orders")
def shard_round_trip(spark, d):
    """Orders as shards of a priority with dictionaries, and back."""
    rows = t(spark, d, "orders")
    return sinks.decoded_shards(*sinks.coded_shards(rows, "o_orderpriority", ["o_custkey", "o_orderstatus"], ["o_orderkey"], ["o_orderkey"], most=700), "o_orderpriority", most=700)


@query("""
WITH c AS (SELECT o_orderpriority, o_custkey AS value, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, value) - 1 AS INTEGER) AS code, value, n FROM c""")
def shard_dictionaries(spark, d):
    return sinks.coded_shards(t(spark, d, "orders"), "o_orderpriority", ["o_custkey"], ["o_orderkey"], ["o_orderkey"])[1]["o_custkey"]


@query("""
WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN c_nationkey < 10 THEN 'inner' ELSE 'outer' END AS section, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), f AS (SELECT year, section, unnest(['urgent', 'low']) AS field, unnest([urgent, low]) AS sum FROM c)
SELECT 'section total' AS rule, year, section, field, sum, sum + 1 AS printed FROM f WHERE section = 'inner' AND field = 'urgent' AND year % 2 = 0
UNION ALL SELECT 'grand total', year, NULL, field, CAST(sum(sum) + 1 AS BIGINT), CAST(sum(sum) AS BIGINT) FROM f WHERE field = 'urgent' AND year % 2 = 0 GROUP BY year, field""")
def grid_totals(spark, d):
    """Counts laid out as a printed grid for each year, with a wrong total now and then, read back by headings and sections."""
    both = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = [F.count_if(F.col("o_orderpriority") == p).alias(n) for n, p in (("urgent", "1-URGENT"), ("low", "5-LOW"))]
    year, outer = F.year("o_orderdate").alias("year"), (F.col("c_nationkey") >= 10).cast("int").alias("part")
    print_ = lambda rows, row, label: rows.select("year", row.cast("int").alias("row"), F.create_map(F.lit("B"), label, F.lit("D"), F.format_number("urgent", 0), F.lit("E"), F.col("low").cast("string")).alias("cells"))
    lines = print_(both.groupBy(year, outer, "c_nationkey", "n_name").agg(*counts), 10 + F.col("part") * 100 + F.col("c_nationkey"), F.col("n_name"))
    wrong = F.col("urgent") + F.when((F.col("year") % 2 == 0) & (F.col("part") == 0), 1).otherwise(0)
    totals = print_(both.groupBy(year, outer).agg(*counts).withColumn("urgent", wrong), 90 + F.col("part") * 100, F.when(F.col("part") == 0, "Inner total").otherwise("Outer total**"))
    grand = print_(both.groupBy(year).agg(*counts), F.lit(300), F.lit("GRAND  TOTAL"))
    cells = lambda **c: F.create_map(*(F.lit(x) for pair in c.items() for x in pair))
    head = both.select(year).distinct().select("year", F.explode(F.array(F.struct(F.lit(2).alias("row"), cells(D="Orders", F="Other").alias("cells")), F.struct(F.lit(3).alias("row"), cells(B="Nation", D="URGENT*", E="Low", F="All").alias("cells")))).alias("h")).select("year", "h.*")
    rows = checkpointed(lines.unionByName(totals).unionByName(grand).unionByName(head))  # each reading and gate looks at it
    columns = grids.headed_columns(rows, ["year"], "ORDERS", {"URGENT": "urgent", "LOW": "low"}, ["urgent", "low"])
    found = grids.printed_totals(grids.sectioned(rows, ["year"], columns, "B", [("inner", "Inner total"), ("outer", "Outer total")], "Grand total"), ["year"])
    return found.select("rule", *(F.get_json_object("detail", f"$.{c}").cast(k).alias(c) for c, k in (("year", "int"), ("section", "string"), ("field", "string"), ("sum", "bigint"), ("printed", "bigint"))))


LANES = f"SELECT o_custkey AS g, o_orderkey AS k, {DAY} AS a, {DAY} + CAST(o_orderkey % 90 AS INTEGER) AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY {DAY}, o_orderkey) AS n FROM orders"


@query(f"""
WITH RECURSIVE p AS ({LANES}), r AS (SELECT g, k, n, 1 AS spot, [b] AS ends FROM p WHERE n = 1
  UNION ALL SELECT g, k, n, spot, CASE WHEN spot > len(ends) THEN list_append(ends, b) ELSE list_concat(list_append(ends[1:spot - 1], b), ends[spot + 1:]) END
  FROM (SELECT p.*, r.ends, coalesce(nullif(list_position(list_transform(r.ends, lambda e: e <= p.a), true), 0), len(r.ends) + 1) AS spot FROM r JOIN p ON p.g = r.g AND p.n = r.n + 1))
SELECT g AS o_custkey, k AS o_orderkey, CAST(spot - 1 AS INTEGER) AS lane FROM r""")
def order_lanes(spark, d):
    """Orders open for some days in lanes of their customer."""
    until = F.date_add(day(), (F.col("o_orderkey") % 90).cast("int"))
    return places.packed_lanes(t(spark, d, "orders").select("o_custkey", "o_orderkey", day().alias("a"), until.alias("b")), "o_custkey", "o_orderkey", "a", "b")


@query("""
WITH RECURSIVE p AS (SELECT c_mktsegment AS g, c_custkey AS k, CAST(c_nationkey * 10 AS DOUBLE) AS x, CAST(c_custkey % 1000 AS DOUBLE) AS y, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer),
r AS (SELECT g, k, n, 1 AS spot, [{'x': x, 'y': y, 'n': 1.0::DOUBLE}] AS c FROM p WHERE n = 1
  UNION ALL SELECT g, k, n, spot, CASE WHEN spot > len(c) THEN list_append(c, {'x': x, 'y': y, 'n': 1.0::DOUBLE}) ELSE list_transform(c, lambda e, j: CASE WHEN j = spot THEN {'x': e.x + x, 'y': e.y + y, 'n': e.n + 1.0::DOUBLE} ELSE e END) END
  FROM (SELECT p.*, r.c, coalesce(nullif(list_position(list_transform(r.c, lambda e: sqrt(power(e.x / e.n - p.x, 2) + power(e.y / e.n - p.y, 2)) <= 6.5), true), 0), len(r.c) + 1) AS spot FROM r JOIN p ON p.g = r.g AND p.n = r.n + 1)),
z AS (SELECT g, arg_max(c, n) AS c FROM r GROUP BY 1)
SELECT g AS c_mktsegment, k AS c_custkey, CAST(spot - 1 AS INTEGER) AS cluster, z.c[spot].x / z.c[spot].n AS x, z.c[spot].y / z.c[spot].n AS y FROM r JOIN z USING (g)""")
def customer_clusters(spark, d):
    """Customers of a segment gathered where their nation and number put them."""
    points = t(spark, d, "customer").select("c_mktsegment", "c_custkey", (F.col("c_nationkey") * 10.0).alias("x"), (F.col("c_custkey") % 1000).cast("double").alias("y"))
    return places.clustered(points, "c_mktsegment", "c_custkey", 6.5)


#: What html_text() does, in SQL: no scripts, styles, comments and tags, HTML 4's entities and numbered ones decoded, single spaces.
ENTITIES = "MAP {" + ", ".join(f"'{n}': {c}" for n, c in sorted({**html.entities.name2codepoint, "apos": 39}.items())) + "}"
SPACES = r"[ \t\n\x0B\f\r]+"


def html_text_sql(page: str) -> str:
    bare = rf"regexp_replace(regexp_replace({page}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    inner = r"regexp_extract(piece, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});', 1)"
    digits = f"('0x' || lpad({inner}[3:], 8, '0'))"
    code = f"CASE WHEN {inner} = '' THEN NULL WHEN regexp_matches({inner}, '^#[0-9]') THEN CAST({inner}[2:] AS INTEGER) WHEN {inner}[1] = '#' THEN CAST({digits} AS INTEGER) ELSE ({ENTITIES})[{inner}] END"
    known = f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}) || piece[length({inner}) + 2:] ELSE '&' || piece END"
    decoded = f"array_to_string(list_transform(string_split({bare}, '&'), lambda piece, i: CASE WHEN i = 1 THEN piece ELSE {known} END), '')"
    return rf"trim(regexp_replace({decoded}, '[ \t\n\x0B\f\r\x{{00A0}}]+', ' ', 'g'))"


def plain_sql(words: str) -> str:
    """plain_typography() in lower case."""
    return f"lower(trim(regexp_replace(translate({words}, '‘’“”–—\u00a0', '''''\"\"-- '), '{SPACES}', ' ', 'g')))"


@query(f"""
WITH x AS (SELECT page_id, html, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages),
y AS (SELECT page_id, html, {html_text_sql("title")} AS title, {html_text_sql("html")} AS body FROM x)
SELECT page_id, contains(html, 'class="ad"') AS has_ad, CAST((length(html) - length(replace(html, '<p>', ''))) // 3 AS INTEGER) AS paragraphs,
  CASE WHEN contains({plain_sql("body")}, {plain_sql("title")}) THEN title END AS quoted FROM y""")
def page_quotes(spark, d):
    title = text.html_text(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    quoted = F.when(text.quoted_in(title, text.html_text(F.col("html"))), title)
    return t(spark, d, "pages").select("page_id", F.contains("html", F.lit('class="ad"')).alias("has_ad"), text.occurrences(F.col("html"), "<p>").alias("paragraphs"), quoted.alias("quoted"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_discount = 0 AND l_tax = 0 THEN NULL ELSE l_discount END AS x, CASE WHEN l_discount = 0 AND l_tax = 0 THEN NULL ELSE l_tax END AS y,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS parsed, CAST(l_orderkey + l_linenumber / 100.0 AS DECIMAL(18, 2)) AS dollars,
  CASE WHEN l_linenumber < 3 THEN CAST(l_shipdate AS DATE) END AS day, CASE WHEN l_linenumber < 5 THEN CAST(date_trunc('month', l_shipdate) AS DATE) END AS month FROM lineitem""")
def parsed_values(spark, d):
    line, ship = F.col("l_linenumber"), F.col("l_shipdate")
    x, y = numbers.sentinel_to_null(F.col("l_discount"), F.col("l_tax"))
    number = numbers.number_or_missing(F.when(line == 1, " . ").otherwise(F.col("l_quantity").cast("string")))
    dollars = text.exact_dollars(F.concat(F.lit(" $"), F.format_number(F.col("l_orderkey") + line / 100, 2)))
    written = F.when(line == 1, F.date_format(ship, "yyyy-MM-dd")).when(line == 2, F.date_format(ship, "M/d/yyyy")).otherwise("n.d.")
    label = F.when(line < 5, F.date_format(ship, "yyyy-MM")).otherwise("1999-13")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", x.alias("x"), y.alias("y"), number.alias("parsed"), dollars.alias("dollars"), dates.mixed_date(written).alias("day"), dates.month_label(label).alias("month"))


@query(f"""
SELECT o_orderkey, make_date(CAST(year({DAY}) AS BIGINT), 10, 1) AS term_from, make_date(CAST(year({DAY}) + 1 AS BIGINT), 9, 30) AS term_to, make_date(CAST(year({DAY} + INTERVAL 3 MONTH) AS BIGINT), 9, 30) + 45 > DATE '1999-11-01' AS part_year,
  date_diff('day', DATE '1950-05-17', {DAY}) / 365.25 AS age, {DAY} - 7 AS first,
  CASE o_orderpriority WHEN '1-URGENT' THEN CAST({DAY} + INTERVAL 12 MONTH AS DATE) - 1 WHEN '2-HIGH' THEN CAST({DAY} + INTERVAL 3 MONTH AS DATE) - 1 WHEN '3-MEDIUM' THEN last_day({DAY}) WHEN '5-LOW' THEN {DAY} + 6 ELSE {DAY} END AS ends,
  ends >= DATE '1998-03-01' AS shown FROM orders""")
def period_rules(spark, d):
    p = F.col("o_orderpriority")
    frequency = F.when(p == "1-URGENT", "annual").when(p == "2-HIGH", "quarterly").when(p == "3-MEDIUM", "monthly").when(p == "5-LOW", "weekly").otherwise("daily")
    a, b = dates.term_bounds(F.year(day()))
    return t(spark, d, "orders").select(
        "o_orderkey", a.alias("term_from"), b.alias("term_to"), dates.is_partial(dates.fiscal_year(day()), F.lit("1999-11-01").cast("date"), 45).alias("part_year"), dates.age_in_years(F.lit("1950-05-17").cast("date"), day()).alias("age"),
        dates.earliest(F.array(day(), F.date_sub(day(), 7), F.lit(None).cast("date"))).alias("first"), dates.period_end(day(), frequency).alias("ends"), dates.shown_from(day(), frequency, F.lit("1998-03-01").cast("date")).alias("shown"),
    )


@query("""
WITH x AS (SELECT p_partkey, p_size AS a, p_partkey % 40 AS b, p_size * 37.0 AS span FROM part), u AS (SELECT *, span / 5 AS raw, pow(10.0, floor(log10(span / 5))) AS unit FROM x)
SELECT p_partkey, CASE WHEN raw <= unit THEN unit * 1.0 WHEN raw <= 2 * unit THEN 2 * unit WHEN raw <= 2.5 * unit THEN 2.5 * unit WHEN raw <= 5 * unit THEN 5 * unit ELSE 10 * unit END AS step,
  CAST(a AS DOUBLE) / (a + b) AS yes, CASE WHEN a >= 30 THEN '-$' || a || '.0M' WHEN a >= 10 THEN '$' || a || '.0K' ELSE '$' || a END AS label,
  CASE WHEN a <= 0 THEN 0 WHEN a < 5 THEN 1 WHEN a < 20 THEN 2 ELSE 3 END * CAST(sign(20 - b) AS DOUBLE) AS shade,
  CASE WHEN a = b THEN 'exact' WHEN abs(a - b) <= 3 THEN 'minor' WHEN a % 2 = 0 THEN 'exception' ELSE 'fatal' END AS tallied,
  CASE WHEN b = 0 THEN 'stop' WHEN b >= 30 THEN 'stop' WHEN b >= 10 THEN 'investigate' ELSE 'pass' END AS graded FROM u""")
def number_labels(spark, d):
    a, b = F.col("p_size"), F.col("p_partkey") % 40
    money = F.when(a >= 30, -1e6 * a).when(a >= 10, 1e3 * a).otherwise(a.cast("double"))
    sign = F.signum(20 - b).cast("int")
    return t(spark, d, "part").select(
        "p_partkey", numbers.nice_step(a * F.lit(37.0)).alias("step"), numbers.yes_share(a, b).alias("yes"), numbers.money_label(money).alias("label"), places.shade_signed(a * sign, [5, 20]).cast("double").alias("shade"),
        gates.arbitrate(a, b, 3, a % 2 == 0).alias("tallied"), gates.grade_gap(F.when(b > 0, b), 10, 30).alias("graded"),
    )


@query("""
SELECT DISTINCT (c_custkey % 360 - 180 + 100.0) * cos(radians(40.0)) * 2.0 AS x, CAST((40.0 - c_custkey % 90) * 2.0 AS DOUBLE) AS y FROM customer WHERE x BETWEEN -100 AND 100 AND y BETWEEN -50 AND 50""")
def projected_places(spark, d):
    rows = t(spark, d, "customer").select((F.col("c_custkey") % 360 - 180).alias("lon"), (F.col("c_custkey") % 90).alias("lat"))
    return places.projected(rows, "lon", "lat", -100.0, 40.0, 2.0, (-100.0, -50.0, 100.0, 50.0)).select("x", "y")


# Nested forms


@query("""
WITH u AS (SELECT user_id, event_id, event_type, CAST(ts AS DATE) AS day, value FROM events)
SELECT user_id, min(day) FILTER (event_type = 'error') AS first_error, bool_or(event_type = 'signup') AS has_signup, count(*) AS n, count(*) AS by_kind, CAST(sum(event_id * 2) AS BIGINT) AS doubled, arg_min(event_type, event_id) AS first_kind FROM u GROUP BY 1""")
def array_rules(spark, d):
    rows = t(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    kinds = rows.groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))
    lists = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", F.col("day").alias("date"), F.col("event_type").alias("text")))).alias("actions"))
    ids = F.transform("actions", lambda a: a["event_id"])
    doubled = F.aggregate(nested.zipped(ids, ids, lambda x, y: x + y), F.lit(0).cast("long"), lambda a, x: a + x)
    return lists.join(kinds, "user_id").select(
        "user_id", nested.first_day_matching(F.col("actions"), "^error").alias("first_error"), nested.any_matching(F.col("actions"), "signup").alias("has_signup"), F.size("actions").cast("long").alias("n"), nested.map_total(F.col("m")).alias("by_kind"),
        doubled.alias("doubled"), F.get("actions", F.lit(0))["text"].alias("first_kind"),
    )


@query("""
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS place, event_id, event_type FROM events""")
def exploded_lists(spark, d):
    """The lists of two halves of the table put together again and exploded."""
    rows = t(spark, d, "events")
    half = F.when(F.col("event_id") < 500, 0).otherwise(1)
    parts = rows.groupBy("user_id", half.alias("half")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("list"))
    return nested.exploded(nested.merged_lists(parts, "user_id", "list", "half"), ["user_id"], "list")


@query("""
WITH m AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders GROUP BY 1, 2, 3),
y AS (SELECT DISTINCT o_custkey, year FROM m), g AS (SELECT o_custkey, year, CAST(i AS INTEGER) AS month FROM y, range(1, 13) r(i))
SELECT o_custkey, year, string_agg(coalesce(CAST(n AS VARCHAR), '-'), ' ' ORDER BY month) AS months FROM g LEFT JOIN m USING (o_custkey, year, month) GROUP BY 1, 2""")
def month_slots(spark, d):
    """Orders by month of each customer's year: most months have none."""
    rows = t(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    return nested.month_slots(rows, ["o_custkey", "year"], "month", "n").withColumn("months", F.array_join("months", " ", "-"))


@query("""
WITH s AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders), f AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, bool_or(o_orderstatus = 'F') AS extractable, bool_or(o_orderpriority = '1-URGENT') AS needs_review
  FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1, 2)
SELECT o_custkey, year, CASE WHEN f.year IS NULL THEN 'no_filing' WHEN NOT extractable THEN 'not_extractable' WHEN needs_review THEN 'needs_review' ELSE 'usable' END AS state FROM s LEFT JOIN f USING (o_custkey, year)""")
def filing_states(spark, d):
    rows = t(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    filings = rows.filter("o_orderkey % 3 > 0").groupBy("o_custkey", "year").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("extractable"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("needs_review"))
    return nested.filing_state(rows.select("o_custkey", "year").distinct(), filings, ["o_custkey", "year"]).select("o_custkey", "year", "state")


@query("""
SELECT event_id, '{' || concat_ws(',', CASE WHEN event_type <> 'view' THEN '"kind":"' || event_type || '"' END, '"user":' || user_id) || '}' AS fields, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def compact_fields(spark, d):
    rows = t(spark, d, "events").withColumns({"kind": F.when(F.col("event_type") != "view", F.col("event_type")), "user": F.col("user_id"), "k": nested.reduced(F.col("props"), "k INT")["k"]})
    return nested.compacted(rows, ["event_id", "k"], ["kind", "user"])


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AND l_linestatus = 'F' AS law, l_discount > 0.05 AS house, l_tax > 0.04 AS senate, l_quantity > 40 AS reported, l_quantity > 25 AS marked, l_quantity > 10 AS heard,
  CASE l_suppkey % 3 WHEN 0 THEN 'house' WHEN 1 THEN 'senate' ELSE 'joint' END AS chamber, CASE l_partkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'D' ELSE 'I' END AS party, l_orderkey % 2 AS dem, l_linenumber % 2 AS rep, CAST(l_shipdate AS DATE) AS last FROM lineitem),
s AS (SELECT *, CASE WHEN law THEN 6 WHEN CASE chamber WHEN 'house' THEN house WHEN 'senate' THEN senate ELSE house OR senate END THEN 5 WHEN reported THEN 4 WHEN marked THEN 3 WHEN heard THEN 2 ELSE 1 END AS stage FROM b)
SELECT chamber, stage, CASE party WHEN 'R' THEN dem > 0 WHEN 'D' THEN rep > 0 ELSE dem > 0 AND rep > 0 END AS both_parties, count(*) AS n,
  CAST(max(CASE WHEN stage <= 3 AND date_diff('day', last, DATE '2000-01-01') >= 30 THEN date_diff('day', last, DATE '2000-01-01') END) AS INTEGER) AS longest FROM s GROUP BY 1, 2, 3""")
def bill_facts(spark, d):
    q = F.col("l_quantity")
    chamber = F.when(F.col("l_suppkey") % 3 == 0, "house").when(F.col("l_suppkey") % 3 == 1, "senate").otherwise("joint")
    party = F.when(F.col("l_partkey") % 3 == 0, "R").when(F.col("l_partkey") % 3 == 1, "D").otherwise("I")
    rows = t(spark, d, "lineitem").withColumns({"chamber": chamber, "both_parties": nested.bipartisan(party, F.col("l_orderkey") % 2, F.col("l_linenumber") % 2)})
    rows = rows.withColumn("stage", nested.bill_stage(F.col("chamber"), (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, q > 40, q > 25, q > 10))
    waited = nested.waiting_days(F.col("stage"), F.col("l_shipdate").cast("date"), F.lit("2000-01-01").cast("date"))
    return rows.groupBy("chamber", "stage", "both_parties").agg(F.count("*").alias("n"), F.max(waited).alias("longest"))


@query("""
SELECT s.user_id AS user_id, coalesce(h.n, c.n, o.n) AS n FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'click')) s
LEFT JOIN (SELECT user_id, nullif(count(*), 3) AS n, true AS there FROM events WHERE event_type = 'view' GROUP BY 1) h ON h.user_id = s.user_id
LEFT JOIN (SELECT user_id, nullif(count(*), 3) AS n FROM events WHERE event_type = 'click' GROUP BY 1) c ON c.user_id = s.user_id AND h.there IS NULL
LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) o ON o.user_id = s.user_id""")
def spliced_feeds(spark, d):
    count = lambda kind: t(spark, d, "events").filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"))
    history, current = (count(k).withColumn("n", F.when(F.col("n") != 3, F.col("n"))) for k in ("view", "click"))
    return unions.spliced(history, current, count("error"), ["user_id"], "n")


@query("SELECT 'customers' AS source, c_nationkey AS nation FROM customer UNION ALL SELECT 'suppliers', s_nationkey FROM supplier")
def union_with_source(spark, d):
    side = lambda name, key: t(spark, d, name).select(F.col(key).alias("nation"))
    return unions.with_provenance(customers=side("customer", "c_nationkey"), suppliers=side("supplier", "s_nationkey"))


# Gates


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT c_acctbal > 0")
def gate_valid(spark, d):
    return details(gates.valid(t(spark, d, "customer"), "balance is positive", F.col("c_acctbal") > 0, "c_custkey", "c_acctbal"), c_custkey="long", c_acctbal="double")


@query("""
WITH p AS (SELECT l_suppkey AS k, CAST(sum(l_quantity) AS BIGINT) AS s, CAST(sum(l_quantity) AS BIGINT) + l_suppkey % 17 AS w FROM lineitem GROUP BY 1)
SELECT arg_max(k, (abs(s - w) / w, k)) AS at, max(abs(s - w) / w) AS gap FROM p""")
def gate_worst_gap(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("long").alias("q"))
    totals = rows.groupBy("k").agg((F.sum("q") + F.max(F.col("k") % 17)).alias("w"))
    return gates.worst_gap(rows, totals, ["k"], "q", "w").select(F.col("at.k").alias("at"), "gap")


@query("""
WITH f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_discount = 0.1 AND l_tax = 0), e AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0)
SELECT 'undocumented' AS rule, k FROM f WHERE k NOT IN (SELECT k FROM e) UNION ALL SELECT 'no longer found', k FROM e WHERE k NOT IN (SELECT k FROM f)""")
def gate_exceptions(spark, d):
    found = t(spark, d, "lineitem").filter("l_discount = 0.1 AND l_tax = 0").select(F.col("l_orderkey").alias("k")).distinct()
    documented = t(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"))
    return gates.known_exceptions(found, documented, ["k"]).select("rule", F.get_json_object("detail", "$.k").cast("long").alias("k"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS ordered, CAST(year(l_shipdate) AS INTEGER) AS shipped FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE ordered <> shipped")
def gate_same_period(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.year("o_orderdate").alias("ordered"), F.year("l_shipdate").alias("shipped"))
    return details(gates.same_period(rows, "ordered", "shipped"), ordered="int", shipped="int")


@query("""
WITH a AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), b AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size <> 7 GROUP BY 1)
SELECT a.p_brand AS p_brand, a.n AS _again, b.n AS _told FROM a LEFT JOIN b ON a.p_brand = b.p_brand WHERE a.n <> coalesce(b.n, 0)""")
def gate_reaggregates(spark, d):
    told = t(spark, d, "part").filter("p_size <> 7").groupBy("p_brand").agg(F.count("*").alias("n"))
    return details(gates.reaggregates(t(spark, d, "part"), told, ["p_brand"], "n"), p_brand="string", _again="long", _told="long")


@query("SELECT avg(CASE WHEN l.doc_id IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM documents d LEFT JOIN labels l USING (doc_id) HAVING share < 0.97")
def gate_match_floor(spark, d):
    both = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id", F.lit(True).alias("hit")), "doc_id", "left")
    return details(gates.match_floor(both, F.col("hit").isNotNull(), 0.97), share="double")


@query("SELECT 'orders' AS name, CAST(count(*) AS VARCHAR) AS found, '7' AS expected FROM orders UNION ALL SELECT 'largest', CAST(max(o_orderkey) AS VARCHAR), '9' FROM orders")
def gate_anchors(spark, d):
    return details(gates.anchors(t(spark, d, "orders"), {"orders": (F.count("*"), 7), "largest": (F.max("o_orderkey"), 9), "least": (F.min("o_orderkey"), 0)}), name="string", found="string", expected="string")


@query(f"SELECT o_orderkey, {DAY} AS day FROM orders WHERE {DAY} NOT BETWEEN DATE '1995-06-01' AND DATE '2001-01-31'")
def gate_within(spark, d):
    rows = t(spark, d, "orders").withColumn("day", day())
    return details(gates.within(rows, "day", F.lit("1995-06-01").cast("date"), F.lit("2001-01-31").cast("date"), "o_orderkey"), o_orderkey="long", day="date")


@query(f"""
WITH m AS ({STATUS_MONTHS}) SELECT a.month AS key, a.n AS low, b.n AS high FROM m a JOIN m b USING (month) WHERE a.series = 'F' AND b.series = 'O' AND a.n > b.n""")
def gate_ordered_pair(spark, d):
    return details(gates.ordered_pair(_status_months(spark, d).withColumnRenamed("month", "key"), "key", "series", "n", "F", "O"), key="date", low="long", high="long")


@query(f"""
SELECT o_custkey, max({DAY}) FILTER (o_orderstatus = 'F') AS last_final, min({DAY}) FILTER (o_orderstatus = 'P') AS first_preliminary FROM orders GROUP BY 1 HAVING last_final > first_preliminary""")
def gate_status_order(spark, d):
    rows = t(spark, d, "orders").select("o_custkey", day().alias("day"), F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "P", "preliminary").alias("status"))
    return details(gates.status_order(rows, ["o_custkey"], "day", "status"), o_custkey="long", last_final="date", first_preliminary="date")


@query("""
SELECT 'references' AS rule, user_id FROM events WHERE user_id NOT IN (SELECT doc_id FROM documents) GROUP BY 2
UNION ALL SELECT 'day within window', user_id FROM events WHERE NOT CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-29'
UNION ALL SELECT 'known kind', user_id FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') UNION ALL SELECT 'quote', user_id FROM events WHERE event_id % 50 = 0""")
def gate_curated(spark, d):
    rows = t(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 50 > 0, F.col("props")).alias("quote"))
    known = t(spark, d, "documents").select(F.col("doc_id").alias("user_id"))
    found = gates.curated(rows, known, "user_id", "day", F.lit("2024-01-03").cast("date"), F.lit("2024-01-29").cast("date"), ["view", "click", "purchase"])
    return found.select("rule", F.get_json_object("detail", "$.user_id").cast("long").alias("user_id"))
