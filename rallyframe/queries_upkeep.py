"""Registered queries on the upkeep of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.operators import upkeep
from rallyframe.plans.tables import table
from rallyframe.registry import query


@query("b1_stored_rows", "SELECT event_id, lower(trim(event_type)) AS event_type, CASE WHEN event_id % 3 = 0 THEN '' ELSE user_id::VARCHAR END AS user, CASE WHEN event_id % 4 = 0 THEN '{}' ELSE '{\"k\":' || user_id || '}' END AS props FROM events")
def b1(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")
    rows = table(spark, folder, "events").select(key, F.concat(F.lit(" "), F.upper("event_type")).alias("event_type"), F.when(key % 3 != 0, F.col("user_id")).alias("user"), F.when(key % 4 != 0, F.struct(F.col("user_id").alias("k"))).alias("props"))
    return upkeep.stored(rows, ["event_type"], ["user"], ["props"])


@query("k13_enriched", """WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey::DOUBLE END AS b FROM orders),
i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice + 0.001 END AS a, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey + (o_orderkey % 2) * 0.4 END AS b FROM orders WHERE o_orderkey % 3 <> 0)
SELECT c.k, coalesce(c.a, i.a) AS a, coalesce(c.b, i.b) AS b, (c.a IS NULL AND i.a IS NOT NULL)::INT + (c.b IS NULL AND i.b IS NOT NULL)::INT AS filled, coalesce(abs(c.a - i.a) > 0.01, false)::INT + coalesce(abs(c.b - i.b) > 0.5, false)::INT AS conflicts FROM c LEFT JOIN i ON i.k = c.k""")
def k13(spark: SparkSession, folder: str) -> DataFrame:
    orders, key = table(spark, folder, "orders"), F.col("o_orderkey")
    own = orders.select(key.alias("k"), F.when(key % 4 != 0, F.col("o_totalprice")).alias("a"), F.when(key % 5 != 0, F.col("o_custkey").cast("double")).alias("b"))
    new = orders.where("o_orderkey % 3 <> 0").select(key.alias("k"), F.when(key % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") + 0.001).alias("a"), F.when(key % 11 != 0, F.col("o_custkey") + key % 2 * 0.4).alias("b"))
    return upkeep.enriched(own, new, "k", {"a": 0.01, "b": 0.5})


@query("k14_consistent_parts", """WITH p AS (SELECT o_custkey AS c, year(o_orderdate) AS y, o_orderstatus AS s, count(*) AS n, count(*) FILTER (o_totalprice > 250000) AS w, count(*) FILTER (o_totalprice <= 250000) + CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END AS l FROM orders GROUP BY 1, 2, 3),
t AS (SELECT o_custkey AS c, year(o_orderdate) AS y, count(*) + CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS n FROM orders WHERE o_custkey % 10 <> 0 GROUP BY 1, 2), g AS (SELECT c, y, count(*) AS parts, bool_or(w + l <> n) AS wrong, sum(n) AS n FROM p GROUP BY 1, 2)
SELECT g.c, g.y::INT AS y, parts, CASE WHEN wrong THEN 'part' WHEN t.n IS NULL THEN 'no_total' WHEN t.n <> g.n THEN 'total' END AS reason FROM g LEFT JOIN t ON t.c = g.c AND t.y = g.y""")
def k14(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y"), "o_orderstatus", (F.col("o_totalprice") > 250000).alias("won"))
    off = lambda k: F.when(F.col("c") % k == 0, 1).otherwise(0)
    parts = orders.groupBy("c", "y", "o_orderstatus").agg(F.count("*").alias("n"), F.count_if("won").alias("w"), F.count_if(~F.col("won")).alias("l")).withColumn("l", F.col("l") + off(13))
    totals = orders.where("c % 10 <> 0").groupBy("c", "y").agg(F.count("*").alias("n"), F.count_if("won").alias("w"), F.count_if(~F.col("won")).alias("l")).withColumn("n", F.col("n") + off(7))
    return upkeep.consistent(parts, totals, ["c", "y"], ["w", "l"], "n")


@query("k16_day_projection", "SELECT l_orderkey, l_linenumber AS id, l_quantity AS q FROM lineitem WHERE l_shipdate::DATE = DATE '1998-06-02' AND l_linenumber <> 3")
def k16(spark: SparkSession, folder: str) -> DataFrame:
    # an order's few lines become the items of its row
    lines = table(spark, folder, "lineitem")
    rows = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("q"))).alias("items"))
    found = upkeep.day_projection(rows, "items", F.col("item.day") == F.lit("1998-06-02").cast("date"), spark.range(1).select(F.lit(3).alias("id")), "id")
    return found.select("l_orderkey", "item.id", "item.q")


@query("k17_overridden", """WITH l AS (SELECT user_id, arg_max(value, (ts, value)) AS value, count(*) AS n FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY 1)
SELECT c_custkey AS user_id, coalesce(l.value, c_acctbal) AS value, l.n IS NOT NULL AS bridged FROM customer LEFT JOIN l ON l.user_id = c_custkey""")
def k17(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select(F.col("c_custkey").cast("long").alias("user_id"), F.col("c_acctbal").alias("value"))
    return upkeep.overridden(rows, table(spark, folder, "events").where("event_type = 'purchase'"), "user_id", ["value"], "ts")


@query("k20_pruned", "SELECT event_type, count(*) FILTER (fresh) AS kept, count(*) FILTER (NOT fresh) AS dropped FROM (SELECT event_type, epoch(date_trunc('second', ts)) >= epoch(TIMESTAMP '2024-01-20 00:00:00') - 3600 * CASE event_type WHEN 'click' THEN 48 WHEN 'error' THEN 12 ELSE 240 END AS fresh FROM events) GROUP BY 1")
def k20(spark: SparkSession, folder: str) -> DataFrame:
    return upkeep.pruned(table(spark, folder, "events"), "event_type", "ts", F.lit("2024-01-20 00:00:00"), {"click": 48, "error": 12}, 240)[1]


@query("i6_settled_pairs", """WITH p AS (SELECT o_orderkey AS k, o_orderdate AS tm, ['A', 'N', 'R'][o_orderkey % 3 + 1] AS pick FROM orders),
n AS (SELECT p.k, CASE WHEN l_quantity >= 45 THEN NULL ELSE l_returnflag END AS w FROM p JOIN lineitem ON l_orderkey = p.k AND l_quantity > 30 AND abs(epoch(l_shipdate) - epoch(tm)) <= 24 * 3600 * 300),
o AS (SELECT k, count(DISTINCT coalesce(w, '')) AS c, max(w) AS w FROM n GROUP BY 1)
SELECT p.k, CASE WHEN c IS NULL THEN 'pending' WHEN c > 1 THEN 'ambiguous' WHEN w IS NULL THEN 'void' ELSE 'settled' END AS status, CASE WHEN c = 1 AND w IS NOT NULL THEN pick = w END AS correct FROM p LEFT JOIN o ON o.k = p.k""")
def i6(spark: SparkSession, folder: str) -> DataFrame:
    pending = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("tm"), F.get(F.lit(["A", "N", "R"]), (F.col("o_orderkey") % 3).cast("int")).alias("pick"))
    results = table(spark, folder, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("tm"), F.when(F.col("l_quantity") < 45, F.col("l_returnflag")).alias("winner"))
    return upkeep.settled_pairs(pending, results, "k", "tm", "pick", 24 * 300).select("k", "status", "correct")


@query("h11_audit", """SELECT unnest(['priced', 'dated', 'known_status', 'small_discount']) AS "check", unnest([count(*) FILTER (NOT coalesce(l_extendedprice > 0, false)), count(*) FILTER (NOT coalesce(l_shipdate >= TIMESTAMP '1995-02-01', false)), count(*) FILTER (NOT coalesce(l_returnflag IN ('A', 'N', 'R'), false)), count(*) FILTER (NOT coalesce(l_discount < 0.09, false))]) AS violations,
  unnest([count(*) FILTER (NOT coalesce(l_extendedprice > 0, false)) = 0, count(*) FILTER (NOT coalesce(l_shipdate >= TIMESTAMP '1995-02-01', false)) = 0, count(*) FILTER (NOT coalesce(l_returnflag IN ('A', 'N', 'R'), false)) = 0, count(*) FILTER (NOT coalesce(l_discount < 0.09, false)) = 0]) AS passed FROM lineitem""")
def h11(spark: SparkSession, folder: str) -> DataFrame:
    checks = {"priced": F.col("l_extendedprice") > 0, "dated": F.col("l_shipdate") >= F.expr("timestamp_ntz '1995-02-01 00:00:00'"), "known_status": F.col("l_returnflag").isin("A", "N", "R"), "small_discount": F.col("l_discount") < 0.09}
    return upkeep.audited(table(spark, folder, "lineitem"), checks)


@query("e26_form_of_events", "WITH k AS (SELECT user_id, value > 40 AS won, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type <> 'error') SELECT user_id, count(*) AS n, count(*) FILTER (won) AS wins, round(avg(won::INT), 6) AS share FROM k WHERE k <= 35 GROUP BY 1")
def e26(spark: SparkSession, folder: str) -> DataFrame:
    return upkeep.form_of_events(table(spark, folder, "events"), "user_id", "ts", "event_id", F.col("event_type") != "error", F.col("value") > 40)


_H8 = "SELECT flag, '{0}' AS variant, count(*) AS n, round(avg(pow({1} - y, 2)), 6) AS brier, round(avg(-(y * ln(greatest({1}, 1e-15)) + (1 - y) * ln(1 - {1}))), 6) AS log_loss, round(avg({1}) - avg(y), 6) AS gap FROM r GROUP BY 1 HAVING count(*) >= 100"


@query("h8_variant_scores", f"WITH r AS (SELECT l_linenumber AS flag, (l_returnflag = 'R')::INT AS y, l_quantity / 60 AS a, CASE WHEN l_linenumber <> 2 THEN 0.3 + l_discount END AS b FROM lineitem WHERE l_linenumber <> 2) {_H8.format('quantity', 'a')} UNION ALL {_H8.format('discount', 'b')}")
def h8(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("flag"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 60).alias("a"), F.when(F.col("l_linenumber") != 2, 0.3 + F.col("l_discount")).alias("b"))
    return upkeep.variant_scores(rows, ["flag"], F.col("y"), {"quantity": F.col("a"), "discount": F.col("b")}, 100)


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('open', 'cup')))"


@query("k23_names_alike", f"""WITH p AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 5 WHEN 0 THEN p_name || ' Open' WHEN 1 THEN 'cup of ' || p_name WHEN 2 THEN replace(p_name, 'e', 'a') WHEN 3 THEN p_type ELSE 'Open Cup' END AS b FROM part),
w AS (SELECT p_partkey, {_WORDS.format('a')} AS x, {_WORDS.format('b')} AS y FROM p), t AS (SELECT *, array_to_string(x, ' ') AS s, array_to_string(y, ' ') AS t FROM w)
SELECT p_partkey, len(x) > 0 AND len(y) > 0 AND (list_has_all(y, x) OR list_has_all(x, y) OR 1 - levenshtein(s, t) / greatest(length(s), length(t)) >= 0.86) AS alike FROM t""")
def k23(spark: SparkSession, folder: str) -> DataFrame:
    name, k = F.col("p_name"), F.col("p_partkey") % 5
    other = F.when(k == 0, F.concat(name, F.lit(" Open"))).when(k == 1, F.concat(F.lit("cup of "), name)).when(k == 2, F.translate(name, "e", "a")).when(k == 3, F.col("p_type")).otherwise("Open Cup")
    return table(spark, folder, "part").select("p_partkey", upkeep.names_alike(name, other, ["open", "cup"]).alias("alike"))
