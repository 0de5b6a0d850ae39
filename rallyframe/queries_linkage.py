"""Registered queries on linking and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.operators import linkage
from rallyframe.plans.tables import table
from rallyframe.registry import query


@query("c1_one_to_one", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey WHERE o_orderkey % 7 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def c1(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").where("o_orderkey % 7 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    known = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return linkage.one_to_one(orders, known, ["o_custkey"]).select("o_orderkey", "o_custkey", "c_name")


@query("c2_settlement_join", "SELECT l_orderkey, l_linenumber, o_orderstatus, l_quantity * (o_orderstatus = 'F')::INT AS settled FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def c2(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return table(spark, folder, "lineitem").join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", "o_orderstatus", (F.col("l_quantity") * (F.col("o_orderstatus") == "F").cast("int")).alias("settled"))


@query("c3_routed", """WITH k AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o.o_orderkey, CASE WHEN k.o_orderkey IS NULL THEN 'new' WHEN k.o_totalprice = o.o_totalprice AND k.o_orderstatus = o.o_orderstatus THEN 'matched' ELSE 'conflict' END AS route FROM orders o LEFT JOIN k USING (o_orderkey)""")
def c3(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    known = orders.where("o_orderkey % 3 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return linkage.routed(orders, known, ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).select("o_orderkey", "route")


@query("c5_stream_parity", """WITH c AS (SELECT k, sum(x) AS x, sum(y) AS y FROM (SELECT l_orderkey AS k, 1 AS x, 0 AS y FROM lineitem UNION ALL SELECT o_orderkey, 0, 2 FROM orders WHERE o_orderkey % 4 <> 0) GROUP BY 1)
SELECT 'first' AS side, sum(greatest(x - y, 0))::BIGINT AS n FROM c UNION ALL SELECT 'second', sum(greatest(y - x, 0))::BIGINT FROM c UNION ALL SELECT 'both', sum(least(x, y))::BIGINT FROM c""")
def c5(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"))
    return linkage.stream_parity(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k")), orders.union(orders), ["k"])


@query("c6_possible_duplicates", """WITH e AS (SELECT event_id, event_type, user_id % 6 AS a, (user_id * 7 + event_id // 2) % 6 AS b, ts FROM events)
SELECT event_id FROM e WHERE event_id % 2 = 0 AND EXISTS (SELECT 1 FROM e k WHERE k.event_id % 2 = 1 AND k.event_type = e.event_type AND least(k.a, k.b) = least(e.a, e.b) AND greatest(k.a, k.b) = greatest(e.a, e.b)
  AND abs(epoch(date_trunc('second', k.ts))::BIGINT - epoch(date_trunc('second', e.ts))::BIGINT) <= 43200)""")
def c6(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "event_type", (F.col("user_id") % 6).alias("a"), ((F.col("user_id") * 7 + F.floor(F.col("event_id") / 2)) % 6).alias("b"), "ts")
    return linkage.possible_duplicates(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["event_type"], "a", "b", "ts", 12).select("event_id")


@query("c9_momentum", """WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
n AS (SELECT c.event_id, c.user_id, c.ts, p.ts AS seen_at, p.value AS v FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts > p.ts),
m AS (SELECT n.*, o.value AS w FROM (SELECT *, seen_at - INTERVAL 7 DAY AS lagged FROM n) n ASOF LEFT JOIN p o ON n.user_id = o.user_id AND n.lagged >= o.ts)
SELECT event_id, round(ln(1 + v) - ln(1 + w), 6) AS momentum FROM m""")
def c9(spark: SparkSession, folder: str) -> DataFrame:
    from rallyframe.operators import joins

    events = table(spark, folder, "events")
    facts = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("v"))
    now = joins.asof(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), facts, ["user_id"], "ts", "ts", ["v"], "400 days")
    lagged = now.select("event_id", "user_id", "v", (F.col("asof_time") - F.expr("interval 7 days")).alias("lagged"))
    then = joins.asof(lagged, facts.withColumnRenamed("v", "w"), ["user_id"], "lagged", "ts", ["w"], "400 days", strict=False)
    return then.select("event_id", F.round(F.log1p("v") - F.log1p("w"), 6).alias("momentum"))


@query("c11_shifted_season", "WITH s AS (SELECT o_custkey, year(o_orderdate)::INT AS year, sum(o_totalprice) AS spent FROM orders GROUP BY 1, 2) SELECT o_orderkey, round(spent, 2) AS spent FROM orders o LEFT JOIN s ON s.o_custkey = o.o_custkey AND s.year = year(o.o_orderdate) - 1")
def c11(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    seasons = orders.groupBy("o_custkey", "year").agg(F.sum("o_totalprice").alias("spent"))
    return linkage.shifted_season(orders, seasons, ["o_custkey"], "year", ["spent"]).select("o_orderkey", F.round("spent", 2).alias("spent"))


_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_INITIAL = "substr({0}, 1, 1) || ' ' || list_last(string_split({0}, ' '))"


@query("c13_crosswalk", f"""WITH n AS (SELECT p_partkey AS asked, CASE WHEN p_partkey % 3 = 0 THEN substr(p_name, 1, 1) || substr(p_name, instr(p_name, ' ')) ELSE upper(p_name) END AS name FROM part),
k AS (SELECT p_partkey AS id, {_PLAIN.format("p_name")} AS k FROM part WHERE p_partkey % 5 <> 0), x AS (SELECT k, min(id) AS id FROM k GROUP BY 1 HAVING count(DISTINCT id) = 1),
l AS (SELECT {_INITIAL.format("k")} AS k, min(id) AS id FROM k GROUP BY 1 HAVING count(DISTINCT id) = 1), o AS (SELECT *, {_PLAIN.format("name")} AS p FROM n)
SELECT asked, coalesce(x.id, l.id) AS p_partkey, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN l.id IS NOT NULL THEN 'initial' END AS how FROM o LEFT JOIN x ON x.k = o.p LEFT JOIN l ON l.k = {_INITIAL.format("o.p")}""")
def c13(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    short = F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, instr(p_name, ' '))"))
    names = part.select(F.col("p_partkey").alias("asked"), F.when(F.col("p_partkey") % 3 == 0, short).otherwise(F.upper("p_name")).alias("name"))
    return linkage.crosswalk(names, part.where("p_partkey % 5 <> 0").select("p_partkey", "p_name"), "name", "p_name", "p_partkey").select("asked", "p_partkey", "how")


@query("c15_scored_link", """WITH a AS (SELECT event_id AS a, user_id, ts, value AS x FROM events WHERE event_type = 'view'), b AS (SELECT event_id AS b, user_id, ts AS t, value AS y FROM events WHERE event_type = 'purchase'),
m AS (SELECT a, b, 1.0::DOUBLE / (1 + abs(epoch(date_trunc('second', ts))::BIGINT - epoch(date_trunc('second', t))::BIGINT) / 3600.0::DOUBLE) AS score FROM a JOIN b USING (user_id) WHERE ts::DATE = t::DATE),
g AS (SELECT * FROM m WHERE score >= 0.1), n AS (SELECT *, max(score) OVER (PARTITION BY a) AS top FROM g),
s AS (SELECT a, arg_max(b, score) AS b, max(score) AS score FROM n GROUP BY a HAVING count(*) FILTER (top - score <= 0.02) = 1) SELECT a, b, round(score, 6) AS score FROM s QUALIFY count(*) OVER (PARTITION BY b) = 1""")
def c15(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts")).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    a = events.where("event_type = 'view'").select("user_id", "day", F.col("event_id").alias("a"), "s")
    b = events.where("event_type = 'purchase'").select("user_id", "day", F.col("event_id").alias("b"), F.col("s").alias("t"))
    score = 1.0 / (1 + F.abs(F.col("s") - F.col("t")) / 3600.0)
    return linkage.scored_link(a, b, ["user_id", "day"], "a", "b", score, 0.1, 0.02).select("a", "b", F.round("score", 6).alias("score"))


@query("c23_canonical_merge", """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS note FROM orders WHERE o_orderkey % 5 <> 0),
n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 > 0 THEN 'N' END AS status, o_totalprice + 1 AS price, 'new' AS note FROM orders WHERE o_orderkey % 3 <> 0)
SELECT k, coalesce(n.status, o.status) AS status, coalesce(n.price, o.price) AS price, coalesce(o.note, n.note) AS note, CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'old' ELSE 'merged' END AS origin FROM o FULL JOIN n USING (k)""")
def c23(spark: SparkSession, folder: str) -> DataFrame:
    orders, k = table(spark, folder, "orders"), F.col("o_orderkey")
    old = orders.where("o_orderkey % 5 <> 0").select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.when(k % 4 > 0, F.col("o_orderpriority")).alias("note"))
    new = orders.where("o_orderkey % 3 <> 0").select(k.alias("k"), F.when(k % 6 > 0, F.lit("N")).alias("status"), (F.col("o_totalprice") + 1).alias("price"), F.lit("new").alias("note"))
    return linkage.merged(old, new, ["k"], ["status", "price"], ["note"])


@query("c29_interval_link", """WITH q AS (SELECT event_id, user_id, ts, epoch(date_trunc('second', ts))::BIGINT AS s FROM events WHERE event_type = 'view'), p AS (SELECT event_id AS pick, user_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events WHERE event_type = 'purchase'),
m AS (SELECT q.event_id, min(pick) AS pick, any_value(q.s) AS qs, min(p.s) AS ps FROM q JOIN p ON q.user_id = p.user_id AND abs(q.s - p.s) <= 21600 GROUP BY 1 HAVING count(DISTINCT pick) = 1) SELECT event_id, pick FROM m WHERE qs < ps""")
def c29(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    picks = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pick"), F.col("ts").alias("start"))
    return linkage.interval_link(events.where("event_type = 'view'").select("event_id", "user_id", "ts"), picks, ["user_id"], "ts", "start", "pick", 21600).select("event_id", "pick")


@query("c31_conservation", """SELECT count(*) FILTER (b.k IS NULL) AS lost, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND a.c <> b.c) AS changed, count(*) FILTER (a.k IS NULL) AS added
FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey % 9 <> 0) a FULL JOIN (SELECT o_orderkey AS k, o_custkey + (o_orderkey % 10 = 0)::INT AS c FROM orders WHERE o_orderkey % 8 <> 0) b ON a.k = b.k""")
def c31(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return linkage.conserved(orders.where("k % 9 <> 0"), orders.where("k % 8 <> 0").withColumn("c", F.col("c") + (F.col("k") % 10 == 0).cast("int")), "k", ["c"])


@query("c32_lookup", "SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON n_nationkey = c_nationkey")
def c32(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return linkage.mapped(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), nations, "c_nationkey", "nation", F.lit("unknown")).select("c_custkey", "nation")


@query("c35_pairs_in_bucket", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 5")
def c35(spark: SparkSession, folder: str) -> DataFrame:
    return linkage.pairs_in_bucket(table(spark, folder, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_partkey", "p_retailprice", 5.0)


@query("g10_unique_across_years", "SELECT o_custkey, min(year(o_orderdate))::INT AS first_part, max(year(o_orderdate))::INT AS last_part FROM orders GROUP BY 1 HAVING min(year(o_orderdate)) <> max(year(o_orderdate))")
def g10(spark: SparkSession, folder: str) -> DataFrame:
    return linkage.unique_across(table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("year")), "o_custkey", "year")


@query("i1_reconcile_ledger", """WITH l AS (SELECT o_orderkey AS k, o_orderstatus AS pick, o_orderdate AS issued, CASE WHEN o_orderkey % 6 = 0 THEN 'settled' ELSE 'open' END AS status, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 12 = 0 END AS won FROM orders WHERE o_orderkey % 4 = 0),
f AS (SELECT l_orderkey AS k, arg_min(l_linestatus, (l_shipdate, l_linestatus)) AS pick, min(l_shipdate) AS issued, min(l_linestatus) AS lo, max(l_linestatus) AS hi FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1), r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE 'O' END AS winner FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT coalesce(l.k, f.k) AS k, coalesce(l.pick, f.pick) AS pick, coalesce(l.issued, f.issued) AS issued, l.status, l.won, f.lo, f.hi, r.winner FROM l FULL JOIN f ON l.k = f.k LEFT JOIN r ON r.k = coalesce(l.k, f.k)),
n AS (SELECT *, CASE WHEN winner IS NOT NULL THEN winner = pick ELSE won END AS now FROM b)
SELECT k, pick, issued, CASE WHEN coalesce(lo <> pick OR hi <> pick, false) THEN 'conflict' WHEN winner IS NULL THEN coalesce(status, 'open') WHEN won IS NOT NULL AND won <> now THEN 'corrected' ELSE 'settled' END AS status, now AS won FROM n""")
def i1(spark: SparkSession, folder: str) -> DataFrame:
    orders, k = table(spark, folder, "orders"), F.col("o_orderkey")
    ledger = orders.where("o_orderkey % 4 = 0").select(k.alias("k"), F.col("o_orderstatus").alias("pick"), F.col("o_orderdate").alias("issued"), F.when(k % 6 == 0, "settled").otherwise("open").alias("status"), F.when(k % 6 == 0, k % 12 == 0).alias("won"))
    made = table(spark, folder, "lineitem").where("l_shipdate is not null").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("pick"), F.col("l_shipdate").alias("issued"))
    results = orders.where("o_orderkey % 2 = 0").select(k.alias("k"), F.when(k % 3 == 0, "F").otherwise("O").alias("winner"))
    return linkage.reconciled(ledger, made, results, "k")


@query("i4_carry_forward", """WITH b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INT AS place FROM customer WHERE c_custkey % 3 = 0), t AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey)::INT AS place FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM b UNION ALL SELECT c_custkey, ((SELECT max(place) FROM b) + row_number() OVER (ORDER BY place, c_custkey))::INT FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM b)""")
def i4(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    customers = table(spark, folder, "customer")
    before = customers.where("c_custkey % 3 = 0").select("c_custkey", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("place"))
    today = customers.where("c_custkey % 2 = 0").select("c_custkey", F.row_number().over(Window.orderBy("c_custkey")).alias("place"))
    return linkage.carried_forward(today, before, "c_custkey", "place")


@query("k15_confirmed_only", "SELECT o_orderkey FROM orders WHERE sha256(o_orderkey || '|' || o_custkey) IN (SELECT sha256(o_orderkey || '|' || (o_custkey + o_orderkey % 2)) FROM orders WHERE o_orderkey % 3 = 0)")
def k15(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    manifest = orders.where("o_orderkey % 3 = 0").select(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), (F.col("o_custkey") + F.col("o_orderkey") % 2).cast("string")), 256).alias("digest"))
    return linkage.confirmed_only(orders, manifest, ["o_orderkey", "o_custkey"]).select("o_orderkey")


@query("k35_merged_outcomes", """WITH c AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), l AS (SELECT l_orderkey AS k, max(l_linestatus) AS v FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
SELECT coalesce(c.k, l.k) AS k, CASE WHEN c.k IS NOT NULL AND l.k IS NOT NULL AND c.v <> l.v THEN NULL WHEN c.k IS NULL THEN l.v ELSE c.v END AS v, CASE WHEN c.k IS NOT NULL AND l.k IS NOT NULL AND c.v <> l.v THEN 'conflict' WHEN c.k IS NULL THEN 'ledger' ELSE 'canonical' END AS how FROM c FULL JOIN l ON c.k = l.k""")
def k35(spark: SparkSession, folder: str) -> DataFrame:
    canonical = table(spark, folder, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    ledger = table(spark, folder, "lineitem").where("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("v"))
    return linkage.merged_outcomes(canonical, ledger, "k", "v")


@query("s7_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)")
def s7(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    gone = events.where("event_type = 'error' and value > 150").select("user_id").distinct()
    return linkage.without_tombstones(events, gone, "user_id", "ts", F.expr("timestamp_ntz '2024-01-30'"), 240).select("event_id")


@query("s4_latest_status", "SELECT user_id, arg_max(event_type, (event_type IN ('purchase', 'error'), ts, event_type)) AS event_type, coalesce(max(ts) FILTER (event_type IN ('purchase', 'error')), max(ts)) AS since FROM events GROUP BY 1")
def s4(spark: SparkSession, folder: str) -> DataFrame:
    return linkage.latest_status(table(spark, folder, "events").select("user_id", "ts", "event_type"), "user_id", "ts", "event_type", ["purchase", "error"])
