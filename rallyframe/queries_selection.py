"""Registered queries on ranking, selection and single values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions import values
from rallyframe.operators import selection
from rallyframe.plans.tables import table
from rallyframe.registry import query

_CARDS = "SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, o_orderpriority, o_orderstatus = 'F' AS won, o_totalprice AS v FROM orders"


def _cards(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority", (F.col("o_orderstatus") == "F").alias("won"), F.col("o_totalprice").alias("v"))


def _order() -> list:
    return [F.desc("v"), F.col("o_orderkey")]


@query("f2_ranked", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(CASE WHEN event_type = 'purchase' THEN value END, 0) DESC, value DESC, event_id)::INT AS place FROM events")
def f2(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", "user_id", "value", F.when(F.col("event_type") == "purchase", F.col("value")).alias("spent"))
    return selection.ranked(rows, ["user_id"], ["spent", "value"], [F.col("event_id")]).select("event_id", "place")


@query("f4_tiers", f"SELECT o_orderkey, CASE WHEN v >= 400000 AND won THEN 0 WHEN v >= 300000 THEN 1 WHEN o_orderpriority = '1-URGENT' THEN 2 END::INT AS tier FROM ({_CARDS})")
def f4(spark: SparkSession, folder: str) -> DataFrame:
    tier = selection.first_tier([(F.col("v") >= 400000) & F.col("won"), F.col("v") >= 300000, F.col("o_orderpriority") == "1-URGENT"])
    return _cards(spark, folder).select("o_orderkey", tier.alias("tier"))


@query("f6_filled", f"""WITH k AS (SELECT *, CASE WHEN v >= 400000 THEN 0 WHEN v >= 200000 THEN 1 END AS kind FROM ({_CARDS})), p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY kind, v DESC, o_orderkey)::INT AS place FROM k WHERE kind IS NOT NULL)
SELECT o_orderkey, place, CASE WHEN kind = 0 THEN 'core' ELSE 'fallback' END AS source FROM p WHERE kind = 0 OR place <= 3""")
def f6(spark: SparkSession, folder: str) -> DataFrame:
    return selection.filled(_cards(spark, folder), ["day"], F.col("v") >= 400000, F.col("v") >= 200000, _order(), 3).select("o_orderkey", "place", "source")


@query("f7_one_per_event", f"""WITH t AS (SELECT *, CASE WHEN v >= 300000 THEN 0 WHEN v >= 150000 THEN 1 END::INT AS tier, o_custkey % 40 AS event, year(day) AS y FROM ({_CARDS})), b AS (SELECT * FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY y, event ORDER BY tier, v DESC, o_orderkey) = 1)
SELECT o_orderkey, tier, row_number() OVER (PARTITION BY y ORDER BY tier, v DESC, o_orderkey)::INT AS place FROM b QUALIFY place <= 15""")
def f7(spark: SparkSession, folder: str) -> DataFrame:
    rows = _cards(spark, folder).withColumns({"event": F.col("o_custkey") % 40, "y": F.year("day")})
    tier = F.when(F.col("v") >= 300000, 0).when(F.col("v") >= 150000, 1)
    return selection.one_per_event(rows, ["y"], "event", tier, _order(), 15).select("o_orderkey", "tier", "place")


@query("f8_sections", f"""WITH c AS (SELECT *, CASE WHEN v >= 450000 THEN 0 WHEN v >= 350000 THEN 1 END AS s0, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND v >= 250000 THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 END AS s1, CASE WHEN won THEN 0 END AS s2 FROM ({_CARDS})),
a AS (SELECT o_orderkey, 'prime' AS section, row_number() OVER (PARTITION BY day ORDER BY s0, v DESC, o_orderkey)::INT AS place FROM c WHERE s0 IS NOT NULL QUALIFY place <= 2),
b AS (SELECT o_orderkey, 'urgent' AS section, row_number() OVER (PARTITION BY day ORDER BY s1, v DESC, o_orderkey)::INT AS place FROM c WHERE s1 IS NOT NULL AND o_orderkey NOT IN (SELECT o_orderkey FROM a) QUALIFY place <= 1),
r AS (SELECT * FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a UNION ALL SELECT o_orderkey FROM b) AND (s2 IS NOT NULL OR v >= 100000)),
d AS (SELECT o_orderkey, 'value' AS section, row_number() OVER (PARTITION BY day ORDER BY coalesce(s2, 1048576), v DESC, o_orderkey)::INT AS place, s2 FROM r QUALIFY (s2 IS NOT NULL AND place <= 4) OR (s2 IS NULL AND place <= 3))
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT o_orderkey, section, place FROM d""")
def f8(spark: SparkSession, folder: str) -> DataFrame:
    v, yes = F.col("v"), F.lit(True)
    rules = [
        ("prime", yes, [v >= 450000, v >= 350000], 2),
        ("urgent", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), [v >= 250000, F.col("o_orderpriority") == "1-URGENT"], 1),
        ("value", yes, [F.col("won")], 4),
    ]
    return selection.sections(_cards(spark, folder), "o_orderkey", "day", rules, _order(), v >= 100000, 3).select("o_orderkey", "section", "place")


@query("f11_newest", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def f11(spark: SparkSession, folder: str) -> DataFrame:
    return selection.newest(table(spark, folder, "events").select("event_id", "ts"), "ts", "event_id", 25)


@query("f12_daily_anchor", "SELECT ts::DATE::VARCHAR AS day, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE hour(ts) >= 6 GROUP BY 1")
def f12(spark: SparkSession, folder: str) -> DataFrame:
    return selection.daily_anchor(table(spark, folder, "events"), "ts", "event_id").withColumn("day", F.col("day").cast("string"))


@query("f13_equal_capacity", f"""WITH c AS (SELECT *, v >= 350000 AS a, o_orderpriority = '1-URGENT' AS b FROM ({_CARDS})), n AS (SELECT day, least(count(*) FILTER (a), count(*) FILTER (b)) AS n FROM c GROUP BY 1),
x AS (SELECT day, won, row_number() OVER (PARTITION BY day ORDER BY v DESC, o_orderkey) AS p FROM c WHERE a), y AS (SELECT day, won, row_number() OVER (PARTITION BY day ORDER BY o_orderkey) AS p FROM c WHERE b)
SELECT day::VARCHAR AS day, n, (SELECT count(*) FROM x WHERE x.day = n.day AND p <= n AND won) AS wins_first, (SELECT count(*) FROM y WHERE y.day = n.day AND p <= n AND won) AS wins_second FROM n WHERE n > 0""")
def f13(spark: SparkSession, folder: str) -> DataFrame:
    out = selection.equal_capacity(_cards(spark, folder), "day", F.col("v") >= 350000, F.col("o_orderpriority") == "1-URGENT", _order(), [F.col("o_orderkey")], F.col("won"))
    return out.withColumn("day", F.col("day").cast("string"))


@query("k2_text_search", """WITH f AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS n, p_retailprice AS w FROM part WHERE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) LIKE '%re%'),
t AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN n = 're' THEN 0 WHEN n LIKE 're%' THEN 1 ELSE 2 END, w DESC, n, p_partkey)::INT AS place FROM f QUALIFY place <= 30) SELECT p_partkey, place, count(*) OVER (PARTITION BY n) > 1 AS ambiguous FROM t""")
def k2(spark: SparkSession, folder: str) -> DataFrame:
    from rallyframe.functions.text import plain_name

    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    return selection.text_search(part, plain_name(F.col("p_name")), "re", "p_retailprice", "p_partkey", 30).select("p_partkey", "place", "ambiguous")


@query("k3_budgeted", """WITH e AS (SELECT event_id, event_type = 'purchase' AND value > 100 AS pri, (epoch(date_trunc('second', ts))::BIGINT - epoch(TIMESTAMP '2024-01-10')::BIGINT) / 3600.0::DOUBLE AS h, value FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'),
b AS (SELECT *, CASE WHEN pri THEN -1 WHEN h <= 3 THEN 0 WHEN h <= 12 THEN 1 WHEN h <= 24 THEN 2 WHEN h <= 48 THEN 3 ELSE 4 END::INT AS band FROM e), t AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY value DESC, event_id) AS t FROM b)
SELECT event_id, band FROM t ORDER BY band >= 0, band = 4, CASE WHEN band >= 0 THEN t ELSE 0 END, band, value DESC, event_id LIMIT 40""")
def k3(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").where("ts > timestamp_ntz '2024-01-10' and ts < timestamp_ntz '2024-01-13'")
    hours = (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.expr("timestamp_ntz '2024-01-10'").cast("timestamp"))) / 3600
    return selection.budgeted(rows.select("event_id", "event_type", "value", "ts"), (F.col("event_type") == "purchase") & (F.col("value") > 100), hours, [3, 12, 24, 48], [F.desc("value"), F.col("event_id")], 40).select("event_id", "band")


@query("b8_whitelist", "SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN '{}' ELSE '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' END AS props FROM events")
def b8(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", values.whitelisted(F.col("props"), ["k", "missing"]).alias("props"))


@query("b14_redaction", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS c_acctbal, CASE WHEN c_nationkey < 10 THEN c_name ELSE 'hidden' END AS c_name FROM customer")
def b14(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", values.redacted(F.col("c_acctbal"), F.col("c_mktsegment") == "BUILDING").alias("c_acctbal"), values.redacted(F.col("c_name"), F.col("c_nationkey") < 10, F.lit("hidden")).alias("c_name"))


@query("s8_journal", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 48 HOUR ORDER BY ts DESC, event_id DESC LIMIT 100")
def s8(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "ts")
    last = events.agg((F.max("ts") - F.expr("interval 48 hours")).alias("t")).scalar()
    return selection.newest(events.where(F.col("ts") > last), "ts", "event_id", 100).select("event_id")


@query("e3_pooled_rating", "SELECT user_id, round(count(*) / (count(*) + 8.0) * avg(value) + (1 - count(*) / (count(*) + 8.0)) * (SELECT avg(value) FROM events), 6) AS rating FROM events GROUP BY 1")
def e3(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    overall = events.agg(F.avg("value")).scalar()
    return events.groupBy("user_id").agg(F.avg("value").alias("own"), F.count("*").alias("n")).select("user_id", F.round(values.pooled(F.col("own"), overall, F.col("n")), 6).alias("rating"))
