"""Registered queries of the core library: each applies an operator to whole tables, with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions import stats, text
from rallyframe.operators import history, joins, metrics, rows, selection
from rallyframe.plans.tables import table
from rallyframe.registry import ORACLES, QUERIES
from rallyframe.registry import query as _query
from rallyframe.streaming import peaks

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

FLAGSHIP = "d10_betting_metrics"


@_query("a1_scan_before", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' AND o_orderkey IS NOT NULL")
def a1(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").where("o_orderdate < timestamp_ntz '1995-06-01' and o_orderkey is not null").select("o_orderkey", "o_orderdate", "o_totalprice")


@_query("a6_manifest", "SELECT year(o_orderdate)::INT AS year, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last FROM orders GROUP BY 1")
def a6(spark: SparkSession, folder: str) -> DataFrame:
    from rallyframe.sources.snapshots import manifest

    return manifest(table(spark, folder, "orders").withColumn("year", F.year("o_orderdate")), "o_orderdate")


@_query("b3_orientation", "SELECT o_orderkey, ('0x' || substr(sha256(o_orderkey::VARCHAR), 16, 1))::INT % 2 = 1 AS swapped FROM orders")
def b3(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", stats.odd_digest(F.col("o_orderkey")).alias("swapped"))


_GATE_SQL = "CASE WHEN l_quantity < 5 THEN 'small' WHEN l_discount > 0.08 THEN 'discount' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'ok' END"


def _gate() -> dict:
    return {"small": F.col("l_quantity") < 5, "discount": F.col("l_discount") > 0.08, "returned": F.col("l_returnflag") == "R"}


@_query("b5_gate_reasons", f"SELECT {_GATE_SQL} AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def b5(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(rows.first_reason(_gate()).alias("reason")).agg(F.count("*").alias("n"))


@_query(
    "b11_rejection_reasons",
    "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity < 5 THEN 'small' END, CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS reasons FROM lineitem",
)
def b11(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(rows.all_reasons(_gate()), ",").alias("reasons"))


@_query("c4_customers_without_late_orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')")
def c4(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").join(table(spark, folder, "orders").where("o_orderdate >= timestamp_ntz '2000-01-01'").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@_query(
    "c7_asof_purchase",
    """SELECT e.event_id, e.user_id, e.ts, CASE WHEN p.ts >= e.ts - INTERVAL 2 DAY THEN p.value END AS last_value, CASE WHEN p.ts >= e.ts - INTERVAL 2 DAY THEN p.ts END AS asof_time
    FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts > p.ts""",
)
def c7(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    facts = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return joins.asof(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), facts, ["user_id"], "ts", "ts", ["last_value"], "2 days")


@_query(
    "c10_nearest_event",
    """SELECT e.event_id, arg_min(p.event_id, (abs(epoch(date_trunc('second', e.ts))::BIGINT - epoch(date_trunc('second', p.ts))::BIGINT), p.ts, p.event_id)) AS near_id
    FROM (SELECT * FROM events WHERE event_type = 'click') e LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON e.user_id = p.user_id AND abs(epoch(date_trunc('second', e.ts))::BIGINT - epoch(date_trunc('second', p.ts))::BIGINT) <= 86400 GROUP BY 1""",
)
def c10(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    found = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("near_id"), "event_id")
    return joins.nearest(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), found.select("user_id", "at", "near_id"), ["user_id"], "ts", "at", ["near_id"], 86400, "near_id").select("event_id", "near_id")


@_query(
    "c12_unique_name",
    """WITH k AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS k, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1)
    SELECT p.p_partkey AS left_id, k.id AS p_partkey FROM part p LEFT JOIN k ON k.k = trim(regexp_replace(lower(p.p_name), '[^a-z0-9]+', ' ', 'g'))""",
)
def c12(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return joins.unique_key_join(part.select(F.col("p_partkey").alias("left_id"), F.col("p_name").alias("name")), part, text.plain_name(F.col("name")), text.plain_name(F.col("p_name")), "p_partkey").select("left_id", "p_partkey")


@_query(
    "c19_mutual_pairs",
    "SELECT l_orderkey, l_linenumber, count(*) OVER w = 2 AND bool_and(l_linestatus = 'O') OVER w AS mutual FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)",
)
def c19(spark: SparkSession, folder: str) -> DataFrame:
    return joins.mutual_pairs(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus"), ["l_orderkey"], F.col("l_linestatus") == "O").select("l_orderkey", "l_linenumber", "mutual")


@_query("c26_repeated_keys", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def c26(spark: SparkSession, folder: str) -> DataFrame:
    return rows.repeated(table(spark, folder, "orders"), ["o_custkey", "o_orderpriority"])


_W = "1.959963984540054"
_BETTING_SQL = f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate, l_linenumber) AS k FROM lineitem),
g AS (SELECT l_linestatus, l_shipdate IS NULL OR l_tax = 0 AS void, l_returnflag = 'R' AS won, l_quantity AS stake, 1 + l_discount * 10 AS odds FROM d WHERE k = 1),
a AS (SELECT l_linestatus, count(*) AS n, count(*) FILTER (NOT void AND won) AS wins, count(*) FILTER (NOT void AND NOT won) AS losses, count(*) FILTER (void) AS voids,
  coalesce(sum(stake) FILTER (NOT void), 0) AS staked, sum(CASE WHEN void THEN 0 WHEN won THEN stake * (odds - 1) ELSE -stake END) AS profit, avg(odds) FILTER (NOT void) AS avg_odds FROM g GROUP BY 1),
p AS (SELECT *, wins + losses AS m, wins / (wins + losses) AS r FROM a)
SELECT l_linestatus, n, wins, losses, voids, round(r, 6) AS hit_rate,
  round((r + {_W} * {_W} / (2 * m) - {_W} * sqrt(r * (1 - r) / m + {_W} * {_W} / (4.0 * m * m))) / (1 + {_W} * {_W} / m), 6) AS ci_low,
  round((r + {_W} * {_W} / (2 * m) + {_W} * sqrt(r * (1 - r) / m + {_W} * {_W} / (4.0 * m * m))) / (1 + {_W} * {_W} / m), 6) AS ci_high,
  round(staked, 4) AS staked, round(profit, 4) AS profit, round(profit / staked, 6) AS roi, round(avg_odds, 6) AS avg_odds FROM p"""


@_query("d10_betting_metrics", _BETTING_SQL)
def d10(spark: SparkSession, folder: str) -> DataFrame:
    issued = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_linestatus", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    earliest = rows.one_of_each(issued, ["l_orderkey", "l_partkey"], [F.col("l_shipdate"), F.col("l_linenumber")])
    return metrics.betting(earliest, ["l_linestatus"], F.col("l_returnflag") == "R", F.col("l_shipdate").isNull() | (F.col("l_tax") == 0), F.col("l_quantity"), 1 + F.col("l_discount") * 10)


_P_SQL = "SELECT n_chars / (n_chars + 1000.0::DOUBLE) AS p, quality::DOUBLE AS y, lang, source FROM documents JOIN labels USING (doc_id)"


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    both = table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source").join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
    return both.select((F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("p"), F.col("quality").cast("double").alias("y"), "lang", "source")


@_query("d5_calibration_bins", f"SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM ({_P_SQL}) GROUP BY 1")
def d5(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.calibration(_scored(spark, folder), F.col("p"), F.col("y"))


@_query(
    "d4_scores",
    f"""WITH b AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, sum(p) AS p, sum(y) AS y, count(*) FILTER ((p >= 0.5) = (y = 1)) AS r, sum((p - y) * (p - y)) AS s, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) AS l FROM ({_P_SQL}) GROUP BY 1)
    SELECT sum(n)::BIGINT AS n, round(sum(r) / sum(n), 6) AS accuracy, round(sum(s) / sum(n), 6) AS brier, round(sum(l) / sum(n), 6) AS log_loss, round(sum(abs(p - y)) / sum(n), 6) AS ece FROM b""",
)
def d4(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.scores(_scored(spark, folder), F.col("p"), F.col("y"))


_THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]


@_query(
    "d7_selective_accuracy",
    f"""WITH s AS ({_P_SQL}), t AS (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in _THRESHOLDS)}]) AS threshold)
    SELECT threshold, count(*) FILTER (greatest(p, 1 - p) >= threshold) AS n,
    round(count(*) FILTER (greatest(p, 1 - p) >= threshold AND (p >= 0.5) = (y = 1)) / nullif(count(*) FILTER (greatest(p, 1 - p) >= threshold), 0), 6) AS accuracy,
    round(count(*) FILTER (greatest(p, 1 - p) >= threshold) / count(*), 6) AS coverage FROM s CROSS JOIN t GROUP BY 1""",
)
def d7(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.selective(_scored(spark, folder), F.col("p"), F.col("y"), _THRESHOLDS)


@_query(
    "d3_one_way_reports",
    f"""SELECT dimension, value, count(*) AS n, round(avg(y), 6) AS rate, count(*) < 50 AS small_sample FROM (SELECT 'lang' AS dimension, lang AS value, y FROM ({_P_SQL}) UNION ALL SELECT 'source', source, y FROM ({_P_SQL})) GROUP BY 1, 2""",
)
def d3(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.one_way(_scored(spark, folder), ["lang", "source"], F.col("y"))


@_query(
    "d12_trailing_windows",
    """WITH m AS (SELECT max(ts) AS now FROM events), d AS (SELECT unnest([3, 7, 10, 14, 30]) AS days)
    SELECT days, count(*) AS n, round(avg(value), 6) AS mean_value FROM events, m, d WHERE epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)) <= days * 86400 GROUP BY 1""",
)
def d12(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return metrics.trailing(events.select("ts", "value"), "ts", events.agg(F.max("ts")).scalar(), [3, 7, 10, 14, 30], F.col("value"))


@_query("d15_event_analytics", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts, round(median(value), 6) AS median_value FROM events GROUP BY 1")
def d15(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.median("value"), 6).alias("median_value")
    )


@_query("d29_missing_rates", "SELECT 'value' AS name, round(avg((value IS NULL)::INT), 6) AS missing FROM events UNION ALL SELECT 'props', round(avg((props IS NULL)::INT), 6) FROM events")
def d29(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.missing_rates(table(spark, folder, "events"), ["value", "props"])


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("share"))


_DAILY_SQL = "SELECT user_id, ts::DATE AS day, count(*) AS n, avg((event_type = 'purchase')::INT) AS share FROM events GROUP BY 1, 2"


@_query(
    "e7_form_before_day",
    f"""SELECT user_id, day::VARCHAR AS day, count(share) OVER w AS n_before, round((2 + coalesce(sum(share) OVER w, 0)) / (4 + count(share) OVER w), 6) AS form
    FROM ({_DAILY_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
)
def e7(spark: SparkSession, folder: str) -> DataFrame:
    return history.form(_daily(spark, folder), ["user_id"], "day", F.col("share")).select("user_id", F.col("day").cast("string").alias("day"), "n_before", "form")


@_query(
    "e10_rest_days",
    f"""SELECT user_id, day::VARCHAR AS day, CASE WHEN lag(day) OVER w IS NULL THEN 14 ELSE least(day - lag(day) OVER w, 180) END::INT AS rest_days FROM ({_DAILY_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY day)""",
)
def e10(spark: SparkSession, folder: str) -> DataFrame:
    return history.rest_days(_daily(spark, folder), ["user_id"], "day").select("user_id", F.col("day").cast("string").alias("day"), "rest_days")


@_query("e17_running_best", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS best_so_far FROM orders")
def e17(spark: SparkSession, folder: str) -> DataFrame:
    return history.running_best(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "best_so_far")


@_query(
    "e21_mid_rank",
    "SELECT p_partkey, round(CASE WHEN count(*) OVER g <= 1 THEN 1 ELSE (rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2) / (count(*) OVER g - 1) END, 6) AS mid_rank FROM part WINDOW g AS (PARTITION BY p_brand)",
)
def e21(spark: SparkSession, folder: str) -> DataFrame:
    return history.mid_rank(table(spark, folder, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size").select("p_partkey", "mid_rank")


@_query("e22_top_per_priority", "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 10")
def e22(spark: SparkSession, folder: str) -> DataFrame:
    return selection.top_n(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10).select("o_orderkey", "o_orderpriority", F.col("place").cast("long").alias("place"))


@_query(
    "e24_split_by_day",
    """WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders))
    SELECT CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.85) THEN 'calibration' ELSE 'test' END AS part, count(*) AS n FROM orders JOIN d ON d.day = o_orderdate::DATE GROUP BY 1""",
)
def e24(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return history.split_by_day(days, "day").groupBy("part").agg(F.count("*").alias("n"))


@_query(
    "f3_threshold_cascade",
    """WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, o_totalprice AS v FROM orders),
    c AS (SELECT y, CASE WHEN count(*) FILTER (v >= 400000) >= 40 THEN 400000.0 WHEN count(*) FILTER (v >= 300000) >= 40 THEN 300000.0 ELSE 200000.0 END::DOUBLE AS threshold FROM o GROUP BY 1)
    SELECT o_orderkey, threshold FROM o JOIN c USING (y) WHERE v >= threshold""",
)
def f3(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), "o_totalprice")
    return selection.cascade(orders, ["y"], F.col("o_totalprice"), [200000.0, 300000.0, 400000.0], 40).select("o_orderkey", "threshold")


@_query(
    "f5_exclusive_sections",
    """WITH a AS (SELECT o_orderkey, o_orderdate::DATE AS day, 'prime' AS section, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_totalprice >= 200000 QUALIFY place <= 2),
    b AS (SELECT o_orderkey, o_orderdate::DATE AS day, 'urgent' AS section, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT o_orderkey FROM a) QUALIFY place <= 1)
    SELECT o_orderkey, day::VARCHAR AS day, section, place FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
)
def f5(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderpriority")
    sections = [("prime", F.col("o_totalprice") >= 200000, 2), ("urgent", F.col("o_orderpriority") == "1-URGENT", 1)]
    picked = selection.exclusive_sections(orders, "o_orderkey", "day", sections, [F.desc("o_totalprice"), F.col("o_orderkey")])
    return picked.select("o_orderkey", F.col("day").cast("string").alias("day"), "section", F.col("place").cast("long").alias("place"))


@_query("f9_fixed_sample", "SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(c_custkey::VARCHAR || '|day1')) <= 5")
def f9(spark: SparkSession, folder: str) -> DataFrame:
    return selection.fixed_sample(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], [F.col("c_custkey"), F.lit("day1")], 5).select("c_custkey", "c_mktsegment")


@_query("f10_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def f10(spark: SparkSession, folder: str) -> DataFrame:
    return selection.page(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 2)


@_query("g4_earliest_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def g4(spark: SparkSession, folder: str) -> DataFrame:
    return rows.one_of_each(table(spark, folder, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@_query(
    "g7_first_capture",
    """WITH f AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1994-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
    SELECT * FROM f UNION ALL (SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM f) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)""",
)
def g7(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    frozen = rows.one_of_each(orders.where("o_orderdate < timestamp_ntz '1994-01-01'"), ["o_custkey"], [F.col("o_orderkey")])
    return rows.first_capture(frozen, orders, ["o_custkey"], [F.col("o_orderkey")]).drop("o_orderdate")


@_query(
    "g9_conflicts",
    "SELECT l_orderkey, l_suppkey, l_linenumber, count(DISTINCT l_returnflag) OVER (PARTITION BY l_orderkey, l_suppkey) > 1 AS conflict FROM lineitem",
)
def g9(spark: SparkSession, folder: str) -> DataFrame:
    return rows.with_conflicts(table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_suppkey"], ["l_returnflag"]).drop("l_returnflag")


@_query(
    "d31_set_compare",
    """SELECT CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS change, count(*) AS n
    FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01') b USING (k) GROUP BY 1""",
)
def d31(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    before = orders.where("o_orderkey % 5 <> 0").select("o_orderkey", F.col("o_totalprice").alias("v"))
    after = orders.where("o_orderdate < timestamp_ntz '1997-01-01'").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("v"))
    return rows.compared(before, after, ["o_orderkey"], "v")


@_query("s2_running_peak", "SELECT user_id, max(value) AS peak, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1")
def s2(spark: SparkSession, folder: str) -> DataFrame:
    return peaks.peaks(table(spark, folder, "events"), ["user_id"], "ts", "value")


# the other query modules register theirs on import
from rallyframe import queries_evidence, queries_history, queries_linkage, queries_platform, queries_reports, queries_rules, queries_selection, queries_significance, queries_training, queries_upkeep  # noqa: E402, F401
