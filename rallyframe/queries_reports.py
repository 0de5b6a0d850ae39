"""Registered queries on reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.operators import metrics, reports
from rallyframe.plans.tables import table
from rallyframe.registry import query

_BETS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate, l_quantity / 51 AS p, l_returnflag = 'R' AS won, (l_returnflag = 'R')::INT AS y, 1 + l_discount * 20 AS odds, l_quantity AS stake, l_tax FROM lineitem"


def _bets(spark: SparkSession, folder: str) -> DataFrame:
    won = F.col("l_returnflag") == "R"
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", (F.col("l_quantity") / 51).alias("p"), won.alias("won"), won.cast("int").alias("y"), (1 + F.col("l_discount") * 20).alias("odds"), F.col("l_quantity").alias("stake"), "l_tax")


@query("d2_group_metrics", f"SELECT l_suppkey, count(*) AS n, round(avg(((p >= 0.5) = (y = 1))::INT), 6) AS accuracy, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(greatest(p, 1 - p)), 6) AS confidence FROM ({_BETS}) GROUP BY 1 HAVING count(*) >= 50")
def d2(spark: SparkSession, folder: str) -> DataFrame:
    return reports.group_metrics(_bets(spark, folder), ["l_suppkey"], F.col("p"), F.col("y"))


@query("d11_slices", f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(y), 6) AS hit_rate, round(sum(CASE WHEN won THEN stake * (odds - 1) ELSE -stake END), 4) AS profit, grouping_id(l_returnflag, l_linestatus)::INT AS level FROM ({_BETS}) GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))")
def d11(spark: SparkSession, folder: str) -> DataFrame:
    return reports.slices(_bets(spark, folder), ["l_returnflag", "l_linestatus"], F.col("won"), F.col("stake"), F.col("odds"))


@query("d12_best_window", """WITH m AS (SELECT max(ts) AS now FROM events), d AS (SELECT unnest([3, 7, 10, 14, 30, 180, 365]) AS days),
w AS (SELECT days, count(*) AS n, round(avg(value), 6) AS mean_value FROM events, m, d WHERE epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)) <= days * 86400 GROUP BY 1) SELECT * FROM w WHERE n >= 30 ORDER BY mean_value DESC, days LIMIT 1""")
def d12b(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return reports.best_window(metrics.trailing(events.select("ts", "value"), "ts", events.agg(F.max("ts")).scalar(), [3, 7, 10, 14, 30, 180, 365], F.col("value")))


@query("d20_points_per_side", "SELECT l_orderkey, count(*) FILTER (l_quantity > 5 AND l_suppkey % 2 = 0) AS p1_points, count(*) FILTER (l_quantity > 5 AND l_suppkey % 2 = 0 AND l_returnflag = 'R') AS p1_won, count(*) FILTER (l_quantity > 5 AND l_suppkey % 2 = 1) AS p2_points, count(*) FILTER (l_quantity > 5 AND l_suppkey % 2 = 1 AND l_returnflag = 'R') AS p2_won, count(*) FILTER (l_quantity <= 5) AS invalid FROM lineitem GROUP BY 1")
def d20(spark: SparkSession, folder: str) -> DataFrame:
    return reports.per_side(table(spark, folder, "lineitem"), ["l_orderkey"], F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(2), F.col("l_returnflag") == "R", F.col("l_quantity") > 5)


@query("d21_totals_agree", "WITH t AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS quantity, count(*) AS lines FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(abs(t.quantity - (t.quantity + (o_orderkey % 10 = 0)::INT)) < 0.000001, false) AS agrees FROM orders LEFT JOIN t USING (o_orderkey)")
def d21(spark: SparkSession, folder: str) -> DataFrame:
    detail = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    totals = {"quantity": F.sum("l_quantity"), "lines": F.count("*")}
    summary = table(spark, folder, "orders").select("o_orderkey").join(detail.groupBy("o_orderkey").agg(*[c.alias(n) for n, c in totals.items()]), "o_orderkey", "left").withColumn("quantity", F.col("quantity") + (F.col("o_orderkey") % 10 == 0).cast("int"))
    return reports.totals_agree(detail, summary, ["o_orderkey"], totals).select("o_orderkey", "agrees")


@query("d23_baselines", "WITH b AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS baseline FROM orders GROUP BY 1, 2) SELECT o_orderkey, round(o_totalprice / baseline, 6) AS ratio FROM orders JOIN b USING (o_orderpriority, o_orderstatus)")
def d23(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    base = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("baseline"))
    return orders.join(base, ["o_orderpriority", "o_orderstatus"]).select("o_orderkey", F.round(F.col("o_totalprice") / F.col("baseline"), 6).alias("ratio"))


@query("d24_most_common", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1")
def d24(spark: SparkSession, folder: str) -> DataFrame:
    return reports.most_common(table(spark, folder, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id")


@query("d26_pooled_rates", """WITH b AS (SELECT least(floor(p * 20), 19)::INT AS bin, count(*) AS n, avg(p) AS s, (sum(l_tax * 10 >= 5 * p) + 2.0::DOUBLE) / (count(*) + 4.0::DOUBLE) AS r FROM (SELECT l_tax, (l_quantity / 51)::DOUBLE AS p FROM lineitem) GROUP BY 1 HAVING count(*) >= 60),
m AS (SELECT x.bin AS i, y.bin AS j, sum(z.n * z.r) / sum(z.n) AS mean FROM b x JOIN b y ON y.bin >= x.bin JOIN b z ON z.bin BETWEEN x.bin AND y.bin GROUP BY 1, 2),
l AS (SELECT b.bin, i, min(mean) AS low FROM b JOIN m ON i <= b.bin AND j >= b.bin GROUP BY 1, 2) SELECT bin, round(any_value(s), 6) AS score, round(max(low), 6) AS rate FROM l JOIN b USING (bin) GROUP BY 1""".replace("sum(l_tax * 10 >= 5 * p)", "count(*) FILTER (l_tax * 10 >= 5 * p)"))
def d26(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select((F.col("l_quantity") / 51).alias("p"), "l_tax")
    found = reports.pooled_rates(rows, F.col("p"), (F.col("l_tax") * 10 >= 5 * F.col("p")).cast("int"))
    return found.select("bin", F.round("score", 6).alias("score"), F.round("rate", 6).alias("rate"))


@query("d27_paired_difference", f"WITH d AS (SELECT l_suppkey, (p - y) * (p - y) - (0.5 - y) * (0.5 - y) AS d FROM ({_BETS})), g AS (SELECT l_suppkey, count(d) AS n, avg(d) AS m, stddev_samp(d) AS s FROM d GROUP BY 1) SELECT l_suppkey, n, round(m, 6) AS difference, CASE WHEN n >= 30 THEN round(m - 1.96 * s / sqrt(n), 6) END AS low, CASE WHEN n >= 30 THEN round(m + 1.96 * s / sqrt(n), 6) END AS high FROM g")
def d27(spark: SparkSession, folder: str) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    return reports.paired_difference(_bets(spark, folder), ["l_suppkey"], (p - y) * (p - y), (0.5 - y) * (0.5 - y))


#: Where a Poisson(1) number goes one up, greatest first.
_POISSON = " ".join(f"WHEN u >= {sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r}::DOUBLE THEN {k + 1}" for k in range(7, -1, -1))


@query("d28_cluster_bootstrap", f"""WITH c AS (SELECT l_shipdate::DATE AS day, sum((p - y) * (p - y) - (0.5 - y) * (0.5 - y)) AS x, count(*)::DOUBLE AS n FROM ({_BETS}) WHERE l_shipdate IS NOT NULL GROUP BY 1),
u AS (SELECT c.*, r, ('0x' || substr(md5('s:' || r || ':' || day), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM c, (SELECT unnest(range(1, 201)) AS r)),
w AS (SELECT *, CASE {_POISSON} ELSE 0 END AS k FROM u), d AS (SELECT r, sum(k * x) / sum(k * n) AS d FROM w GROUP BY 1)
SELECT (SELECT count(*) FROM c) AS clusters, round((SELECT sum(x) / sum(n) FROM c), 6) AS difference, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM d""")
def d28(spark: SparkSession, folder: str) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    rows = _bets(spark, folder).where("l_shipdate is not null").withColumn("day", F.to_date("l_shipdate"))
    return reports.cluster_bootstrap(rows, "day", (p - y) * (p - y), (0.5 - y) * (0.5 - y))


@query("d30_fingerprint", """WITH d AS (SELECT sha256(o_orderkey || '|' || o_custkey) AS d FROM orders), s AS (SELECT count(*) AS n, sum(('0x' || substr(d, 1, 8))::BIGINT)::VARCHAR AS a, sum(('0x' || substr(d, 9, 8))::BIGINT)::VARCHAR AS b FROM d)
SELECT n, sha256(n || '|' || a || '|' || b) AS fingerprint FROM s""")
def d30(spark: SparkSession, folder: str) -> DataFrame:
    return reports.fingerprint(table(spark, folder, "orders"), ["o_orderkey", "o_custkey"])


@query("d34_key_inventory", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def d34(spark: SparkSession, folder: str) -> DataFrame:
    return reports.key_inventory(table(spark, folder, "events"), "props")


@query("k1_flat_stakes", f"""WITH b AS (SELECT *, CASE WHEN l_tax > 0.01 THEN won END AS w FROM ({_BETS})) SELECT l_linestatus, count(*) AS published, count(w) AS settled, count(*) FILTER (w) AS wins, round(avg(CASE WHEN w THEN odds - 1 WHEN NOT w THEN -1 END), 6) AS yield,
round(avg(p) FILTER (w IS NOT NULL), 6) AS confidence, round(avg(w::INT) - avg(p) FILTER (w IS NOT NULL), 6) AS gap, round(avg((p - w::INT) * (p - w::INT)), 6) AS brier, count(w) < 100 AS small_sample FROM b GROUP BY 1""")
def k1(spark: SparkSession, folder: str) -> DataFrame:
    rows = _bets(spark, folder).withColumn("w", F.when(F.col("l_tax") > 0.01, F.col("won")))
    return reports.flat_stakes(rows, ["l_linestatus"], F.col("p"), F.col("w"), F.col("odds"))


@query("k5_input_diagnostics", """WITH l AS (SELECT l_returnflag, unnest(['quantity', 'discount', 'tax', 'none']) AS feature, unnest([l_quantity, l_discount, l_tax, 0.0]) AS x FROM lineitem)
SELECT l_returnflag, feature, count(*) AS finite, min(x) AS least, max(x) AS greatest, count(*) FILTER (x <> 0) AS nonzero, round(var_pop(x), 4) AS variance, min(x) = max(x) AS dead FROM l GROUP BY 1, 2""")
def k5(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.lit(0.0).alias("none"))
    return reports.input_diagnostics(rows, ["l_returnflag"], ["quantity", "discount", "tax", "none"])


@query("k24_profile", """WITH m AS (SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1), k AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2)
SELECT m.*, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM m JOIN k USING (user_id) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY m.user_id, n, mean, median, p90"))
def k24(spark: SparkSession, folder: str) -> DataFrame:
    return reports.profile(table(spark, folder, "events").select("user_id", "value", "event_type"), ["user_id"], "value", "event_type")


@query("k25_what_if", f"""WITH b AS (SELECT *, CASE WHEN won THEN odds - 1 ELSE -1 END AS profit FROM ({_BETS})), r AS (SELECT 'sure' AS rule, p >= 0.7 AS keep, won, profit FROM b UNION ALL SELECT 'cheap', odds <= 2, won, profit FROM b)
SELECT rule, count(*) FILTER (NOT keep) AS removed, count(*) FILTER (NOT keep AND NOT won) AS losses_prevented, count(*) FILTER (NOT keep AND won) AS wins_given_up, round(avg(profit) FILTER (keep) - avg(profit), 6) AS yield_change FROM r GROUP BY 1""")
def k25(spark: SparkSession, folder: str) -> DataFrame:
    rows = _bets(spark, folder)
    return reports.what_if(rows, F.col("won"), F.when(F.col("won"), F.col("odds") - 1).otherwise(-1.0), {"sure": F.col("p") >= 0.7, "cheap": F.col("odds") <= 2})


@query("k27_funnel", f"""WITH f AS (SELECT unnest([0.5, 0.7, 0.9]) AS floor), b AS ({_BETS})
SELECT floor::DOUBLE AS floor, g.place, g.gate, count(*) FILTER (p >= floor AND (g.place < 1 OR odds >= 1.4) AND (g.place < 2 OR l_tax > 0.03)) AS left FROM b, f, (SELECT unnest([0, 1, 2])::INT AS place, unnest(['floor', 'odds', 'tax']) AS gate) g GROUP BY 1, 2, 3""".replace("AS left FROM", 'AS "left" FROM'))
def k27(spark: SparkSession, folder: str) -> DataFrame:
    return reports.funnel(_bets(spark, folder), F.col("p"), [0.5, 0.7, 0.9], {"odds": F.col("odds") >= 1.4, "tax": F.col("l_tax") > 0.03})


@query("k32_calendar_gaps", "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_orderkey % 13 = 0) SELECT s.day::VARCHAR AS day FROM (SELECT unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day) s ANTI JOIN d ON d.day = s.day")
def k32(spark: SparkSession, folder: str) -> DataFrame:
    return reports.calendar_gaps(table(spark, folder, "orders").where("o_orderkey % 13 = 0"), "o_orderdate").select(F.col("day").cast("string").alias("day"))


@query("k32_thin_years", "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE o_orderkey % 13 = 0) SELECT year(d)::INT AS year, count(*) AS days, (max(d) - min(d) + 1)::INT AS span, max(d) - min(d) + 1 >= 14 AND count(*) < 0.5 * (max(d) - min(d) + 1) AS suspicious FROM d GROUP BY 1")
def k32b(spark: SparkSession, folder: str) -> DataFrame:
    return reports.thin_years(table(spark, folder, "orders").where("o_orderkey % 13 = 0"), "o_orderdate")


@query("k33_signal_split", """WITH s AS (SELECT event_id, ts::DATE AS day FROM events WHERE event_type <> 'error' AND value < 100), d AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM s))
SELECT event_id, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'calibration' ELSE 'test' END AS part FROM s JOIN d USING (day)""")
def k33(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return reports.signal_split(rows, "day", F.col("event_type") != "error", F.col("value"), F.lit(100.0)).select("event_id", "part")


@query("k7_positions", "WITH p AS (SELECT event_id, user_id, ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY value DESC, event_id)::INT AS place FROM events WHERE event_type = 'view') SELECT event_id, place, row_number() OVER (PARTITION BY day, user_id ORDER BY place) > 1 AS repeated FROM p")
def k7(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").where("event_type = 'view'").select("event_id", "user_id", F.to_date("ts").alias("day"), "value")
    return reports.running_positions(rows, "day", [F.desc("value"), F.col("event_id")], "user_id").select("event_id", "place", "repeated")


@query("d3_with_intervals", f"WITH g AS (SELECT l_suppkey, count(won) AS n, count(*) FILTER (won) AS wins FROM ({_BETS}) GROUP BY 1), r AS (SELECT *, wins / n AS r, 1.959963984540054 AS z FROM g) SELECT l_suppkey, n, wins, round(r, 6) AS rate, round(greatest((r + z * z / (2 * n) - z * sqrt(r * (1 - r) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 0), 6) AS low, round(least((r + z * z / (2 * n) + z * sqrt(r * (1 - r) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 1), 6) AS high FROM r")
def d3b(spark: SparkSession, folder: str) -> DataFrame:
    return reports.with_interval(_bets(spark, folder), ["l_suppkey"], F.col("won"))
