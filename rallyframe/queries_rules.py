"""Registered queries on row rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.operators import gates
from rallyframe.plans.tables import table
from rallyframe.registry import query


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


_KEY = "l_orderkey, l_linenumber"


@query("b2_side_swap", f"SELECT {_KEY}, CASE WHEN l_returnflag = 'R' THEN l_suppkey ELSE l_partkey END AS l_partkey, CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_suppkey END AS l_suppkey, CASE WHEN l_returnflag = 'R' THEN l_tax ELSE l_discount END AS p1_rate, l_quantity AS total FROM lineitem")
def b2(spark: SparkSession, folder: str) -> DataFrame:
    rows = _lines(spark, folder).withColumn("stats", F.create_map(F.lit("p1_rate"), F.col("l_discount"), F.lit("p2_rate"), F.col("l_tax"), F.lit("total"), F.col("l_quantity")))
    swapped = gates.swap_sides(rows, [("l_partkey", "l_suppkey")], "stats", F.col("l_returnflag") == "R")
    return swapped.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("stats")["p1_rate"].alias("p1_rate"), F.col("stats")["total"].alias("total"))


@query("b4_mirror", f"SELECT {_KEY}, 0 - l_quantity AS l_quantity, round(1 - l_discount, 6) AS l_discount, l_extendedprice AS l_tax, l_tax AS l_extendedprice, l_partkey FROM lineitem")
def b4(spark: SparkSession, folder: str) -> DataFrame:
    rows = _lines(spark, folder).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_partkey")
    return gates.mirrored(rows, ["l_quantity"], ["l_discount"], [("l_tax", "l_extendedprice")]).withColumn("l_discount", F.round("l_discount", 6))


@query("b7_provenance", """WITH r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'not_point_in_time' WHEN coalesce(trim(props), '') = '' THEN 'no_source' WHEN ts > TIMESTAMP '2024-01-20' THEN 'too_late' END AS why_not, value FROM events)
SELECT coalesce(why_not, 'ok') AS reason, count(*) AS n, count(CASE WHEN why_not IS NULL THEN value END) AS kept FROM r GROUP BY 1""")
def b7(spark: SparkSession, folder: str) -> DataFrame:
    kept = gates.proven(table(spark, folder, "events"), "value", F.col("event_type") != "error", F.col("props"), F.col("ts"), F.expr("timestamp_ntz '2024-01-20'"))
    return kept.groupBy(F.coalesce("why_not", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), F.count("value").alias("kept"))


_PRICED = "SELECT *, l_quantity / 50 AS p, 1 + l_discount * 20 AS odds FROM lineitem"


def _priced(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).withColumns({"p": F.col("l_quantity") / 50, "odds": 1 + F.col("l_discount") * 20})


@query("b9_price_guardrails", f"SELECT {_KEY}, p * odds - 1 AS ev FROM ({_PRICED}) WHERE odds >= 1.5 AND p - 1 / odds >= 0.05::DOUBLE AND p * odds - 1 > 0.1::DOUBLE")
def b9(spark: SparkSession, folder: str) -> DataFrame:
    rows = _priced(spark, folder)
    return rows.where(gates.priced_well(F.col("p"), F.col("odds"), 1.5, 0.05, 0.1)).select("l_orderkey", "l_linenumber", (F.col("p") * F.col("odds") - 1).alias("ev"))


@query("b10_candidate_gate", f"SELECT {_KEY} FROM ({_PRICED}) WHERE p >= 0.6 AND l_tax >= 0.02::DOUBLE AND least(l_partkey, l_suppkey) >= 4")
def b10(spark: SparkSession, folder: str) -> DataFrame:
    return _priced(spark, folder).where(gates.candidate(F.col("p"), F.col("l_tax"), [F.col("l_partkey"), F.col("l_suppkey")], 0.6, 0.02, 4)).select("l_orderkey", "l_linenumber")


@query("b12_integrity", f"""SELECT {_KEY}, concat_ws(',', CASE WHEN p >= 0.8 AND odds >= 2.5 THEN 'price_inversion' END, CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' THEN 'post_start_quote' END, CASE WHEN p >= 0.8 AND l_linenumber < 2 THEN 'unsubstantiated' END) AS flags FROM ({_PRICED})""")
def b12(spark: SparkSession, folder: str) -> DataFrame:
    flags = gates.integrity_flags(F.col("p"), F.col("odds"), F.col("l_shipdate"), F.expr("timestamp_ntz '1999-01-01'"), F.col("l_linenumber"), inverted=2.5, least_evidence=2)
    return _priced(spark, folder).select("l_orderkey", "l_linenumber", F.array_join(flags, ",").alias("flags"))


@query("b13_visible_feed", """WITH v AS (SELECT event_id, ts, ts - INTERVAL 5 HOUR AS local FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00')
SELECT event_id, false AS stale FROM v WHERE local::DATE = (TIMESTAMP '2024-01-15 07:00:00')::DATE AND (local - INTERVAL 6 HOUR)::DATE = (TIMESTAMP '2024-01-15 01:00:00')::DATE""")
def b13(spark: SparkSession, folder: str) -> DataFrame:
    return gates.visible(table(spark, folder, "events"), "ts", F.expr("timestamp_ntz '2024-01-15 12:00:00'"), "America/New_York").select("event_id", "stale")


@query("b15_exclusion_list", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def b15(spark: SparkSession, folder: str) -> DataFrame:
    gone = _lines(spark, folder).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, folder, "orders").select("o_orderkey").join(gone, "o_orderkey", "left_anti")


@query("b16_fill_missing", f"SELECT {_KEY}, CASE WHEN l_discount > 0.02 THEN l_discount ELSE l_tax END AS rate, l_quantity AS quantity FROM lineitem")
def b16(spark: SparkSession, folder: str) -> DataFrame:
    old = F.create_map(F.lit("rate"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")))
    new = F.create_map(F.lit("rate"), F.col("l_tax"), F.lit("quantity"), F.col("l_quantity"))
    rows = _lines(spark, folder).select("l_orderkey", "l_linenumber", gates.fill_missing(old, new).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", F.col("m")["rate"].alias("rate"), F.col("m")["quantity"].alias("quantity"))


@query("b17_complement", f"SELECT {_KEY}, round(coalesce(CASE WHEN l_returnflag = 'A' THEN l_discount END, CASE WHEN l_tax BETWEEN 0.02 AND 1 THEN 1 - l_tax END), 6) AS rate FROM lineitem")
def b17(spark: SparkSession, folder: str) -> DataFrame:
    rate = gates.complemented(F.when(F.col("l_returnflag") == "A", F.col("l_discount")), F.when(F.col("l_tax") >= 0.02, F.col("l_tax")))
    return _lines(spark, folder).select("l_orderkey", "l_linenumber", F.round(rate, 6).alias("rate"))


@query("b18_sample_weights", "WITH w AS (SELECT o_orderkey, pow(2.0, -(DATE '2001-12-31' - o_orderdate::DATE) / 365.0) AS w FROM orders) SELECT o_orderkey, round(w / avg(w) OVER (), 6) AS weight, round(sum(w) OVER () * sum(w) OVER () / sum(w * w) OVER (), 4) AS ess FROM w")
def b18(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return gates.sample_weights(rows, "day", F.lit("2001-12-31").cast("date"), 365).select("o_orderkey", F.round("weight", 6).alias("weight"), F.round("ess", 4).alias("ess"))


@query("c26_quarantine", "SELECT event_id, count(*) OVER (PARTITION BY user_id, date_trunc('hour', ts)) > 1 AS repeated FROM events")
def c26b(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", F.concat_ws("|", F.col("user_id"), F.date_trunc("hour", "ts")).alias("key"))
    return gates.quarantined(rows, "key").select("event_id", "repeated")


@query("g8_repeated_events", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) = 1 AS kept FROM events")
def g8(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", "ts", F.concat_ws("|", F.col("user_id"), F.col("event_type"), F.to_date("ts")).alias("event"))
    return gates.settled_once(rows, "event", "ts", "event_id").select("event_id", "kept")


@query("h3_calibrators", f"""SELECT {_KEY}, round(1 / (1 + pow((1 - p) / p, 0.8)), 6) AS platt, round(CASE WHEN p < 0.2 THEN 0.1 WHEN p < 0.5 THEN 0.1 + (p - 0.2) * ((0.45 - 0.1) / (0.5 - 0.2)) WHEN p < 0.9 THEN 0.45 + (p - 0.5) * ((0.95 - 0.45) / (0.9 - 0.5)) ELSE 0.95 END, 6) AS isotonic FROM (SELECT *, (l_quantity / 51)::DOUBLE AS p FROM lineitem)""")
def h3(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("l_quantity") / 51
    return _lines(spark, folder).select("l_orderkey", "l_linenumber", F.round(gates.platt(p, 0.8), 6).alias("platt"), F.round(gates.interpolated(p, [(0.2, 0.1), (0.5, 0.45), (0.9, 0.95)]), 6).alias("isotonic"))


_MODEL = {
    "trees": [
        {"feature": "q", "threshold": 25, "left": {"leaf": -0.4}, "right": {"feature": "d", "threshold": 0.05, "missing_left": True, "left": {"leaf": 0.2}, "right": {"leaf": 0.7}}},
        {"feature": "t", "threshold": 0.04, "left": {"leaf": 0.1}, "right": {"leaf": -0.1}},
    ],
    "linear": {"q": 0.02, "d": -3.0}, "intercept": -0.2, "blend": 0.6,
}


@query("h5_portable_scorer", f"""WITH f AS (SELECT {_KEY}, l_quantity AS q, CASE WHEN l_returnflag <> 'A' THEN l_discount END AS d, l_tax AS t FROM lineitem)
SELECT {_KEY}, round(1 / (1 + exp(-(0.6 * (CASE WHEN q <= 25 THEN -0.4 WHEN d IS NULL OR d <= 0.05 THEN 0.2 ELSE 0.7 END + CASE WHEN t <= 0.04 THEN 0.1 ELSE -0.1 END)::DOUBLE + 0.4 * (-0.2 + 0.02 * q - 3.0 * coalesce(d, 0))::DOUBLE))), 6) AS p FROM f""")
def h5(spark: SparkSession, folder: str) -> DataFrame:
    row = {"q": F.col("l_quantity"), "d": F.when(F.col("l_returnflag") != "A", F.col("l_discount")), "t": F.col("l_tax")}
    return _lines(spark, folder).select("l_orderkey", "l_linenumber", F.round(gates.model_score(row, _MODEL), 6).alias("p"))


@query("h7_market_anchored", f"SELECT {_KEY}, round(1 / (1 + exp(-(0.7 * ln(f / (1 - f)) + 0.3 * ln(p / (1 - p))))), 6) AS rank_p FROM (SELECT *, least(greatest(l_quantity / 51, 0.000001), 0.999999)::DOUBLE AS p, least(greatest(0.4 + l_discount, 0.000001), 0.999999)::DOUBLE AS f FROM lineitem)")
def h7(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("l_orderkey", "l_linenumber", F.round(gates.anchored(F.col("l_quantity") / 51, 0.4 + F.col("l_discount"), 0.7), 6).alias("rank_p"))


@query("k8_bounded_price", f"SELECT {_KEY}, round(3.0 + (greatest(least(l_quantity / 50, 0.9), 0.5) - 0.5) / (0.9 - 0.5) * (1.2 - 3.0), 6) AS price FROM lineitem")
def k8(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("l_orderkey", "l_linenumber", F.round(gates.bounded_price(F.col("l_quantity") / 50, 0.5, 0.9, 3.0, 1.2), 6).alias("price"))


@query("k9_step_margin", f"SELECT {_KEY}, CASE WHEN l_quantity < 4 THEN 1.0 WHEN l_quantity < 8 THEN 1.5 ELSE 2.0 END::DOUBLE AS margin FROM lineitem")
def k9(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("l_orderkey", "l_linenumber", gates.stepped(F.col("l_quantity"), [(4, 1.0), (8, 1.5)], 2.0).alias("margin"))


@query("k11_unique_id", "SELECT l_orderkey, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS supplier FROM lineitem GROUP BY 1")
def k11(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).groupBy("l_orderkey").agg(gates.only_value(F.col("l_suppkey")).alias("supplier"))


@query("d9_custom_bins", "SELECT CASE WHEN p < 0.55 THEN 0 WHEN p < 0.6 THEN 1 WHEN p < 0.65 THEN 2 WHEN p < 0.7 THEN 3 WHEN p < 0.8 THEN 4 ELSE 5 END::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM (SELECT l_quantity / 50 AS p, (l_returnflag = 'R')::INT AS y FROM lineitem) WHERE p BETWEEN 0.5 AND 1 GROUP BY 1")
def d9(spark: SparkSession, folder: str) -> DataFrame:
    rows = _lines(spark, folder).select((F.col("l_quantity") / 50).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    bins = rows.withColumn("bin", gates.banded(F.col("p"), [0.5, 0.55, 0.6, 0.65, 0.7, 0.8, 1])).where("bin is not null")
    return bins.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("rate"))
