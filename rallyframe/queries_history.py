"""Registered queries on point-in-time features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.operators import history
from rallyframe.plans.tables import table
from rallyframe.registry import query

_ROWS = "SELECT event_id, user_id, ts::DATE AS day, event_type, value, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END::DOUBLE AS won FROM events"
#: Pairs of a row and each row of its last 80 of earlier days.
_RECENT = f"""e AS ({_ROWS}), p AS (SELECT a.event_id, a.day AS today, b.day, b.value, b.won, b.event_type, (a.day - b.day) AS age, row_number() OVER (PARTITION BY a.event_id ORDER BY b.day DESC, b.event_id DESC) AS k
  FROM e a JOIN e b ON a.user_id = b.user_id AND b.day < a.day AND b.day >= a.day - 400), r AS (SELECT * FROM p WHERE k <= 80)"""


def _events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", "value", (F.col("event_type") == "purchase").cast("double").alias("won"))


def _recent(spark: SparkSession, folder: str, **made: Column) -> DataFrame:
    """Each event's id with what is made of the recent history of its user's day."""
    events = _events(spark, folder)
    days = history.recent(events, ["user_id"], "day", "event_id", ["value", "won", "event_type"])
    return events.select("event_id", "user_id", "day").join(days.select("user_id", "day", *[v.alias(c) for c, v in made.items()]), ["user_id", "day"])


@query("d17_decayed_mean_with_prior", f"WITH {_RECENT} SELECT e.event_id, round((0.5 * 4 + coalesce(sum(pow(2.0, -age / 30.0) * r.won), 0)) / (4 + coalesce(sum(pow(2.0, -age / 30.0)), 0)), 6) AS form_30, round(sum(pow(2.0, -age / 120.0) * r.value) / sum(pow(2.0, -age / 120.0)), 6) AS mean_120 FROM e LEFT JOIN r USING (event_id) GROUP BY 1")
def d17(spark: SparkSession, folder: str) -> DataFrame:
    today = F.col("day")
    found = _recent(spark, folder, form_30=history.decayed(F.col("recent"), today, "won", 30, 0.5, 4), mean_120=history.decayed(F.col("recent"), today, "value", 120))
    return found.select("event_id", F.round("form_30", 6).alias("form_30"), F.round("mean_120", 6).alias("mean_120"))


@query("d18_decayed_moments", f"""WITH {_RECENT}, w AS (SELECT *, pow(2.0, -age / 120.0) AS w FROM r), m AS (SELECT event_id, count(*) AS n, sum(w) * sum(w) / sum(w * w) AS ess, sum(w * value) / sum(w) AS mean FROM w GROUP BY 1)
SELECT e.event_id, coalesce(any_value(m.n), 0) AS n, round(any_value(m.ess), 6) AS ess, round(any_value(m.mean), 6) AS mean, round(sum(w.w * (w.value - m.mean) * (w.value - m.mean)) / sum(w.w), 4) AS variance FROM e LEFT JOIN m USING (event_id) LEFT JOIN w USING (event_id) GROUP BY 1""")
def d18(spark: SparkSession, folder: str) -> DataFrame:
    found = _recent(spark, folder, m=history.decayed_moments(F.col("recent"), F.col("day"), "value", 120))
    return found.select("event_id", "m.n", F.round("m.ess", 6).alias("ess"), F.round("m.mean", 6).alias("mean"), F.round("m.variance", 4).alias("variance"))


@query("d19_decayed_rate", f"WITH {_RECENT} SELECT e.event_id, round(sum(pow(2.0, -age / 180.0) * r.won) / sum(pow(2.0, -age / 180.0)), 6) AS rate, round(sum(pow(2.0, -age / 180.0)) * sum(pow(2.0, -age / 180.0)) / sum(pow(2.0, -age / 90.0)), 6) AS ess FROM e LEFT JOIN r USING (event_id) GROUP BY 1")
def d19(spark: SparkSession, folder: str) -> DataFrame:
    found = _recent(spark, folder, m=history.decayed_moments(F.col("recent"), F.col("day"), "won", 180))
    return found.select("event_id", F.round("m.mean", 6).alias("rate"), F.round("m.ess", 6).alias("ess"))


@query("e6_last_rows", f"WITH {_RECENT} SELECT e.event_id, count(r.day) AS n, round(max(r.value), 6) AS greatest, (min(r.day) - DATE '1970-01-01')::INT AS oldest FROM e LEFT JOIN r USING (event_id) GROUP BY 1")
def e6(spark: SparkSession, folder: str) -> DataFrame:
    rows = F.col("recent")
    found = _recent(spark, folder, n=F.size(rows).cast("long"), greatest=F.array_max(F.transform(rows, lambda r: r["value"])), oldest=F.array_min(F.transform(rows, lambda r: r["d"])))
    return found.select("event_id", "n", F.round("greatest", 6).alias("greatest"), "oldest")


@query("e9_trailing_counts", "WITH d AS (SELECT event_id, user_id, ts::DATE AS day, value FROM events) SELECT event_id, count(*) OVER w7 AS n_7, round(sum(value) OVER w7, 6) AS sum_7, count(*) OVER w14 AS n_14, round(sum(value) OVER w14, 6) AS sum_14 FROM d WINDOW w7 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), w14 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)")
def e9(spark: SparkSession, folder: str) -> DataFrame:
    return history.trailing_counts(_events(spark, folder), ["user_id"], "day", [7, 14], F.col("value")).select("event_id", "n_7", "sum_7", "n_14", "sum_14")


@query("e11_conditional_rate", f"WITH {_RECENT} SELECT e.event_id, round((0.4 * 6 + coalesce(sum(pow(2.0, -age / 60.0) * r.won) FILTER (r.value > 50), 0)) / (6 + coalesce(sum(pow(2.0, -age / 60.0)) FILTER (r.value > 50), 0)), 6) AS rate FROM e LEFT JOIN r USING (event_id) GROUP BY 1")
def e11(spark: SparkSession, folder: str) -> DataFrame:
    rate = history.decayed(F.col("recent"), F.col("day"), "won", 60, 0.4, 6, only=lambda r: r["value"] > 50)
    return _recent(spark, folder, rate=rate).select("event_id", F.round("rate", 6).alias("rate"))


@query("e12_context_form", f"WITH {_RECENT} SELECT e.event_id, CASE WHEN count(r.day) FILTER (r.event_type = e.event_type) >= 2 THEN round((0.5 * 5 + sum(pow(2.0, -age / 240.0) * (r.value > 40)::INT) FILTER (r.event_type = e.event_type)) / (5 + sum(pow(2.0, -age / 240.0)) FILTER (r.event_type = e.event_type)), 6) END AS form FROM e LEFT JOIN r USING (event_id) GROUP BY e.event_id")
def e12(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder).withColumn("high", (F.col("value") > 40).cast("int"))
    same = lambda r: r["event_type"] == F.col("event_type")
    form = history.decayed(F.col("recent"), F.col("day"), "high", 240, 0.5, 5, only=same)
    days = history.recent(events, ["user_id"], "day", "event_id", ["high", "event_type"])
    contexts = events.select("user_id", "day", "event_type").distinct().join(days, ["user_id", "day"])  # each context of a day once
    formed = contexts.select("user_id", "day", "event_type", F.when(F.size(F.filter("recent", same)) >= 2, F.round(form, 6)).alias("form"))
    return events.join(formed, ["user_id", "day", "event_type"]).select("event_id", "form")


@query("e13_head_to_head", """WITH m AS (SELECT l_orderkey, l_linenumber, l_suppkey % 20 AS a, l_partkey % 20 AS b, l_shipdate::DATE AS day, l_returnflag = 'R' AS won FROM lineitem WHERE l_suppkey % 20 <> l_partkey % 20),
p AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN a <= b THEN won ELSE NOT won END::INT AS low_won FROM m)
SELECT l_orderkey, l_linenumber, n_met, round(CASE WHEN a <= b THEN s ELSE 0 - s END, 6) AS advantage
FROM (SELECT *, (coalesce(sum(low_won) OVER w, 0) + 2.0::DOUBLE) / (count(low_won) OVER w + 4.0::DOUBLE) - 0.5::DOUBLE AS s, count(low_won) OVER w AS n_met FROM p WINDOW w AS (PARTITION BY lo, hi ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))""")
def e13(spark: SparkSession, folder: str) -> DataFrame:
    met = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 20).alias("a"), (F.col("l_partkey") % 20).alias("b"), F.to_date("l_shipdate").alias("day"), (F.col("l_returnflag") == "R").alias("won"))
    return history.head_to_head(met.where("a <> b"), "a", "b", "day", F.col("won")).select("l_orderkey", "l_linenumber", "n_met", "advantage")


@query("e14_last_known", "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS last_seen, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS last_clicked FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def e14(spark: SparkSession, folder: str) -> DataFrame:
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", of("view").alias("seen"), of("click").alias("clicked"))
    return history.last_known(events, ["user_id"], ["ts", "event_id"], ["seen", "clicked"]).select("event_id", "last_seen", "last_clicked")


@query("e15_running_baseline", """WITH d AS (SELECT l_returnflag AS flag, l_shipdate::DATE AS day, sum(l_discount * l_quantity) AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
b AS (SELECT flag, day, CASE WHEN sum(w) OVER v >= 1000 THEN sum(x) OVER v / sum(w) OVER v END AS baseline FROM d WINDOW v AS (PARTITION BY flag ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT l_orderkey, l_linenumber, round(baseline, 6) AS baseline FROM lineitem JOIN b ON flag = l_returnflag AND day = l_shipdate::DATE""")
def e15(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "l_quantity", F.to_date("l_shipdate").alias("day"))
    return history.running_baseline(rows, ["l_returnflag"], "day", F.col("l_discount"), F.col("l_quantity"), 1000).select("l_orderkey", "l_linenumber", "baseline")


@query("e16_speed_index", """WITH e AS (SELECT event_id, ts, user_id % 10 AS surface, user_id AS venue, event_type AS event, value FROM events),
c AS (SELECT event_id, count(value) OVER s AS ns, sum(value) OVER s AS xs, count(value) OVER v AS nv, coalesce(sum(value) OVER v, 0) AS xv, count(value) OVER x AS ne, coalesce(sum(value) OVER x, 0) AS xe FROM e
  WINDOW s AS (PARTITION BY surface ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY surface, venue ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x AS (PARTITION BY surface, venue, event ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, round(CASE WHEN ns >= 20 THEN xs / ns END, 6) AS baseline, round(CASE WHEN nv - ne >= 5 THEN (xv - xe) / (nv - ne) END - CASE WHEN ns >= 20 THEN xs / ns END, 6) AS venue_index, round(CASE WHEN ne >= 3 THEN xe / ne END - CASE WHEN ns >= 20 THEN xs / ns END, 6) AS event_index FROM c""")
def e16(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "ts", (F.col("user_id") % 10).alias("surface"), F.col("user_id").alias("venue"), F.col("event_type").alias("event"), "value", F.to_date("ts").alias("day"))
    return history.row_index(events, "surface", "venue", "event", ["ts", "event_id"], "value", "day").select("event_id", "baseline", "venue_index", "event_index")


@query("e20_first_and_last_quote", """WITH q AS (SELECT user_id, ts, value, epoch(date_trunc('second', TIMESTAMP '2024-01-20 12:00:00'))::BIGINT - epoch(date_trunc('second', ts))::BIGINT AS ahead FROM events),
b AS (SELECT user_id, arg_min(value, (ts, value)) FILTER (ahead <= 36 * 3600 AND ahead >= 2 * 3600) AS entry, arg_max(value, (ts, value)) FILTER (ahead > 0 AND ahead <= 600 * 60) AS close FROM q GROUP BY 1)
SELECT user_id, entry, close, round(100 * (entry / nullif(close, 0) - 1), 3) AS clv FROM b""")
def e20(spark: SparkSession, folder: str) -> DataFrame:
    quotes = table(spark, folder, "events").select("user_id", "ts", "value", F.expr("timestamp_ntz '2024-01-20 12:00:00'").alias("start"))
    return history.first_and_last_quote(quotes, ["user_id"], "ts", "start", "value", late_minutes=600)


@query("e23_day_boundary", "WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT day, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, (sum(n) OVER ())::BIGINT AS rows FROM d) SELECT day::VARCHAR AS day, before, rows FROM c WHERE before > 0 ORDER BY abs(before - 0.55::DOUBLE * rows), day LIMIT 1")
def e23(spark: SparkSession, folder: str) -> DataFrame:
    return history.day_boundary(table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day")), "day").withColumn("day", F.col("day").cast("string"))


@query("e25_folds_by_year", "WITH y AS (SELECT year(o_orderdate)::INT AS fold, count(*) AS test FROM orders GROUP BY 1), c AS (SELECT fold, coalesce(sum(test) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS train, test FROM y) SELECT * FROM c WHERE train >= 1000 AND test >= 100")
def e25(spark: SparkSession, folder: str) -> DataFrame:
    return history.folds_by_year(table(spark, folder, "orders").select(F.year("o_orderdate").alias("year")), "year", 1000, 100)


@query("e27_evidence", f"WITH {_RECENT} SELECT e.event_id, count(r.day) AS n, round(sum(pow(2.0, -age / 90.0)) * sum(pow(2.0, -age / 90.0)) / sum(pow(2.0, -age / 45.0)), 6) AS ess, min(age)::INT AS latest_age FROM e LEFT JOIN r USING (event_id) GROUP BY 1")
def e27(spark: SparkSession, folder: str) -> DataFrame:
    found = _recent(spark, folder, v=history.evidence(F.col("recent"), F.col("day"), 90))
    return found.select("event_id", "v.n", F.round("v.ess", 6).alias("ess"), "v.latest_age")
