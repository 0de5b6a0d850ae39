"""Registered queries on decayed moments, snapshots, the training frame and the serving index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.operators import decay, frames
from rallyframe.plans.scratch import scratch_path
from rallyframe.plans.tables import table
from rallyframe.registry import query
from rallyframe.sources import pair_index

_E18_SQL = """WITH e AS (SELECT user_id, event_type, ts::DATE AS day, value FROM events), k AS (SELECT DISTINCT user_id, event_type, day FROM e),
p AS (SELECT k.*, r.value, k.day - r.day AS age FROM k JOIN e r ON r.user_id = k.user_id AND r.event_type = k.event_type AND r.day < k.day),
w AS (SELECT *, pow(2.0, -age / 7.0) AS a, pow(2.0, -age / 90.0) AS b FROM p),
m AS (SELECT user_id, event_type, day, count(value) AS n, sum(a * value) / sum(a) AS mean_7, sum(b * value) / sum(b) AS mean_90, sum(a) * sum(a) / sum(a * a) AS ess_7, sum(b) * sum(b) / sum(b * b) AS ess_90 FROM w GROUP BY ALL),
v AS (SELECT user_id, event_type, day, sum(a * pow(value - mean_7, 2)) / sum(a) AS var_7, sum(b * pow(value - mean_90, 2)) / sum(b) AS var_90 FROM w JOIN m USING (user_id, event_type, day) GROUP BY ALL)
SELECT k.user_id, k.event_type, k.day::VARCHAR AS day, coalesce(n, 0) AS n, round(mean_7, 6) AS mean_7, round(var_7, 4) AS var_7, round(ess_7, 5) AS ess_7, round(mean_90, 6) AS mean_90, round(var_90, 4) AS var_90, round(ess_90, 5) AS ess_90
FROM k LEFT JOIN m USING (user_id, event_type, day) LEFT JOIN v USING (user_id, event_type, day)"""


@query("e18_walk_forward_moments", _E18_SQL)
def e18(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "value")
    days = decay.daily(events, ["user_id", "event_type"], "day", F.col("value"))
    found = decay.moments_before(days, ["user_id"], "day", {"h7": 7.0, "h90": 90.0}, more=["event_type"])
    own = [F.round(f"h{h}.{c}", d).alias(f"{name}_{h}") for h in (7, 90) for c, name, d in (("mean", "mean", 6), ("variance", "var", 4), ("ess", "ess", 5))]
    return found.select("user_id", "event_type", F.col("day").cast("string").alias("day"), F.col("h7.n").alias("n"), *own)


MATCHES = frames.Matches("id", "day", "surface", ("a", "b"), ("a_stat", "b_stat"), "a_won")

_MATCHES_SQL = """m AS (SELECT * FROM (SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_orderstatus AS surface, o_custkey % 100 AS a, o_orderkey * 7919 % 101 AS b, o_totalprice / 97003 AS a_stat, (o_orderkey % 1000) / 257::DOUBLE AS b_stat, o_totalprice > 250000 AS a_won FROM orders) WHERE a <> b),
s AS (SELECT id, day, surface, 0 AS side, a AS player, a_won::INT::DOUBLE AS won, a_stat AS stat FROM m UNION ALL SELECT id, day, surface, 1, b, (NOT a_won)::INT::DOUBLE, b_stat FROM m),
d AS (SELECT player, day, count(*) AS c, sum(won) AS w, sum(stat) AS x, max(stat) AS t FROM s GROUP BY 1, 2),
f AS (SELECT x.player, x.day, coalesce(sum(y.c), 0)::BIGINT AS n_before, (2.0::DOUBLE + coalesce(sum(y.w), 0)) / (4.0::DOUBLE + coalesce(sum(y.c), 0)) AS win_rate,
  (2.0::DOUBLE + coalesce(sum(y.w * pow(2.0, -(x.day - y.day) / 30.0)), 0)) / (4.0::DOUBLE + coalesce(sum(y.c * pow(2.0, -(x.day - y.day) / 30.0)), 0)) AS form_30,
  (2.0::DOUBLE + coalesce(sum(y.w * pow(2.0, -(x.day - y.day) / 120.0)), 0)) / (4.0::DOUBLE + coalesce(sum(y.c * pow(2.0, -(x.day - y.day) / 120.0)), 0)) AS form_120,
  CASE WHEN max(y.day) IS NULL THEN 14 ELSE least(x.day - max(y.day), 180) END::INT AS rest_days, coalesce(sum(y.c) FILTER (x.day - y.day <= 7), 0)::BIGINT AS played_7, coalesce(sum(y.c) FILTER (x.day - y.day <= 28), 0)::BIGINT AS played_28,
  sum(y.x) / sum(y.c) AS stat_mean, sum(y.x * pow(2.0, -(x.day - y.day) / 120.0)) / sum(y.c * pow(2.0, -(x.day - y.day) / 120.0)) AS stat_120, max(y.t) AS best_stat
  FROM d x LEFT JOIN d y ON y.player = x.player AND y.day < x.day GROUP BY 1, 2),
ds AS (SELECT player, surface, day, count(*) AS c, sum(won) AS w FROM s GROUP BY 1, 2, 3),
fs AS (SELECT x.player, x.surface, x.day, coalesce(sum(y.c), 0)::BIGINT AS surface_n, (2.0::DOUBLE + coalesce(sum(y.w * pow(2.0, -(x.day - y.day) / 180.0)), 0)) / (4.0::DOUBLE + coalesce(sum(y.c * pow(2.0, -(x.day - y.day) / 180.0)), 0)) AS surface_form_180
  FROM ds x LEFT JOIN ds y ON y.player = x.player AND y.surface = x.surface AND y.day < x.day GROUP BY 1, 2, 3),
k AS (SELECT s.id, s.side, f.*, fs.surface_n, fs.surface_form_180 FROM s JOIN f ON f.player = s.player AND f.day = s.day JOIN fs ON fs.player = s.player AND fs.surface = s.surface AND fs.day = s.day),
g AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, day, count(*) AS c, sum(CASE WHEN a <= b THEN a_won ELSE NOT a_won END::INT) AS w FROM m GROUP BY 1, 2, 3),
h AS (SELECT lo, hi, day, coalesce(sum(c) OVER q, 0)::BIGINT AS n_met, coalesce(sum(w) OVER q, 0) AS lw FROM g WINDOW q AS (PARTITION BY lo, hi ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT m.*, h.n_met, CASE WHEN a <= b THEN 1 ELSE -1 END * ((lw + 2.0::DOUBLE) / (n_met + 4.0::DOUBLE) - 0.5::DOUBLE) AS h2h FROM m JOIN h ON h.lo = least(a, b) AND h.hi = greatest(a, b) AND h.day = m.day)"""
_ROUND = {"n_before": None, "surface_n": None, "rest_days": None, "played_7": None, "played_28": None}


def _sql_side(at: str, name: str) -> str:
    return ", ".join(f"{at}.{c} AS {name}_{c}" if c in _ROUND else f"round({at}.{c}, 6) AS {name}_{c}" for c in frames.SIDE)


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("surface"), (F.col("o_custkey") % 100).alias("a"), (F.col("o_orderkey") * 7919 % 101).alias("b"),
        (F.col("o_totalprice") / 97003).alias("a_stat"), (F.col("o_orderkey") % 1000 / 257).alias("b_stat"), (F.col("o_totalprice") > 250000).alias("a_won"),
    )


@query("e4_match_snapshot", f"WITH {_MATCHES_SQL} SELECT j.id, {_sql_side('x', 'first')}, {_sql_side('y', 'second')}, j.n_met, round(j.h2h, 6) AS h2h FROM j JOIN k x ON x.id = j.id AND x.side = 0 JOIN k y ON y.id = j.id AND y.side = 1")
def e4(spark: SparkSession, folder: str) -> DataFrame:
    found = frames.snapshot(_matches(spark, folder), MATCHES)
    side = lambda name: [(F.col(f"{name}.{c}") if c in _ROUND else F.round(f"{name}.{c}", 6)).alias(f"{name}_{c}") for c in frames.SIDE]
    return found.select("id", *side("first"), *side("second"), "n_met", F.round("h2h", 6).alias("h2h"))


_SWAP = "(('0x' || substr(sha256(j.id::VARCHAR), 16, 1))::INT % 2 = 1)"
_D = ", ".join(f"round(CASE WHEN {_SWAP} THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * (x.{c} - y.{c}), 6) + 0 AS d_{c}" for c in frames.SIDE)


@query("e5_training_frame", f"WITH {_MATCHES_SQL} SELECT j.id, j.day::VARCHAR AS day, {_SWAP} AS swapped, (a_won <> {_SWAP})::INT AS label, {_D}, j.n_met, round(CASE WHEN {_SWAP} THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * j.h2h, 6) AS h2h FROM j JOIN k x ON x.id = j.id AND x.side = 0 JOIN k y ON y.id = j.id AND y.side = 1 WHERE x.n_before >= 1 AND y.n_before >= 1")
def e5(spark: SparkSession, folder: str) -> DataFrame:
    found = frames.training_frame(_matches(spark, folder), MATCHES)
    return found.select("id", F.col("day").cast("string").alias("day"), "swapped", "label", *[F.round(f"d_{c}", 6).alias(f"d_{c}") for c in frames.SIDE], "n_met", F.round("h2h", 6).alias("h2h"))


@query("a23_pair_lookup", """WITH r AS (SELECT DISTINCT least(l_suppkey::VARCHAR, l_partkey::VARCHAR) || chr(31) || greatest(l_suppkey::VARCHAR, l_partkey::VARCHAR) AS pair FROM lineitem WHERE l_quantity >= 50)
SELECT replace(pair, chr(31), '|') AS pair, count(*) AS n, round(sum(l_extendedprice), 2) AS total, max(l_shipdate)::DATE::VARCHAR AS last_day
FROM (SELECT *, least(l_suppkey::VARCHAR, l_partkey::VARCHAR) || chr(31) || greatest(l_suppkey::VARCHAR, l_partkey::VARCHAR) AS pair FROM lineitem) JOIN r USING (pair) GROUP BY 1""")
def a23(spark: SparkSession, folder: str) -> DataFrame:
    lines, path = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate"), scratch_path(spark, "pairs")
    pair_index.build_index(lines.drop("l_quantity"), path, "l_suppkey", "l_partkey", "l_shipdate")
    found = pair_index.lookup_all(spark, path, lines.where("l_quantity >= 50"), "l_suppkey", "l_partkey")
    return found.groupBy(F.replace("pair", F.lit(pair_index.MARK), F.lit("|")).alias("pair")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.to_date(F.max("l_shipdate")).cast("string").alias("last_day"))
