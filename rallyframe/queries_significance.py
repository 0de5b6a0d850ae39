"""Registered queries on comparisons of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions import values
from rallyframe.functions.stats import elo_expected
from rallyframe.operators import significance
from rallyframe.plans.tables import table
from rallyframe.registry import query

_AUC = "SELECT '{0}' AS score, count(*) AS n, sum(y)::BIGINT AS positives, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y))), 9) AS auc FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM (SELECT (l_returnflag = 'R')::INT AS y, {1} AS s FROM lineitem))"


@query("d4_roc_auc", f"{_AUC.format('price', 'l_extendedprice')} UNION ALL {_AUC.format('discount', 'l_discount')} UNION ALL {_AUC.format('constant', '0.5')}")
def d4_auc(spark: SparkSession, folder: str) -> DataFrame:
    lines, y = table(spark, folder, "lineitem"), (F.col("l_returnflag") == "R").cast("int")
    parts = [significance.roc_auc(lines, p, y).withColumn("score", F.lit(name)) for name, p in (("price", F.col("l_extendedprice")), ("discount", F.col("l_discount")), ("constant", F.lit(0.5)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("auc", F.round("auc", 9))


@query("k28_mcnemar", """WITH r AS (SELECT l_shipdate::DATE AS day, l_partkey % 2 AS y, l_quantity / 50 AS a, l_discount * 10 AS b FROM lineitem),
c AS (SELECT year(day) * 100 + month(day) AS month, count(*) AS n, count(*) FILTER ((a >= 0.5) = (y = 1) AND (b >= 0.5) <> (y = 1)) AS new_only, count(*) FILTER ((b >= 0.5) = (y = 1) AND (a >= 0.5) <> (y = 1)) AS old_only FROM r GROUP BY 1),
t AS (SELECT *, new_only + old_only AS d, least(new_only, old_only) AS low FROM c)
SELECT month, n, new_only, old_only, round(CASE WHEN d = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, low + 1), lambda k: exp(lgamma(d + 1) - lgamma(k + 1) - lgamma(d - k + 1) - d * ln(2.0))))) END, 9) AS p_value FROM t""")
def k28(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select((F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long").alias("month"), (F.col("l_partkey") % 2).alias("y"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"))
    return significance.compared(rows, ["month"], F.col("y"), F.col("a"), F.col("b")).withColumn("p_value", F.round("p_value", 9))


@query("k28_row_bootstrap", """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders), g AS (SELECT k, v, unnest(range(0, 25)) AS d FROM o),
x AS (SELECT v, d, sha256('1:' || d || ':' || k) AS h FROM g), u AS (SELECT v, d * 8 + p AS round, ('0x' || substr(h, 8 * p + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM x, (SELECT unnest(range(0, 8)) AS p)),
w AS (SELECT round, v, list_sum(list_transform([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.9999988747974021, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892], lambda c: (u >= c)::INT)) AS n FROM u),
m AS (SELECT round, sum(n * v) / sum(n) AS m FROM w GROUP BY 1)
SELECT (SELECT count(*) FROM o) AS n, round((SELECT avg(v) FROM o), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m""")
def k28_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    found = significance.row_bootstrap(table(spark, folder, "orders"), F.col("o_orderkey"), F.col("o_totalprice"))
    return found.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


_NUMBER = "row_number() OVER (PARTITION BY g ORDER BY ('0x' || substr({0}, 1, 7))::BIGINT % 16, {0}, k)"


@query("k26_permutation_sensitivity", f"""WITH r AS (SELECT o_orderstatus AS g, o_orderkey AS k, o_totalprice / 500000 AS d, o_orderpriority < '3' AS y FROM orders),
h AS (SELECT *, sha256('1:' || ':' || k) AS a, sha256('1:d' || ':' || k) AS b FROM r), n AS (SELECT *, {_NUMBER.format('a')} AS i, {_NUMBER.format('b')} AS j FROM h),
p AS (SELECT x.g, x.y::INT AS y, x.d, z.d AS e FROM n x JOIN n z ON z.g = x.g AND z.j = x.i)
SELECT g, count(*) AS n, round(avg(pow(d - y, 2)), 8) AS brier, round(avg(pow(e - y, 2)), 8) AS permuted, round(sum(e), 4) AS total FROM p GROUP BY 1""")
def k26(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("g"), F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 500000).alias("d"), (F.col("o_orderpriority") < "3").cast("int").alias("y"))
    found = significance.permuted(rows, "g", "k", ["d"])
    loss = lambda c: F.round(F.avg(F.pow(F.col(c) - F.col("y"), F.lit(2.0))), 8)
    return found.groupBy("g").agg(F.count("*").alias("n"), loss("d").alias("brier"), loss("d_permuted").alias("permuted"), F.round(F.sum("d_permuted"), 4).alias("total"))


@query("e1_elo_update", """WITH m AS (SELECT l_orderkey, l_linenumber, 1500 + l_quantity * 10 AS a, 1500 + l_discount * 1000 AS b, l_partkey % 400 AS n, (l_returnflag = 'R')::INT AS won, l_linenumber % 4 AS level FROM lineitem),
e AS (SELECT *, 1 / (1 + pow(10.0, (b - a) / 400)) AS x, greatest(12, least(32, 32 / (1 + 0.16 * ln(1 + n)))) AS k FROM m)
SELECT l_orderkey, l_linenumber, round(k, 6) AS k, round(a + k * (1 + 0.15 * level) * (won - x), 6) AS rating FROM e""")
def e1(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    a, b, n, won = 1500 + F.col("l_quantity") * 10, 1500 + F.col("l_discount") * 1000, F.col("l_partkey") % 400, F.col("l_returnflag") == "R"
    rating = values.elo_update(a, elo_expected(a, b), won, n, 1 + 0.15 * (F.col("l_linenumber") % 4))
    return lines.select("l_orderkey", "l_linenumber", F.round(values.elo_factor(n), 6).alias("k"), F.round(rating, 6).alias("rating"))
