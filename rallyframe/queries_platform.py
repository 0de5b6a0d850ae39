"""Registered queries on linkers with gates, dimensions, estimates, offers and typed provider rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions import matches as match
from rallyframe.operators import estimates, linkers, offers
from rallyframe.plans.tables import table
from rallyframe.registry import query

_SHIFT = "CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 20 ELSE o_orderkey % 3 - 1 END"


@query("c18_gated_link", f"""WITH m AS (SELECT o_orderkey AS mid, o_custkey % 300 AS blk, o_orderstatus AS tour, o_orderdate::DATE AS day, o_orderkey % 7 AS surface, o_orderkey % 9 AS event, o_orderpriority AS round, o_orderkey % 2 AS best, o_custkey % 2 AS winner FROM orders),
s AS (SELECT o_orderkey AS sid, o_custkey % 300 AS blk, o_orderstatus AS tour, o_orderkey % 5 = 0 AS start, o_orderdate::DATE - ({_SHIFT})::INT AS day, CASE WHEN o_orderkey % 11 = 0 THEN (o_orderkey + 1) % 7 ELSE o_orderkey % 7 END AS surface,
  CASE WHEN o_orderkey % 6 = 0 THEN -1 ELSE o_orderkey % 9 END AS event, CASE WHEN o_orderkey % 14 = 0 THEN 'x' ELSE o_orderpriority END AS round, o_orderkey % 2 AS best, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey % 2 END AS winner FROM orders WHERE o_orderkey % 4 = 0),
j AS (SELECT sid, mid, m.day - s.day AS d, start, coalesce(s.surface = m.surface, false) AS su, coalesce(s.event = m.event, false) AS ev, coalesce(s.round = m.round, false) AS ro, coalesce(s.best = m.best, false) AS be, coalesce(s.winner = m.winner, false) AS wi,
  coalesce(s.surface <> m.surface OR s.best <> m.best OR s.winner <> m.winner, s.surface <> m.surface, false) OR coalesce(s.best <> m.best, false) OR coalesce(s.winner <> m.winner, false) AS veto
  FROM s JOIN m ON s.blk = m.blk AND s.tour = m.tour AND m.day - s.day BETWEEN CASE WHEN start THEN 0 ELSE -1 END AND CASE WHEN start THEN 16 ELSE 1 END),
c AS (SELECT *, CASE WHEN start THEN 1 WHEN d = 0 THEN 4 ELSE 1 END + su::INT + 2 * ev::INT + ro::INT + be::INT + 3 * wi::INT AS score,
  array_to_string(list_filter([CASE WHEN NOT start AND d = 0 THEN 'date' END, CASE WHEN NOT start AND d <> 0 THEN 'near' END, CASE WHEN start THEN 'window' END, CASE WHEN su THEN 'surface' END, CASE WHEN ev THEN 'event' END, CASE WHEN ro THEN 'round' END, CASE WHEN be THEN 'best_of' END, CASE WHEN wi THEN 'winner' END], lambda x: x IS NOT NULL), ',') AS evidence FROM j),
r AS (SELECT *, CASE WHEN veto THEN 0 WHEN wi AND score >= 8 AND (NOT start OR (ev AND ro AND su AND be)) THEN 2 ELSE 1 END AS rank FROM c),
t AS (SELECT *, rank() OVER (PARTITION BY sid ORDER BY rank DESC, score DESC) AS o FROM r), b AS (SELECT sid, rank, score, count(DISTINCT mid) AS k, min(mid) AS mid, arg_min(evidence, mid) AS evidence FROM t WHERE o = 1 GROUP BY ALL),
n AS (SELECT mid, count(*) AS n FROM b WHERE rank = 2 AND k = 1 GROUP BY 1), v AS (SELECT s.sid, b.mid, b.score, b.evidence, CASE WHEN rank IS NULL THEN 'unmatched' WHEN rank = 0 THEN 'vetoed' WHEN rank = 1 THEN 'rejected' WHEN k > 1 THEN 'tied' WHEN n > 1 THEN 'contested' ELSE 'linked' END AS reason
  FROM s LEFT JOIN b ON b.sid = s.sid LEFT JOIN n ON n.mid = b.mid)
SELECT sid, CASE WHEN reason = 'linked' THEN mid END AS mid, score, evidence, reason FROM v""")
def c18(spark: SparkSession, folder: str) -> DataFrame:
    orders, key = table(spark, folder, "orders"), F.col("o_orderkey")
    common = [(F.col("o_custkey") % 300).alias("blk"), F.col("o_orderstatus").alias("tour"), (key % 2).alias("best")]
    targets = orders.select(key.alias("mid"), F.to_date("o_orderdate").alias("day"), (key % 7).alias("surface"), (key % 9).alias("event"), F.col("o_orderpriority").alias("round"), (F.col("o_custkey") % 2).alias("winner"), *common)
    sources = orders.where("o_orderkey % 4 = 0").select(
        key.alias("sid"), F.date_sub(F.to_date("o_orderdate"), F.expr(_SHIFT).cast("int")).alias("day"), (key % 5 == 0).alias("start"), F.when(key % 11 == 0, (key + 1) % 7).otherwise(key % 7).alias("surface"),
        F.when(key % 6 == 0, -1).otherwise(key % 9).alias("event"), F.when(key % 14 == 0, "x").otherwise(F.col("o_orderpriority")).alias("round"), F.when(key % 13 != 0, F.col("o_custkey") % 2).alias("winner"), *common,
    )
    same = lambda c: F.col(f"s_{c}") == F.col(f"m_{c}")
    exact, start = F.col("s_day") == F.col("m_day"), F.col("s_start")
    told = [
        linkers.Evidence("date", ~start & exact, 4), linkers.Evidence("near", ~start & ~exact, 1), linkers.Evidence("window", start, 1), linkers.Evidence("surface", same("surface"), 1), linkers.Evidence("event", same("event"), 2),
        linkers.Evidence("round", same("round"), 1), linkers.Evidence("best_of", same("best"), 1), linkers.Evidence("winner", same("winner"), 3),
    ]
    veto = F.coalesce(~same("surface"), F.lit(False)) | F.coalesce(~same("best"), F.lit(False)) | F.coalesce(~same("winner"), F.lit(False))
    accept = lambda score, held: held["winner"] & (score >= 8) & (~held["window"] | (held["event"] & held["round"] & held["surface"] & held["best_of"]))
    window = F.when(start, 0).otherwise(-1), F.when(start, 16).otherwise(1)
    return linkers.gated_link(sources, targets, "sid", "mid", ["blk", "tour"], "day", window, told, veto, accept, widest=16).withColumn("evidence", F.array_join("evidence", ","))


@query("c25_distinct_collisions", """WITH o AS (SELECT o_orderkey, o_orderkey // 2 AS k, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey END AS provider, o_orderpriority AS event, o_orderdate AS tm FROM orders),
c AS (SELECT k, count(*) AS n, least(count(DISTINCT provider), count(DISTINCT event), count(DISTINCT tm)) AS l, least(count(provider), count(event), count(tm)) AS t FROM o GROUP BY 1)
SELECT o_orderkey, CASE WHEN n > 1 AND l = n AND t = n THEN left(sha256('collision|' || o.k || '|' || event), 24) ELSE o.k::VARCHAR END AS resolved_id, CASE WHEN n = 1 THEN 'none' WHEN l = n AND t = n THEN 'split' ELSE 'unresolved' END AS collision FROM o JOIN c ON c.k = o.k""")
def c25(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 2).alias("k"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderkey")).alias("provider"), F.col("o_orderpriority").alias("event"), F.col("o_orderdate").alias("at"))
    return linkers.distinct_collisions(rows, "k", ["provider", "event", "at"], "event").select("o_orderkey", "resolved_id", "collision")


_C27_NEW = "SELECT CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS id, c_name AS a, CASE WHEN c_custkey % 14 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS d, {0} AS x FROM {1} WHERE {2}"


@query("c27_trusted_batch", f"""WITH e AS (SELECT c_custkey AS id, c_name AS a, c_nationkey AS d, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS x FROM customer WHERE c_custkey % 3 <> 0),
i AS ({_C27_NEW.format("CASE WHEN c_custkey % 22 = 0 THEN 'OTHER' ELSE c_mktsegment END", "customer", "c_custkey % 2 = 0")} UNION ALL {_C27_NEW.format("'TWICE'", "customer", "c_custkey % 26 = 0")}),
p AS (SELECT id, count(DISTINCT {{'a': a, 'd': d, 'x': x}}) AS k, min({{'a': a, 'd': d, 'x': x}}) AS r FROM i GROUP BY 1),
j AS (SELECT p.id, k, r.a AS na, r.d AS nd, r.x AS nx, e.a, e.d, e.x, e.id IS NOT NULL AS old, EXISTS (SELECT 1 FROM e f WHERE f.a = r.a AND f.d = r.d) AS named FROM p LEFT JOIN e ON e.id = p.id),
v AS (SELECT *, CASE WHEN k > 1 THEN 'duplicate' WHEN old AND (a IS DISTINCT FROM na OR d IS DISTINCT FROM nd) THEN 'identity_changed' WHEN NOT old AND named THEN 'known_elsewhere' WHEN NOT old THEN 'new' WHEN coalesce(x <> nx, false) THEN 'conflict' WHEN x IS NULL AND nx IS NOT NULL THEN 'filled' ELSE 'unchanged' END AS verdict FROM j)
SELECT id, verdict, CASE verdict WHEN 'new' THEN nx WHEN 'filled' THEN nx ELSE x END AS x FROM v""")
def c27(spark: SparkSession, folder: str) -> DataFrame:
    people, key = table(spark, folder, "customer"), F.col("c_custkey")
    existing = people.where("c_custkey % 3 <> 0").select(key.cast("long").alias("id"), F.col("c_name").alias("a"), F.col("c_nationkey").cast("long").alias("d"), F.when(key % 4 != 0, F.col("c_mktsegment")).alias("x"))
    batch = lambda rows, x: rows.select(F.when(key % 10 == 0, key + 1000000).otherwise(key).cast("long").alias("id"), F.col("c_name").alias("a"), F.when(key % 14 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).cast("long").alias("d"), x.alias("x"))
    incoming = batch(people.where("c_custkey % 2 = 0"), F.when(key % 22 == 0, "OTHER").otherwise(F.col("c_mktsegment"))).unionByName(batch(people.where("c_custkey % 26 = 0"), F.lit("TWICE")))
    merged, verdicts = linkers.trusted_batch(existing, incoming, "id", ["a", "d"], ["x"])
    return verdicts.join(merged.select("id", "x"), "id", "left").select("id", "verdict", "x")


@query("c33_first_compatible", """WITH g AS (SELECT 'n' || n_nationkey AS name, n_regionkey AS region FROM nation UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation WHERE n_nationkey % 4 = 0),
d AS (SELECT c_custkey AS id, c_custkey % 5 AS want, [CASE WHEN c_custkey % 3 = 0 THEN 'nowhere' ELSE 'n' || (c_custkey % 25) END, 'n' || c_nationkey, 'n' || ((c_nationkey + 7) % 25)] AS cs FROM customer),
e AS (SELECT id, want, k - 1 AS position, cs[k] AS name FROM d, (VALUES (1), (2), (3)) x(k)), p AS (SELECT id, position, name, count(region) FILTER (region = want OR region = 0) AS n, min(region) FILTER (region = want OR region = 0) AS region FROM e LEFT JOIN g USING (name) GROUP BY 1, 2, 3),
b AS (SELECT id, min(position) FILTER (n = 1) AS position, count(*) FILTER (n > 1) AS ambiguous FROM p GROUP BY 1)
SELECT b.id, b.position, p.name, p.region, ambiguous FROM b LEFT JOIN p ON p.id = b.id AND p.position = b.position""")
def c33(spark: SparkSession, folder: str) -> DataFrame:
    nations, key = table(spark, folder, "nation"), F.col("c_custkey")
    places = nations.unionByName(nations.where("n_nationkey % 4 = 0")).select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.col("n_regionkey").alias("region"))
    named = lambda k: F.concat(F.lit("n"), k.cast("string"))
    rows = table(spark, folder, "customer").select(key.alias("id"), (key % 5).alias("want"), F.array(F.when(key % 3 == 0, "nowhere").otherwise(named(key % 25)), named(F.col("c_nationkey")), named((F.col("c_nationkey") + 7) % 25)).alias("cs"))
    return linkers.first_compatible(rows, "id", "cs", places, "name", (F.col("region") == F.col("want")) | (F.col("region") == 0))


@query("c30_overlaid_status", """WITH s AS (SELECT l_orderkey, l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_shipdate DESC, l_returnflag DESC, l_extendedprice DESC) AS k FROM lineitem WHERE l_quantity > 10)
SELECT o_orderkey, coalesce(l_returnflag, o_orderstatus) AS status, coalesce(l_extendedprice, o_totalprice) AS price, CASE WHEN l_orderkey IS NULL THEN 'frozen' WHEN l_returnflag = 'R' THEN 'settled' ELSE 'live' END AS overlay FROM orders LEFT JOIN s ON l_orderkey = o_orderkey AND k = 1""")
def c30(spark: SparkSession, folder: str) -> DataFrame:
    frozen = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    statuses = table(spark, folder, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", F.col("l_returnflag").alias("status"), F.col("l_extendedprice").alias("price"))
    return linkers.overlaid(frozen, statuses, "o_orderkey", "l_shipdate", ["status", "price"], F.col("status") == "R")


@query("c14_player_dimension", """WITH s AS (SELECT o_custkey % 400 AS player, CASE WHEN o_orderkey % 15 = 0 THEN '' ELSE 'P' || (o_custkey % 400) || CASE o_orderkey % 6 WHEN 0 THEN ' Jr' WHEN 1 THEN ' II' ELSE '' END END AS name, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE 'C' || (o_orderkey % 7) END AS country, o_orderdate AS tm, o_orderkey AS id FROM orders),
p AS (SELECT c_custkey AS player, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'N' || c_nationkey END AS country, '19' || (60 + c_nationkey) AS birth_date, left(c_mktsegment, 1) AS hand FROM customer WHERE c_custkey < 400 AND c_custkey % 5 = 0),
l AS (SELECT player, count(*) AS seen, arg_max(name, (tm, id)) FILTER (name <> '') AS name FROM s GROUP BY 1), n AS (SELECT DISTINCT player, name FROM s WHERE name <> '' UNION SELECT player, name FROM p), a AS (SELECT player, list(name ORDER BY name) AS aliases FROM n GROUP BY 1),
c AS (SELECT player, country, row_number() OVER (PARTITION BY player ORDER BY count(*) DESC, country) AS k FROM s WHERE country <> '' GROUP BY 1, 2)
SELECT l.player, l.name, array_to_string(coalesce(aliases, []), '|') AS aliases, coalesce(p.country, c.country) AS country, birth_date, hand, seen FROM l LEFT JOIN a ON a.player = l.player LEFT JOIN c ON c.player = l.player AND k = 1 LEFT JOIN p ON p.player = l.player""")
def c14(spark: SparkSession, folder: str) -> DataFrame:
    key, player = F.col("o_orderkey"), F.col("o_custkey") % 400
    name = F.when(key % 15 == 0, "").otherwise(F.concat(F.lit("P"), player, F.when(key % 6 == 0, " Jr").when(key % 6 == 1, " II").otherwise("")))
    seen = table(spark, folder, "orders").select(player.cast("long").alias("player"), name.alias("name"), F.when(key % 8 == 0, "").otherwise(F.concat(F.lit("C"), key % 7)).alias("country"), F.col("o_orderdate").alias("at"), key.alias("id"))
    profiles = table(spark, folder, "customer").where("c_custkey < 400 AND c_custkey % 5 = 0").select(
        F.col("c_custkey").cast("long").alias("player"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("N"), "c_nationkey")).alias("country"), F.concat(F.lit("19"), 60 + F.col("c_nationkey")).alias("birth_date"), F.left("c_mktsegment", F.lit(1)).alias("hand")
    )
    return linkers.player_dimension(seen, "player", "name", "country", ["at", "id"], profiles).withColumn("aliases", F.array_join("aliases", "|"))


_MODAL = "SELECT p_brand, '{0}' AS \"column\", {0}::VARCHAR AS value, count(*) AS n FROM part WHERE {0} IS NOT NULL GROUP BY 1, 3"


@query("d25_modal_attributes", f"WITH c AS ({_MODAL.format('p_type')} UNION ALL {_MODAL.format('p_size')} UNION ALL {_MODAL.format('p_name')}), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, \"column\" ORDER BY n DESC, value) AS k, count(*) OVER (PARTITION BY p_brand, \"column\") AS different FROM c) SELECT p_brand, \"column\", value, n, different FROM r WHERE k = 1")
def d25(spark: SparkSession, folder: str) -> DataFrame:
    return linkers.modal(table(spark, folder, "part"), ["p_brand"], ["p_type", "p_size", "p_name"])


@query("d33_point_weighted", """WITH r AS (SELECT o_custkey % 100 AS player, o_orderstatus AS tour, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 19 <> 0 THEN (o_orderkey % 103) / 101.0::DOUBLE END AS rate, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 400 END AS points FROM orders),
u AS (SELECT *, coalesce(points > 0 AND points <= 3000 AND rate >= 0 AND rate <= 1, false) AS ok FROM r), k AS (SELECT DISTINCT player, tour, day FROM u),
o AS (SELECT k.player, k.tour, k.day, count(u.rate) AS rates, count(*) FILTER (ok) AS counts, sum(least(points, 250) * pow(2.0, -(k.day - u.day) / 120.0)) FILTER (ok) AS w, sum(rate * least(points, 250) * pow(2.0, -(k.day - u.day) / 120.0)) FILTER (ok) AS x FROM k LEFT JOIN u ON u.player = k.player AND u.tour = k.tour AND u.day < k.day GROUP BY 1, 2, 3),
td AS (SELECT tour, day, sum(points) FILTER (ok) AS p, sum(points * rate) FILTER (ok) AS x FROM u GROUP BY 1, 2), t AS (SELECT tour, day, sum(p) OVER w AS p, sum(x) OVER w AS x FROM td WINDOW w AS (PARTITION BY tour ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o.player, o.tour, o.day::VARCHAR AS day, CASE WHEN t.p >= 1000 AND counts > 0 AND 2 * counts >= rates THEN round((200 * t.x / t.p + coalesce(o.x, 0)) / (200 + coalesce(o.w, 0)), 6) END AS estimate, rates, counts FROM o JOIN t ON t.tour = o.tour AND t.day = o.day""")
def d33(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select((F.col("o_custkey") % 100).alias("player"), F.col("o_orderstatus").alias("tour"), F.to_date("o_orderdate").alias("day"), F.when(key % 19 != 0, key % 103 / 101).alias("rate"), F.when(key % 3 != 0, key % 400).alias("points"))
    return estimates.point_weighted(rows, "player", "tour", "day", "rate", "points").withColumns({"estimate": F.round("estimate", 6), "day": F.col("day").cast("string")})


@query("h9_count_projections", """WITH m AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_custkey % 60 AS a, o_orderkey * 7919 % 61 AS b, o_orderkey % 23 AS x, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 17 END AS y FROM orders),
s AS (SELECT id, day, 0 AS side, a AS player, b AS opponent, x AS own, y AS allowed FROM m UNION ALL SELECT id, day, 1, b, a, y, x FROM m), k AS (SELECT DISTINCT player, day FROM s),
o AS (SELECT k.player, k.day, count(own) AS n, sum(own * pow(2.0, -(k.day - s.day) / 365.0)) / sum(pow(2.0, -(k.day - s.day) / 365.0)) FILTER (own IS NOT NULL) AS mean FROM k LEFT JOIN s ON s.player = k.player AND s.day < k.day GROUP BY 1, 2),
ov AS (SELECT o.player, o.day, sum(pow(2.0, -(o.day - s.day) / 365.0) * pow(own - mean, 2)) / sum(pow(2.0, -(o.day - s.day) / 365.0)) FILTER (own IS NOT NULL) AS v FROM o JOIN s ON s.player = o.player AND s.day < o.day GROUP BY 1, 2),
a AS (SELECT k.player, k.day, count(allowed) AS n, sum(allowed * pow(2.0, -(k.day - s.day) / 365.0)) / sum(pow(2.0, -(k.day - s.day) / 365.0)) FILTER (allowed IS NOT NULL) AS mean FROM k LEFT JOIN s ON s.player = k.player AND s.day < k.day GROUP BY 1, 2),
av AS (SELECT a.player, a.day, sum(pow(2.0, -(a.day - s.day) / 365.0) * pow(allowed - mean, 2)) / sum(pow(2.0, -(a.day - s.day) / 365.0)) FILTER (allowed IS NOT NULL) AS v FROM a JOIN s ON s.player = a.player AND s.day < a.day GROUP BY 1, 2),
d AS (SELECT day, count(own) AS n, sum(own) AS x FROM s GROUP BY 1), g AS (SELECT day, sum(x) OVER w / sum(n) OVER w AS base FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT s.id, s.side, o.n AS n, o.mean, ov.v, coalesce(a.n, 0) AS an, a.mean AS am, av.v AS av, base, 0.3 * least(1.0::DOUBLE, coalesce(a.n, 0) / 12.0::DOUBLE) AS share FROM s JOIN o ON o.player = s.player AND o.day = s.day LEFT JOIN ov ON ov.player = s.player AND ov.day = s.day
  LEFT JOIN a ON a.player = s.opponent AND a.day = s.day LEFT JOIN av ON av.player = s.opponent AND av.day = s.day JOIN g ON g.day = s.day)
SELECT id, side, CASE WHEN n >= 6 THEN round(greatest(0, (1 - share) * (mean * n + base * 7) / (n + 7) + share * CASE WHEN am IS NULL THEN base ELSE (am * an + base * 7) / (an + 7) END), 5) END AS estimate,
  CASE WHEN n >= 6 THEN round(greatest(0, (1 - share) * (1 - share) * v + share * share * coalesce(av, v)), 4) END AS variance, n AS samples, an AS opponent_samples FROM j""")
def h9(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    made = table(spark, folder, "orders").select(key.alias("id"), F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 60).alias("a"), (key * 7919 % 61).alias("b"), (key % 23).alias("x"), F.when(key % 9 != 0, key % 17).alias("y"))
    side = lambda k, p, o, own, allowed: F.struct(F.lit(k).alias("side"), F.col(p).alias("player"), F.col(o).alias("opponent"), F.col(own).alias("own"), F.col(allowed).alias("allowed"))
    sides = made.select("id", "day", F.inline(F.array(side(0, "a", "b", "x", "y"), side(1, "b", "a", "y", "x"))))
    found = estimates.count_projections(sides, "player", "opponent", "day", "own", "allowed", 365.0, 0.3)
    return found.select("id", "side", F.round("estimate", 5).alias("estimate"), F.round("variance", 4).alias("variance"), "samples", "opponent_samples")


@query("e28_market_state", """WITH r AS (SELECT o_custkey % 200 AS player, o_orderstatus AS tour, o_orderkey % 2 AS fmt, o_orderdate AS tm, o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderkey % 9 <> 0), b AS (SELECT tour, fmt, CASE WHEN count(*) >= 12 THEN avg(v) END AS baseline FROM r GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY tour, player ORDER BY tm DESC, id DESC) AS k FROM r), p AS (SELECT tour, player, count(*) AS samples, avg(v) AS mean, max(fmt) FILTER (k = 1) AS fmt FROM k WHERE k <= 30 GROUP BY 1, 2)
SELECT p.tour, player, samples, round(mean, 3) AS mean, p.fmt, round(baseline, 3) AS baseline FROM p LEFT JOIN b ON b.tour = p.tour AND b.fmt = p.fmt""")
def e28(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select((F.col("o_custkey") % 200).alias("player"), F.col("o_orderstatus").alias("tour"), (key % 2).alias("fmt"), F.col("o_orderdate").alias("at"), key.alias("id"), F.when(key % 9 != 0, F.col("o_totalprice")).alias("v"))
    return estimates.market_state(rows, "player", "tour", "fmt", ["at", "id"], "v").withColumns({"mean": F.round("mean", 3), "baseline": F.round("baseline", 3)})


@query("h10_shadow_report", """WITH r AS (SELECT l_shipdate::DATE AS day, (l_returnflag = 'R')::INT AS y, l_quantity / 60 AS p0, l_discount * 3 + 0.2::DOUBLE AS p1 FROM lineitem WHERE l_linenumber <> 3),
q AS (SELECT day, pow(p0 - y, 2) AS b0, pow(p1 - y, 2) AS b1, -(y * ln(greatest(p0, 1e-15)) + (1 - y) * ln(1 - p0)) AS l0, -(y * ln(greatest(p1, 1e-15)) + (1 - y) * ln(1 - p1)) AS l1 FROM r)
SELECT count(*) AS n, count(DISTINCT day) AS days, round(avg(b0), 6) AS brier, round(avg(b1), 6) AS challenger_brier, round(avg(l0), 6) AS log_loss, round(avg(l1), 6) AS challenger_log_loss, round(avg(b1 - b0), 6) AS brier_difference, round(1.959963984540054 * sqrt(var_pop(b1 - b0) / count(*)), 6) AS brier_half_width,
  round(avg(l1 - l0), 6) AS log_loss_difference, round(1.959963984540054 * sqrt(var_pop(l1 - l0) / count(*)), 6) AS log_loss_half_width, count(*) >= 1000 AND count(DISTINCT day) >= 30 AND avg(b1 - b0) - 1.959963984540054 * sqrt(var_pop(b1 - b0) / count(*)) <= 0 AND avg(l1 - l0) - 1.959963984540054 * sqrt(var_pop(l1 - l0) / count(*)) <= 0 AS ready FROM q""")
def h10(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("day"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 60).alias("p0"), F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 3 + 0.2).alias("p1"))
    found = estimates.shadow_report(rows, "day", F.col("y"), F.col("p0"), F.col("p1"), 1000, 30)
    return found.select("n", "days", *[F.round(c, 6).alias(c) for c, kind in found.dtypes if kind == "double"], "ready")


@query("d13_kpi_scan", """WITH e AS (SELECT user_id, ts::DATE AS d, ts, CASE WHEN event_id % 8 <> 0 THEN ts END AS issued, event_type, CASE WHEN value > 50 THEN 'win' WHEN value > 10 THEN 'loss' WHEN value > 5 THEN 'void' END AS o, 1 + value / 60 - 0.3::DOUBLE AS q FROM events),
c AS (SELECT 'all' AS category, * FROM e WHERE o IS NOT NULL UNION ALL SELECT 'top', * FROM e WHERE o IS NOT NULL AND event_type = 'purchase' UNION ALL SELECT 'rest', * FROM e WHERE o IS NOT NULL AND event_type IN ('click', 'view')),
p AS (SELECT 'all' AS period, * FROM c UNION ALL SELECT '7', * FROM c WHERE ts <= TIMESTAMP '2024-01-29 12:00:00' AND ts >= TIMESTAMP '2024-01-22 12:00:00' UNION ALL SELECT '14', * FROM c WHERE ts <= TIMESTAMP '2024-01-29 12:00:00' AND ts >= TIMESTAMP '2024-01-15 12:00:00'),
u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY category, period, user_id, d ORDER BY issued IS NULL, issued, o, q) = 1)
SELECT category, period, count(*) FILTER (o = 'win') AS wins, count(*) FILTER (o = 'loss') AS losses, count(*) FILTER (o = 'void') AS voids, round(avg(q) FILTER (o <> 'void' AND q > 1), 5) AS avg_odds, count(*) FILTER (o <> 'void' AND q > 1) AS staked,
  round(coalesce(sum(CASE WHEN o = 'win' THEN q - 1 ELSE -1 END) FILTER (o <> 'void' AND q > 1), 0), 5) AS profit, count(*) FILTER (o <> 'void') AS sample, round(count(*) FILTER (o = 'win') / nullif(count(*) FILTER (o <> 'void'), 0), 6) AS hit_rate,
  round(sum(CASE WHEN o = 'win' THEN q - 1 ELSE -1 END) FILTER (o <> 'void' AND q > 1) / nullif(count(*) FILTER (o <> 'void' AND q > 1), 0), 6) AS roi FROM u GROUP BY 1, 2""")
def d13(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("value")
    rows = table(spark, folder, "events").select("user_id", F.to_date("ts").alias("d"), "ts", F.when(F.col("event_id") % 8 != 0, F.col("ts")).alias("issued"), "event_type", F.when(v > 50, "win").when(v > 10, "loss").when(v > 5, "void").alias("o"), (1 + v / 60 - 0.3).alias("q"))
    named = {"all": F.lit(True), "top": F.col("event_type") == "purchase", "rest": F.col("event_type").isin("click", "view")}
    found = offers.kpis(rows, ["user_id", "d"], "issued", "ts", F.lit("2024-01-29 12:00:00").cast("timestamp"), [7, 14], named, F.col("o"), F.col("q"))
    return found.withColumns({c: F.round(c, 5) for c in ("avg_odds", "profit")} | {c: F.round(c, 6) for c in ("hit_rate", "roi")})


_MARK = "sha256('{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}')"
_PARTS = ", ".join(f"sum(('0x' || substr({_MARK}, {8 * k + 1}, 8))::BIGINT)::VARCHAR AS p{k}" for k in range(8))


@query("i5_offer_digests", f"WITH d AS (SELECT (ts - INTERVAL 6 HOUR)::DATE AS day, event_type, count(*) AS n, {_PARTS} FROM events GROUP BY 1, 2) SELECT day::VARCHAR AS day, event_type, n, sha256(n || '|' || {" || '|' || ".join(f'p{k}' for k in range(8))}) AS digest FROM d")
def i5(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("day", offers.betting_day(F.col("ts"), "UTC", 6))
    return offers.offer_digests(rows, "day", "event_type", ["event_id", "user_id"]).withColumn("day", F.col("day").cast("string"))


@query("i2_feed", """WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'win' END AS outcome FROM orders WHERE o_orderkey % 3 = 0),
j AS (SELECT o.*, b.outcome, b.o_orderkey IS NOT NULL AS inside, (epoch(o_orderdate) - epoch(TIMESTAMP '1998-06-01 00:00:00')) / 3600 AS ahead FROM orders o LEFT JOIN b ON b.o_orderkey = o.o_orderkey),
p AS (SELECT *, CASE WHEN outcome IS NOT NULL THEN 'result' WHEN ahead > 0 AND ahead <= 480 THEN 'upcoming' WHEN ahead <= 0 AND inside THEN 'live' END AS part FROM j)
SELECT o_orderkey, part, '{"o_orderstatus":"' || o_orderstatus || '","o_custkey":' || o_custkey || CASE WHEN outcome IS NULL THEN '' ELSE ',"outcome":"' || outcome || '"' END || '}' AS payload FROM p WHERE part IS NOT NULL""")
def i2(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    ledger = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "win").alias("outcome"))
    return offers.feed(orders, ledger, "o_orderkey", "o_orderdate", F.lit("1998-06-01 00:00:00"), 480, ["o_orderstatus", "o_custkey"]).select("o_orderkey", "part", "payload")


@query("k6_accounting_audit", """WITH e AS (SELECT CASE WHEN event_id % 50 <> 0 THEN 'k' || (event_id % 4000) END AS k, event_id % 4000 AS i, event_id FROM events),
r AS (SELECT k, CASE WHEN i % 31 <> 0 THEN i END AS issued, CASE WHEN i % 29 = 0 THEN i - 5 ELSE i + 5 END AS start, CASE i % 7 WHEN 0 THEN 'void' WHEN 1 THEN NULL WHEN 2 THEN 'loss' ELSE 'win' END AS outcome, CASE WHEN i % 11 = 0 THEN 0.9::DOUBLE ELSE 1.25 + (i % 8) / 4.0 END AS odds, 1.0 AS stake, i, event_id FROM e),
f AS (SELECT *, CASE WHEN event_id >= 8000 AND i % 13 = 0 THEN 9.0 WHEN i % 17 = 0 THEN 0.5 WHEN outcome = 'win' THEN odds - 1 ELSE -1.0 END AS profit FROM r),
p AS (SELECT k, count(*) AS n, count(DISTINCT {'i': issued, 's': start, 'o': outcome, 'q': odds, 'k': stake, 'p': profit}) AS d, min(issued) AS issued, min(start) AS start, min(outcome) AS outcome, min(odds) AS odds, min(profit) AS profit FROM f WHERE k IS NOT NULL GROUP BY 1),
s AS (SELECT *, CASE WHEN outcome = 'win' THEN odds - 1 ELSE -1.0 END AS expected, CASE WHEN d > 1 THEN 'conflicting' WHEN issued IS NULL THEN 'unissued' WHEN issued >= start THEN 'late' WHEN outcome = 'void' THEN 'void' WHEN outcome IS NULL THEN 'pending' WHEN odds <= 1 THEN 'unpriced' WHEN abs(profit - CASE WHEN outcome = 'win' THEN odds - 1 ELSE -1.0 END) > 1e-9 THEN 'mismatch' ELSE 'verified' END AS status FROM p)
SELECT status, count(*) AS n, coalesce(sum(expected::DOUBLE) FILTER (status = 'verified'), 0)::DOUBLE AS profit FROM s GROUP BY 1 UNION ALL SELECT 'identical_duplicate', sum(n - 1) FILTER (d = 1)::BIGINT, 0::DOUBLE FROM s HAVING sum(n - 1) FILTER (d = 1) > 0 UNION ALL SELECT 'missing_key', count(*), 0::DOUBLE FROM f WHERE k IS NULL""")
def k6(spark: SparkSession, folder: str) -> DataFrame:
    i, e = F.col("event_id") % 4000, F.col("event_id")
    rows = table(spark, folder, "events").select(
        F.when(e % 50 != 0, F.concat(F.lit("k"), i)).alias("k"), F.when(i % 31 != 0, i).alias("issued"), F.when(i % 29 == 0, i - 5).otherwise(i + 5).alias("start"),
        F.when(i % 7 == 0, "void").when(i % 7 == 2, "loss").when(i % 7 > 2, "win").alias("outcome"), F.when(i % 11 == 0, 0.9).otherwise(1.25 + i % 8 / 4).alias("odds"), F.lit(1.0).alias("stake"), i.alias("i"), e,
    )
    profit = F.when((e >= 8000) & (F.col("i") % 13 == 0), 9.0).when(F.col("i") % 17 == 0, 0.5).when(F.col("outcome") == "win", F.col("odds") - 1).otherwise(-1.0)
    return offers.accounting_audit(rows.withColumn("profit", profit), "k", "issued", "start", "outcome", "odds", "stake", "profit")


@query("k10_rolling_days", "WITH e AS (SELECT user_id, event_id, DATE '2024-01-25' - ts::DATE AS age FROM events) SELECT user_id, count(*) FILTER (age = 0) AS days_1, count(*) FILTER (age >= 0 AND age < 7) AS days_7, count(*) FILTER (age >= 0 AND age < 30) AS days_30 FROM e GROUP BY 1")
def k10(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return offers.rolling_days(events.unionByName(events.where("event_id % 3 = 0")), "user_id", "event_id", F.to_date("ts"), F.lit("2024-01-25").cast("date"), [1, 7, 30])


@query("k12_retry_due", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN true ELSE floor((epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(date_trunc('second', ts)))) / 3600 >= [6, 24, 72][least(greatest(event_id % 6, 1), 3)] END AS due FROM events")
def k12(spark: SparkSession, folder: str) -> DataFrame:
    due = offers.due(F.when(F.col("event_id") % 5 != 0, F.col("ts")), F.col("event_id") % 6, F.lit("2024-01-20 00:00:00"), [6, 24, 72])
    return table(spark, folder, "events").select("event_id", due.alias("due"))


@query("k18_successors", """WITH e AS (SELECT event_id, user_id, floor(value / 12)::BIGINT AS version, event_type AS digest, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr FROM events),
t AS (SELECT *, max(version) OVER (PARTITION BY user_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e), f AS (SELECT user_id, version, arg_min(digest, nr) AS first FROM e GROUP BY 1, 2)
SELECT event_id, CASE WHEN top IS NULL OR t.version > top THEN 'accepted' WHEN t.version < top THEN 'regressed' WHEN t.digest = first THEN 'repeated' ELSE 'conflict' END AS verdict FROM t LEFT JOIN f ON f.user_id = t.user_id AND f.version = top""")
def k18(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", F.floor(F.col("value") / 12).alias("version"), F.col("event_type").alias("digest"))
    return offers.successors(rows, "user_id", ["ts", "event_id"], "version", "digest").select("event_id", "verdict")


@query("k19_lifecycle", """WITH u AS (SELECT c_custkey AS u, DATE '2024-01-01' - (c_custkey * 7 % 200)::INT AS seen FROM customer), s AS (SELECT u, seen, DATE '2024-01-01' - seen AS idle FROM u),
f AS (SELECT *, CASE WHEN idle >= 150 THEN 'close' WHEN idle >= 90 THEN 'warn' WHEN idle >= 30 THEN 'remind' END AS action FROM s), a AS (SELECT c_custkey AS u, 'warn' AS action, DATE '2023-10-01' AS since FROM customer WHERE c_custkey % 4 = 0)
SELECT f.u, f.action, f.idle::INT AS idle_days FROM f LEFT JOIN a ON a.u = f.u AND a.action = f.action WHERE f.action IS NOT NULL AND (since IS NULL OR since < seen)""")
def k19(spark: SparkSession, folder: str) -> DataFrame:
    people, today = table(spark, folder, "customer"), F.lit("2024-01-01").cast("date")
    users = people.select(F.col("c_custkey").alias("u"), F.date_sub(today, (F.col("c_custkey") * 7 % 200).cast("int")).alias("seen"))
    done = people.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("u"), F.lit("warn").alias("action"), F.lit("2023-10-01").cast("date").alias("since"))
    return offers.lifecycle(users, done, "u", "seen", today, [("remind", 30), ("warn", 90), ("close", 150)])


_SCORES = ["6-4 6-3", "7-6(5) 3-6 6-2", "6-4 2-1", "", "x", "6-7(3) 6-4 7-5 6-1", "6-0, 6-0", "10-8"]
#: What each score means: sets of both sides, games.
_MEANT = [(2, 0, 19), (2, 1, 30), (1, 0, 13), None, None, (3, 1, 42), (2, 0, 12), (0, 0, 18)]


def _case(k: int) -> str:
    return "CASE o_orderkey % 8 " + " ".join(f"WHEN {n} THEN {'NULL' if m is None else m[k]}" for n, m in enumerate(_MEANT)) + " END"


@query("a21_typed_events", f"""WITH o AS (SELECT o_orderkey, {_case(0)} AS sa, {_case(1)} AS sb, {_case(2)} AS games, CASE WHEN o_orderkey % 33 = 0 OR o_orderkey % 25 = 0 THEN 'malformed' WHEN o_orderkey % 3 = 0 THEN 'no_sides' WHEN o_orderkey % 21 = 1 THEN 'no_start' END AS reject,
  lower(['ATP', 'WTA', 'ITF M15', 'other'][o_orderkey % 4 + 1]) AS tour, CASE o_orderkey % 6 WHEN 1 THEN 'Wimbledon' WHEN 2 THEN 'Wimbledon Qualifying' ELSE 'City Open' END AS tournament, CASE WHEN o_orderkey % 2 = 0 THEN 'a' WHEN o_orderkey % 5 <> 0 THEN 'b' END AS winner FROM orders),
f AS (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 3 WHEN o_orderkey % 8 = 5 THEN 5 WHEN tour IN ('wta', 'itf m15') THEN 3 WHEN tour = 'atp' AND tournament = 'Wimbledon' THEN 5 WHEN tour = 'atp' THEN 3 END AS best FROM o),
v AS (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN 'retired' WHEN winner IS NOT NULL AND greatest(sa, sb) < CASE WHEN best = 5 THEN 3 ELSE 2 END THEN 'incomplete' END AS void FROM f)
SELECT o_orderkey, CASE WHEN reject IS NULL THEN tour END AS tour, CASE WHEN reject IS NULL THEN best END AS best_of, CASE WHEN reject IS NULL THEN winner END AS winner, CASE WHEN reject IS NULL THEN sa END AS sets_a, CASE WHEN reject IS NULL THEN sb END AS sets_b, CASE WHEN reject IS NULL THEN games END AS games, CASE WHEN reject IS NULL THEN void END AS void, reject FROM v""")
def a21(spark: SparkSession, folder: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    person = lambda k: F.struct(F.concat(F.lit("p"), k).alias("id"), F.lit("name").alias("name"))
    home, away = customer, customer + key % 3
    event = F.struct(
        F.when(key % 25 == 0, "").otherwise(key.cast("string")).alias("id"), person(home).alias("home"), person(away).alias("away"), F.struct(F.lit("finished").alias("type"), F.when(key % 9 == 0, "Player retired").alias("description")).alias("status"),
        F.struct(F.when(key % 6 == 1, "Wimbledon").when(key % 6 == 2, "Wimbledon Qualifying").otherwise("City Open").alias("name"), F.get(F.lit(["ATP", "WTA", "ITF M15", "other"]), (key % 4).cast("int")).alias("tour")).alias("tournament"), F.lit("R1").alias("round"),
        F.when(key % 21 != 1, F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("start"), F.when(key % 10 == 0, 3).alias("bestOf"), F.when(key % 2 == 0, F.concat(F.lit("p"), home)).when(key % 5 != 0, F.concat(F.lit("p"), away)).otherwise("zz").alias("winner"),
        F.get(F.lit(_SCORES), (key % 8).cast("int")).alias("score"),
    )
    raw = table(spark, folder, "orders").select("o_orderkey", F.when(key % 33 == 0, "oops").otherwise(F.to_json(event)).alias("json"))
    return match.typed_events(raw, "json").select("o_orderkey", "tour", "best_of", "winner", "sets_a", "sets_b", "games", "void", "reject")


@query("graded_picks", """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE l_linenumber % 3 WHEN 0 THEN 'winner' WHEN 1 THEN 'games' ELSE 'other' END AS market, CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END WHEN l_suppkey % 2 = 0 THEN 'over' ELSE 'under' END AS side, CASE WHEN l_partkey % 10 = 0 THEN 'retired' END AS void, CASE WHEN l_partkey % 7 <> 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'a' ELSE 'b' END END AS winner FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN void IS NOT NULL THEN 'void' WHEN market = 'winner' THEN CASE WHEN winner IS NULL THEN 'pending' WHEN winner = side THEN 'win' ELSE 'loss' END WHEN market = 'games' THEN CASE WHEN l_quantity = 25 THEN 'void' WHEN (l_quantity > 25) = (side = 'over') THEN 'win' ELSE 'loss' END ELSE 'pending' END AS grade FROM r""")
def grades(spark: SparkSession, folder: str) -> DataFrame:
    line, odd = F.col("l_linenumber") % 3, lambda c: F.col(c) % 2 != 0
    side = F.when(line == 0, F.when(odd("l_suppkey"), "b").otherwise("a")).otherwise(F.when(odd("l_suppkey"), "under").otherwise("over"))
    winner: Column = F.when(F.col("l_partkey") % 7 != 0, F.when(odd("l_partkey"), "b").otherwise("a"))
    market = F.when(line == 0, "winner").when(line == 1, "games").otherwise("other")
    grade = match.graded(market, side, F.lit(25.0), F.when(F.col("l_partkey") % 10 == 0, "retired"), winner, F.col("l_quantity"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", grade.alias("grade"))
