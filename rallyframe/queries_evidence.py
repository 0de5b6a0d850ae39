"""Registered queries on claims of several sources: votes, boards, similar names, contexts and point tapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.operators import evidence
from rallyframe.plans.tables import table
from rallyframe.registry import query
from rallyframe.streaming import live

_C20_CLAIMS = "SELECT l_orderkey AS k, l_linenumber AS row, CASE l_returnflag WHEN 'R' THEN 'charted' WHEN 'A' THEN 'feed' ELSE 'copied' END AS family, 'f' || (l_partkey % 3) AS field, CASE WHEN l_suppkey % 12 = 0 THEN 'NaN'::DOUBLE WHEN l_suppkey % 5 = 0 THEN 9.0::DOUBLE ELSE (l_orderkey % 2)::DOUBLE END AS value FROM lineitem WHERE l_quantity > 2"


@query("c20_reconciled_claims", f"""WITH c AS ({_C20_CLAIMS}), e AS (SELECT o_orderkey AS k, 'f0' AS field, (o_orderkey % 2)::DOUBLE AS known FROM orders WHERE o_orderkey % 3 = 0),
m AS (SELECT c.*, known, NOT isfinite(value) OR coalesce(abs(value - known) > 1e-6, false) AS clash FROM c LEFT JOIN e ON e.k = c.k AND e.field = c.field),
t AS (SELECT k, row, bool_or(clash) AS tainted FROM m GROUP BY 1, 2), a AS (SELECT m.*, tainted, known IS NULL AND NOT clash AS open FROM m JOIN t ON t.k = m.k AND t.row = m.row),
f AS (SELECT k, field, bool_or(clash) AS clash, max(known) AS known, min(value) FILTER (open) AS low, max(value) FILTER (open) AS high, count(*) FILTER (open AND NOT tainted) AS sources,
  count(*) FILTER (open AND NOT tainted AND family = 'charted') AS witnesses, count(*) FILTER (open AND NOT tainted AND family = 'feed') AS others, count(DISTINCT family) FILTER (open AND NOT tainted) AS families FROM a GROUP BY 1, 2),
d AS (SELECT *, coalesce(high - low > 1e-6, false) AS disputed FROM f), q AS (SELECT k, bool_or(clash OR disputed) AS contested FROM d GROUP BY 1),
v AS (SELECT d.*, CASE WHEN known IS NOT NULL THEN CASE WHEN clash THEN 'conflict' ELSE 'known' END WHEN disputed THEN 'disputed' WHEN sources = 0 THEN CASE WHEN clash AND low IS NULL THEN 'conflict' ELSE 'tainted' END
  WHEN contested AND (witnesses = 0 OR others = 0) THEN 'uncorroborated' ELSE 'staged' END AS verdict FROM d JOIN q ON q.k = d.k)
SELECT k, field, CASE WHEN verdict = 'staged' THEN low END AS value, verdict, sources, families FROM v""")
def c20(spark: SparkSession, folder: str) -> DataFrame:
    family = F.when(F.col("l_returnflag") == "R", "charted").when(F.col("l_returnflag") == "A", "feed").otherwise("copied")
    value = F.when(F.col("l_suppkey") % 12 == 0, float("nan")).when(F.col("l_suppkey") % 5 == 0, 9.0).otherwise((F.col("l_orderkey") % 2).cast("double"))
    claims = table(spark, folder, "lineitem").where("l_quantity > 2").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("row"), family.alias("family"), F.concat(F.lit("f"), F.col("l_partkey") % 3).alias("field"), value.alias("value"))
    known = table(spark, folder, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.lit("f0").alias("field"), (F.col("o_orderkey") % 2).cast("double").alias("value"))
    return evidence.reconciled(known, claims, "k", "charted", never="copied")


@query("c28_board_match", """WITH b AS (SELECT DISTINCT event_id AS id, ts, user_id AS full, user_id % 40 AS short FROM events WHERE event_type = 'click'), f AS (SELECT event_id AS fixture, ts, user_id AS full, user_id % 40 AS short FROM events WHERE event_type = 'purchase'),
s1 AS (SELECT b.id, 1 AS stage, min(fixture) AS lo, max(fixture) AS hi FROM b JOIN f ON f.full = b.full AND abs(epoch(date_trunc('second', b.ts)) - epoch(date_trunc('second', f.ts))) <= 7200 GROUP BY 1),
s2 AS (SELECT b.id, 2 AS stage, min(fixture) AS lo, max(fixture) AS hi FROM b JOIN f ON f.short = b.short AND abs(epoch(date_trunc('second', b.ts)) - epoch(date_trunc('second', f.ts))) <= 2700 WHERE b.id NOT IN (SELECT id FROM s1) GROUP BY 1),
o AS (SELECT *, CASE WHEN lo = hi THEN lo END AS one FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2)), n AS (SELECT one, count(*) AS n FROM o WHERE one IS NOT NULL GROUP BY 1),
j AS (SELECT b.id, o.stage, o.one, n, o.id IS NULL AS none FROM b LEFT JOIN o ON o.id = b.id LEFT JOIN n ON n.one = o.one),
v AS (SELECT *, CASE WHEN none THEN 'unmatched' WHEN one IS NULL THEN 'ambiguous' WHEN n > 1 THEN 'contested' ELSE 'matched' END AS diagnosis FROM j)
SELECT id, CASE WHEN diagnosis = 'matched' THEN one END AS fixture, stage, diagnosis FROM v""")
def c28(spark: SparkSession, folder: str) -> DataFrame:
    keys = [F.col("user_id").alias("full"), (F.col("user_id") % 40).alias("short")]
    events = table(spark, folder, "events")
    board = events.where("event_type = 'click'").select(F.col("event_id").alias("id"), "ts", *keys)
    fixtures = events.where("event_type = 'purchase'").select(F.col("event_id").alias("fixture"), "ts", *keys)
    return evidence.board_match(board, fixtures, "id", "fixture", "ts", [("full", 7200), ("short", 2700)]).drop("ts")


@query("k21_similar_names", """WITH p AS (SELECT p_partkey AS id, p_brand AS block, p_name AS form, left(p_name, 1) || ' ' || string_split(p_name, ' ')[-1] AS initials, p_type, p_size FROM part WHERE p_name <> ''),
a AS (SELECT * FROM p WHERE p_size <= 25), b AS (SELECT * FROM p WHERE p_size > 25),
m AS (SELECT a.id AS source, b.id AS target, levenshtein(a.form, b.form) AS distance, a.initials = b.initials AS alike, a.form = b.form AS same, length(a.form) >= 8 AND length(b.form) >= 8 AS long FROM a JOIN b ON a.block = b.block AND a.p_type = b.p_type)
SELECT source, target, CASE WHEN same THEN 'exact' WHEN alike THEN 'initials' ELSE 'edits' END AS evidence, distance::INT AS distance, CASE WHEN same THEN 4 WHEN alike THEN 2 ELSE 1 END AS score FROM m WHERE alike OR (long AND distance <= 2)""")
def k21(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    return evidence.similar_names(parts.where("p_size <= 25"), parts.where("p_size > 25"), "p_partkey", "p_name", "p_brand", ["p_type"])


def _section(*entries: tuple[str, Column]) -> Column:
    return F.create_map(*[c for name, value in entries for c in (F.lit(name), value)])


@query("c24_merged_context", """WITH e AS (SELECT event_id AS i, event_id % 7 AS s, event_id % 5 AS t, event_id % 3 AS r, value::VARCHAR AS v, user_id::VARCHAR AS u FROM events)
SELECT i, CASE WHEN s > 2 THEN 'a' || u WHEN t > 2 THEN 'b' || v END AS market, CASE WHEN r > 0 THEN 'y' WHEN s > 1 THEN 'x' END AS claim, CASE WHEN r > 0 THEN NULL WHEN s > 1 THEN u END AS claim_by,
  CASE WHEN s = 4 THEN u WHEN t > 0 THEN v ELSE u END AS place, CASE WHEN t = 1 THEN u WHEN t = 2 THEN u ELSE v END AS note, u AS kept FROM e""")
def c24(spark: SparkSession, folder: str) -> DataFrame:
    s, t, r = (F.col("event_id") % k for k in (7, 5, 3))
    u, v, none = F.col("user_id").cast("string"), F.col("value").cast("string"), F.lit(None).cast("map<string,string>")
    put = lambda *pairs: F.map_filter(F.create_map(*[c for name, m in pairs for c in (F.lit(name), m)]), lambda _, m: m.isNotNull())
    left = put(
        ("market", F.when(s > 2, _section(("price", F.concat(F.lit("a"), u)))).otherwise(none)), ("claim", F.when(s > 1, _section(("of", F.lit("x")), ("by", u))).otherwise(none)),
        ("environment", _section(("resolved", F.when(s == 4, "true").otherwise("false")), ("place", u))), ("notes", _section(("note", u), ("kept", u))),
    )
    right = put(
        ("market", F.when(t > 2, _section(("price", F.concat(F.lit("b"), v)))).otherwise(none)), ("claim", F.when(r > 0, _section(("of", F.lit("y")))).otherwise(none)),
        ("environment", F.when(t > 0, _section(("place", v))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))),
        ("notes", _section(("note", F.when(t == 1, F.lit(None)).when(t == 2, "").otherwise(v)))),
    )
    merged = evidence.merged_context(left, right, ["market"], ["claim"], ("environment", "resolved"))
    rows = table(spark, folder, "events").select(F.col("event_id").alias("i"), merged.alias("m"))
    at = lambda section, entry: F.col("m")[section][entry]
    return rows.select("i", at("market", "price").alias("market"), at("claim", "of").alias("claim"), at("claim", "by").alias("claim_by"), at("environment", "place").alias("place"), at("notes", "note").alias("note"), at("notes", "kept").alias("kept"))


_SIGNS = "CASE event_type WHEN 'view' THEN CASE WHEN value > 30 THEN 'S' ELSE '.' END WHEN 'click' THEN 'R' WHEN 'error' THEN CASE WHEN value > 120 THEN 'x' WHEN value > 60 THEN '/' ELSE 'A' END WHEN 'purchase' THEN ';' ELSE 'D' END"


@query("tape_points", f"""WITH e AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, {_SIGNS} AS sign, row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT *, sign IN ('S', 'A', 'R', 'D') AS point, sign IN (';', '.') AS ends FROM e),
c AS (SELECT *, coalesce(sum(point::INT) OVER w, 0) AS seen FROM b WINDOW w AS (PARTITION BY user_id, week ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, seen > coalesce(max(CASE WHEN ends THEN seen END) OVER (PARTITION BY user_id, week ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS played FROM c),
s AS (SELECT *, coalesce(sum(((ends AND played) OR sign = '/')::INT) OVER (PARTITION BY user_id, week ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS server,
  CASE WHEN sign = '/' AND NOT played THEN 'turn_without_point' WHEN sign = 'x' THEN 'unknown_sign' END AS error FROM p),
g AS (SELECT user_id, week, count(*) FILTER (point AND server = 0) AS s0, count(*) FILTER (sign IN ('S', 'A') AND server = 0) AS w0, count(*) FILTER (point AND server = 1) AS s1, count(*) FILTER (sign IN ('S', 'A') AND server = 1) AS w1,
  count(*) FILTER (ends AND played) AS games, arg_min(error, i) FILTER (error IS NOT NULL) AS error FROM s GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN error IS NOT NULL THEN error WHEN s0 + s1 < 8 THEN 'too_few_points' WHEN s0 = 0 OR s1 = 0 THEN 'one_sided' END AS e FROM g)
SELECT user_id, week::VARCHAR AS week, CASE WHEN e IS NULL THEN s0 END::INT AS served0, CASE WHEN e IS NULL THEN w0 END::INT AS won0, CASE WHEN e IS NULL THEN s1 END::INT AS served1, CASE WHEN e IS NULL THEN w1 END::INT AS won1, CASE WHEN e IS NULL THEN games END::INT AS games, e AS error FROM h""")
def tape(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week"), "ts", "event_id", F.expr(_SIGNS).alias("sign"))
    tapes = rows.groupBy("user_id", "week").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "sign"))), lambda r: r["sign"]), "").alias("tape"))
    return tapes.select("user_id", F.col("week").cast("string").alias("week"), evidence.point_tape(F.col("tape")).alias("p")).select("user_id", "week", "p.*")


@query("c21_point_links", """WITH a AS (SELECT 'x' || s_suppkey AS alias, 'p' || (s_suppkey % 50) AS name FROM supplier),
m AS (SELECT l_orderkey AS id, year(l_shipdate) * 12 + month(l_shipdate) AS month, 'p' || (l_suppkey % 50) AS one, 'p' || (l_partkey % 50) AS two, CASE WHEN l_quantity < 30 THEN NULL ELSE l_discount END AS k0, CASE WHEN l_quantity < 40 THEN NULL ELSE l_tax END AS k1 FROM lineitem WHERE l_linenumber <= 2),
p AS (SELECT l_orderkey * 10 + l_linenumber AS row, year(l_shipdate) * 12 + month(l_shipdate) AS month, 'x' || (l_partkey % 100) AS one, 'p' || (l_suppkey % 60) AS two, l_discount AS r0, l_tax AS r1 FROM lineitem WHERE l_linenumber > 2),
mr AS (SELECT *, least(one, two) AS lo, greatest(one, two) AS hi FROM m WHERE one <> two), mg AS (SELECT month, lo, hi, count(*) AS n, min(id) AS id, min(one) AS f, min(k0) AS k0, min(k1) AS k1 FROM mr GROUP BY 1, 2, 3),
pr AS (SELECT p.row, p.month, coalesce(x.name, one) AS one, coalesce(y.name, two) AS two, r0, r1 FROM p LEFT JOIN a x ON x.alias = one LEFT JOIN a y ON y.alias = two),
j AS (SELECT pr.*, n, id, k0, k1, CASE WHEN one = f THEN r0 ELSE r1 END AS a0, CASE WHEN one = f THEN r1 ELSE r0 END AS a1 FROM pr LEFT JOIN mg ON mg.month = pr.month AND mg.lo = least(one, two) AND mg.hi = greatest(one, two)),
v AS (SELECT *, CASE WHEN one = two THEN 'unusable' WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' WHEN coalesce(abs(k0 - a0) > 0.02, false) OR coalesce(abs(k1 - a1) > 0.02, false) THEN 'conflict' WHEN k0 IS NOT NULL AND k1 IS NOT NULL THEN 'present' ELSE 'linked' END AS reason FROM j)
SELECT row, CASE WHEN reason = 'linked' THEN id END AS id, CASE WHEN reason = 'linked' THEN a0 END AS first, CASE WHEN reason = 'linked' THEN a1 END AS second, reason FROM v""")
def c21(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumn("month", F.year("l_shipdate") * 12 + F.month("l_shipdate"))
    named = lambda letter, c, k: F.concat(F.lit(letter), F.col(c) % k)
    matches = lines.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("id"), "month", named("p", "l_suppkey", 50).alias("one"), named("p", "l_partkey", 50).alias("two"), F.when(F.col("l_quantity") >= 30, F.col("l_discount")).alias("k0"), F.when(F.col("l_quantity") >= 40, F.col("l_tax")).alias("k1"))
    points = lines.where("l_linenumber > 2").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), "month", named("x", "l_partkey", 100).alias("one"), named("p", "l_suppkey", 60).alias("two"), F.col("l_discount").alias("r0"), F.col("l_tax").alias("r1"))
    aliases = table(spark, folder, "supplier").select(F.concat(F.lit("x"), "s_suppkey").alias("alias"), named("p", "s_suppkey", 50).alias("name"))
    return evidence.point_links(points, matches, aliases, ["month"], ("one", "two"), "id", "row", ("r0", "r1"), ("k0", "k1"))


@query("s1_live_scan", """WITH p AS (SELECT c_custkey AS pick, c_acctbal / 10000 AS probability FROM customer WHERE c_acctbal / 10000 >= 0.3),
m AS (SELECT pick, ts, value, event_type FROM events JOIN p ON pick = user_id WHERE event_type <> 'error'),
f AS (SELECT pick, 'lost_first' AS rule, ts, value FROM m WHERE event_type = 'click' AND value > 40 UNION ALL SELECT pick, 'break_lead', ts, value FROM m WHERE event_type = 'view' AND value > 60 UNION ALL SELECT pick, 'won_second', ts, value FROM m WHERE event_type = 'purchase' AND value > 20)
SELECT sha256(pick || '|' || rule) AS signal, pick, rule, epoch_us(min(ts))::BIGINT AS fired_us, count(*) AS seen FROM f GROUP BY pick, rule""")
def s1(spark: SparkSession, folder: str) -> DataFrame:
    picks = table(spark, folder, "customer").select(F.col("c_custkey").alias("pick"), (F.col("c_acctbal") / 10000).alias("probability")).where("probability >= 0.3")
    return live.fired(live.scan(table(spark, folder, "events").withColumnRenamed("user_id", "pick").where("event_type <> 'error'"), picks, "pick", "ts", LIVE_RULES), "pick", "ts").select("signal", "pick", "rule", F.unix_micros(F.col("ts").cast("timestamp")).alias("fired_us"), "seen")


LIVE_RULES = {"lost_first": "event_type = 'click' AND value > 40", "break_lead": "event_type = 'view' AND value > 60", "won_second": "event_type = 'purchase' AND value > 20"}
