import datetime as dt

import pytest
from pyspark.sql import functions as F

from rallyframe.functions import stats, text
from rallyframe.operators import joins, linkage, rows, selection
from rallyframe.sources import snapshots
from rallyframe.streaming import peaks


def test_asof_is_strict_and_bounded(spark):
    day = lambda d: dt.datetime(2025, 1, d)
    left = spark.createDataFrame([(1, "a", day(10)), (2, "a", day(5)), (3, "b", day(10)), (4, "a", day(30))], "i int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", day(5), 5), ("a", day(10), 10)], "k string, t timestamp_ntz, v int")
    strict = {r.i: r.v for r in joins.asof(left, right, ["k"], "t", "t", ["v"], "14 days").collect()}
    assert strict == {1: 5, 2: None, 3: None, 4: None}
    inclusive = {r.i: r.v for r in joins.asof(left, right, ["k"], "t", "t", ["v"], "14 days", strict=False).collect()}
    assert inclusive == {1: 10, 2: 5, 3: None, 4: None}


def test_asof_of_empty_sides(spark):
    left = spark.createDataFrame([], "k string, t timestamp_ntz")
    right = spark.createDataFrame([], "k string, t timestamp_ntz, v int")
    assert joins.asof(left, right, ["k"], "t", "t", ["v"], "1 day").collect() == []


def test_years_round_trip_and_manifest(spark, tmp_path):
    data = spark.createDataFrame([(1, dt.datetime(2024, 5, 1)), (2, dt.datetime(2025, 5, 1))], "id int, t timestamp_ntz")
    snapshots.write_years(data, str(tmp_path / "s"), "t")
    assert sorted(r.id for r in snapshots.read_years(spark, str(tmp_path / "s"), "t").collect()) == [1, 2]
    assert [r.id for r in snapshots.read_years(spark, str(tmp_path / "s"), "t", years=[2024]).collect()] == [1]
    assert [r.id for r in snapshots.read_years(spark, str(tmp_path / "s"), "t", before="2025-05-01 00:00:00").collect()] == [1]
    snapshots.write_years(data.where("id = 1"), str(tmp_path / "s"), "t", empty_years=[2025])
    assert [r.id for r in snapshots.read_years(spark, str(tmp_path / "s"), "t").collect()] == [1]
    data.limit(1).withColumn("year", F.lit(2024)).write.mode("append").partitionBy("year").parquet(str(tmp_path / "s/data"))
    with pytest.raises(ValueError):
        snapshots.read_years(spark, str(tmp_path / "s"), "t")


def test_append_new_is_idempotent(spark, tmp_path):
    data = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    assert snapshots.append_new(data, str(tmp_path / "l"), ["a", "b"]).count() == 2
    assert snapshots.append_new(data, str(tmp_path / "l"), ["a", "b"]).count() == 0


def test_upsert_and_reasons(spark):
    old = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    new = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert {r.k: r.v for r in rows.upsert(old, new, ["k"]).collect()} == {1: "old", 2: "new", 3: "new"}
    rules = {"low": F.col("k") < 2, "old": F.col("v") == "old"}
    assert [tuple(r) for r in old.select(rows.first_reason(rules), rows.all_reasons(rules)).collect()] == [("low", ["low", "old"]), ("old", ["old"])]


def test_functions(spark):
    row = spark.range(1).select(
        F.round(stats.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)), 1).alias("km"),
        stats.wilson(F.lit(8), F.lit(10))[0].alias("low"), stats.wilson(F.lit(0), F.lit(0))[0].alias("none"),
        text.initial_surname(F.lit(" Ana  de-Soto ")).alias("key"), text.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("j"),
    ).first()
    assert row.km == 10007.6 and abs(row.low - 0.4901) < 1e-3 and row.none is None and row.key == "a soto" and row.j == 0.5


def test_cascade_falls_to_lowest(spark):
    df = spark.createDataFrame([("d", 0.9), ("d", 0.7), ("d", 0.5), ("e", 0.95)], "k string, p double")
    got = {(r.k, r.p, r.threshold) for r in selection.cascade(df, ["k"], F.col("p"), [0.6, 0.8], 2).collect()}
    assert got == {("d", 0.9, 0.6), ("d", 0.7, 0.6), ("e", 0.95, 0.6)}


def test_stream_equals_batch(spark, tmp_path):
    data = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "value")
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = peaks.peaks(stream, ["user_id"], "ts", "value").writeStream.outputMode("complete").format("memory").queryName("peaks").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("peaks").collect())) == sorted(map(tuple, peaks.peaks(data, ["user_id"], "ts", "value").collect()))


def test_old_dates_decay(spark):
    from rallyframe.operators import history

    rows = [(k, "a", dt.date(1992, 1, 1 + k), float(k)) for k in range(5)] + [(9, "a", dt.date(2150, 1, 1), 3.0), (10, "b", dt.date(1850, 5, 5), None)]
    df = history.recent(spark.createDataFrame(rows, "i int, k string, day date, v double"), ["k"], "day", "i", ["v"], last=3)
    days = {day: i for i, _, day, _ in rows}
    got = {days[r.day]: r.m for r in df.select("day", history.decayed(F.col("recent"), F.col("day"), "v", 7).alias("m")).collect()}
    weights = [2 ** (-age / 7) for age in (3, 2, 1)]
    assert got[0] is None and got[9] is None and got[10] is None and got[4] == pytest.approx(sum(w * v for w, v in zip(weights, (1, 2, 3))) / sum(weights))


def test_values(spark):
    from rallyframe.functions import values

    rows = [("1,234.5", "6/4", "2025-01-02T03:04:05Z"), ("12%", "+150", "1700000000"), ("x", "-200", "soon"), (None, "1.0", None), ("NaN", "2.5", "")]
    got = spark.createDataFrame(rows, "n string, o string, t string").select(values.number(F.col("n")).alias("n"), values.decimal_odds(F.col("o")).alias("o"), values.utc_time(F.col("t")).alias("t")).collect()
    assert [r.n for r in got] == [1234.5, 12.0, None, None, None] and [r.o for r in got] == [2.5, 2.5, 1.5, None, 2.5]
    assert [r.t is None for r in got] == [False, False, True, True, True]
    one = spark.range(1).select(
        values.folded(F.lit(" Łódź-Ñandú ")).alias("f"), values.enum(F.lit(" Clay "), {"clay": ["clay", "red"]}).alias("e"), values.games(F.lit("SSRAD")).alias("g"), values.overround([F.lit(1.9), F.lit(1.9)]).alias("m"),
        values.elo_update(F.lit(1500.0), F.lit(0.5), F.lit(True), F.lit(0)).alias("elo"), stats.shrink(F.lit(1.0), F.lit(4), F.lit(0.5), 4.0).alias("s"), stats.fair_pair(F.lit(2.0), F.lit(2.0)).alias("p"), stats.expected_value(F.lit(0.5), F.lit(2.2)).alias("ev"),
        stats.elo_expected(F.lit(1500.0), F.lit(1500.0)).alias("x"), stats.logit(F.lit(0.5)).alias("l"), text.overlap_of_shorter(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("o"),
    ).first()
    assert one.f == "lodz nandu" and one.e == "clay" and tuple(one.g) == (3, 2, 5) and one.m == pytest.approx(2 / 1.9 - 1) and one.elo == 1516.0
    assert (one.s, one.p, one.x, one.l, one.o) == (0.75, 0.5, 0.5, 0.0, 1.0) and one.ev == pytest.approx(0.1)


def test_csv_and_jsonl(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    assert snapshots.read_csv(spark, str(tmp_path / "a.csv"), "id int, name string").count() == 2
    with pytest.raises(ValueError):
        snapshots.read_csv(spark, str(tmp_path / "a.csv"), "id int, other string")
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert snapshots.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int", 2, "a > 1").count() == 1
    with pytest.raises(ValueError):
        snapshots.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int", 3)


def test_slots_and_once(spark, tmp_path):
    at = lambda m, s=0: dt.datetime(2025, 1, 1, 12, m, s)
    rows = spark.createDataFrame([("a", at(3, 59), 1.0), ("a", at(4), 2.0), ("a", at(8, 59), 3.0), ("b", at(9), 4.0), ("b", at(9), 4.0)], "k string, t timestamp, v double")
    want = {("a", at(-0 or 0).replace(hour=11, minute=59), 1.0), ("a", at(4), 5.0), ("b", at(9), 8.0)}
    assert {(r.k, r.slot_start, r.total) for r in peaks.slots(rows, "t", ["k"], "v").collect()} == want
    assert peaks.once(rows, ["k", "v"], "t").count() == 4
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = peaks.once(stream, ["k", "v"], "t").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("once").count() == 4


def test_merges_on_edge_cases(spark):
    from rallyframe.operators import gates, linkage

    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert {tuple(r) for r in linkage.merged(a, a.limit(0), ["k"], ["v"], []).collect()} == {(1, "x", "old"), (2, None, "old")}
    with pytest.raises(ValueError):
        linkage.one_to_one(a, a.union(a).withColumnRenamed("v", "w"), ["k"])
    twice = gates.swap_sides(gates.swap_sides(a.withColumn("w", F.lit("y")), [("v", "w")]), [("v", "w")])
    assert {tuple(r) for r in twice.collect()} == {(1, "x", "y"), (2, None, "y")}
    assert gates.sample_weights(spark.createDataFrame([], "day date"), "day", F.current_date(), 30).count() == 0


def test_pairs_of_a_dense_step_are_spread(spark):
    # 400 rows in one step, 40 in the next, some beyond, a null
    values = [(k, "x", 10.0 + (k % 7) / 2) for k in range(400)] + [(k, "x", 15.0 + (k % 9) / 2) for k in range(400, 440)] + [(440, "x", 40.0), (441, "y", 11.0), (442, "x", None)]
    df = spark.createDataFrame(values, "id long, bucket string, v double")
    found = linkage.pairs_in_bucket(df, ["bucket"], "id", "v", 5.0, block=50).withColumn("at", F.spark_partition_id()).collect()
    meant = {(a, b) for a, p, x in values for b, q, y in values if a < b and p == q and x is not None and y is not None and abs(x - y) <= 5}
    assert len(found) == len(meant) and {(r.a, r.b) for r in found} == meant
    tasks = [sum(r["at"] == k for r in found) for k in {r["at"] for r in found}]
    assert len(tasks) >= 4 and max(tasks) < 0.5 * len(meant)


def _sent(plan):
    """The rows that an executed plan's exchanges wrote."""
    inner = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan"}.get(plan.nodeName())
    children = [getattr(plan, inner)()] if inner else [plan.children().apply(k) for k in range(plan.children().size())]
    own = plan.metrics().get("shuffleRecordsWritten")
    return (own.get().value() if own.isDefined() else 0) + sum(map(_sent, children))


def test_pairs_are_sent_in_proportion_to_rows(spark):
    def sent(n):
        df = spark.range(n).selectExpr("id", "'x' AS bucket", "10 + id % 97 / 10.0D AS v")
        counted = linkage.pairs_in_bucket(df, ["bucket"], "id", "v", 5.0, block=20).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        found, every = counted.collect()[0], spark.range(n).selectExpr("id AS b", "10 + id % 97 / 10.0D AS w").join(df).where("id < b AND abs(v - w) <= 5")
        assert found == every.agg(F.count("*"), F.sum(F.xxhash64("id", "b").cast("decimal(38,0)"))).collect()[0]
        return _sent(counted._jdf.queryExecution().executedPlan())

    few, many = sent(400), sent(1600)
    assert 400 < few and many < 6 * few, (few, many)


def test_pairs_at_the_edges_of_steps(spark):
    # differences that are rounded to the bound across a whole step, a repeated id, values without a difference
    values = [(0, "x", -1e-20), (1, "x", 5.0), (2, "x", 10.0), (2, "x", 12.0), (3, "x", float("inf")), (4, "x", float("inf")), (5, "x", float("nan")), (6, "x", float("-inf")), (7, None, 5.0), (8, None, 5.0), (None, "x", 5.0), (None, "x", 8.0)]
    found = linkage.pairs_in_bucket(spark.createDataFrame(values, "id long, bucket string, v double"), ["bucket"], "id", "v", 5.0).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1), (1, 2)]
    assert linkage.pairs_in_bucket(spark.createDataFrame([], "id long, bucket string, v double"), ["bucket"], "id", "v", 5.0).count() == 0
