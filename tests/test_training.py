"""Decayed moments, snapshots, training frame, pair index and comparisons of predictions against brute force."""

import datetime as dt
import glob
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from rallyframe.operators import decay, frames, ranges, significance
from rallyframe.sources import pair_index

DAY0 = dt.date(1990, 1, 1)


def days_of(rng, n, spread):
    return [DAY0 + dt.timedelta(days=rng.choice([rng.randint(0, spread), rng.randint(0, 30), spread - rng.randint(0, 5)])) for _ in range(n)]


@pytest.mark.parametrize("half_lives", [(1.0, 30.0), (7.5, 365.0)])
def test_decayed_moments_equal_brute_force(spark, half_lives):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice("xy"), day, None if rng.random() < 0.1 else 1e6 + rng.random()) for day in days_of(rng, 1000, 2500)]
    df = spark.createDataFrame(rows, "k string, s string, day date, v double")
    found = decay.moments_before(decay.daily(df, ["k", "s"], "day", F.col("v")), ["k"], "day", {f"h{n}": h for n, h in enumerate(half_lives)}, more=["s"]).collect()
    assert len(found) == len({(k, s, day) for k, s, day, _ in rows})
    for r in found:
        earlier = [((r["day"] - day).days, v) for k, s, day, v in rows if k == r["k"] and s == r["s"] and day < r["day"] and v is not None]
        for n, h in enumerate(half_lives):
            got, w = r[f"h{n}"], [2 ** (-age / h) for age, _ in earlier]
            assert got["n"] == len(earlier)
            assert got["weight"] == pytest.approx(sum(w), rel=1e-9, abs=1e-290)
            if sum(w) > 1e-250:
                mean = sum(x * v for x, (_, v) in zip(w, earlier)) / sum(w)
                assert got["mean"] == pytest.approx(mean, rel=1e-12)
                assert got["variance"] == pytest.approx(sum(x * (v - mean) ** 2 for x, (_, v) in zip(w, earlier)) / sum(w), abs=1e-6)
                assert got["ess"] == pytest.approx(sum(w) ** 2 / sum(x * x for x in w), rel=1e-9)


def test_decayed_moments_without_values(spark):
    df = spark.createDataFrame([("a", DAY0, None), ("a", DAY0 + dt.timedelta(days=1), 3.0)], "k string, day date, v double")
    rows = decay.moments_before(decay.daily(df, ["k"], "day", F.col("v")), ["k"], "day", {"m": 5.0}).select("m", decay.with_prior(F.col("m"), 0.4, 6.0).alias("p")).collect()
    assert all(r["m"]["n"] == 0 and r["m"]["mean"] is None and r["m"]["ess"] is None and r["p"] == pytest.approx(0.4) for r in rows)
    assert decay.moments_before(decay.daily(df.limit(0), ["k"], "day", F.col("v")), ["k"], "day", {"m": 5.0}).count() == 0


OF = frames.Matches("id", "day", "surface", ("a", "b"), ("sa", "sb"), "won")
MATCHES = "id long, day date, surface string, a string, b string, sa double, sb double, won boolean"


def test_training_frame_sees_no_row_of_its_day(spark):
    rng = random.Random(6)
    rows = [(i, day, rng.choice("cg"), *rng.sample("pqrst", 2), rng.random(), rng.random(), rng.random() < 0.5) for i, day in enumerate(sorted(days_of(rng, 200, 60)))]
    last = rows[150][1]
    changed = [(i, d, s, a, b, 1 - x, 1 - y, not w) if d >= last else (i, d, s, a, b, x, y, w) for i, d, s, a, b, x, y, w in rows]

    def features(own):
        return {r["id"]: tuple(v for c, v in r.asDict().items() if c != "label") for r in frames.training_frame(spark.createDataFrame(own, MATCHES), OF, least=0).where(F.col("day") <= F.lit(last)).collect()}

    before = features(rows)
    assert before == features(changed) and len(before) == sum(d <= last for _, d, *_ in rows)


def test_training_frame_turns_sides(spark):
    rng = random.Random(8)
    rows = [(i, day, "c", *rng.sample("pqr", 2), rng.random(), rng.random(), rng.random() < 0.5) for i, day in enumerate(days_of(rng, 60, 40))]
    turned = [(i, d, s, b, a, y, x, not w) for i, d, s, a, b, x, y, w in rows]
    one, two = ({r["id"]: r for r in frames.training_frame(spark.createDataFrame(own, MATCHES), OF, least=0).collect()} for own in (rows, turned))
    for i, r in one.items():
        assert r["label"] == 1 - two[i]["label"] and r["swapped"] == two[i]["swapped"] and r["h2h"] == pytest.approx(-two[i]["h2h"])
        assert all((r[f"d_{f}"] is None and two[i][f"d_{f}"] is None) or r[f"d_{f}"] == pytest.approx(-two[i][f"d_{f}"], abs=1e-12) for f in frames.SIDE)


def test_lookup_opens_one_bucket(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(f"p{i % 40}", f"p{(i * 7 + 1) % 40}", i) for i in range(500)] + [(None, "p1", 0)]
    df = spark.createDataFrame(rows, "a string, b string, at int")
    pair_index.build_index(df, path, "a", "b", "at")
    want = sorted(i for a, b, i in rows if a and {a, b} == {"p3", "p22"})
    assert want
    own = f"bucket={pair_index.lookup(spark, path, 'p3', 'p22').select(pair_index.bucket_of(F.col('pair')).alias('k')).first()['k']}"
    for f in glob.glob(f"{path}/bucket=*/*.parquet"):
        if f"/{own}/" not in f and f != sorted(glob.glob(f"{path}/bucket=*/*.parquet"))[0]:  # one whole file is left for the schema
            with open(f, "wb") as broken:
                broken.write(b"no parquet")
    got = pair_index.lookup(spark.newSession(), path, "p22", "p3")
    assert sorted(r["at"] for r in got.collect()) == want


def test_roc_auc(spark):
    rng = random.Random(1)
    rows = [(rng.choice([rng.random(), 0.25, 0.5]), int(rng.random() < 0.3)) for _ in range(700)] + [(None, 1), (0.3, None)]
    auc = lambda own: significance.roc_auc(spark.createDataFrame(own, "p double, y int"), F.col("p"), F.col("y")).first()
    pos, neg = [p for p, y in rows if y == 1 and p is not None], [p for p, y in rows if y == 0]
    got = auc(rows)
    assert (got["n"], got["positives"]) == (700, len(pos))
    assert got["auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg), abs=1e-12)
    assert auc([(0.5, 1), (0.5, 0), (0.5, 0)])["auc"] == 0.5 and auc([(0.1, 0), (0.2, 1)])["auc"] == 1.0
    assert auc([(0.5, 1)])["auc"] is None and auc([])["n"] == 0


def test_mcnemar_is_exact(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (3, 3), (0, 12), (5, 14), (19, 20), (20, 21), (40, 10), (400, 350), (5100, 4900), (4800, 5200), (0, 2000), (10, 9990)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", significance.mcnemar_p(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        n, low = r["a"] + r["b"], min(r["a"], r["b"])
        want = 1.0 if r["a"] == r["b"] else min(1.0, 2 * sum(math.comb(n, k) for k in range(low + 1)) / 2**n)
        assert r["p"] == pytest.approx(want, abs=1e-9), (r["a"], r["b"])


def test_bootstrap_is_reproducible(spark):
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("v"))
    one, two = (significance.row_bootstrap(x, F.col("id"), F.col("v"), rounds=100) for x in (df, df.repartition(5)))
    a, b = one.first(), two.first()
    mean = sum(i % 7 for i in range(400)) / 400
    assert a["n"] == 400 and a["mean"] == pytest.approx(mean) and a["low"] == pytest.approx(b["low"]) and a["high"] == pytest.approx(b["high"])
    assert mean - 0.4 < a["low"] < mean - 0.08 and mean + 0.08 < a["high"] < mean + 0.4


def test_permutation_stays_within_groups(spark):
    rows = [(i, None if i % 50 == 0 else "big" if i % 3 else "small", float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    got = significance.permuted(df, "g", "k", ["v"]).collect()
    again = {r["k"]: r["v_permuted"] for r in significance.permuted(df.repartition(7), "g", "k", ["v"]).collect()}
    assert {r["k"]: r["v_permuted"] for r in got} == again and len(got) == 600
    for g in (None, "big", "small"):
        own = [r for r in got if r["g"] == g]
        assert sorted(r["v"] for r in own) == sorted(r["v_permuted"] for r in own)
    assert sum(r["v"] == r["v_permuted"] for r in got) < 60
    other = {r["k"]: r["v_permuted"] for r in significance.permuted(df, "g", "k", ["v"], seed=2).collect()}
    assert other != again


def test_numbers_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 5, rng.randint(0, 1000)])) for i in range(800)]
    got = {r["k"]: r["n"] for r in ranges.numbered(spark.createDataFrame(rows, "k int, v int"), "v", [F.col("k")], "n").collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {k: n for n, (k, _) in enumerate(order, 1)}


def test_one_busy_key_stays_linear(spark):
    """A million rows of one key over 500 days: histories and decayed sums are made per day, 500 rows, not per row."""
    from rallyframe.operators import history

    rows = spark.range(1_000_000).select(F.col("id"), F.lit("k").alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 500).cast("int")).alias("day"), (F.col("id") % 11).cast("double").alias("v"))
    recent = history.recent(rows, ["k"], "day", "id", ["v"])
    assert recent.select(F.count("*"), F.min(F.size("recent")), F.max(F.size("recent"))).first()[:] == (500, 0, 80)
    days = decay.moments_before(decay.daily(rows, ["k"], "day", F.col("v")), ["k"], "day", {"m": 30.0})
    n, last = days.select(F.count("*"), F.max("m.n")).first()
    assert (n, last) == (500, 998_000)


def test_bootstrap_sums_rounds_in_their_tasks(spark):
    rows = [(i, None if i % 40 == 0 else float(i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(3)
    found = significance.row_bootstrap(df, F.col("id"), F.col("v"), rounds=20)
    steps = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
    x, w = [0.0] * 20, [0] * 20
    for i, v in rows:
        bits = b"".join(hashlib.sha256(f"1:{d}:{i}".encode()).digest() for d in range(3))
        for r in range(20) if v is not None else ():
            k = sum(int.from_bytes(bits[4 * r : 4 * r + 4], "big") / 2**32 >= s for s in steps)
            x[r], w[r] = x[r] + k * v, w[r] + k
    got, means = found.first(), sorted(a / b for a, b in zip(x, w, strict=True))
    at = lambda q: means[int(19 * q)] + (19 * q) % 1 * (means[int(19 * q) + 1] - means[int(19 * q)])
    kept = [v for _, v in rows if v is not None]
    assert got["n"] == len(kept) and got["mean"] == pytest.approx(sum(kept) / len(kept))
    assert got["low"] == pytest.approx(at(0.025)) and got["high"] == pytest.approx(at(0.975))
    # no row is made for a row and a round
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
