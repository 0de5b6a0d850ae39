"""Claims, boards, names, contexts, tapes and live signals against brute force and by cases."""

import datetime as dt
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from rallyframe.operators import evidence
from rallyframe.streaming import live


def brute_claims(known, claims):
    """The rules of ``reconciled`` for one key."""
    rows = {}
    for row, family, field, value in claims:
        if value is not None:
            rows.setdefault(row, []).append((family, field, value))
    clash = lambda f, v: not math.isfinite(v) or (f in known and abs(v - known[f]) > 1e-6)
    tainted = {row for row, own in rows.items() if any(clash(f, v) for _, f, v in own)}
    fields = {f for own in rows.values() for _, f, _ in own}
    open_ = {f: [(row, fam, v) for row, own in rows.items() for fam, g, v in own if g == f and f not in known and math.isfinite(v)] for f in fields}
    clashes = {f for own in rows.values() for _, f, v in own if clash(f, v)}
    disputed = {f for f, own in open_.items() if own and max(v for *_, v in own) - min(v for *_, v in own) > 1e-6}
    out = {}
    for f in fields:
        clean = [(fam, v) for row, fam, v in open_[f] if row not in tainted]
        families = {fam for fam, _ in clean}
        if f in known:
            verdict = "conflict" if f in clashes else "known"
        elif f in disputed:
            verdict = "disputed"
        elif not clean:
            verdict = "conflict" if f in clashes and not open_[f] else "tainted"
        elif (clashes or disputed) and ("chart" not in families or not families - {"chart", "copy"}):
            verdict = "uncorroborated"
        else:
            verdict = "staged"
        out[f] = (verdict, clean[0][1] if verdict == "staged" else None, len(clean), len(families))
    return out


def test_claims_equal_brute_force(spark):
    rng = random.Random(9)
    known = {k: {f: float(rng.randint(0, 1)) for f in "ab" if rng.random() < 0.3} for k in range(150)}
    claims = [(k, row, rng.choice(["chart", "feed", "copy"]), f, rng.choice([1.0, 1.0, 1.0, 0.0, None, float("nan")] if rng.random() < 0.5 else [1.0])) for k in range(150) for row in range(rng.randint(0, 4)) for f in "abc" if rng.random() < 0.7]
    got = evidence.reconciled(
        spark.createDataFrame([(k, f, v) for k, own in known.items() for f, v in own.items()], "k int, field string, value double"), spark.createDataFrame(claims, "k int, row int, family string, field string, value double"), "k", "chart", "copy"
    )
    want = {(k, f): v for k in range(150) for f, v in brute_claims(known[k], [c[1:] for c in claims if c[0] == k]).items()}
    assert {(r["k"], r["field"]): (r["verdict"], r["value"], r["sources"], r["families"]) for r in got.collect()} == want
    assert {v[0] for v in want.values()} == {"known", "conflict", "disputed", "tainted", "uncorroborated", "staged"}


def test_board_diagnoses(spark):
    at = lambda minutes: dt.datetime(2025, 1, 1, 12) + dt.timedelta(minutes=minutes)
    schema = "id string, ts timestamp, full string, short string"
    board = [
        ("one", at(0), "anna b", "a b"), ("late", at(0), "far c", "f c"), ("short", at(0), "x", "s t"), ("two", at(0), "dora e", "d e"), ("c1", at(0), "gil h", "g h"), ("c2", at(5), "gil h", "g h"),
        ("one", at(0), "anna b", "a b"), (None, at(0), "anna b", "a b"), ("untimed", None, "anna b", "a b"), ("strict", at(0), "kim l", "k l"),
    ]
    fixtures = [
        ("f1", at(120), "anna b", "a b"), ("f2", at(121), "far c", "z"), ("f3", at(45), "sam t", "s t"), ("f4", at(1), "dora e", "d e"), ("f5", at(2), "dora e", "d e"), ("f6", at(3), "gil h", "g h"),
        ("f7", at(10), "kim l", "k l"), ("f8", at(0), "other", "k l"), ("f1", at(120), "anna b", "a b"),
    ]
    got = evidence.board_match(spark.createDataFrame(board, schema), spark.createDataFrame(fixtures, schema.replace("id", "fixture", 1)), "id", "fixture", "ts", [("full", 7200), ("short", 2700)])
    rows = {(r["id"], r["ts"] is None): (r["fixture"], r["stage"], r["diagnosis"]) for r in got.collect()}
    assert rows == {
        ("one", False): ("f1", 1, "matched"), ("late", False): (None, None, "unmatched"), ("short", False): ("f3", 2, "matched"), ("two", False): (None, 1, "ambiguous"), ("c1", False): (None, 1, "contested"),
        ("c2", False): (None, 1, "contested"), (None, False): (None, None, "unusable"), ("untimed", True): (None, None, "unusable"), ("strict", False): ("f7", 1, "matched"),
    }


def test_similar_names_equal_all_pairs(spark):
    rng = random.Random(12)
    parts = ["ivan", "иван", "petrov", "петров", "Müller", "muller", "maria", "μαρια", "lopez", "gonzalez", "schmidt", "o'neil", "li"]

    def name():
        own = f"{rng.choice(parts)} {rng.choice(parts)}"
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(own))
            own = own[:k] + rng.choice(["", "x", own[k] + "e"]) + own[k + 1 :]
        return own

    rows = [(i, rng.choice(["t1", "t2"]), None if i % 97 == 0 else name(), rng.choice([None, "1990", "1991"])) for i in range(2000)]
    schema = "id int, tour string, name string, born string"
    a, b = spark.createDataFrame(rows[:1000], schema), spark.createDataFrame(rows[1000:], schema)
    pairs = evidence.similar_names(a, b, "id", "name", "tour", ["born"])
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {(r["source"], r["target"]): (r["evidence"], r["distance"]) for r in pairs.collect()}
    forms = {r["id"]: r["f"] for r in a.union(b).select("id", evidence.latin(F.col("name")).alias("f")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE n (id INT, tour VARCHAR, born VARCHAR, f VARCHAR)")
    con.executemany("INSERT INTO n VALUES (?, ?, ?, ?)", [(i, tour, born, forms[i]) for i, tour, _, born in rows])
    want = con.execute("""SELECT a.id, b.id, CASE WHEN a.f = b.f THEN 'exact' WHEN a.f[1] || ' ' || string_split(a.f, ' ')[-1] = b.f[1] || ' ' || string_split(b.f, ' ')[-1] THEN 'initials' ELSE 'edits' END, levenshtein(a.f, b.f) AS d
      FROM n a JOIN n b ON a.tour = b.tour AND a.id < 1000 AND b.id >= 1000 AND a.f <> '' AND b.f <> '' AND coalesce(a.born = b.born, true)
      WHERE a.f[1] || ' ' || string_split(a.f, ' ')[-1] = b.f[1] || ' ' || string_split(b.f, ' ')[-1] OR (length(a.f) >= 8 AND length(b.f) >= 8 AND levenshtein(a.f, b.f) <= 2)""").fetchall()
    assert got == {(x, y): (e, d) for x, y, e, d in want} and {e for e, _ in got.values()} == {"exact", "initials", "edits"}


def test_latin_forms(spark):
    got = spark.createDataFrame([("Щукин  Юрий",), ("Ελένη",), (" Åsa-Łódź ",), (None,)], "n string").select(evidence.latin(F.col("n")).alias("f")).collect()
    assert [r["f"] for r in got] == ["shchukin yurii", "eleni", "asa lodz", ""]


def test_context_merge_is_idempotent(spark):
    cases = [
        ({"market": {"p": "1"}, "claim": {"of": "x", "by": "u"}, "env": {"ok": "true", "at": "a"}}, {"market": {"p": "2"}, "claim": {"of": "y"}, "env": {"at": "b"}, "new": {"k": "v"}}),
        ({"env": {"ok": "false", "at": "a"}, "notes": {"n": "1", "m": "2"}}, {"env": {}, "notes": {"n": "", "m": "3", "o": None}}),
        (None, {"env": {"at": "b"}}), ({"env": {"at": "b"}}, None), (None, None),
    ]
    df = spark.createDataFrame(cases, "a map<string,map<string,string>>, b map<string,map<string,string>>")
    rule = lambda a, b: evidence.merged_context(F.col(a), F.col(b), ["market"], ["claim"], ("env", "ok"))
    rows = df.withColumn("m", rule("a", "b")).withColumn("again", rule("m", "b")).collect()
    assert all(r["m"] == r["again"] for r in rows)
    assert rows[0]["m"] == {"market": {"p": "1"}, "claim": {"of": "y"}, "env": {"ok": "true", "at": "a"}, "new": {"k": "v"}}
    assert rows[1]["m"] == {"env": {"ok": "false", "at": "a"}, "notes": {"n": "1", "m": "3", "o": None}}
    assert [r["m"] for r in rows[2:]] == [{"env": {"at": "b"}}, {"env": {"at": "b"}}, {}]


def test_tapes(spark):
    tapes = {
        "SSSS;RRRR;SASA.DRDR": (8, 8, 8, 0, 3, None), "SRSR/SR SR/RR;": (6, 2, 4, 2, 1, None), "": ("empty",), "  ": ("empty",), None: ("empty",), "/SSSSSSSSS": ("turn_without_point",), "SSSS;SSx/SSSS": ("unknown_sign",),
        "SS;RR": ("too_few_points",), "SSSSSSSSS": ("one_sided",), "SS;/SSSSSSSS": ("turn_without_point",), ";;SSSS;;SSSS": (4, 4, 4, 4, 1, None),
    }
    got = spark.createDataFrame([(t,) for t in tapes], "t string").select("t", evidence.point_tape(F.col("t")).alias("p")).collect()
    for r in got:
        want = tapes[r["t"]]
        assert tuple(r["p"]) == (want if len(want) == 6 else (None,) * 5 + want), r


RULES = {"high": "value > 50", "click": "kind = 'click'"}


def test_stream_and_batch_fire_alike_and_once(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2025, 1, 1)
    rows = [(rng.randint(0, 20), start + dt.timedelta(minutes=i), rng.choice(["click", "view"]), rng.random() * 100) for i in range(200)]
    schema = "pick int, ts timestamp, kind string, value double"
    picks = spark.createDataFrame([(k,) for k in range(0, 20, 2)], "pick int")
    events = spark.createDataFrame(rows, schema)
    events.where(F.col("ts") < F.lit(start + dt.timedelta(minutes=100))).write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in live.fired(live.scan(events, picks, "pick", "ts", RULES), "pick", "ts").select("signal", "pick", "rule").collect()}

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        found = live.fired(live.scan(stream, picks, "pick", "ts", RULES), "pick", "ts")
        going = found.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / checkpoint)).foreachBatch(live.emit_once(str(tmp_path / "out"))).trigger(availableNow=True).start()
        going.awaitTermination()

    run("one")
    events.where(F.col("ts") >= F.lit(start + dt.timedelta(minutes=100))).write.mode("append").parquet(str(tmp_path / "in"))
    run("one")  # goes on where it stopped
    run("new")  # starts anew: nothing fires twice
    got = spark.read.parquet(str(tmp_path / "out")).select("signal", "pick", "rule").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    sink = live.emit_once(path)
    sink(spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "signal string, n int"), 0)
    sink(spark.createDataFrame([("b", 2), ("c", 2)], "signal string, n int"), 1)
    sink(spark.createDataFrame([("b", 2), ("c", 2)], "signal string, n int"), 1)
    sink(spark.createDataFrame([("d", 3)], "signal string, n int"), 0)  # another checkpoint's first batch
    assert sorted(r["signal"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "d"]


def test_point_links_reasons(spark):
    matches = spark.createDataFrame([(1, 2020, "ann", "bea", None, None), (2, 2020, "cil", "dot", 0.5, None), (3, 2020, "eve", "fay", 0.5, 0.5), (4, 2020, "gil", "hal", None, None), (5, 2020, "hal", "gil", None, None)], "id int, year int, one string, two string, k0 double, k1 double")
    points = spark.createDataFrame(
        [(1, 2020, "b.", "ann", 0.6, 0.4), (2, 2020, "cil", "dot", 0.9, 0.4), (3, 2020, "eve", "fay", 0.5, 0.5), (4, 2020, "gil", "hal", 0.1, 0.2), (5, 2021, "ann", "bea", 0.1, 0.2), (6, 2020, "ann", "ann", 0.1, 0.2), (7, 2020, None, "ann", 0.1, 0.2), (8, 2020, "dot", "cil", 0.3, 0.51)],
        "row int, year int, one string, two string, r0 double, r1 double",
    )
    aliases = spark.createDataFrame([("b.", "bea"), ("x", "ann"), ("x", "bea")], "alias string, name string")
    got = evidence.point_links(points, matches, aliases, ["year"], ("one", "two"), "id", "row", ("r0", "r1"), ("k0", "k1"))
    assert {r["row"]: tuple(r)[1:] for r in got.collect()} == {
        1: (1, 0.4, 0.6, "linked"), 2: (None, None, None, "conflict"), 3: (None, None, None, "present"), 4: (None, None, None, "ambiguous"), 5: (None, None, None, "unmatched"),
        6: (None, None, None, "unusable"), 7: (None, None, None, "unusable"), 8: (2, 0.51, 0.3, "linked"),
    }


def test_claims_are_dealt_to_tasks_of_bounded_size(spark):
    claims = spark.range(4000).selectExpr("id % 1000 AS k", "id % 2 AS row", "CASE WHEN id % 3 = 0 THEN 'charted' ELSE 'feed' END AS family", "'f' || (id % 4) AS field", "CAST(id % 5 AS DOUBLE) AS value")
    known = claims.where("k % 7 = 0").selectExpr("k", "field", "1.0D AS value")
    few, many = (evidence.reconciled(known, claims, "k", "charted", most=most) for most in (500_000, 100))
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    # 4000 claims of at most 100 a task: every exchange has 40 partitions, whatever the session's number is
    made = many._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in made and all(x.rstrip(")").endswith(", 40") for x in re.findall(r"hashpartitioning\([^)]*\)", made))
