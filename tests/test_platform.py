"""Linkers with gates, guards of canonical tables, offers, estimates and typed provider rows by cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rallyframe.functions import matches
from rallyframe.operators import estimates, linkers, offers

D = lambda n: dt.date(2025, 1, 1) + dt.timedelta(days=n)


def test_gated_link_reasons(spark):
    schema = "id int, blk string, day date, surface string, winner string"
    matches_ = spark.createDataFrame([(1, "a", D(0), "c", "x"), (2, "b", D(0), "c", "x"), (3, "b", D(0), "c", "x"), (4, "c", D(1), "c", "x"), (5, "d", D(0), "g", "x"), (6, "e", D(0), "c", "y"), (7, "f", D(3), "c", "x"), (8, "h", D(0), None, "x")], schema)
    sources = spark.createDataFrame(
        [(10, "a", D(0), "c", "x"), (11, "b", D(0), "c", "x"), (12, "c", D(1), "c", "x"), (13, "c", D(1), "c", "x"), (14, "d", D(0), "c", "x"), (15, "e", D(0), "c", "x"), (16, "f", D(0), "c", "x"), (17, None, D(0), "c", "x"), (18, "a", None, "c", "x"), (19, "h", D(1), "c", "x")], schema
    )
    same = lambda c: F.col(f"s_{c}") == F.col(f"m_{c}")
    told = [linkers.Evidence("date", same("day"), 4), linkers.Evidence("surface", same("surface"), 1), linkers.Evidence("winner", same("winner"), 3)]
    got = linkers.gated_link(sources.withColumnRenamed("id", "sid"), matches_.withColumnRenamed("id", "mid"), "sid", "mid", ["blk"], "day", (F.lit(-1), F.lit(1)), told, ~same("surface"), lambda score, held: held["winner"] & (score >= 3), 1)
    assert {r["sid"]: (r["mid"], r["score"], r["reason"]) for r in got.collect()} == {
        10: (1, 8, "linked"), 11: (None, 8, "tied"), 12: (None, 8, "contested"), 13: (None, 8, "contested"), 14: (None, 7, "vetoed"), 15: (None, 5, "rejected"), 16: (None, None, "unmatched"),
        17: (None, None, "unusable"), 18: (None, None, "unusable"), 19: (8, 3, "linked"),
    }


def test_trusted_batch_protects_what_is_there(spark):
    schema = "id int, a string, b string, x string, y string"
    existing = spark.createDataFrame([(1, "p", "q", "1", None), (2, "r", "s", None, None), (3, "t", "u", "3", "3")], schema)
    incoming = spark.createDataFrame([(1, "p", "q", "9", "7"), (2, "r", "z", "2", "2"), (3, "t", "u", "3", None), (4, "p", "q", "4", "4"), (5, "n", "n", "5", None), (6, "m", "m", "6", "6"), (6, "m", "m", "7", "6"), (7, "k", "k", "1", "1"), (7, "k", "k", "1", "1"), (None, "j", "j", "1", "1")], schema)
    merged, verdicts = linkers.trusted_batch(existing, incoming, "id", ["a", "b"], ["x", "y"])
    assert {r["id"]: r["verdict"] for r in verdicts.collect()} == {1: "conflict", 2: "identity_changed", 3: "unchanged", 4: "known_elsewhere", 5: "new", 6: "duplicate", 7: "new"}
    assert {tuple(r) for r in merged.collect()} == {(1, "p", "q", "1", "7"), (2, "r", "s", None, None), (3, "t", "u", "3", "3"), (5, "n", "n", "5", None), (7, "k", "k", "1", "1")}


def test_scores(spark):
    cases = {
        "6-4 3-6 7-6(5)": ([(6, 4, None), (3, 6, None), (7, 6, 5)], 2, 1, 32, None), "6:0,6:1": ([(6, 0, None), (6, 1, None)], 2, 0, 13, None), "6-4 3-2": ([(6, 4, None), (3, 2, None)], 1, 0, 15, "incomplete"), "": (None, None, None, None, "empty"),
        None: (None, None, None, None, "empty"), "6-4 ret": (None, None, None, None, "malformed"), "8-6": ([(8, 6, None)], 0, 0, 14, "incomplete"), "7-5": ([(7, 5, None)], 1, 0, 12, None), "6-5": ([(6, 5, None)], 0, 0, 11, "incomplete"),
    }
    for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", matches.score(F.col("t")).alias("s")).collect():
        sets, a, b, games, error = cases[r["t"]]
        assert (r["s"]["sets"] if sets is None else [tuple(x) for x in r["s"]["sets"]], r["s"]["sets_a"], r["s"]["sets_b"], r["s"]["games"], r["s"]["error"]) == (sets, a, b, games, error), r["t"]


def test_formats_and_void_reasons(spark):
    cases = [(5, "WTA", "x", "", 2, 5, "provider"), (None, "ATP", "x", "", 4, 5, "sets"), (None, "ATP", "Wimbledon", "R1", 2, 5, "slam"), (None, "ATP", "Wimbledon", "Qualifying 1", None, 3, "tour"), (2, "ATP Challenger", "Roland Garros", "", None, 3, "tour"), (None, "", "x", None, None, None, "unknown"), (None, None, None, None, None, None, "unknown")]
    df = spark.createDataFrame([c[:5] for c in cases], "e int, t string, n string, r string, s int").select(matches.best_of(*(F.col(c) for c in "etnrs")).alias("f"))
    assert [tuple(r["f"]) for r in df.collect()] == [c[5:] for c in cases]
    void = [("finished", "Player RETIRED", 1, 0, 3, "a", "retired"), ("finished", None, 1, 0, 3, "a", "incomplete"), ("finished", None, 2, 0, 5, "a", "incomplete"), ("finished", None, 2, 0, 3, "a", None), ("walk_over w/o", None, None, None, None, None, "walkover"), (None, None, None, None, None, "a", None), ("finished", "", 1, 0, 3, None, None)]
    got = spark.createDataFrame([c[:6] for c in void], "s string, d string, a int, b int, k int, w string").select(matches.void_reason(*(F.col(c) for c in "sdabkw")).alias("v")).collect()
    assert [r["v"] for r in got] == [c[6] for c in void]


def test_typed_events_reject_what_is_no_match(spark):
    event = {"id": "1", "home": {"id": "a", "name": "A"}, "away": {"id": "b"}, "status": {"type": "Finished"}, "tournament": {"name": "Open", "tour": "ATP"}, "start": 1735689600, "winner": "b", "score": "4-6 4-6", "extra": [1]}
    raw = [json.dumps(e) for e in (event, event | {"id": ""}, event | {"away": {"id": "a"}}, event | {"start": None}, {"id": "9"})] + ["{", "", None, "[]"]
    got = matches.typed_events(spark.createDataFrame([(k, t) for k, t in enumerate(raw)], "k int, json string"), "json").orderBy("k").collect()
    assert [r["reject"] for r in got] == [None, "malformed", "no_sides", "no_start", "no_sides", "malformed", "malformed", "malformed", "malformed"]
    r = got[0]
    assert (r["match_id"], r["tour"], r["winner"], r["sets_a"], r["sets_b"], r["games"], r["best_of"], r["void"], r["status"]) == ("1", "atp", "b", 0, 2, 20, 3, None, "finished")
    assert all(v is None for c, v in got[1].asDict().items() if c not in ("k", "reject"))


def test_successors_and_markers(spark):
    rows = [("a", 1, 1, "x"), ("a", 2, 1, "x"), ("a", 3, 1, "y"), ("a", 4, 3, "z"), ("a", 5, 2, "x"), ("a", 6, 3, "z"), ("a", 7, 4, None), ("a", 8, 4, None), ("b", 1, 5, "q")]
    got = offers.successors(spark.createDataFrame(rows, "k string, t int, v int, d string"), "k", ["t"], "v", "d").collect()
    assert {(r["k"], r["t"]): r["verdict"] for r in got} == dict(zip([(k, t) for k, t, *_ in rows], ["accepted", "repeated", "conflict", "accepted", "regressed", "repeated", "accepted", "repeated", "accepted"]))
    now = F.lit("2025-01-02 00:00:00")
    cases = [(None, None, True), ("2025-01-01 19:00:00", 1, False), ("2025-01-01 18:00:00", 1, True), ("2025-01-01 18:00:00", 2, False), ("2025-01-01 00:00:00", 9, True), ("2025-01-01 18:00:00", None, True)]
    due = spark.createDataFrame([c[:2] for c in cases], "t string, n int").select(offers.due(F.col("t").cast("timestamp"), F.col("n"), now, [6, 24]).alias("d")).collect()
    assert [r["d"] for r in due] == [c[2] for c in cases]


def test_digests_do_not_hang_on_order(spark):
    df = spark.createDataFrame([(1, "s", "a"), (1, "s", "b"), (1, "t", None), (2, "s", "a")], "d int, s string, v string")
    one, two = ({(r["d"], r["s"]): r["digest"] for r in offers.offer_digests(x, "d", "s", ["v"]).collect()} for x in (df, df.orderBy(F.desc("v")).repartition(3)))
    assert one == two and len(set(one.values())) == 3
    changed = offers.offer_digests(df.union(df.where("v = 'b'")), "d", "s", ["v"]).where("d = 1 AND s = 's'").first()
    assert changed["n"] == 3 and changed["digest"] != one[1, "s"]


def test_point_weighted_needs_points(spark):
    rows = [("p", "t", D(k), 0.6, 100 if k % 3 == 0 else None) for k in range(9)] + [("q", "t", D(0), 0.5, 2000), ("q", "t", D(5), 0.7, 100), ("q", "t", D(8), None, None)]
    got = {(r["player"], r["day"]): r for r in estimates.point_weighted(spark.createDataFrame(rows, "player string, tour string, day date, rate double, points int"), "player", "tour", "day", "rate", "points").collect()}
    assert got["p", D(0)]["estimate"] is None and got["p", D(8)]["estimate"] is None and (got["p", D(8)]["rates"], got["p", D(8)]["counts"]) == (8, 3)
    w, prior = [250 * 2 ** (-8 / 120), 100 * 2 ** (-3 / 120)], (2000 * 0.5 + 100 * 0.7 + 3 * 100 * 0.6) / 2400
    assert got["q", D(8)]["estimate"] == pytest.approx((200 * prior + w[0] * 0.5 + w[1] * 0.7) / (200 + sum(w)), abs=1e-12)


def test_first_compatible_place(spark):
    places = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2), ("z", 2)], "name string, region int")
    rows = spark.createDataFrame([(1, ["w", "x"], 1), (2, ["y", "z"], 2), (3, ["y"], 9), (4, [], 1), (5, None, 1), (6, ["x", "z"], 2)], "id int, names array<string>, want int")
    got = linkers.first_compatible(rows, "id", "names", places, "name", F.col("region") == F.col("want")).collect()
    assert {r["id"]: (r["position"], r["name"]) for r in got} == {1: (1, "x"), 2: (0, "y"), 3: (None, None), 4: (None, None), 5: (None, None), 6: (1, "z")}


def test_a_score_is_parsed_once_a_row(spark):
    raw = spark.createDataFrame([(1, "{}")], "k long, json string")
    plan = matches.typed_events(raw, "json")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") + plan.count("regexp_extract(") == 1 and plan.count("from_json") == 1
