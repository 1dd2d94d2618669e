"""Typed contracts, targets and paired frames on small tables with every fault."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts as ct
from tidemark.operators import targets as tg


def test_issues_of_each_kind(spark):
    rows = [("1", "a", "2", "x"), ("1", "b", "0", "x"), (None, "a", "9", "x"), ("z", None, "3.5", "x"), ("2", "c", "NaN", "x")]
    df = spark.createDataFrame(rows, "k string, v string, n string, more string")
    rules = (ct.Typed("k", kind="bigint"), ct.Typed("v", allowed=("a", "b")), ct.Typed("n", kind="double", least=1, most=5, nullable=True), ct.Typed("gone"))
    got = {tuple(r[:3]): [f"{i.code}:{i.column}" for i in r.issues] for r in ct.checked(df, rules, ("k",), ("n",)).collect()}
    every = ["MISSING_COLUMN:gone", "SCHEMA_DRIFT_EXTRA_COLUMN:more"]
    assert got["1", "a", "2"] == every + ["DUPLICATE_PRIMARY_KEY:k"] and got["1", "b", "0"] == every + ["VALUE_BELOW_MINIMUM:n"]
    assert got[None, "a", "9"] == every + ["NULL_NOT_ALLOWED:k", "VALUE_ABOVE_MAXIMUM:n"]
    assert got["z", None, "3.5"] == every + ["TYPE_MISMATCH:k", "NULL_NOT_ALLOWED:v"] and "VALUE_NOT_ALLOWED:v" in got["2", "c", "NaN"]
    passed, aside = ct.quarantined(ct.checked(df, rules[:2], extras=True))
    assert passed.columns == df.columns and passed.count() == 2 and aside.count() == 3
    typed = spark.createDataFrame([(1.5, True), (float("nan"), None)], "x double, b boolean")
    marks = [[i.code for i in r.issues] for r in ct.checked(typed, (ct.Typed("x", kind="double", most=1), ct.Typed("b", kind="boolean", nullable=True))).orderBy("x").collect()]
    assert marks == [["VALUE_ABOVE_MAXIMUM"], ["NULL_NOT_ALLOWED"]]
    assert ct.checked(df.limit(0), rules, ("k",)).count() == 0


GOOD = (1, "2024-01-02", 7, 3, "31.5", "10", "4", "2", "1")
COLUMNS = "game_id long, event_date string, player_id long, team_id long, min string, pts string, reb string, ast string, fg3m string"
FAULTS = {
    "IDENTITY_NULL": {3: None},
    "EVENT_DATE_INVALID": {1: "2024-02-30"},
    "MINUTES_MISSING": {4: "DNP"},
    "MINUTES_NEGATIVE": {4: "-1"},
    "MINUTES_ABOVE_BOUND": {4: "61"},
    "REB_MISSING": {6: None},
    "AST_NEGATIVE": {7: "-2"},
    "ZERO_MINUTES_WITH_STATS": {4: "0"},
}


def test_targets_fail_closed(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), COLUMNS)
    made = tg.build_targets(frame(GOOD, (2, *GOOD[1:4], "0", "0", "0", "0", "0"))).orderBy("game_id").collect()
    assert [(r.target_minutes, r.target_played, r.target_points) for r in made] == [(31.5, 1, 10.0), (0.0, 0, 0.0)] and str(made[0].event_date) == "2024-01-02"
    for fault, change in FAULTS.items():
        bad = (9, *(change.get(i, x) for i, x in enumerate(GOOD) if i))
        assert [r.fault for r in tg.fault_counts(tg.judged(frame(GOOD, bad))).collect()] == [fault]
        with pytest.raises(tg.TargetError, match=f"{fault}=1"):
            tg.build_targets(frame(GOOD, bad))
    with pytest.raises(tg.TargetError, match="DUPLICATE_OUTCOME=2"):
        tg.build_targets(frame(GOOD, GOOD))
    with pytest.raises(tg.TargetError, match="MISSING_COLUMNS ast"):
        tg.build_targets(frame(GOOD).drop("ast"))


def test_paired_frames(spark):
    rows = [("2024-01-02", p, m, 20.0, 18.0, 10.0, 30.0, 1, 2.0, 0, "5-9", "low") for p in range(3) for m in ("a", "b")]
    columns = "event_date string, player_id long, method string, actual double, estimate double, lower double, upper double, covered int, abs_error double, role_change_flag int, history_group string, volatility_group string"
    frame = spark.createDataFrame(rows, columns)
    faults = lambda df: {r.fault: r.n for r in tg.paired_faults(df, ("event_date", "player_id"), ("a", "b")).collect()}
    assert faults(frame) == {}
    one = (F.col("player_id") == 1) & (F.col("method") == "b")
    put = lambda c, v: frame.withColumn(c, F.when(one, F.lit(v)).otherwise(F.col(c)))
    assert faults(put("covered", 0)) == {"COVERAGE_INCONSISTENT": 1} and faults(put("abs_error", 2.1)) == {"ERROR_INCONSISTENT": 1}
    assert faults(put("covered", 2)) == {"NOT_BINARY": 1, "COVERAGE_INCONSISTENT": 1} and faults(put("history_group", "20+")) == {"HISTORY_GROUP_DIFFERS": 1}
    assert faults(put("lower", 31.0))["BOUNDS_INVALID"] == 1 and faults(put("estimate", float("inf"))) == {"ESTIMATE_INVALID": 1, "ESTIMATE_DIFFERS": 1}
    assert faults(put("method", "c")) == {"UNEXPECTED_METHOD": 1, "UNPAIRED": 1} and faults(put("method", "a")) == {"DUPLICATE_METHOD_ROW": 1, "UNPAIRED": 1}
