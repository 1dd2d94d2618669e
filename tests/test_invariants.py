"""Invariants of snapshots and registries, registry changes, trees and attribution on small tables."""

import json

from pyspark.sql import functions as F

from tidemark.operators import attribution as at
from tidemark.operators import invariants as iv
from tidemark.operators import page_tables as pt
from tidemark.operators import registry as rg
from tidemark.sources import trees


def test_governance(spark):
    names = "feature_name string, feature_group string, description string, source_domain string, pregame_available boolean, historical_available boolean, today_available boolean, missing_value_policy string, leakage_checked boolean, coverage_status string, research_status string, feature_version string, notes string"
    row = lambda name, flags=(True,) * 4, cover="PASS", status="APPROVED_BASELINE": (name, "g", "d", "s", *flags[:3], "null", flags[3], cover, status, "1", "")
    rows = [row("a"), row("b", (True, True, False, True)), row("c", cover="FAIL"), row("d", status="NEW"), row("e", (False,) * 4, "FAIL", "BLOCKED"), row("f"), row("f"), row(" ", cover="?"), row("h", (None, True, True, True))]
    got = sorted((r.feature_name, r.code) for r in iv.governance(spark.createDataFrame(rows, names)).collect())
    assert got == [(" ", "APPROVED_WITHOUT_COVERAGE"), (" ", "COVERAGE_STATUS_INVALID"), (" ", "FEATURE_NAME_BLANK"), ("b", "APPROVED_NOT_TODAY"), ("c", "APPROVED_WITHOUT_COVERAGE"), ("d", "RESEARCH_STATUS_INVALID"), ("f", "FEATURE_NAME_REPEATED"), ("f", "FEATURE_NAME_REPEATED"), ("h", "PREGAME_AVAILABLE_NOT_BOOLEAN")]
    assert [r.code for r in iv.governance(spark.createDataFrame(rows, names).drop("notes")).collect()] == ["MISSING_COLUMN notes"]


def test_minting_repeats_itself(spark):
    there = spark.createDataFrame([("P00000007", "player", "x"), ("T00000001", "team", "y")], "canonical_id string, entity_type string, display_name string")
    rows = [("player" if k % 3 else "team", f"n{k % 4}", k % 2, k) for k in range(40)] + [("coach", "z", 0, 99), ("player", " ", 0, 98)]
    new = spark.createDataFrame(rows, "entity_type string, display_name string, round int, k long")
    ids = lambda n: sorted((r.k, r.canonical_id) for r in rg.created(new.repartition(n), there, "round").collect())
    assert ids(1) == ids(5) and {i for _, i in ids(3)} == {f"P{k:08d}" for k in range(8, 34)} | {f"T{k:08d}" for k in range(2, 16)}


def test_trees_of_any_depth(spark):
    deep = {"@type": "SportsEvent", "name": "deep"}
    for k in range(12):
        deep = {"@type": f"L{k}", "in": [0, deep]}
    docs = spark.createDataFrame([(1, json.dumps([deep])), (2, "{"), (3, None), (4, "7"), (5, json.dumps({"a": {"@type": ["x", "SportsEvent"], "name": None}}))], "doc int, j string")
    found = trees.nodes(docs, "j").where(trees.named_type(F.col("value"), trees.EVENT)).select("doc", F.size("path").alias("n"), F.try_element_at("parent_types", F.lit(-1)).alias("up")).collect()
    assert sorted(map(tuple, found)) == [(1, 25, "L0"), (5, 1, "")]
    assert trees.nodes(docs.where("doc in (2, 3)"), "j").collect() == []


def test_a_conflict_empties_the_game_for_what_follows(spark):
    cells = [
        (1, 100.0, 30.0, "01/02/2024"), (1, 100.0, 200.0, "ATL@BKN"), (1, 120.0, 270.0, "Boston Celtics"), (1, 140.0, 430.0, "Lee, Ann"), (1, 140.0, 600.0, "Out"), (1, 160.0, 270.0, "Atlanta Hawks"),
        (1, 180.0, 430.0, "Poe, Cy"), (1, 180.0, 600.0, "Out"), (2, 100.0, 430.0, "Roe, Di"), (2, 100.0, 600.0, "Out"), (2, 120.0, 200.0, "BOS@ATL"), (2, 120.0, 270.0, "Boston Celtics"), (2, 140.0, 430.0, "Fox, Ed"), (2, 140.0, 600.0, "Out"),
        (2, 160.0, 30.0, "13/45/2024"), (2, 180.0, 670.0, "not yet  submitted"), (2, 530.0, 600.0, "Out"),
    ]
    df = spark.createDataFrame([(1, *c) for c in cells], "doc int, page int, y double, x double, text string")
    rows, doubts = at.attributed(df)
    got = {r.player: (r.game, r.team, r.context_origin) for r in rows.where("kind = 'PLAYER'").collect()}
    same, cross = "SAME_PAGE_OR_PRIOR_CONTEXT", "CROSS_PAGE_CONTINUATION"
    assert got == {"Lee, Ann": (None, "BOS", same), "Poe, Cy": (None, "ATL", same), "Roe, Di": (None, "ATL", cross), "Fox, Ed": ("BOS@ATL", "BOS", same)}
    issues = sorted((r.page, r.y, r.issue) for r in doubts.where("issue <> 'REASON_MISSING'").collect())
    assert issues == [(1, 120.0, "TEAM_MATCHUP_CONFLICT"), (1, 140.0, "MISSING_CONTEXT"), (1, 180.0, "MISSING_CONTEXT"), (2, 100.0, "MISSING_CONTEXT"), (2, 160.0, "INVALID_GAME_DATE"), (2, 180.0, "MISSING_CONTEXT")]


def test_words_join_the_nearest_open_line(spark):
    boxes = [(10.0, 0.0, "a"), (12.9, 5.0, "b"), (14.0, 1.0, "c"), (12.0, 9.0, "d"), (17.5, 2.0, "e"), (None, 3.0, "f")]
    df = spark.createDataFrame([(1, 1, y, x, t) for y, x, t in boxes], "doc int, page int, y double, x double, text string")
    got = {r.text: r.line_y for r in pt.nearest_lines(df, ("doc", "page"), F.col("y"), ["y", "x"], 3.0).collect()}
    opened, want = [], {}
    for y, _, t in sorted(b for b in boxes if b[0] is not None):
        near = [o for o in opened if abs(o - y) <= 3]
        want[t] = min(near, key=lambda o: abs(o - y)) if near else y
        opened += [] if near else [y]
    assert got == want and len(set(want.values())) == 3


def test_the_log_of_doubts_reads_its_cells_once(spark):
    cells = spark.createDataFrame([(1, 1, 100.0, 430.0, "Lee, Ann"), (1, 1, 100.0, 600.0, "Out"), (1, 1, 112.0, 670.0, "Left Knee"), (1, 1, 116.0, 670.0, "Rest")], "doc int, page int, y double, x double, text string")
    rows, doubts = at.attributed(cells)
    for df in (rows, doubts):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert [(r.reason, r.reason_ys) for r in rows.collect()] == [("Left Knee", "112.0")]
    assert sorted(r.issue for r in doubts.collect()) == ["MISSING_CONTEXT"]


def test_pages_of_words_are_read_once(spark):
    words = [(1, 1, 842.0, x, 70.0, x + 40, 78.0, t) for x, t in ((430.0, "Player"), (590.0, "Status"), (670.0, "Reason:"))]
    words += [(1, p, 842.0, x, 100.0, x + 40, 108.0, t) for p in (1, 2) for x, t in ((430.0, "Lee,"), (475.0, "Ann"), (590.0, "Out"))] + [(1, 2, 842.0, 670.0, 94.0, 700.0, 102.0, "Rest")]
    df = spark.createDataFrame(words, "doc int, page int, width double, x0 double, y0 double, x1 double, y1 double, text string")
    records, columns = pt.table_records(df), pt.page_columns(pt._lined(df))
    found = pt.recovered_reasons(records, df)
    for of, reads in ((columns, 1), (records, 1), (found, 2)):
        assert of._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == reads
    assert sorted((r.page, r["mode"]) for r in columns.collect()) == [(1, "DETECTED_HEADER"), (2, "REUSED_COLUMNS")]
    assert sorted((r.page, r.decision, r.proposed_reason) for r in found.collect()) == [(1, "UNRESOLVED", None), (2, "PROPOSED_REVIEW_REQUIRED", "Rest")]
