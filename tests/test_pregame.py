"""Contracts, identities, provenance, feeds and calibration on small fixtures."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import dates, text
from tidemark.operators import contracts as ct
from tidemark.operators import day_features as days
from tidemark.operators import eligibility as el
from tidemark.operators import forecasts as fc
from tidemark.operators import identity as idn
from tidemark.operators import packets as pk
from tidemark.operators import provenance as pv
from tidemark.plans.registry import rounded
from tidemark.sources import feeds

SF = "/root/testdata/sf0.001"


def test_bootstrap_has_width(spark):
    for name in ("bootstrap_lcg", "bootstrap_md5"):
        r = catalog.queries()[name](spark, SF).first()
        assert r.reps == 500 and r.low < r.mean < r.high


def test_ewm_over_a_long_history_with_gaps(spark):
    r = random.Random(2)
    values = [None if r.random() < 0.3 else r.uniform(0, 50) for _ in range(700)]
    rows = spark.createDataFrame([(1, dt.date(2020, 1, 1) + dt.timedelta(k), 1, v, 1.0, 1.0) for k, v in enumerate(values)], "entity_id long, event_date date, games long, minutes double, points double, extras double")
    got = {x.event_date: x for x in days.day_windows(rows).collect()}
    for span in (3, 5, 10):
        mean, alpha = None, 2 / (span + 1)
        for k, v in enumerate(values):
            found = got[dt.date(2020, 1, 1) + dt.timedelta(k)][f"ewm_{span}"]
            assert (found is None) == (mean is None) and (mean is None or abs(found - mean) < 1e-9)
            if v is not None:
                mean = v if mean is None else alpha * v + (1 - alpha) * mean


def test_conformal_widths_are_order_statistics(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), dt.date(2024, 1, 1) + dt.timedelta(r.randrange(25)), r.choice([r.uniform(0, 40), 3.25, 3.2500001])) for _ in range(600)]
    got = {(x.g, x.event_date): (x.n, x.width) for x in fc.conformal(spark.createDataFrame(rows, "g string, event_date date, error double"), "g").collect()}
    want = {}
    for g, d in {(g, d) for g, d, _ in rows}:
        past = sorted(e for h, x, e in rows if h == g and x < d)
        if past:
            want[g, d] = (len(past), past[min(len(past), -(-9 * (len(past) + 1) // 10)) - 1])
    assert got == want


def test_predictors_fail_closed(spark):
    rows = spark.createDataFrame([(1.0, 2, "x", None)], "mean_5 double, days long, name string, gap double")
    assert el.predictors(rows, ["mean_5", "days"]).columns == ["mean_5", "days"]
    for names, message in ((["Target X"], "forbidden"), (["nope"], "missing predictor"), (["name"], "non-numeric"), (["gap"], "non-finite"), (["days", "Days"], "collide"), ([], "no approved")):
        with pytest.raises(el.ContractViolation, match=message):
            el.predictors(rows, names)
    assert ct.missing_columns(rows, [ct.Rule("mean_5"), ct.Rule("days"), ct.Rule("other")]) == [("other", "MISSING_COLUMN"), ("name", "SCHEMA_DRIFT_EXTRA_COLUMN"), ("gap", "SCHEMA_DRIFT_EXTRA_COLUMN")]
    with pytest.raises(ValueError, match="NULL_NOT_ALLOWED"):
        ct.enforce(ct.violations(rows, [ct.Rule("gap")], ["days"]))
    assert [r.v for r in ct.keep_first(spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "k long, v long"), ["k"], ["v"]).orderBy("k").collect()] == [1, 5]


def test_canonical_table_fails_closed(spark):
    registry = spark.createDataFrame([("player", "f", "1", "P1"), ("player", "f", "2", "P2"), ("player", "f", "3", "P3"), ("player", "f", "3", "P4"), ("player", "g", "4", "P5")], "entity_type string, source_name string, source_id string, canonical_id string")
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "player_id string, game_id string")
    assert sorted(r.player_id for r in idn.canonical(rows("1", " 2 "), registry, {"player_id": "player"}, "f").collect()) == ["P1", "P2"]
    for bad, code in ((("1", "4"), "UNRESOLVED"), (("3",), "AMBIGUOUS"), ((None,), "NULL_REQUIRED_VALUE")):
        with pytest.raises(idn.BuildError, match=code):
            idn.canonical(rows(*bad), registry, {"player_id": "player"}, "f")
    teams = spark.createDataFrame([("LA  clippers",), ("lac",), ("Moon",), (None,)], "t string").select(idn.team_code("t").alias("c"))
    assert [r.c for r in teams.collect()] == ["LAC", "LAC", None, None]
    assert {r.k: r.canonical_id for r in idn.minted(spark.createDataFrame([(k,) for k in (30, 10, 20)], "k long"), "k", "T").collect()} == {10: "T00000001", 20: "T00000002", 30: "T00000003"}


def test_objects_are_stored_once(spark, tmp_path):
    root = str(tmp_path / "objects")
    pv.new_store(spark, root)
    files = lambda *x: spark.createDataFrame([(bytearray(b),) for b in x], "content binary")
    pv.store_objects(files(b"a", b"b", b"a"), root)
    assert sorted(r.outcome for r in pv.object_outcomes(files(b"a", b"c"), root).collect()) == ["KNOWN", "NEW"]
    pv.store_objects(files(b"a", b"c"), root)
    assert spark.read.parquet(root).count() == 3
    made = pv.register_bytes(spark.createDataFrame([("x/y.pdf", bytearray(b"abc"))], "path string, content binary")).first()
    assert made.byte_size == 3 and made.validation_status == "UNVALIDATED" and made.sha256.startswith("ba7816bf")
    parents = spark.createDataFrame([("a", "PASS", "AB")], "artifact_id string, validation_status string, sha256 string")
    pv.assert_usable(pv.parent_status(parents, spark.createDataFrame([("a", "ab")], "artifact_id string, actual_sha256 string")))
    with pytest.raises(pv.ProvenanceError, match="PARENT_HASH_MISMATCH"):
        pv.assert_usable(pv.parent_status(parents, spark.createDataFrame([("a", "cd")], "artifact_id string, actual_sha256 string")))


def test_names_fold_and_dates_fail_to_null(spark):
    rows = spark.createDataFrame([("  Dončić  ŁUKA ﬁn", "2024-02-30"), ("Straße", "Feb 3, 2024"), (None, None)], "n string, d string")
    assert [(r.n, r.d) for r in rows.select(text.folded("n").alias("n"), dates.day_of("d").alias("d")).collect()] == [("doncic łuka fin", None), ("strasse", dt.date(2024, 2, 3)), (None, None)]


def test_feeds(spark):
    rows = spark.createDataFrame([("a", 0, '{"data":[{"id":"1","date":"x"}],"meta":{"next_cursor":9}}'), ("a", 1, '{"data":[{"id":"2"}],"meta":{}}'), ("b", 0, "no")], "s string, p int, body string")
    assert sorted((r.s, str(r.id), r.tipoff, r.status) for r in feeds.envelope_games(rows, "s", "p", "body").collect()) == [("a", "1", "x", "COMPLETE"), ("a", "2", "MISSING", "COMPLETE"), ("b", "None", "MISSING", "INVALID_JSON")]
    atom = spark.createDataFrame([("<feed><entry><link href='u'/></entry></feed>",), ("<html/>",)], "body string")
    assert [(r.link, r.kind) for r in feeds.item_links(atom, "body").collect()] == [("u", "ATOM")]


def test_training_is_denied(spark):
    rows = spark.createDataFrame([(True,)], "eligible boolean")
    assert pk.training_authorization(rows).first().asDict() == {"eligible": False, "authorization": "DENIED_NOT_OVERRIDABLE"}
    runs = spark.createDataFrame([(["a", "b", "c"], ["b", "c"]), (["a"], ["a", "a"]), (["a"], []), ([], [])], "h array<string>, n array<string>").select(pk.has_run(F.col("h"), F.col("n")).alias("x"))
    assert [r.x for r in runs.collect()] == [True, False, False, False]


def test_report_times_at_the_ends_of_summer_time(spark):
    names = {"1998-10-25_1AM": 6, "1998-10-25_2AM": 7, "1998-10-25_12AM": 4, "1998-04-05_2AM": 7, "1998-04-05_3AM": 7, "1998-04-05_1AM": 6}
    rows = spark.createDataFrame([(f"Injury-Report_{n}.pdf",) for n in names], "n string").select("n", F.date_format(dates.report_time("n"), "H:mm").alias("t"))
    assert {r.n[14:-4]: r.t for r in rows.collect()} == {n: f"{h}:00" for n, h in names.items()}


def test_a_run_of_tokens_in_a_long_text(spark):
    long = "the of " * 20000
    texts = [(1, long), (2, long + "a of, The b"), (3, "of them"), (4, "often the"), (5, ""), (6, None)]
    rows = spark.createDataFrame(texts, "k int, t string").select("k", pk.has_run(pk.tokens("t"), F.array(F.lit("of"), F.lit("the"))).alias("x"))
    assert {r.k: r.x for r in rows.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: None}


def test_day_means_are_sums_in_order_and_halves_round_as_in_sql(spark):
    values = [0.1 + k * 1.7 for k in range(40)]
    columns = "entity_id long, event_date date, game_id long, minutes double, points double, extras double"
    rows = [(1, dt.date(2024, 1, 1), k, v, float("inf") if k % 2 else 1e25, float("nan")) for k, v in enumerate(values)]
    random.Random(3).shuffle(rows)
    got = days.day_grain(spark.createDataFrame(rows, columns)).first()
    total = 0.0
    for v in values:
        total += v
    assert (got.games, got.minutes, got.points, got.extras) == (40, total / 40, 1e25, None)
    halves = [16.5459375, 33.2390625, -33.2390625, 1e305, float("nan"), None]
    out = rounded(spark.createDataFrame([(x, 1) for x in halves], "x double, n int"), "x", "n").collect()
    sql = [r[0] for r in duckdb.sql("select round(x, 6) from (select unnest([16.5459375, 33.2390625, -33.2390625, 1e305, 'nan', null]::double[]) as x)").fetchall()]
    assert [str(r.x) for r in out] == [str(x) for x in sql] and {r.n for r in out} == {1}
