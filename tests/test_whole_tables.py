"""Queries over whole tables, and statuses that missing or conflicting rows give."""

import random

import duckdb
from oracle import found
from oracle import rows as sorted_rows
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import reconcile as rc
from tidemark.operators import review as rv
from tidemark.operators import targets as tg

SF = "/root/testdata/sf0.001"


def test_every_row_takes_part(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    assert catalog.queries()["candidate_entries"](spark, SF).select("candidate").distinct().count() == part.count()
    seen = catalog.queries()["one_to_one_integrity"](spark, SF).collect()
    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    keys = orders.select("o_orderkey").union(lines.select("l_orderkey")).distinct().count()
    assert sum(r.n for r in seen) == keys and "DUPLICATE" in {r.status for r in seen}


def test_statuses_of_missing_and_conflicting_rows(spark):
    k = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    assert {(r.k, r.status) for r in rv.one_to_one(k(1, 2, 4), k(2, 3, 4, 4), ["k"]).collect()} == {(1, "LEFT_ONLY"), (2, "ONE_TO_ONE"), (3, "RIGHT_ONLY"), (4, "DUPLICATE")}
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "name string, team int")
    registry = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 1), ("c", 4, 1)], "name string, id long, team int")
    assert {(r.name, r.status) for r in rv.named(rows, registry).collect()} == {("a", "MATCHED"), ("b", "TEAM_CONFLICT"), ("c", "SEVERAL_IDS"), ("d", "NO_ID")}
    t = lambda *x: spark.createDataFrame(x, "team long, day long, t long")
    out = rc.match_status(t((1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (4, 1, 9)), t((1, 1, 60), (2, 1, 999), (4, 1, 0), (5, 1, 0)), ["team", "day"], "t")
    assert {(r.team, r.status) for r in out.collect()} == {(1, "MATCHED"), (2, "TIME_CONFLICT"), (3, "OFFICIAL_ONLY"), (4, "AMBIGUOUS"), (5, "PROVIDER_ONLY")}


def test_entries_of_large_classes_meet_once(spark):
    n = 700  # more than a block: all share a name, half of them share two
    rows = spark.range(n).select(F.col("id").alias("candidate"), F.expr("array('x', if(id % 2 = 0, 'y', null), concat('own', id))").alias("names"))
    entries = spark.range(n).select(F.col("id").alias("entry"), F.lit(1).alias("team"), F.explode(F.expr("if(id % 2 = 0, array('x', 'y', null), array('x', 'x'))")).alias("name"))
    out = rv.under_any_name(rows, "names", entries, ["candidate", "entry", "team"])
    seen = out.agg(F.count("*").alias("n"), F.count_distinct("candidate", "entry").alias("d")).first()
    assert out.columns == ["candidate", "entry", "team"] and (seen.n, seen.d) == (n * n, n * n)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Project")  # no pair is gathered again to be told apart


def test_entries_meet_by_blocks_of_a_name(spark, monkeypatch):
    monkeypatch.setattr(rv, "BLOCK", 16)
    monkeypatch.setattr(rv, "FEW", 4)
    draw = random.Random(5)
    under = lambda: draw.sample(["x", "x", "y", "z", "zz", None], draw.randint(0, 4))
    rows, entries = [(i % 90, under()) for i in range(120)], [(i % 90, i % 3, n) for i in range(120) for n in under()]
    out = rv.under_any_name(spark.createDataFrame(rows, "candidate long, names array<string>"), "names", spark.createDataFrame(entries, "entry long, team int, name string"), ["candidate", "team", "entry"])
    seen = [tuple(r) for r in out.collect()]
    assert out.columns == ["candidate", "team", "entry"] and len(seen) == len(set(seen))
    assert set(seen) == {(c, t, e) for c, names in rows for e, t, n in entries if n is not None and n in names}


def test_entries_never_list_pairs_of_classes(spark):
    n, adaptive = 200, spark.conf.get("spark.sql.adaptive.enabled")
    rows = spark.range(n).select(F.col("id").alias("candidate"), F.expr("array('x', concat('own', id))").alias("names"))
    entries = spark.range(n).select(F.col("id").alias("entry"), F.explode(F.expr("array('x', concat('own', id))")).alias("name"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan that is walked is the one that runs
    try:
        done = rv.under_any_name(rows, "names", entries, ["candidate", "entry"])._jdf.queryExecution()
        assert done.toRdd().count() == n * n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    todo, joined = [done.executedPlan()], []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        joined += [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
    assert joined and max(joined) <= 4 * n


def test_entries_of_missing_names_match_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql(
        f"""copy (select * from (values (1::bigint, 'a', 'b', 'c', 1), (2, 'b c', null, 'c', 2), (3, null, 'b', 'c', null), (4, null, 'b', null, 4), (5, 'c', 'b', '', 5), (null, 'a', null, null, 6))
        t(p_partkey, p_name, p_brand, p_type, p_size)) to '{tmp_path}/part.parquet' (format parquet)"""
    )
    con.sql(f"create view part as select * from read_parquet('{tmp_path}/part.parquet')")
    want = con.sql(catalog.oracle_sql()["candidate_entries"])
    assert found(catalog.queries()["candidate_entries"](spark, str(tmp_path))) == sorted_rows([d[0] for d in want.description], want.fetchall())


def test_fields_that_differ_are_found_without_repeating_rows(spark):
    frame = spark.createDataFrame([(1, m) for m in "ab"], "k int, method string").select("k", "method", *(F.lit(1.0).alias(c) for c in (*tg.NUMBERS, "role_change_flag", "history_group", "volatility_group")), F.lit("2024-01-02").alias("event_date"))
    assert "Expand" not in tg.paired_faults(frame, ["k"], ("a", "b"))._jdf.queryExecution().optimizedPlan().toString()
