"""Sources with a given shape, manifests, embedded JSON, page lines and streams, on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import layout
from tidemark.sources import files
from tidemark.streaming import capture


def test_csv_shape(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿game_id,minutes\nG1,20\nG2,\nG3,-4\nG4,61\nG5,x\n", encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), ["game_id", "minutes"], exact=True)
    assert [tuple(r) for r in rows.orderBy("game_id").collect()][:2] == [("G1", "20"), ("G2", None)]
    found = {(r.column, r.code): r.n for r in files.strict_numbers(rows, ["minutes"], {"minutes": 60}).collect()}
    assert found == {("minutes", "BLANK"): 1, ("minutes", "NEGATIVE"): 1, ("minutes", "ABOVE_MAXIMUM"): 1, ("minutes", "NOT_FINITE"): 1}
    with pytest.raises(files.SourceError, match="SOURCE_SCHEMA_MISSING points"):
        files.read_csv(spark, str(tmp_path / "a.csv"), ["game_id", "points"])
    with pytest.raises(files.SourceError, match="SOURCE_SCHEMA_EXTRA minutes"):
        files.read_csv(spark, str(tmp_path / "a.csv"), ["game_id"], exact=True)
    (tmp_path / "b.csv").write_text("")
    with pytest.raises(files.SourceError, match="SOURCE_SCHEMA_EMPTY"):
        files.read_csv(spark, str(tmp_path / "b.csv"), ["game_id"])


def test_manifest_tells_changed_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    made = files.write_with_manifest(rows, path, dataset="t")
    assert made["rows"] == 2 and files.read_with_manifest(spark, path).count() == 2
    assert files.logical_digest(rows.orderBy(F.desc("k")))["digest"] == made["digest"]
    rows.limit(1).write.mode("append").parquet(path)
    with pytest.raises(files.SourceError, match="DIGEST_MISMATCH"):
        files.read_with_manifest(spark, path)


def test_json_shapes(spark):
    doc = '{"season":{"dates":[{"games":[{"id":"1"},{"id":"2"}]},{"games":[{"id":"3"}]}]}}'
    rows = spark.createDataFrame([("x", doc), ("y", "no json")], "name string, j string")
    out = files.unnest(rows, "j", "season struct<dates array<struct<games array<struct<id string>>>>>", "season.dates", "games")
    assert sorted(tuple(r) for r in out.collect()) == [("x", "1"), ("x", "2"), ("x", "3")]
    headed = files.headed_rows(spark.createDataFrame([('{"headers":["a","b"],"rowSet":[["1","2"],["3"]]}',)], "j string"), "j").collect()
    assert [(r.whole, r.fields) for r in headed] == [(True, {"a": "1", "b": "2"}), (False, None)]
    cdx = files.first_row_heads(spark.createDataFrame([('[["u","t"],["x","2020"]]',), ("[]",)], "j string"), "j").collect()
    assert [r.fields for r in cdx] == [{"u": "x", "t": "2020"}]
    page = '<script id="d" type="j">{"@type":"E","sub":[{"startDate":"2020\\u002d01"},{"startDate" : "b\\"c"}]}</script>'
    got = spark.createDataFrame([(page,), ("<p>",)], "h string").select(files.embedded_json("h", "d").alias("j")).select(files.fields_named("j", "startDate").alias("v")).collect()
    assert [r.v for r in got] == [["2020-01", 'b"c'], None]


def test_lines_by_first_and_last_word(spark):
    rows = spark.createDataFrame([(1, float(y), i) for i, y in enumerate([0, 2, 4, 6, 20])] + [(1, None, 9)], "page int, y double, i int")
    line = lambda anchor: {r.i: r.line for r in layout.lines(rows, ["page"], "y", "i", 3.0, anchor).collect()}
    assert line("first") == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 9: None}
    assert line("last") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 9: None}


def test_capture_keeps_and_marks_duplicates(spark, tmp_path):
    source, path, log = (str(tmp_path / n) for n in ("in", "ledger", "log"))
    for batch in ([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5)]):
        spark.createDataFrame(batch, "digest string, seq long").coalesce(1).write.mode("append").parquet(source)
        capture.capture(spark.readStream.schema("digest string, seq long").parquet(source), path, log).awaitTermination()
    got = {r.seq: (r.outcome, r.duplicate_of) for r in spark.read.parquet(path).collect()}
    assert got == {1: ("SUCCESS", None), 2: ("SUCCESS", None), 3: ("DUPLICATE", 1), 4: ("DUPLICATE", 2), 5: ("SUCCESS", None)}


def test_day_grain_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    rows = [(1, at(1, 1), 10.0), (1, at(1, 5), 20.0), (2, at(2, 1), 5.0), (1, at(9, 1), 1.0)]
    spark.createDataFrame(rows, "entity_id long, ts timestamp, minutes double").write.parquet(source)
    days = capture.day_grain_stream(spark.readStream.schema("entity_id long, ts timestamp, minutes double").parquet(source))
    days.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(path).awaitTermination()
    got = sorted((r.entity_id, r.event_date.day, r.games, r.minutes) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1, 2, 15.0), (2, 2, 1, 5.0)]


COLUMNS = ("game_id", "team", "opponent", "min")


def test_snapshot_scan_fails_closed(spark, tmp_path):
    import hashlib

    def scan(rows=("G1,BOS,NYK,31.5", "G2,BOS,MIA, 12 "), head="game_id,team,opponent,min", **manifest):
        folder = tmp_path / f"s{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        text = "\ufeff" + "\n".join([head, *rows]) + "\n"
        (folder / "a.csv").write_text(text, encoding="utf-8")
        told = {"sha256": {"a.csv": hashlib.sha256(text.encode()).hexdigest()}, "row_count": len(rows)} | manifest
        return files.snapshot_scan(spark, str(folder), told, COLUMNS, ["min"], {"min": 60}, ["game_id"], ("team", "opponent"))

    rows, faults = scan()
    assert {tuple(r) for r in rows.collect()} == {("G1", "BOS", "NYK", 31.5), ("G2", "BOS", "MIA", 12.0)} and faults.count() == 0
    assert {tuple(r) for r in scan(("31.5,G1,BOS,NYK",), "min,game_id,team,opponent")[0].collect()} == {("G1", "BOS", "NYK", 31.5)}
    bad = scan(("G1,BOS,BOS,x", "G1,BOS,NYK,61", "G3, ,NYK,-1", "G4,BOS,NYK,5,more"))[1]
    assert {(r.code, r.column): r.n for r in bad.collect()} == {
        ("SAME_TEAM_AND_OPPONENT", "team|opponent"): 1, ("INVALID_NUMERIC", "min"): 1, ("OUT_OF_RANGE", "min"): 2, ("NULL_CANONICAL_FIELD", "team"): 1, ("EXTRA_CSV_VALUES", ""): 1, ("DUPLICATE_KEY", "game_id"): 1,
    }
    for code, kwargs in (("PARENT_HASH_MISMATCH", {"sha256": {"a.csv": "0"}}), ("MANIFEST_ROW_COUNT_MISMATCH", {"row_count": 3}), ("INVALID_OR_DUPLICATE_HEADER", {"head": "min,min,team,opponent"}), ("CANONICAL_SCHEMA_MISMATCH", {"head": "game_id,team,opponent,pts"})):
        with pytest.raises(files.SourceError, match=code):
            scan(**kwargs)
