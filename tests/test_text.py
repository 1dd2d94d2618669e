"""Names, phrases, addresses and sentences about moves, as people write them."""

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import layout


def test_names(spark):
    rows = spark.createDataFrame([("José Ñúñez Jr.",), ("O'Neal,  Shaquille III",), ("BOGDANOVIĆ Bojan",), ("  Van  Dyke, Dick",), (None,)], "n string")
    got = [(r.p, r.f) for r in rows.select(tx.plain_name("n").alias("p"), tx.first_last("n").alias("f")).collect()]
    assert got == [("jose nunez", "José Ñúñez Jr."), ("o neal shaquille", "Shaquille III O'Neal"), ("bogdanovi bojan", "BOGDANOVIĆ Bojan"), ("van dyke dick", "Dick Van  Dyke"), (None, None)]
    assert [r.n for r in rows.select(tx.folded("n").alias("n")).collect()][2] == "bogdanovic bojan"


def test_phrases_are_whole_words(spark):
    rows = spark.createDataFrame([("see José's note",), ("Joséphine",), ("xJosé",), ("JOSÉ",), ("a-José.",)], "t string")
    assert [r.x for r in rows.select(tx.has_phrase("t", "José").alias("x")).collect()] == [True, False, False, False, True]


def test_addresses(spark):
    rows = spark.createDataFrame([("HTTPS://News.Example.COM/A/b/?q=1#x",), ("https://news.example.com/A/b",), ("https://news.example.com",)], "u string")
    assert [r.x for r in rows.select(tx.canonical_url("u").alias("x")).collect()] == ["https://news.example.com/A/b", "https://news.example.com/A/b", "https://news.example.com"]


def test_directions_in_free_text(spark):
    told = [
        ("The Boston Celtics acquired guard Ann-Marie Lee from the Utah Jazz on Friday.", "GRAMMATICAL_DIRECTION_CANDIDATE"),
        ("Utah Jazz traded forward Ann-Marie Lee to the Boston Celtics, sources say.", "GRAMMATICAL_DIRECTION_CANDIDATE"),
        ("Ann-Marie Lee was sent from Utah Jazz to Boston Celtics.", "GRAMMATICAL_DIRECTION_CANDIDATE"),
        ("Ann-Marie Lee scored 20 as the Utah Jazz beat the Boston Celtics.", "COOCCURRENCE_ONLY"),
        ("Ann-Marie Lee scored 20 for the Utah Jazz.", "NO_GRAMMATICAL_DIRECTION"),
        ("The Boston Celtics acquired a guard from the Utah Jazz.", "NO_DIRECTION_PROPOSAL"),
        ("The Jazz will send rookie Ann-Marie Lee and a pick to the Boston Celtics.", "GRAMMATICAL_DIRECTION_CANDIDATE"),
        ("Ann-Marie Lee was dealt to the Boston Celtics from Utah.", "GRAMMATICAL_DIRECTION_CANDIDATE"),
        ("Ann-Marie Lee was dealt to the Boston Celtics by Utah.", "COOCCURRENCE_ONLY"),
        ("Boston Celtics acquired " + "x" * 98 + " Ann-Marie Lee from Utah.", "GRAMMATICAL_DIRECTION_CANDIDATE"),
        ("Boston Celtics acquired " + "x" * 99 + " Ann-Marie Lee from Utah.", "COOCCURRENCE_ONLY"),
        ("Ann-Marie Leeds was traded from the Utah Jazz to the Boston Celtics.", "NO_DIRECTION_PROPOSAL"),
    ]
    rows = spark.createDataFrame(told, "t string, want string").select("want", tx.direction("t", F.lit("Ann-Marie Lee"), F.array(F.lit("utah"), F.lit("jazz")), F.array(F.lit("Boston Celtics"))).alias("got"))
    assert [r.got for r in rows.collect()] == [w for _, w in told]
    stages = [("The trade is pending league approval.", "PENDING_APPROVAL"), ("They reportedly agreed to a deal.", "REPORTED_OR_AGREED"), ("They officially acquired her.", "ANNOUNCED_LANGUAGE_UNVERIFIED"), ("A quiet day.", "STAGE_UNKNOWN")]
    assert [r.s for r in spark.createDataFrame([(t,) for t, _ in stages], "t string").select(tx.stage("t").alias("s")).collect()] == [s for _, s in stages]
    assert spark.createDataFrame([("One. Two! Three? four",)], "t string").select(tx.sentences("t").alias("s")).first().s == ["One.", "Two!", "Three?", "four"]


def test_lanes_from_headers_and_reasons_that_go_on(spark):
    words = [
        ("d", 1, 800.0, 10.0, 5.0, "Player"), ("d", 1, 800.0, 300.0, 5.0, "Status"), ("d", 1, 800.0, 500.0, 5.0, "Reason"),
        ("d", 1, 800.0, 12.0, 30.0, "Lee"), ("d", 1, 800.0, 310.0, 30.0, "Out"), ("d", 1, 800.0, 505.0, 30.0, "Left"), ("d", 1, 800.0, 520.0, 42.0, "Knee"), ("d", 1, 800.0, 505.0, 90.0, "late"),
        ("d", 2, 801.5, 400.0, 30.0, "Doubtful"), ("d", 3, 900.0, 400.0, 30.0, "x"),
    ]
    df = spark.createDataFrame(words, "doc string, page int, width double, x double, y double, text string")
    placed = layout.header_lanes(df, ["Player", "Status", "Reason"])
    assert {(r.page, r.text): r.lane for r in placed.collect()} == {(1, "Lee"): "Player", (1, "Out"): "Status", (1, "Left"): "Reason", (1, "Knee"): "Reason", (1, "late"): "Reason", (2, "Doubtful"): "Status", (3, "x"): None}
    rows = layout.continued(placed.where("page = 1"), "Reason", ["Player", "Status"])
    assert [(r.y, r.Player, r.Status, r.Reason) for r in rows.orderBy("y").collect()] == [(30.0, "Lee", "Out", "Left Knee"), (90.0, None, None, "late")]
