"""The test tables in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.identity import TEAMS
from tidemark.operators.report_lines import REPORT_NAMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as games of an entity: a key, a day, a group, minutes within [0, 60) and two counts."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("game_id"),
        F.col("user_id").alias("entity_id"),
        F.to_date("ts").alias("event_date"),
        F.col("event_type").alias("team_id"),
        (F.col("value") - 60 * F.floor(F.col("value") / 60)).alias("minutes"),
        F.floor("value").cast("long").alias("points"),
        F.get_json_object("props", "$.k").try_cast("long").alias("extras"),
    )


#: the same in SQL
ENTITY_GAMES = """
 select event_id as game_id, user_id as entity_id, cast(ts as date) as event_date, event_type as team_id,
        value - 60*floor(value/60) as minutes, cast(floor(value) as bigint) as points,
        try_cast(json_extract_string(props, '$.k') as bigint) as extras
 from events
"""


LAST_NAMES = ("Smith", "Van Dyke", "O'Neal", "Jones")
FIRST_NAMES = ("John", "Ann-Marie", "P.J.", "Lee")
_listed = lambda names: "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as lines of status reports: doc, page, line, text; dates, matchups with a team, and players' statuses."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    team, code, other = pick(REPORT_NAMES, c % 30), pick(TEAMS, c % 30), pick(TEAMS, (c + 1 + k % 7) % 30)
    name = F.concat(pick(LAST_NAMES, F.expr("o_orderkey div 5 % 4")), F.lit(", "), pick(FIRST_NAMES, F.expr("o_orderkey div 11 % 4")))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Injury Report: "), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" 05:30 PM")))
        .when(k % 5 == 1, F.concat(F.lit("07:00 (ET) "), code, F.lit("@"), other, F.lit(" "), team))
        .when(k % 5 == 2, F.concat(team, F.lit(" "), name, F.lit(" Out Injury/Illness - Left Knee; Sprain")))
        .when(k % 5 == 3, F.concat(name, F.lit(" Questionable")))
        .otherwise(F.concat(F.lit("see note "), name, F.lit(" Probable Coach Decision")))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (c % 40).alias("doc"), F.expr("o_orderkey div 7 % 3").alias("page"), text.alias("text"))
    return rows.withColumn("line", F.row_number().over(Window.partitionBy("doc", "page").orderBy("o_orderkey"))).drop("o_orderkey")


#: the same in SQL
REPORT_LINES = f"""
 select doc, page, row_number() over (partition by doc, page order by o_orderkey) as line, text from (select o_orderkey, o_custkey % 40 as doc, o_orderkey // 7 % 3 as page,
  case o_orderkey % 5 when 0 then 'Injury Report: ' || strftime(o_orderdate, '%m/%d/%Y') || ' 05:30 PM'
   when 1 then '07:00 (ET) ' || {_listed(TEAMS)}[o_custkey % 30 + 1] || '@' || {_listed(TEAMS)}[(o_custkey + 1 + o_orderkey % 7) % 30 + 1] || ' ' || {_listed(REPORT_NAMES)}[o_custkey % 30 + 1]
   when 2 then {_listed(REPORT_NAMES)}[o_custkey % 30 + 1] || ' ' || {_listed(LAST_NAMES)}[o_orderkey // 5 % 4 + 1] || ', ' || {_listed(FIRST_NAMES)}[o_orderkey // 11 % 4 + 1] || ' Out Injury/Illness - Left Knee; Sprain'
   when 3 then {_listed(LAST_NAMES)}[o_orderkey // 5 % 4 + 1] || ', ' || {_listed(FIRST_NAMES)}[o_orderkey // 11 % 4 + 1] || ' Questionable'
   else 'see note ' || {_listed(LAST_NAMES)}[o_orderkey // 5 % 4 + 1] || ', ' || {_listed(FIRST_NAMES)}[o_orderkey // 11 % 4 + 1] || ' Probable Coach Decision' end as text from orders)
"""


#: a page of report_cells: lines, and where they stand
PER_PAGE, TOP, STEP = 25, 88.0, 18.0


def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as runs of text on report pages: doc, page, x, y, text; a line an order, reasons often on lines of their own.

    Dates, two of them and a wrong one; matchups with and without a team; teams that may be no part of the game;
    pending reports; statuses without a player; reasons without a row; and players.
    """
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    kind = (k + c) % 11
    home, away = pick(list(TEAMS)[:4], k % 4), pick(list(TEAMS)[:4], (k + 1) % 4)
    run = lambda x, text, dy=0.0: F.struct(F.lit(x).alias("x"), F.lit(dy).alias("dy"), text.alias("text"))
    day = F.when(k % 13 == 0, "99/99/2024").when(k % 2 == 0, "01/15/2024").otherwise("02/15/2024")
    team = run(270.0, pick(REPORT_NAMES[:4], c % 4))
    name = F.concat(pick(LAST_NAMES, F.expr("o_orderkey div 5 % 4")), F.lit(", "), pick(FIRST_NAMES, F.expr("o_orderkey div 11 % 4")))
    row = (run(430.0, name), run(600.0, pick(("Out", "Questionable", "Doubtful"), k % 3)))
    reason = lambda text, dy=0.0: run(670.0, F.lit(text), dy)
    runs = (
        F.when(kind == 0, F.array(run(30.0, day)))
        .when(kind == 1, F.array(run(200.0, F.concat(home, F.lit("@"), away)), run(270.0, pick(REPORT_NAMES[:4], k % 4))))
        .when(kind == 2, F.array(run(200.0, F.concat(home, F.lit("@"), away))))
        .when(kind == 3, F.array(team))
        .when(kind == 4, F.array(reason("NOT YET SUBMITTED")))
        .when(kind == 5, F.array(run(600.0, F.lit("Out"))))
        .when(kind == 6, F.array(reason("Left Knee")))
        .when(k % 4 == 0, F.array(*row, reason("Injury/Illness - Sprain")))
        .when(k % 4 == 1, F.array(*row, reason("Injury/Illness - Left", -7.0), reason("Ankle; Soreness", 7.0)))
        .when(k % 4 == 2, F.array(*row))
        .otherwise(F.array(*row, reason("Coach Decision", -7.0)))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_custkey div 10").alias("doc"), F.explode(runs).alias("r"))
    nth = F.dense_rank().over(Window.partitionBy("doc").orderBy("o_orderkey")) - 1
    rows = rows.withColumn("n", nth)
    return rows.select("doc", (F.floor(F.col("n") / PER_PAGE) + 1).cast("long").alias("page"), "r.x", (TOP + (F.col("n") % PER_PAGE) * STEP + F.col("r.dy")).alias("y"), "r.text")


#: the same in SQL
REPORT_CELLS = f"""
 select doc, n // {PER_PAGE} + 1 as page, r.x as x, {TOP}::double + (n % {PER_PAGE}) * {STEP}::double + r.dy as y, r.text as text from (
  select doc, dense_rank() over (partition by doc order by o_orderkey) - 1 as n, r from (select o_orderkey, o_custkey // 10 as doc, unnest(case (o_orderkey + o_custkey) % 11
   when 0 then [struct_pack(x := 30.0::double, dy := 0.0::double, text := case when o_orderkey % 13 = 0 then '99/99/2024' when o_orderkey % 2 = 0 then '01/15/2024' else '02/15/2024' end)]
   when 1 then [struct_pack(x := 200.0::double, dy := 0.0::double, text := {_listed(list(TEAMS)[:4])}[o_orderkey % 4 + 1] || '@' || {_listed(list(TEAMS)[:4])}[(o_orderkey + 1) % 4 + 1]), struct_pack(x := 270.0::double, dy := 0.0::double, text := {_listed(REPORT_NAMES[:4])}[o_orderkey % 4 + 1])]
   when 2 then [struct_pack(x := 200.0::double, dy := 0.0::double, text := {_listed(list(TEAMS)[:4])}[o_orderkey % 4 + 1] || '@' || {_listed(list(TEAMS)[:4])}[(o_orderkey + 1) % 4 + 1])]
   when 3 then [struct_pack(x := 270.0::double, dy := 0.0::double, text := {_listed(REPORT_NAMES[:4])}[o_custkey % 4 + 1])]
   when 4 then [struct_pack(x := 670.0::double, dy := 0.0::double, text := 'NOT YET SUBMITTED')]
   when 5 then [struct_pack(x := 600.0::double, dy := 0.0::double, text := 'Out')]
   when 6 then [struct_pack(x := 670.0::double, dy := 0.0::double, text := 'Left Knee')]
   else list_concat([struct_pack(x := 430.0::double, dy := 0.0::double, text := {_listed(LAST_NAMES)}[o_orderkey // 5 % 4 + 1] || ', ' || {_listed(FIRST_NAMES)}[o_orderkey // 11 % 4 + 1]), struct_pack(x := 600.0::double, dy := 0.0::double, text := ['Out', 'Questionable', 'Doubtful'][o_orderkey % 3 + 1])],
    case o_orderkey % 4 when 0 then [struct_pack(x := 670.0::double, dy := 0.0::double, text := 'Injury/Illness - Sprain')]
     when 1 then [struct_pack(x := 670.0::double, dy := -7.0::double, text := 'Injury/Illness - Left'), struct_pack(x := 670.0::double, dy := 7.0::double, text := 'Ankle; Soreness')]
     when 2 then [] else [struct_pack(x := 670.0::double, dy := -7.0::double, text := 'Coach Decision')] end) end) as r from orders))
"""


def report_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_cells as boxes of words: doc, page, width, x0, y0, x1, y1, text; most pages with a header, some of another width."""
    cells = report_cells(spark, sf_dir)
    heads = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(h).alias("text")) for x, h in ((200.0, "Matchup"), (270.0, "Team"), (430.0, "Player Name"), (590.0, "Current Status"), (670.0, "Reason:"))))
    cells = cells.withColumn("_nth", F.row_number().over(Window.partitionBy("doc", "page").orderBy("y")))
    headed = (F.col("_nth") == 1) & ((F.col("page") == 1) | ((F.col("doc") + F.col("page")) % 3 != 2))
    own = F.array(F.struct("x", "y", "text"))
    runs = F.when(headed, F.concat(own, F.transform(heads, lambda h: F.struct(h["x"].alias("x"), F.lit(70.0).alias("y"), h["text"].alias("text"))))).otherwise(own)
    words = cells.select("doc", "page", F.explode(runs).alias("r")).select("doc", "page", "r.*").withColumn("_w", F.split("text", " "))
    words = words.select("doc", "page", "x", "y", "_w", F.posexplode("_w").alias("i", "text"))
    left = F.col("x") + 5.0 * F.length(F.array_join(F.slice("_w", F.lit(1), F.col("i")), " ")) + F.when(F.col("i") > 0, 5.0).otherwise(0.0)
    width = F.when((F.col("doc") % 5 == 4) & (F.col("page") >= 3), 900.0).when(F.col("doc") % 7 == 3, 842.95).otherwise(841.95)
    width = F.when((F.col("doc") % 7 == 3) & (F.col("page") == 1), 841.95).otherwise(width)
    return words.select("doc", "page", width.alias("width"), left.alias("x0"), (F.col("y") - 4).alias("y0"), (left + 5.0 * F.length("text")).alias("x1"), (F.col("y") + 4).alias("y1"), "text")


#: the same in SQL
REPORT_WORDS = f"""
 select doc, page, case when doc % 7 = 3 and page = 1 then 841.95::double when doc % 5 = 4 and page >= 3 then 900.0::double when doc % 7 = 3 then 842.95::double else 841.95::double end as width,
  x + 5.0::double * before as x0, y - 4 as y0, x + 5.0::double * before + 5.0::double * length(text) as x1, y + 4 as y1, text
 from (select doc, page, x, y, w[i] as text, length(array_to_string(w[1:i - 1], ' ')) + case when i > 1 then 1 else 0 end as before from (select *, unnest(generate_series(1, len(w))) as i from (
  select doc, page, x, y, string_split(text, ' ') as w from (select * from ({REPORT_CELLS}) union all
   select doc, page, h.x, 70.0::double, h.text from (select doc, page, unnest([struct_pack(x := 200.0::double, text := 'Matchup'), struct_pack(x := 270.0::double, text := 'Team'), struct_pack(x := 430.0::double, text := 'Player Name'), struct_pack(x := 590.0::double, text := 'Current Status'),
    struct_pack(x := 670.0::double, text := 'Reason:')]) as h from (select distinct doc, page from ({REPORT_CELLS})) where page = 1 or (doc + page) % 3 <> 2)))))
"""
