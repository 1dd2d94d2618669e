"""Queries on contracts: typed records with quarantine, realised targets, frames of paired methods, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import contracts as ct
from tidemark.operators import targets as tg
from tidemark.plans.registry import query, rounded
from tidemark.sources.bindings import table

RULES = (
    ct.Typed("order_id", kind="bigint", least=0),
    ct.Typed("line", kind="bigint", least=1, most=6),
    ct.Typed("quantity", kind="double", least=2, most=49),
    ct.Typed("flag", allowed=("A", "N", "R"), nullable=True),
    ct.Typed("shipped", kind="date"),
    ct.Typed("checked_by", kind="string"),
)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a table of texts, some of them wrong: words for numbers, broken dates, blanks, repeated keys."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.when(k % 97 != 0, k.cast("string")).alias("order_id"),
        F.when(n == 5, "4").otherwise(n.cast("string")).alias("line"),
        F.when((k + n) % 41 == 0, "many").when((k + n) % 43 == 0, None).otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("int"))).alias("quantity"),
        F.when(k % 31 == 0, "X").when(k % 37 == 0, None).otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(k % 29 == 0, "2024-02-31").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("shipped"),
        F.concat_ws("-", "l_partkey", "l_suppkey", n).alias("lot"),
    )


_TEXT_LINES = """select case when l_orderkey % 97 <> 0 then l_orderkey::varchar end as order_id, case when l_linenumber = 5 then '4' else l_linenumber::varchar end as line,
  case when (l_orderkey + l_linenumber) % 41 = 0 then 'many' when (l_orderkey + l_linenumber) % 43 = 0 then null else ' ' || l_quantity::int end as quantity, case when l_orderkey % 31 = 0 then 'X' when l_orderkey % 37 = 0 then null else l_returnflag end as flag,
  case when l_orderkey % 29 = 0 then '2024-02-31' else strftime(l_shipdate, '%Y-%m-%d') end as shipped, concat_ws('-', l_partkey, l_suppkey, l_linenumber) as lot from lineitem"""
_CHECKED = f"""t as ({_TEXT_LINES}), n as (select *, row_number() over (partition by order_id, line order by lot, quantity, flag, shipped) as nth from t),
 c as (select *, list_filter(['MISSING_COLUMN:checked_by', 'SCHEMA_DRIFT_EXTRA_COLUMN:lot', case when order_id is null then 'NULL_NOT_ALLOWED:order_id' end, case when line::int > 6 then 'VALUE_ABOVE_MAXIMUM:line' end,
  case when quantity is null then 'NULL_NOT_ALLOWED:quantity' end, case when quantity = 'many' then 'TYPE_MISMATCH:quantity' end, case when try_cast(trim(quantity) as double) < 2 then 'VALUE_BELOW_MINIMUM:quantity' end, case when try_cast(trim(quantity) as double) > 49 then 'VALUE_ABOVE_MAXIMUM:quantity' end,
  case when flag = 'X' then 'VALUE_NOT_ALLOWED:flag' end, case when shipped is null then 'NULL_NOT_ALLOWED:shipped' end, case when shipped is not null and try_cast(shipped as date) is null then 'TYPE_MISMATCH:shipped' end, case when order_id is not null and nth > 1 then 'DUPLICATE_PRIMARY_KEY:order_id|line' end], lambda x: x is not null) as codes from n)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.checked(text_lines(spark, sf_dir), RULES, ("order_id", "line"), ("lot", "quantity", "flag", "shipped"))


@query(f"with {_CHECKED} select lot, order_id, array_to_string(codes, ' ') as issues, case when len(codes) > 0 then 'QUARANTINED' else 'PASS' end as validation_status from c")
def record_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues of each record of texts against a typed contract."""
    out = _checked(spark, sf_dir)
    return out.select("lot", "order_id", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["column"])), " ").alias("issues"), "validation_status")


@query(f"with {_CHECKED}, q as (select *, list_filter(codes, lambda x: x not like 'MISSING%' and x not like 'SCHEMA%') as own from c) select case when len(own) > 0 then 'QUARANTINED' else 'PASS' end as outcome, count(*) as n, round(sum(try_cast(trim(quantity) as double)), 6) as quantity from q group by 1")
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passes the contract of the columns that are there, and what is set aside."""
    rows = ct.checked(text_lines(spark, sf_dir), RULES[:-1], ("order_id", "line"), ("lot", "quantity", "flag", "shipped"), extras=True)
    passed, aside = ct.quarantined(rows)
    side = lambda df, name: df.agg(F.count("*").alias("n"), F.sum(F.trim("quantity").try_cast("double")).alias("quantity")).select(F.lit(name).alias("outcome"), "n", "quantity").where("n > 0")
    return rounded(side(passed, "PASS").unionByName(side(aside, "QUARANTINED")), "quantity")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as outcomes in text, some without a player, date or number."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").try_cast("long")
    minutes = F.round(F.col("value") - 60 * F.floor(F.col("value") / 60), 2)
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 2 + event_id % 2 * (event_id % 101 - 1) div 100").alias("game_id"),
        F.when(i % 61 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("event_date"),
        F.when(i % 59 != 0, F.col("user_id")).alias("player_id"),
        F.col("event_type").alias("team_id"),
        F.when(i % 53 == 0, "DNP").when(i % 47 == 0, "0").when(i % 43 == 0, "-1").when(i % 41 == 0, "60.5").otherwise(minutes.cast("string")).alias("min"),
        k.cast("string").alias("pts"),
        F.when(i % 37 == 0, "n/a").otherwise((k % 15).cast("string")).alias("reb"),
        (k % 11 - F.when(i % 31 == 0, 11).otherwise(0)).cast("string").alias("ast"),
        (k % 5).cast("string").alias("fg3m"),
    )


_OUTCOMES = """o as (select event_id // 2 + event_id % 2 * (event_id % 101 - 1) // 100 as game_id, case when event_id % 61 = 0 then 'soon' else strftime(ts, '%Y-%m-%d') end as event_date, case when event_id % 59 <> 0 then user_id end as player_id, event_type as team_id,
  case when event_id % 53 = 0 then 'DNP' when event_id % 47 = 0 then '0' when event_id % 43 = 0 then '-1' when event_id % 41 = 0 then '60.5' else round(value - 60 * floor(value / 60), 2)::varchar end as min, k as pts, case when event_id % 37 <> 0 then k % 15 end as reb, k % 11 - case when event_id % 31 = 0 then 11 else 0 end as ast, k % 5 as fg3m
  from (select *, try_cast(json_extract_string(props, '$.k') as bigint) as k from events)),
 j as (select *, try_cast(min as double) as m, count(*) over (partition by game_id, player_id) as copies from o),
 f as (select *, list_filter([case when game_id is null or player_id is null or team_id is null or event_date is null then 'IDENTITY_NULL' end, case when try_cast(event_date as date) is null then 'EVENT_DATE_INVALID' end, case when copies > 1 then 'DUPLICATE_OUTCOME' end, case when m is null then 'MINUTES_MISSING' end,
  case when m < 0 then 'MINUTES_NEGATIVE' end, case when m > 60 then 'MINUTES_ABOVE_BOUND' end, case when pts is null then 'PTS_MISSING' end, case when reb is null then 'REB_MISSING' end, case when ast is null then 'AST_MISSING' end, case when fg3m is null then 'FG3M_MISSING' end,
  case when pts < 0 then 'PTS_NEGATIVE' end, case when reb < 0 then 'REB_NEGATIVE' end, case when ast < 0 then 'AST_NEGATIVE' end, case when fg3m < 0 then 'FG3M_NEGATIVE' end, case when m = 0 and coalesce(pts, 0) + coalesce(reb, 0) + coalesce(ast, 0) + coalesce(fg3m, 0) > 0 then 'ZERO_MINUTES_WITH_STATS' end], lambda x: x is not null) as faults from j)"""


@query(f"with {_OUTCOMES} select unnest(faults) as fault, count(*) as n from f group by 1")
def target_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps outcomes from being targets, by fault."""
    return tg.fault_counts(tg.judged(outcomes(spark, sf_dir)))


@query(f"with {_OUTCOMES} select game_id, event_date::date as event_date, player_id, team_id, round(m, 6) as target_minutes, pts::double as target_points, reb::double as target_rebounds, ast::double as target_assists, fg3m::double as target_3pm, (m > 0)::int as target_played from f where len(faults) = 0")
def player_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised outcomes of sound rows."""
    return rounded(tg.targets(tg.judged(outcomes(spark, sf_dir))), "target_minutes")


METHODS = ("role_specific", "role_history", "role_history_volatility")


def method_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as forecasts of three methods, with rows, bounds and marks that don't fit."""
    i = F.col("event_id")
    actual = F.round(F.col("value") - 60 * F.floor(F.col("value") / 60), 2)
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(i % 211 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("event_date"), F.col("user_id").alias("player_id"), i.alias("game_id"), actual.alias("actual"),
        F.explode(F.sequence(F.lit(0), F.when(i % 101 == 0, 3).when(i % 103 == 0, 1).otherwise(2))).alias("m"),
    )
    method = F.when((i % 107 == 0) & (F.col("m") == 2), "other").otherwise(F.element_at(F.array(*map(F.lit, METHODS)), F.col("m") % 3 + 1))
    a = F.when((i % 109 == 0) & (F.col("m") == 1), F.col("actual") + 0.5).otherwise(F.col("actual"))
    estimate = F.lit(30.0)
    lower, upper = estimate - 8 - F.col("m") % 3, estimate + 8 + F.col("m") % 3
    return rows.select(
        "event_date", "player_id", "game_id", method.alias("method"), F.when(i % 113 == 0, "none").otherwise(a.cast("string")).alias("actual"), estimate.alias("estimate"),
        F.when(i % 127 == 0, upper + 1).otherwise(lower).alias("lower"), upper.alias("upper"),
        (a.between(lower, upper).cast("int") + F.when(i % 131 == 0, 1).otherwise(0)).alias("covered"), (F.abs(a - estimate) + F.when(i % 137 == 0, 0.01).otherwise(0)).alias("abs_error"),
        (i % 2).alias("role_change_flag"), F.when(i % 139 == 0, F.concat(F.lit("h"), "m")).otherwise("h").alias("history_group"), F.lit("v").alias("volatility_group"),
    )


@query(
    f"""with e as (select event_id, case when event_id % 211 = 0 then 'soon' else strftime(ts, '%Y-%m-%d') end as event_date, user_id as player_id, event_id as game_id, round(value - 60 * floor(value / 60), 2) as a0, unnest(range(case when event_id % 101 = 0 then 4 when event_id % 103 = 0 then 2 else 3 end)) as m from events),
 g as (select *, case when event_id % 107 = 0 and m = 2 then 'other' else {list(METHODS)}[m % 3 + 1] end as method, case when event_id % 109 = 0 and m = 1 then a0 + 0.5 else a0 end as a, 22.0::double - m % 3 as lo, 38.0::double + m % 3 as hi from e),
 r as (select *, case when event_id % 113 = 0 then null else a end as actual, case when event_id % 127 = 0 then hi + 1 else lo end as lower, case when a between lo and hi then 1 else 0 end + case when event_id % 131 = 0 then 1 else 0 end as covered, abs(a - 30) + case when event_id % 137 = 0 then 0.01 else 0 end as abs_error, case when event_id % 139 = 0 then 'h' || m else 'h' end as history from g),
 rows_ as (select unnest(list_filter([case when event_date = 'soon' then 'DATE_INVALID' end, case when method = 'other' then 'UNEXPECTED_METHOD' end, case when actual is null then 'ACTUAL_INVALID' end, case when actual is not null and not (actual between 0 and 60 and lower <= hi) then 'BOUNDS_INVALID' end, case when actual is not null and covered not in (0, 1) then 'NOT_BINARY' end,
  case when abs(abs_error - abs(actual - 30)) > 1e-7 + 1e-5 * abs(actual - 30) then 'ERROR_INCONSISTENT' end, case when actual is not null and covered <> case when actual >= lower and actual <= hi then 1 else 0 end then 'COVERAGE_INCONSISTENT' end], lambda x: x is not null)) as fault from r),
 k as (select game_id, count(*) filter (where method <> 'other') as n, count(distinct method) filter (where method <> 'other') as d, count(distinct coalesce(actual::varchar, '')) as da, count(distinct history) as dh from r group by 1),
 keys as (select unnest(list_filter([case when n > d then 'DUPLICATE_METHOD_ROW' end, case when d <> 3 then 'UNPAIRED' end, case when n = 3 and d = 3 and da > 1 then 'ACTUAL_DIFFERS' end, case when n = 3 and d = 3 and dh > 1 then 'HISTORY_GROUP_DIFFERS' end], lambda x: x is not null)) as fault from k)
 select fault, count(*) as n from (select * from rows_ union all select * from keys) group by 1"""
)
def paired_frame_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a frame of three methods from being compared."""
    return tg.paired_faults(method_rows(spark, sf_dir), ("event_date", "player_id", "game_id"), METHODS)
