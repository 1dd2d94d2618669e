"""Queries on page layout, line-ups, samples, review counts and sentences about moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import layout, lineups
from tidemark.plans.registry import query, rounded
from tidemark.sources.bindings import ENTITY_GAMES, entity_games, table

#: left edges of the lanes on a page of layout.PAGE_WIDTH
LANES = (("date", 0.0), ("time", 110.0), ("matchup", 180.0), ("team", 255.0), ("player", 410.0), ("status", 570.0), ("reason", 655.0))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    """with recursive d as (select l_orderkey, y, row_number() over (partition by l_orderkey order by y) as rn from (select distinct l_orderkey, l_quantity as y from lineitem)),
 f as (select l_orderkey, y, rn, y as start, 0 as line from d where rn = 1
   union all select d.l_orderkey, d.y, d.rn, case when d.y - f.start > 5 then d.y else f.start end, case when d.y - f.start > 5 then f.line + 1 else f.line end from f join d on d.l_orderkey = f.l_orderkey and d.rn = f.rn + 1)
 select l.l_orderkey, l.l_linenumber, l.l_quantity, cast(f.line as bigint) as line from lineitem l join f on f.l_orderkey = l.l_orderkey and f.y = l.l_quantity"""
)
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of quantities on an order, anchored on each line's first."""
    return layout.lines(_words(spark, sf_dir), ["l_orderkey"], "l_quantity", "l_linenumber", 5.0)


@query(
    """with g as (select l_orderkey, l_linenumber, l_quantity, case when l_quantity - lag(l_quantity) over (partition by l_orderkey order by l_quantity, l_linenumber) > 5 then 1 else 0 end as opens from lineitem)
 select l_orderkey, l_linenumber, l_quantity, cast(sum(opens) over (partition by l_orderkey order by l_quantity, l_linenumber range between unbounded preceding and current row) as bigint) as line from g"""
)
def layout_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, anchored on each line's last."""
    return layout.lines(_words(spark, sf_dir), ["l_orderkey"], "l_quantity", "l_linenumber", 5.0, "last")


_X, _WIDTH = "(l_partkey * 37 % 840 + 0.5::double)", "(841.95::double * (1 + l_linenumber % 2))"


@query(
    "select lane, count(*) as n from (select case "
    + " ".join(f"when {_X} >= {start}::double * {_WIDTH} / 841.95::double then '{name}'" for name, start in reversed(LANES))
    + " end as lane from lineitem) group by 1"
)
def layout_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("l_partkey") * 37 % 840).cast("double") + 0.5
    width = F.lit(layout.PAGE_WIDTH) * (1 + F.col("l_linenumber") % 2)
    return table(spark, sf_dir, "lineitem").select(layout.lane(x, width, LANES).alias("lane")).groupBy("lane").agg(F.count("*").alias("n"))


@query(
    """with c as (select user_id, event_id as clue_event_id from events where event_type = 'purchase'), e as (select user_id, event_id from events where event_type <> 'purchase')
 select user_id, event_id, clue_event_id from (select e.*, c.clue_event_id, row_number() over (partition by e.user_id, e.event_id order by abs(c.clue_event_id - e.event_id), c.clue_event_id) as rn from e left join c using (user_id)) where rn = 1"""
)
def nearest_clue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase nearest to each other event of the user."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return layout.nearest(rows, "user_id", "event_id", F.col("event_type") == "purchase", ["event_id"]).drop("event_type")


@query("select user_id, event_id, (event_id + lag(event_id) over w) / 2.0::double as upper, (event_id + lead(event_id) over w) / 2.0::double as lower from events where event_type = 'signup' window w as (partition by user_id order by event_id)")
def midpoint_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.bands(table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", "event_id"), "user_id", "event_id")


_ACTIONS = f"""a as (select e.user_id, cast(e.ts as date) as day, g.extras % 7 as player, cast(date_diff('second', date_trunc('day', e.ts), e.ts) as bigint) as sec, e.event_id,
   case e.event_type when 'click' then 'in' when 'view' then 'out' else 'act' end as kind from events e join ({ENTITY_GAMES}) g on g.game_id = e.event_id where g.extras is not null),
 o as (select *, lag(kind) over (partition by user_id, day, player order by sec, event_id) as before, lead(sec) over (partition by user_id, day, player order by sec, event_id) as next_at from a)"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "in").when(F.col("event_type") == "view", "out").otherwise("act")
    at = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))) - F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp")))
    player = F.get_json_object("props", "$.k").try_cast("long") % 7
    return table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), player.alias("player"), at.alias("at"), "event_id", kind.alias("kind")).where("player is not null")


@query(
    f"""with {_ACTIONS}, s as (select user_id, day, count(*) filter (where before is null and kind <> 'in') as n_must, count(*) filter (where before is null) as n_seen,
   count(*) filter (where (kind = 'in' and before in ('in', 'act')) or (kind in ('out', 'act') and before = 'out')) as n_conflicts from o group by 1, 2),
 t as (select s.*, r.n_roster - n_seen as n_free from s join (select user_id, count(distinct player) as n_roster from a group by 1) r using (user_id)),
 u as (select *, case when n_conflicts = 0 and 3 - n_must between 0 and n_free
   then cast(round(factorial(n_free::int) / (factorial(greatest(0, 3 - n_must)::int) * factorial(greatest(0, n_free - 3 + n_must)::int))) as bigint) else 0 end as n_sets from t)
 select user_id, day, n_must, n_free, n_conflicts, n_sets, case when n_sets = 0 then 'IMPOSSIBLE' when n_sets = 1 then 'UNIQUE' else 'AMBIGUOUS' end as status from u"""
)
def lineup_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threes that may have started a user's day, from clicks (in) and views (out)."""
    actions = _actions(spark, sf_dir)
    return lineups.starts(actions, actions.select("user_id", "player"), ["user_id"], ["day"], 3, "event_id")


@query(
    f"""with {_ACTIONS} select user_id, day, player, cast(sum(case when kind <> 'out' then coalesce(next_at, 86400) - sec else 0 end + case when before is null and kind <> 'in' then sec else 0 end) as bigint) as seconds
 from o group by 1, 2, 3"""
)
def stint_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineups.time_on(_actions(spark, sf_dir), ["user_id", "day"], 0, 86400, "event_id")


@query(
    f"""with {_ACTIONS}, t as (select user_id, sum(case when kind <> 'out' then coalesce(next_at, 86400) - sec else 0 end) as s from o group by 1), b as (select user_id, sum(value) as v from events group by 1),
 m as (select f, avg(abs(v - s / f)) as mae from b left join t using (user_id), (values (1), (10), (60), (600)) x(f) where s is not null group by 1)
 select f::int as scale, round(mae, 6) as mae from m order by mae, f limit 1"""
)
def scale_trial_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divisor that brings seconds after actions nearest to the users' totals."""
    w = W.partitionBy("user_id", "day", "player").orderBy("at", "event_id")
    after = F.when(F.col("kind") != "out", F.coalesce(F.lead("at").over(w), F.lit(86400)) - F.col("at")).otherwise(0)
    total = _actions(spark, sf_dir).select("user_id", after.alias("s")).groupBy("user_id").agg(F.sum("s").alias("s"))
    both = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("v")).join(total, "user_id")
    each = both.select("v", "s", F.explode(F.array(*map(F.lit, (1, 10, 60, 600)))).alias("f")).groupBy("f").agg(F.avg(F.abs(F.col("v") - F.col("s") / F.col("f"))).alias("mae"))
    return rounded(each.agg(F.min(F.struct("mae", "f")).alias("best")).select(F.col("best.f").alias("scale"), F.col("best.mae").alias("mae")), "mae")


@query(
    f"""with g as ({ENTITY_GAMES}), d as (select entity_id, event_date, row_number() over (partition by entity_id order by event_date) - 1 as nth, count(*) over (partition by entity_id) as n from (select distinct entity_id, event_date from g))
 select entity_id, event_date from d where n >= 3 and nth = greatest(1, least(n - 2, round_even((n - 1) * 0.35::double, 0)))"""
)
def representative_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date 35 % into each entity's distinct dates, halves to even, never its first or last."""
    dates = entity_games(spark, sf_dir).select("entity_id", "event_date").distinct()
    dates = dates.withColumn("nth", F.row_number().over(W.partitionBy("entity_id").orderBy("event_date")) - 1).withColumn("n", F.count("*").over(W.partitionBy("entity_id")))
    at = F.greatest(F.lit(1), F.least(F.col("n") - 2, F.bround((F.col("n") - 1) * F.lit(0.35))))
    return dates.where((F.col("n") >= 3) & (F.col("nth") == at)).select("entity_id", "event_date")


@query(
    """with f as (select *, row_number() over (partition by l_suppkey, l_linenumber order by l_extendedprice desc, l_orderkey, l_partkey) as in_page from lineitem)
 select l_suppkey, l_linenumber, l_orderkey from (select *, row_number() over (partition by l_suppkey order by case when in_page = 1 then 0 else 1 end, l_extendedprice desc, l_orderkey, l_partkey, l_linenumber) as rn from f) where rn <= 10"""
)
def sample_topk_page_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows of each supplier: the first of each page (line number) before any second."""
    keys = [F.desc("l_extendedprice"), "l_orderkey", "l_partkey"]
    rows = table(spark, sf_dir, "lineitem").withColumn("in_page", F.row_number().over(W.partitionBy("l_suppkey", "l_linenumber").orderBy(*keys)))
    order = W.partitionBy("l_suppkey").orderBy((F.col("in_page") > 1).cast("int"), *keys, "l_linenumber")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn <= 10").select("l_suppkey", "l_linenumber", "l_orderkey")


@query("select o_custkey, cast(o_orderdate as date) as day, count(distinct o_orderstatus) as n, array_to_string(list_sort(list(distinct o_orderstatus)), '|') as outcomes from orders group by 1, 2 having count(distinct o_orderstatus) > 1")
def same_day_transition_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.sort_array(F.collect_set("o_orderstatus")).alias("s"))
    return rows.where(F.size("s") > 1).select("o_custkey", "day", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("outcomes"))


@query(
    """with g as (select o_custkey, list_sort(list(distinct cast(o_orderdate as date)) filter (where o_orderstatus = 'F')) as a, list_sort(list(distinct cast(o_orderdate as date)) filter (where o_orderstatus = 'O')) as b from orders group by 1)
 select o_custkey, coalesce(len(a), 0)::bigint as n_first, coalesce(len(b), 0)::bigint as n_second, case when a is null and b is null then 'NO_DATE' when a is null or b is null then 'ONE_CATEGORY' when list_has_any(a, b) then 'AGREE' else 'DISAGREE' end as status from g"""
)
def publication_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two categories of dates of one key share a date."""
    dates = lambda s: F.sort_array(F.collect_set(F.when(F.col("o_orderstatus") == s, F.to_date("o_orderdate"))))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(dates("F").alias("a"), dates("O").alias("b"))
    none = lambda c: F.size(c) == 0
    status = F.when(none("a") & none("b"), "NO_DATE").when(none("a") | none("b"), "ONE_CATEGORY").when(F.arrays_overlap("a", "b"), "AGREE").otherwise("DISAGREE")
    return rows.select("o_custkey", F.size("a").cast("long").alias("n_first"), F.size("b").cast("long").alias("n_second"), status.alias("status"))


@query(
    """with r as (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) > 1 as again from orders)
 select o_orderpriority as bottleneck, count(*) as n, count(*) filter (where again) as n_again, count(distinct o_custkey) as n_keys, rank() over (order by count(*) filter (where not again) desc) as place from r group by 1"""
)
def bottleneck_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by reason, those that repeat a key's reason apart, placed by what is left."""
    again = F.row_number().over(W.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")) > 1
    rows = table(spark, sf_dir, "orders").withColumn("again", again).groupBy(F.col("o_orderpriority").alias("bottleneck"))
    rows = rows.agg(F.count("*").alias("n"), F.count_if("again").alias("n_again"), F.count_distinct("o_custkey").alias("n_keys"))
    return rows.withColumn("place", F.rank().over(W.orderBy(F.desc(F.col("n") - F.col("n_again")))).cast("long"))  # a row a reason


_GRADE = "case when {c} is null then 'PENDING' when {c} = 1 then 'YES' when {c} = 0 then 'NO' else 'UNREADABLE' end"


@query(
    f"""with g as (select doc_id, 'quality' as field, {_GRADE.format(c='l.quality')} as grade from documents d left join labels l using (doc_id) union all select doc_id, 'toxic', {_GRADE.format(c='l.toxic')} from documents d left join labels l using (doc_id))
 select field, count(*) filter (where grade = 'YES') as "YES", count(*) filter (where grade = 'NO') as "NO", count(*) filter (where grade = 'UNREADABLE') as "UNREADABLE", count(*) filter (where grade = 'PENDING') as "PENDING" from g group by 1"""
)
def grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review grades of each field, a column a grade."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).unpivot("doc_id", ["quality", "toxic"], "field", "value")
    grade = F.when(F.col("value").isNull(), "PENDING").when(F.col("value") == 1, "YES").when(F.col("value") == 0, "NO").otherwise("UNREADABLE")
    return rows.withColumn("grade", grade).groupBy("field").agg(*(F.count_if(F.col("grade") == g).alias(g) for g in ("YES", "NO", "UNREADABLE", "PENDING")))


@query(
    f"""with g as ({ENTITY_GAMES}), c as (select unnest(['MINUTES_OUT_OF_RANGE', 'NEGATIVE_POINTS', 'ZERO_MINUTES_WITH_POINTS', 'EXTRAS_MISSING']) as code)
 select code, (select count(*) from g where case code when 'MINUTES_OUT_OF_RANGE' then minutes < 0 or minutes > 60 when 'NEGATIVE_POINTS' then points < 0 when 'ZERO_MINUTES_WITH_POINTS' then minutes < 1 and points > 0 else extras is null end) as n from c"""
)
def target_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conditions on targets counted in one pass."""
    checks = {
        "MINUTES_OUT_OF_RANGE": ~F.col("minutes").between(0, 60),
        "NEGATIVE_POINTS": F.col("points") < 0,
        "ZERO_MINUTES_WITH_POINTS": (F.col("minutes") < 1) & (F.col("points") > 0),
        "EXTRAS_MISSING": F.col("extras").isNull(),
    }
    one = entity_games(spark, sf_dir).agg(*(F.count_if(c).alias(k) for k, c in checks.items()))
    return one.unpivot([], list(checks), "code", "n")


#: sentences about a supplier (p), its nation's old team (o) and new one (d), with a gap of any length (g)
SENTENCES = (
    "{d} acquired {p}{g} from the {o}", "Reportedly {p} was traded{g} from {o} to the {d}", "{p}: {o} and {d} are awaiting a physical", "{o} played {d}", "{o} send {p} and a pick{g} to {d}, officially",
    "{p} was dealt to {d}{g} from {o}", "{d} are expected to{g} obtain {p} from {o}", "{p} beat {o} for {d}", "according to {d}, {p}x was sent from {o} to {d}", "{d} RECEIVES{g} {p}; not yet approved", "{p} rests",
)
_SAID = "[" + ", ".join("'" + s + "'" for s in SENTENCES) + f"][s_suppkey % {len(SENTENCES)} + 1]"
_MOVE = "'(?i)(?:" + "|".join(tx.MOVES) + ")'"
_FILL = lambda of, p, o, d: f"replace(replace(replace({of}, '{{p}}', {p}), '{{o}}', {o}), '{{d}}', {d})"
_STAGE = " ".join(f"when regexp_matches(said, '(?i){words}') then '{name}'" for name, words in tx.STAGES)


@query(
    f"""with s as (select s_suppkey, replace(s_name, '#', ' ') as p, 'Old ' || s_nationkey as o, 'New ' || s_nationkey as d, {_SAID} as t from supplier),
 f as (select *, {_FILL("replace(t, '{g}', ' ' || repeat('y', (s_suppkey % 120)::int))", 'p', 'o', 'd')} as said from s)
 select s_suppkey, case when not regexp_matches(said, '(?i)(^|\\W)' || p || '($|\\W)') then 'NO_DIRECTION_PROPOSAL' when regexp_matches(said, {_FILL(_MOVE, 'p', "'(?:' || o || '|Elders)'", "'(?:' || d || ')'")}) then 'GRAMMATICAL_DIRECTION_CANDIDATE'
  when regexp_matches(said, '(?i)(^|\\W)' || o || '($|\\W)') and regexp_matches(said, '(?i)(^|\\W)' || d || '($|\\W)') then 'COOCCURRENCE_ONLY' else 'NO_GRAMMATICAL_DIRECTION' end as direction, case {_STAGE} else 'STAGE_UNKNOWN' end as stage from f"""
)
def move_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction and stage of sentences about suppliers, with gaps between their parts that some patterns reach over."""
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.replace("s_name", F.lit("#"), F.lit(" ")).alias("p"), F.concat(F.lit("Old "), "s_nationkey").alias("o"), F.concat(F.lit("New "), "s_nationkey").alias("d"),
        F.element_at(F.array(*map(F.lit, SENTENCES)), (F.col("s_suppkey") % len(SENTENCES) + 1).cast("int")).alias("said"),
    )
    gap = F.concat(F.lit(" "), F.repeat(F.lit("y"), (F.col("s_suppkey") % 120).cast("int")))
    for mark, x in (("{g}", gap), ("{p}", F.col("p")), ("{o}", F.col("o")), ("{d}", F.col("d"))):
        rows = rows.withColumn("said", F.replace("said", F.lit(mark), x))
    told = tx.direction("said", "p", F.array("o", F.lit("Elders")), F.array("d"))
    return rows.select("s_suppkey", told.alias("direction"), tx.stage("said").alias("stage"))
