"""Queries on line-ups: starters, who was on when, listed sets, and minutes against official ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lineups as lu
from tidemark.plans.records import _ACTIONS, _actions
from tidemark.plans.registry import query, rounded
from tidemark.sources.bindings import table

SIZE, WEEK = 3, 604800
NAMES = ("Ann Lee", "Bo Lee", "Cy Poe", "Di Róe", "Ed Fox")
TEAM = ("game", "team")
_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


def court_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """events as the log of a user's game: weeks are periods, purchases substitutions, errors timeouts; and the rosters of its two teams."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    second = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    kind = F.when(F.col("event_type") == "purchase", "substitution").when(F.col("event_type") == "error", "timeout").otherwise("act")
    slot = lambda n: F.element_at(F.array(*map(F.lit, NAMES)), (n + 1).cast("int"))
    comes = F.expr("k div 10 % 5")
    name = F.when(F.col("k") % 3 == 0, F.element_at(F.split(slot(comes), " "), -1)).otherwise(slot(comes))
    text = F.when(F.col("k") % 17 != 3, F.concat(F.lit("SUB: "), name, F.lit(" FOR "), slot(F.expr("k div 2 % 5")))).otherwise("substitution")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("game"), "event_id", k.alias("k"), kind.alias("kind"), second.alias("second")).where("k is not null")
    actions = rows.select(
        "game",
        (F.col("k") % 2).alias("team"),
        (F.expr(f"second div {WEEK}") + 1).alias("period"),
        (F.col("second") % WEEK).alias("at"),
        F.col("event_id").alias("action_id"),
        "kind",
        F.when(F.col("k") % 23 != 0, F.expr("k div 2 % 5 + 5 * (k % 2)")).alias("player"),
        text.alias("text"),
    )
    roster = rows.groupBy("game").agg(F.sum("k").alias("k")).withColumn("player", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    roster = roster.where("player < 9 or game % 2 = 0")  # some rosters lack their last player
    return actions, roster.select("game", F.expr("player div 5").alias("team"), "player", slot(F.col("player") % 5).alias("name"), ((F.col("k") + F.col("player")) % 40000).cast("double").alias("official"))


_LOG = f"""k as (select user_id as game, event_id as action_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, event_type,
   date_diff('second', timestamp '2024-01-01', date_trunc('second', ts)) as second from events where try_cast(json_extract_string(props, '$.k') as bigint) is not null),
 acts as (select game, k % 2 as team, second // {WEEK} + 1 as period, second % {WEEK} as sec, action_id, case event_type when 'purchase' then 'substitution' when 'error' then 'timeout' else 'act' end as kind,
   case when k % 23 <> 0 then k // 2 % 5 + 5 * (k % 2) end as player, case when k % 17 <> 3 then k // 10 % 5 end as slot, k % 3 = 0 as short from k),
 roster as (select game, p // 5 as team, p as player, {_NAMES}[p % 5 + 1] as name, ((s + p) % 40000)::double as official from (select game, sum(k) as s from k group by 1), range(10) r(p) where p < 9 or game % 2 = 0),
 named as (select game, team, key, min(player) as player from (select game, team, player, unnest(list_distinct([name, split_part(name, ' ', 2)])) as key from roster) group by 1, 2, 3 having count(distinct player) = 1),
 subs as (select a.game, a.team, a.period, a.sec, a.player as outp, coalesce(w.player, l.player) as inp, row_number() over (partition by a.game, a.team, a.period order by a.sec, a.action_id) as n
   from acts a left join named w on w.game = a.game and w.team = a.team and w.key = case when short then split_part({_NAMES}[slot + 1], ' ', 2) else {_NAMES}[slot + 1] end
   left join named l on l.game = a.game and l.team = a.team and l.key = split_part({_NAMES}[slot + 1], ' ', 2) where a.kind = 'substitution'),
 firsts as (select game, team, period, min(sec) filter (where kind = 'substitution') as t from acts group by all),
 cand as (select a.game, a.team, a.period, coalesce(list_sort(list(distinct a.player) filter (where a.player is not null and (kind = 'substitution' and sec = t or kind <> 'timeout' and r.player is not null) and (t is null or sec <= t))), []) as candidates
   from acts a join firsts f using (game, team, period) left join roster r on r.game = a.game and r.team = a.team and r.player = a.player group by all),
 start as (select g.*, candidates, case when candidates is null then 'NO_TEAM_EVENTS' when len(candidates) = {SIZE} then 'UNIQUE' else 'AMBIGUOUS' end as status
   from (select game, team, unnest(range(1, last + 1)) as period from (select distinct game, team from roster) join (select game, max(period) as last from acts group by 1) using (game)) g left join cand using (game, team, period))"""
_FOLD = f"""{_LOG},
 fold as (select game, team, period, 0::bigint as n, 0::bigint as sec, candidates as ons, null::varchar as issue from start where status = 'UNIQUE'
  union all select f.game, f.team, f.period, s.n, s.sec, case when outp is not null and inp is not null and list_contains(ons, outp) and not list_contains(ons, inp) then list_append(list_filter(ons, lambda x: x <> outp), inp) else ons end,
   case when outp is null then 'MISSING_OUTGOING_ID' when not list_contains(ons, outp) then 'OUTGOING_NOT_ON_COURT' when inp is null then 'INCOMING_UNRESOLVED' when list_contains(ons, inp) then 'INCOMING_ALREADY_ON_COURT' end
   from fold f join subs s on s.game = f.game and s.team = f.team and s.period = f.period and s.n = f.n + 1),
 spans as (select *, lead(sec, 1, {WEEK}) over w - sec as span, lag(ons) over w as old from fold window w as (partition by game, team, period order by n)),
 ons as (select game, team, period, player, span, old is null or not list_contains(old, player) as comes from (select *, unnest(ons) as player from spans))"""


@query(f"with recursive {_LOG} select game, team, period, status, len(candidates)::bigint as n_candidates, array_to_string(candidates, ',') as candidates from start")
def period_starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who started each period, from what comes before its first substitution."""
    out = lu.starters(*court_log(spark, sf_dir), TEAM, "period", SIZE)
    size = F.when(F.col("candidates").isNotNull(), F.size("candidates")).cast("long")
    return out.select(*TEAM, "period", "status", size.alias("n_candidates"), F.array_join("candidates", ",").alias("candidates"))


def _periods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    actions, roster = court_log(spark, sf_dir)
    return lu.rebuilt(actions, roster, TEAM, "period", SIZE, F.lit(WEEK)), roster


@query(f"with recursive {_FOLD} select game, team, period, player, sum(span)::bigint as seconds, count(*) filter (where comes) as n_stints from ons group by 1, 2, 3, 4")
def court_stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds and stints of each player in each period, substitution by substitution."""
    stints = _periods(spark, sf_dir)[0].select(*TEAM, "period", F.explode("stints").alias("s"))
    return stints.groupBy(*TEAM, "period", "s.player").agg(F.sum(F.col("s.end") - F.col("s.begin")).alias("seconds"), F.count("*").alias("n_stints"))


@query(
    f"""with recursive {_FOLD} select type, count(*) as n, count(distinct game) as n_games from (select issue as type, game from fold where issue is not null
  union all select 'STARTER_INFERENCE_FAILED', game from start where status <> 'UNIQUE') group by 1"""
)
def lineup_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could not be rebuilt, by kind."""
    errors = _periods(spark, sf_dir)[0].select("game", F.explode("errors.type").alias("type"))
    return errors.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("game").alias("n_games"))


@query(
    f"""with recursive {_FOLD}, on_ as (select game, player, sum(span) / 60.0::double as rebuilt from ons group by 1, 2),
 each as (select r.game, r.team, r.player, official, coalesce(rebuilt, 0) as rebuilt from roster r left join on_ using (game, player)),
 size as (select game, max(period) as periods, count(distinct period) * {WEEK} / 60.0::double as game_minutes from start group by 1),
 gaps as (select game, max(abs(total - {SIZE} * game_minutes)) as team_gap from (select game, team, sum(rebuilt) as total from each group by 1, 2) join size using (game) group by 1),
 off as (select game, avg(abs(rebuilt - official)) as mae, max(abs(rebuilt - official)) as max_error, count(*) filter (where abs(rebuilt - official) > 0.25) as n_over_quarter, count(*) filter (where abs(rebuilt - official) > 1) as n_over_one from each group by 1),
 bad as (select game, count(*) as n from (select game from fold where issue is not null union all select game from start where status <> 'UNIQUE') group by 1),
 told as (select game, count(*) filter (where outp is not null) as n_told, count(*) filter (where outp is not null and inp is null) as n_untold from subs join start using (game, team, period) where status = 'UNIQUE' group by 1)
 select game, periods, round(game_minutes, 6) as game_minutes, round(mae, 6) as mae, round(max_error, 6) as max_error, n_over_quarter, n_over_one, coalesce(bad.n, 0)::bigint as n_errors, coalesce(n_told, 0)::bigint as n_told, coalesce(n_untold, 0)::bigint as n_untold, round(team_gap, 6) as team_gap,
  coalesce(bad.n, 0) = 0 and coalesce(n_untold, 0) = 0 and max_error <= 0.25 and team_gap <= 0.25 as passed from size join gaps using (game) join off using (game) left join bad using (game) left join told using (game)"""
)
def minute_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilt minutes of each game against official ones, and the gate they must pass."""
    return rounded(lu.truth(*_periods(spark, sf_dir), TEAM, "period", SIZE), "game_minutes", "mae", "max_error", "team_gap")


@query(
    f"""with recursive {_ACTIONS}, s as (select user_id, day, list(distinct player) filter (where before is null and kind <> 'in') as must, list(distinct player) as seen,
   count(*) filter (where (kind = 'in' and before in ('in', 'act')) or (kind in ('out', 'act') and before = 'out')) as n_conflicts from o group by 1, 2),
 f as (select user_id, day, coalesce(must, []) as must, list_sort(list_filter(squad, lambda p: not list_contains(seen, p))) as free from s join (select user_id, list(distinct player) as squad from a group by 1) using (user_id) where n_conflicts = 0),
 sets as (select user_id, day, must, free, 0::bigint as k, []::bigint[] as members from f where 3 - len(must) between 0 and len(free)
  union all select user_id, day, must, free, k + 1, m from (select *, unnest(list_transform(list_filter(free, lambda p: len(members) = 0 or p > members[-1]), lambda p: list_append(members, p))) as m from sets where k < 3 - len(must)))
 select user_id, day, array_to_string(list_sort(list_concat(must, members)), ',') as members from sets where k = 3 - len(must)"""
)
def start_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three that may have started a user's day."""
    actions = _actions(spark, sf_dir)
    out = lu.start_sets(actions, actions.select("user_id", "player"), ["user_id"], ["day"], 3, "event_id")
    return out.withColumn("members", F.array_join("members", ","))
