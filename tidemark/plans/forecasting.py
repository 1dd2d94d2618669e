"""Queries on features of earlier days, forecasts and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import day_features as days
from tidemark.operators import forecasts as fc
from tidemark.plans.registry import query, rounded
from tidemark.sources.bindings import ENTITY_GAMES, entity_games
from tidemark.sources.shared import written

WARM_UP = 7
LEAST_PRIOR = 5
LEAST_COVERAGE = 0.88
#: a congruential generator that squares its state twice, so that draws repeat
_SEEDED = "(rep * 7919 + pos * 104729 + 12345) % 2147483647"
_STEPPED = f"((({_SEEDED}) * ({_SEEDED}) % 2147483647) * 48271 + 11) % 2147483647"
LCG_DRAW = f"(({_STEPPED}) * ({_STEPPED}) % 2147483647) % d"
MD5_DRAW = "cast(conv(substr(md5(concat(rep, ':', pos)), 1, 13), 16, 10) as bigint) % d"

_DAYS = f"""games as ({ENTITY_GAMES}),
 days as (select entity_id, event_date, count(*) as games, avg(minutes) as minutes, avg(cast(points as double)) as points, avg(cast(extras as double)) as extras
          from games group by 1, 2),
 rated as (select *, points / nullif(minutes, 0) as rate, row_number() over (partition by entity_id order by event_date) as rn from days),
 ewm as (select entity_id, rn, minutes as e, minutes as e3, minutes as e10 from rated where rn = 1
         union all select r.entity_id, r.rn, case when r.minutes is null then m.e when m.e is null then r.minutes else (2.0::double/6)*r.minutes + (1-2.0::double/6)*m.e end,
           case when r.minutes is null then m.e3 when m.e3 is null then r.minutes else 0.5::double*r.minutes + 0.5::double*m.e3 end,
           case when r.minutes is null then m.e10 when m.e10 is null then r.minutes else (2.0::double/11)*r.minutes + (1-2.0::double/11)*m.e10 end
         from ewm m join rated r on r.entity_id = m.entity_id and r.rn = m.rn + 1),
 feats as (select r.entity_id, r.event_date, r.games, r.minutes, r.points, r.rn - 1 as prior_days,
   lag(minutes) over d as prior_value, coalesce(sum(games) over e, 0) as prior_games,
   avg(minutes) over (d rows between 3 preceding and 1 preceding) as mean_3, avg(minutes) over (d rows between 5 preceding and 1 preceding) as mean_5,
   avg(minutes) over (d rows between 10 preceding and 1 preceding) as mean_10, avg(minutes) over e as season_mean,
   case when count(minutes) over (d rows between 5 preceding and 1 preceding) >= 2 then stddev_pop(minutes) over (d rows between 5 preceding and 1 preceding) end as deviation_5,
   case when count(minutes) over e >= 2 then stddev_pop(minutes) over e end as season_deviation,
   m.e3 as ewm_3, m.e as ewm_5, m.e10 as ewm_10, avg(rate) over (d rows between 5 preceding and 1 preceding) as rate_5
   from rated r left join ewm m on m.entity_id = r.entity_id and m.rn = r.rn - 1
   window d as (partition by r.entity_id order by r.event_date), e as (partition by r.entity_id order by r.event_date rows between unbounded preceding and 1 preceding)),
 features as (select *, mean_3 - season_mean as role_delta, case when abs(mean_3 - season_mean) >= 6 then 1 else 0 end as role_change from feats)"""
# DuckDB can't extend a named window by a frame
for _n in (3, 5, 10):
    _DAYS = _DAYS.replace(f"(d rows between {_n} preceding and 1 preceding)", f"(partition by r.entity_id order by r.event_date rows between {_n} preceding and 1 preceding)")

_LONG = f"""{_DAYS},
 eligible as (select * from features where prior_games >= 5),
 long as (select entity_id, event_date, minutes as actual, prior_games, role_change, rank, candidate, estimate, abs(minutes - estimate) as error from (
   select *, 0 as rank, 'prior_value' as candidate, prior_value as estimate from eligible union all
   select *, 1, 'mean_3', mean_3 from eligible union all select *, 2, 'mean_5', mean_5 from eligible union all
   select *, 3, 'mean_10', mean_10 from eligible union all select *, 4, 'season_mean', season_mean from eligible union all
   select *, 5, 'ewm_5', ewm_5 from eligible) where estimate is not null and minutes is not null)"""

_FEATURES = ("prior_value", "mean_3", "mean_5", "mean_10", "season_mean", "deviation_5", "season_deviation", "ewm_3", "ewm_5", "ewm_10", "rate_5", "role_delta")
_ROUND = ", ".join(f"round({c}, 6) as {c}" for c in _FEATURES)


def _day_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days.day_windows(days.day_grain(entity_games(spark, sf_dir)))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.long_form(_day_rows(spark, sf_dir).where(F.col("prior_games") >= LEAST_PRIOR))


@query(f"with recursive {_DAYS} select g.game_id, g.entity_id, g.event_date, g.team_id, f.prior_days, f.prior_games::bigint as prior_games, {_ROUND}, f.role_change from games g left join features f using (entity_id, event_date)")
def d1_feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = days.feature_frame(entity_games(spark, sf_dir)).drop("minutes", "points", "extras")
    return rounded(out, *_FEATURES).withColumn("prior_days", F.col("prior_days").cast("long"))


@query(f"with recursive {_DAYS} select entity_id, event_date, games, round(minutes, 6) as minutes, round(points, 6) as points, round(extras, 6) as extras from days")
def day_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(days.day_grain(entity_games(spark, sf_dir)), *days.MEASURES)


@query(f"with recursive {_LONG} select candidate, count(*) as n, round(avg(error), 6) as mae from long group by 1")
def candidate_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fc.mean_errors(_long(spark, sf_dir)), "mae")


@query(
    f"""with recursive {_LONG}, labelled as (
 select *, unnest(['overall', case when role_change = 1 then 'role_change' else 'stable' end,
   'history_' || case when prior_games <= 9 then '5-9' when prior_games <= 19 then '10-19' else '20+' end]) as segment from long)
 select segment, candidate, count(*) as n, round(avg(error), 6) as mae from labelled group by 1, 2"""
)
def segment_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fc.segment_errors(_long(spark, sf_dir)), "mae")


_SELECTED = f"""{_LONG},
 daily as (select candidate, rank, event_date, sum(error) as s, count(*) as c from long group by 1, 2, 3),
 past as (select candidate, rank, event_date, coalesce(sum(s) over w, 0) as s, coalesce(sum(c) over w, 0) as c from daily
          window w as (partition by candidate order by event_date rows between unbounded preceding and 1 preceding)),
 best as (select event_date, coalesce(first(candidate order by s / c, rank) filter (where c >= 100), 'mean_5') as candidate from past group by 1),
 nth as (select event_date, row_number() over (order by event_date) - 1 as nth from (select distinct event_date from long)),
 selected as (select l.* from long l join best using (event_date, candidate) join nth using (event_date) where nth >= {WARM_UP})"""


@query(f"with recursive {_SELECTED} select event_date, candidate, count(*) as n, round(avg(error), 6) as mae from selected group by 1, 2")
def prequential_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = fc.selected(_long(spark, sf_dir), WARM_UP)
    return rounded(picked.groupBy("event_date", "candidate").agg(F.count("*").alias("n"), F.avg("error").alias("mae")), "mae")


def _widths(by: str) -> str:
    keys = f"{by}, " if by else ""
    on = f"a.{by} = b.{by} and " if by else ""
    group = f"a.{by}, " if by else ""
    return f"""(select {group}a.event_date, count(*) as n, list_sort(list(b.error))[cast(least(count(*), ceil((count(*) + 1) * 0.9::double)) as int)] as width
      from (select distinct {keys}event_date from base) a join base b on {on}b.event_date < a.event_date group by {group}a.event_date)"""


_BASE = f"{_LONG}, base as (select * from long where candidate = 'ewm_5')"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecasts that intervals are made for, computed once for all that reads them."""
    return written(_long(spark, sf_dir).where("candidate = 'ewm_5'"), "base")


@query(f"with recursive {_BASE} select event_date, n, round(width, 6) as width from {_widths('')}")
def conformal_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fc.conformal(_base(spark, sf_dir)), "width")


@query(f"with recursive {_BASE} select role_change, event_date, n, round(width, 6) as width from {_widths('role_change')}")
def conformal_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fc.conformal(_base(spark, sf_dir), "role_change"), "width")


_SHRUNK = f"""{_BASE}, pooled as {_widths('')}, own as {_widths('role_change')},
 shrunk as (select role_change, event_date, own.n, own.n / (own.n + 250.0::double) * own.width + (1 - own.n / (own.n + 250.0::double)) * pooled.width as width
            from own join pooled using (event_date))"""


@query(f"with recursive {_SHRUNK} select role_change, event_date, n, round(width, 6) as width from shrunk")
def conformal_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fc.shrunk(_base(spark, sf_dir)), "width")


_INTERVALS = f"""{_SHRUNK}, ranged as (
 select b.*, greatest(0, estimate - width) as lower, least(60, estimate + width) as upper from base b join shrunk using (role_change, event_date)),
 covered as (select *, case when actual between lower and upper then 1 else 0 end as covered,
   case when prior_games <= 9 then '5-9' when prior_games <= 19 then '10-19' else '20+' end as history, strftime(event_date, '%Y-%m') as month from ranged),
 summary as (select role_change, history, month, count(*) as n, count(distinct event_date) as dates, avg(covered) as coverage, avg(upper - lower) as mean_width, avg(error) as mae, avg(case when error > 5 then 1.0 else 0.0 end) as over_5, avg(case when error > 10 then 1.0 else 0.0 end) as over_10, avg(case when error > 15 then 1.0 else 0.0 end) as over_15
   from covered group by grouping sets ((role_change), (history), (month), ()))"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base(spark, sf_dir)
    rows = fc.intervals(base, fc.shrunk(base).drop("n"), "role_change")
    return fc.interval_summary(rows.withColumn("history", fc.history_group()).withColumn("month", F.date_format("event_date", "yyyy-MM")), ("role_change", "history", "month"))


_ROUNDED = ("coverage", "mean_width", "mae", "over_5", "over_10", "over_15")
_SUMMARY = "role_change, history, month, n, dates, " + ", ".join(f"round({c}, 6) as {c}" for c in _ROUNDED)


@query(f"with recursive {_INTERVALS} select {_SUMMARY} from summary")
def diagnostics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_summary(spark, sf_dir), *_ROUNDED)


@query(f"with recursive {_INTERVALS} select {_SUMMARY} from summary where n >= 100 and coverage < 0.88")
def guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_summary(spark, sf_dir).where(f"n >= 100 and coverage < {LEAST_COVERAGE}"), *_ROUNDED)


@query(
    f"""with recursive {_LONG}, gains as (select a.event_date, sum(a.error - b.error) as gain, count(*) as n from long a join long b using (entity_id, event_date)
   where a.candidate = 'mean_5' and b.candidate = 'ewm_5' group by 1),
 daily as (select row_number() over (order by event_date) - 1 as nth, gain, n from gains), size as (select count(*) as d from daily),
 draws as (select rep, {LCG_DRAW} as nth from size, range(500) r(rep), range(d) p(pos)),
 reps as (select rep, sum(gain) / sum(n) as ratio from draws join daily using (nth) group by 1)
 select count(*) as reps, round(avg(ratio), 6) as mean, round(quantile_cont(ratio, 0.025), 6) as low, round(quantile_cont(ratio, 0.975), 6) as high from reps"""
)
def bootstrap_lcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date blocks drawn with replacement by a congruential generator, the same in any engine."""
    return _bootstrap(_long(spark, sf_dir), LCG_DRAW)


@query(
    f"""with recursive {_LONG}, gains as (select a.event_date, sum(a.error - b.error) as gain, count(*) as n from long a join long b using (entity_id, event_date)
   where a.candidate = 'mean_5' and b.candidate = 'ewm_5' group by 1),
 daily as (select row_number() over (order by event_date) - 1 as nth, gain, n from gains), size as (select count(*) as d from daily),
 draws as (select rep, ('0x' || substring(md5(rep::varchar || ':' || pos::varchar), 1, 13))::bigint % d as nth from size, range(500) r(rep), range(d) p(pos)),
 reps as (select rep, sum(gain) / sum(n) as ratio from draws join daily using (nth) group by 1)
 select count(*) as reps, round(avg(ratio), 6) as mean, round(quantile_cont(ratio, 0.025), 6) as low, round(quantile_cont(ratio, 0.975), 6) as high from reps"""
)
def bootstrap_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date blocks drawn with replacement by a hash of replicate and position, the same in any engine."""
    return _bootstrap(_long(spark, sf_dir), MD5_DRAW)


def _bootstrap(rows: DataFrame, draw: str) -> DataFrame:
    rows = rows.where("candidate in ('mean_5', 'ewm_5')")
    paired = rows.groupBy("entity_id", "event_date").agg(F.sum(F.when(F.col("candidate") == "mean_5", F.col("error")).otherwise(-F.col("error"))).alias("gain"), F.count("*").alias("c")).where("c = 2")
    daily = paired.groupBy("event_date").agg(F.sum("gain").alias("gain"), F.count("*").alias("n"))
    daily = daily.withColumn("nth", F.row_number().over(W.orderBy("event_date")) - 1)
    size = daily.agg(F.count("*").alias("d"))
    draws = rows.sparkSession.range(500).withColumnRenamed("id", "rep").join(F.broadcast(size)).select("rep", "d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") - 1)).alias("pos"))
    draws = draws.select("rep", F.expr(draw).alias("nth"))
    return rounded(fc.block_bootstrap(daily, draws), "mean", "low", "high")


@query(f"with recursive {_LONG}, s as (select entity_id, event_date, rank, error from long) select a.rank as better, b.rank as worse, count(*) as n, round(avg(b.error - a.error), 6) as gain from s a join s b using (entity_id, event_date) where a.rank < b.rank group by 1, 2")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _long(spark, sf_dir).select("entity_id", "event_date", "rank", "error")
    a, b = rows.withColumnsRenamed({"rank": "better", "error": "ea"}), rows.withColumnsRenamed({"rank": "worse", "error": "eb"})
    pairs = a.join(b, ["entity_id", "event_date"]).where("better < worse")
    return rounded(pairs.groupBy("better", "worse").agg(F.count("*").alias("n"), F.avg(F.col("eb") - F.col("ea")).alias("gain")), "gain")


def _cell_widths(*keys: str) -> str:
    k = "".join(f"a.{c}, " for c in keys)
    on = "".join(f"a.{c} = b.{c} and " for c in keys)
    return f"""(select {k}a.event_date, count(*) as n, list_sort(list(b.error))[cast(least(count(*), ceil((count(*) + 1) * 0.9::double)) as int)] as width
      from (select distinct {k}event_date from celled a) a join celled b on {on}b.event_date < a.event_date group by {k}a.event_date)"""


_CASCADE = f"""{_BASE}, celled as (select *, case when prior_games <= 9 then '5-9' when prior_games <= 19 then '10-19' else '20+' end as history,
   case when count(error) over w >= 3 and avg(error) over w > 5 then 'high' else 'low' end as volatility
   from base window w as (partition by entity_id order by event_date rows between 8 preceding and 1 preceding)),
 w0 as {_cell_widths()}, w1 as {_cell_widths('role_change')}, w2 as {_cell_widths('role_change', 'history')}, w3 as {_cell_widths('role_change', 'history', 'volatility')},
 chosen as (select c.*, coalesce(w3.width, w2.width, w1.width, w0.width) as width,
   case when w3.n is not null then 'role_change+history+volatility' when w2.n is not null then 'role_change+history' when w1.n is not null then 'role_change' else 'pooled' end as level
   from celled c join w0 using (event_date) left join w1 on w1.event_date = c.event_date and w1.role_change = c.role_change and w1.n >= 100
   left join w2 on w2.event_date = c.event_date and w2.role_change = c.role_change and w2.history = c.history and w2.n >= 100
   left join w3 on w3.event_date = c.event_date and w3.role_change = c.role_change and w3.history = c.history and w3.volatility = c.volatility and w3.n >= 100)"""


@query(f"with recursive {_CASCADE} select entity_id, event_date, history, volatility, level, round(width, 6) as width from chosen")
def conformal_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fc.cascade(fc.with_cells(_base(spark, sf_dir)))
    return rounded(out.select("entity_id", "event_date", "history", "volatility", "level", "width"), "width")


@query(f"""with recursive {_CASCADE} select level, count(*) as n, round(avg(case when error <= width then 1.0 else 0.0 end), 6) as coverage, round(sum(error) / sum(sum(error)) over (), 6) as share_of_error,
 count(*) filter (where error > 15) as over_15 from chosen group by 1""")
def risk_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each level of the cascade covers, and its share of all error."""
    out = fc.cascade(fc.with_cells(_base(spark, sf_dir)))
    out = out.groupBy("level").agg(F.count("*").alias("n"), F.avg((F.col("error") <= F.col("width")).cast("double")).alias("coverage"), F.sum("error").alias("e"), F.count_if(F.col("error") > 15).alias("over_15"))
    out = out.withColumn("share_of_error", F.col("e") / F.sum("e").over(W.partitionBy(F.lit(1)))).drop("e")  # a row a level
    return rounded(out, "coverage", "share_of_error")


_METHODS = f"""{_CASCADE}, pooled as {_widths('')}, own as {_widths('role_change')},
 widths as (select event_date, role_change, 'pooled' as method, p.width from (select distinct event_date, role_change from celled) join pooled p using (event_date)
   union all select event_date, role_change, 'role_specific', own.width from own
   union all select event_date, role_change, 'role_shrunk', own.n / (own.n + 250.0::double) * own.width + (1 - own.n / (own.n + 250.0::double)) * p.width from own join pooled p using (event_date)),
 span as (select min(event_date) as a, greatest(max(event_date) - min(event_date), 1) as days from celled join widths using (event_date, role_change)),
 methods as (select c.*, w.method, greatest(0, estimate - w.width) as lower, least(60, estimate + w.width) as upper, case when actual between greatest(0, estimate - w.width) and least(60, estimate + w.width) then 1 else 0 end as covered,
   strftime(event_date, '%Y-%m') as month, case when 3 * (event_date - a) <= days then 'early' when 3 * (event_date - a) <= 2 * days then 'middle' else 'late' end as phase
   from celled c join widths w using (event_date, role_change) cross join span)"""
_DIMENSIONS = ("role_change", "history", "volatility", "month", "phase")


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fc.with_cells(_base(spark, sf_dir))
    roles = rows.select("event_date", "role_change").distinct()
    pooled = fc.conformal(rows).select("event_date", F.col("width").alias("pooled"))
    own = fc.conformal(rows, "role_change").select("event_date", "role_change", "n", F.col("width").alias("own"))
    weight = F.col("n") / (F.col("n") + fc.SHRINK)
    each = roles.join(pooled, "event_date").join(own, ["event_date", "role_change"], "left")
    named = [("pooled", F.col("pooled")), ("role_specific", F.col("own")), ("role_shrunk", weight * F.col("own") + (1 - weight) * F.col("pooled"))]
    widths = each.select("event_date", "role_change", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), w.alias("width")) for m, w in named))).alias("_w")).select("event_date", "role_change", "_w.*").where("width is not null")
    return fc.season_phase(fc.intervals(rows, widths, "role_change").withColumn("month", F.date_format("event_date", "yyyy-MM")))


@query(
    f"""with recursive {_METHODS} select method, {", ".join(_DIMENSIONS)}, count(*) as n, count(distinct event_date) as dates, {", ".join(f"round(avg({e}), 6) as {n}" for n, e in (("coverage", "covered"), ("mean_width", "upper - lower"), ("mae", "error"), *((f"over_{x}", f"case when error > {x} then 1.0 else 0.0 end") for x in (5, 10, 15))))}
 from methods group by grouping sets ({", ".join(f"(method, {d})" for d in _DIMENSIONS)}, (method))"""
)
def method_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method's intervals by role, history, volatility, month and phase of the season, and in all."""
    return rounded(fc.interval_summary(_methods(spark, sf_dir), _DIMENSIONS, ("method",)), *_ROUNDED)


@query(
    f"""with recursive {_METHODS}, one as (select * from methods where method = 'role_specific')
 select {", ".join(_DIMENSIONS[:3])}, count(*) as n, round(avg(error), 6) as mae, round(avg(case when error > 10 then 1.0 else 0.0 end), 6) as over_10, round(avg(case when error > 15 then 1.0 else 0.0 end), 6) as over_15
 from one group by grouping sets ({", ".join(f"({d})" for d in _DIMENSIONS[:3])})"""
)
def error_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast errors by group, each game once: they don't depend on the interval's method."""
    once = _methods(spark, sf_dir).where("method = 'role_specific'")
    out = fc.interval_summary(once, _DIMENSIONS[:3]).where(" or ".join(f"{d} is not null" for d in _DIMENSIONS[:3]))
    return rounded(out.select(*_DIMENSIONS[:3], "n", "mae", "over_10", "over_15"), "mae", "over_10", "over_15")


@query(
    f"""with recursive {_METHODS}, a as (select * from methods where method = 'pooled'), b as (select * from methods where method = 'role_specific')
 select coalesce(a.event_date, b.event_date) as event_date, case when a.event_date is null or b.event_date is null then 'UNPAIRED' else 'PAIRED' end as status, count(*) as n,
   coalesce(sum(b.covered - a.covered), 0)::bigint as coverage_delta, round(coalesce(sum((b.upper - b.lower) - (a.upper - a.lower)), 0), 6) as width_delta
 from a full outer join b on a.entity_id = b.entity_id and a.event_date = b.event_date group by 1, 2"""
)
def paired_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and width of two methods by date, rows paired one to one and checked to agree in what they share."""
    rows = _methods(spark, sf_dir).select("entity_id", "event_date", "method", "actual", "estimate", "role_change", "history", "volatility", "covered", "lower", "upper")
    pairs = fc.paired(rows, ["entity_id", "event_date"], ["actual", "estimate", "role_change", "history", "volatility"], "pooled", "role_specific")
    width = lambda m: F.col(f"{m}.upper") - F.col(f"{m}.lower")
    deltas = F.coalesce(F.sum(F.col("other.covered") - F.col("base.covered")), F.lit(0)).alias("coverage_delta"), F.coalesce(F.sum(width("other") - width("base")), F.lit(0.0)).alias("width_delta")
    return rounded(pairs.groupBy("event_date", "status").agg(F.count("*").alias("n"), *deltas), "width_delta")
