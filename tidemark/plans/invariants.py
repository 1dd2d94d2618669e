"""Queries on invariants of snapshots, registries and source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import invariants as iv
from tidemark.plans.registry import query, rounded
from tidemark.sources.bindings import ENTITY_GAMES, entity_games, table

TARGET = "1998-06-01"


@query(
    f"""with s as (select case when l_orderkey % 83 = 0 then 'soon' else strftime(l_shipdate, '%Y-%m-%d') end as d, case when l_orderkey % 71 = 0 then ' ' else l_orderkey::varchar end as g, l_suppkey::varchar as p, (l_partkey % 9)::varchar as t, case when l_orderkey % 67 = 0 then null else ' ' || (l_suppkey % 9) end as o from lineitem),
 f as (select case when try_cast(d as date) is null then 'INVALID_DATE' end as a, case when try_cast(d as date) >= date '{TARGET}' then 'D1_LEAKAGE' end as b, case when trim(g) = '' then 'MISSING_KEY' end as c, case when o is null then 'TEAM_OPPONENT_MISSING' end as e, case when trim(o) = t then 'TEAM_EQUALS_OPPONENT' end as h from s)
 select fault, count(*) as n from (select unnest([a, b, c, e, h]) as fault from f) where fault is not null group by 1 union all select 'DUPLICATE_KEY', (count(*) - count(distinct (g, p)))::bigint from s where trim(g) <> '' having count(*) > count(distinct (g, p))"""
)
def snapshot_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps shipped lines from being a snapshot of the days before a target."""
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(k % 83 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("event_date"), F.when(k % 71 == 0, " ").otherwise(k.cast("string")).alias("game_id"), F.col("l_suppkey").alias("player_id"),
        (F.col("l_partkey") % 9).alias("team_id"), F.when(k % 67 != 0, F.concat(F.lit(" "), F.col("l_suppkey") % 9)).alias("opponent_team_id"),
    )
    return iv.snapshot_faults(rows, TARGET, ("game_id", "player_id"), "event_date", "team_id", "opponent_team_id")


@query(
    """with m as (select o_orderkey, case when o_orderkey % 7 = 0 then 'D-0' when o_orderkey % 7 = 1 then null else 'D-1' end as c, o_orderdate::date as d, case when o_orderkey % 11 = 0 then o_orderdate::date else (o_orderdate::date - 1)::date end as cut, case when o_orderkey % 13 = 0 then 'noon' when o_orderkey % 17 = 0 then strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00' else strftime(o_orderdate - interval 1 day, '%Y-%m-%d') || 'T23:59:59' end as t,
  case when o_orderkey % 19 = 0 then '' else 'a' end as sha, case when o_orderkey % 5 = 0 then (o_orderdate::date + 1)::date else o_orderdate::date end as said from orders)
 select o_orderkey, case when c is distinct from 'D-1' then 'SNAPSHOT_CONTRACT_NOT_D1' when said <> d then 'SNAPSHOT_TARGET_DATE_MISMATCH' when cut <> d - 1 then 'SNAPSHOT_CUTOFF_MISMATCH' when t = 'noon' then 'SNAPSHOT_AS_OF_INVALID' when t[1:10] <> strftime(d - interval 1 day, '%Y-%m-%d') then 'SNAPSHOT_AS_OF_DATE_MISMATCH' when sha = '' then 'SNAPSHOT_PROVENANCE_MISSING parent_sha256' end as fault from m"""
)
def snapshot_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each snapshot's metadata."""
    k, day = F.col("o_orderkey"), lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyy-MM-dd")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", day(0).alias("target"), F.when(k % 7 == 0, "D-0").when(k % 7 == 1, None).otherwise("D-1").alias("contract"), F.when(k % 5 == 0, day(1)).otherwise(day(0)).alias("target_game_date"),
        F.when(k % 11 == 0, day(0)).otherwise(day(-1)).alias("cutoff_date"), F.when(k % 13 == 0, "noon").when(k % 17 == 0, F.concat(day(0), F.lit("T00:00:00"))).otherwise(F.concat(day(-1), F.lit("T23:59:59"))).alias("as_of_time"),
        F.lit("p").alias("parent_artifact_id"), F.when(k % 19 == 0, "").otherwise("a").alias("parent_sha256"), F.lit("l").alias("logical_sha256"), F.lit("s").alias("snapshot_id"),
    )
    return rows.select("o_orderkey", iv.metadata_fault("target").alias("fault"))


@query(
    """with h as (select c_custkey, case when c_custkey % 7 = 0 then 'few' when c_custkey % 5 = 0 then '-1' else coalesce(n, 0)::varchar end as n, case when c_custkey % 3 = 0 then 'AVAILABLE' when coalesce(n, 0) > 0 then 'AVAILABLE' else 'ZERO_HISTORY' end as s from customer left join (select o_custkey as c_custkey, count(*) as n from orders group by 1) using (c_custkey))
 select c_custkey, case when try_cast(n as bigint) is null or try_cast(n as bigint) < 0 then 'ENTITY_HISTORY_COUNT_INVALID' when s <> case when n::bigint > 0 then 'AVAILABLE' else 'ZERO_HISTORY' end then 'ENTITY_HISTORY_STATUS_INVALID' end as fault from h"""
)
def entity_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer's count of orders and its status go together."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(counts, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    k = F.col("c_custkey")
    count = F.when(k % 7 == 0, "few").when(k % 5 == 0, "-1").otherwise(F.col("n").cast("string")).alias("eligible_game_count")
    status = F.when((k % 3 == 0) | (F.col("n") > 0), "AVAILABLE").otherwise("ZERO_HISTORY").alias("history_status")
    return rows.select("c_custkey", count, status).select("c_custkey", iv.history_fault().alias("fault"))


def feature_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a feature registry."""
    k = F.col("p_partkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.when(k % 29 == 0, " ").otherwise(F.concat_ws(" ", "p_name", k % 400)).alias("feature_name"), F.col("p_brand").alias("feature_group"), F.col("p_type").alias("description"), F.lit("box").alias("source_domain"),
        (k % 3 != 0).alias("pregame_available"), F.when(k % 31 != 0, k % 5 != 0).alias("historical_available"), (k % 7 != 0).alias("today_available"), F.lit("null").alias("missing_value_policy"), (k % 11 != 0).alias("leakage_checked"),
        pick((*iv.COVERAGES, "MAYBE"), F.col("p_size") % 5).alias("coverage_status"), pick((*iv.STATUSES, "NEW"), k % 5).alias("research_status"), F.lit("1").alias("feature_version"), F.lit("").alias("notes"),
    )


@query(
    f"""with r as (select case when p_partkey % 29 = 0 then ' ' else p_name || ' ' || (p_partkey % 400) end as feature_name, p_partkey % 3 <> 0 as pre, case when p_partkey % 31 <> 0 then p_partkey % 5 <> 0 end as hist, p_partkey % 7 <> 0 as today, p_partkey % 11 <> 0 as leak,
  {list((*iv.COVERAGES, "MAYBE"))}[p_size % 5 + 1] as cov, {list((*iv.STATUSES, "NEW"))}[p_partkey % 5 + 1] as st from part), c as (select *, count(*) over (partition by feature_name) as copies, st = 'APPROVED_BASELINE' as ok from r),
 v as (select feature_name, unnest([case when trim(feature_name) = '' then 'FEATURE_NAME_BLANK' end, case when trim(feature_name) <> '' and copies > 1 then 'FEATURE_NAME_REPEATED' end, case when st = 'NEW' then 'RESEARCH_STATUS_INVALID' end, case when cov = 'MAYBE' then 'COVERAGE_STATUS_INVALID' end, case when hist is null then 'HISTORICAL_AVAILABLE_NOT_BOOLEAN' end,
  case when ok and not pre then 'APPROVED_NOT_PREGAME' end, case when ok and not hist then 'APPROVED_NOT_HISTORICAL' end, case when ok and not today then 'APPROVED_NOT_TODAY' end, case when ok and not leak then 'APPROVED_NOT_LEAKAGE_CHECKED' end, case when ok and cov <> 'PASS' then 'APPROVED_WITHOUT_COVERAGE' end]) as code from c)
 select feature_name, code, count(*) as n from v where code is not null group by 1, 2"""
)
def feature_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a feature registry breaks, by feature."""
    return iv.governance(feature_registry(spark, sf_dir)).groupBy("feature_name", "code").agg(F.count("*").alias("n"))


@query(
    """with l as (select l_orderkey, l_suppkey, case when l_partkey % 10 = 0 then null else l_quantity end as q from lineitem),
 g as (select l_orderkey, count(*) as n from l group by 1)
 select 'rows' as metric, count(*)::double as value from l union all select 'columns', 3.0::double union all select 'missing_column_minutes', 1.0::double union all select 'null_rate_l_orderkey', 0.0::double union all select 'null_rate_q', round(avg(case when q is null then 1.0 else 0.0 end), 9)::double from l
 union all select 'unique_games', count(distinct l_orderkey)::double from l union all select 'unique_players', count(distinct l_suppkey)::double from l union all select 'games_not_exactly_two_rows', (count(*) filter (where n <> 2))::double from g
 union all select 'duplicate_full_rows', ((select count(*) from l) - (select count(*) from (select distinct l_orderkey, l_suppkey, q from l)))::double union all select 'duplicate_player_game_keys', ((select count(*) from l) - (select count(*) from (select distinct l_orderkey, l_suppkey from l)))::double"""
)
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates that tell whether a source table is fit for use."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.when(F.col("l_partkey") % 10 != 0, F.col("l_quantity")).alias("q"))
    return rounded(iv.profile(rows, ("l_orderkey", "q", "minutes"), "l_orderkey", "l_suppkey"), "value", digits=9)


@query(
    f"""with g as ({ENTITY_GAMES})
 select a.game_id, count(b.game_id) as n_prior, max(b.event_date) as last_prior, round(case when count(b.game_id) = count(b.extras) then avg(b.extras) end, 6) as prior_mean, (select count(*) from g c where c.entity_id = a.entity_id and c.event_date = a.event_date) > 1 as same_day
 from g a left join g b on b.entity_id = a.entity_id and b.event_date < a.event_date group by a.game_id, a.entity_id, a.event_date"""
)
def prior_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history that each game has from strictly earlier days."""
    out = iv.prior_history(entity_games(spark, sf_dir), "entity_id", "event_date", "extras")
    return rounded(out.select("game_id", "n_prior", "last_prior", "prior_mean", "same_day"), "prior_mean")
