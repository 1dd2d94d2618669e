"""Queries on spelled dates, what may be used before an event, identities, provenance and stints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates as dt
from tidemark.operators import eligibility as el
from tidemark.operators import identity as idn
from tidemark.operators import invariance
from tidemark.operators import packets as pk
from tidemark.operators import provenance as pv
from tidemark.operators import stints as st
from tidemark.plans.registry import query, rounded
from tidemark.sources.bindings import entity_games, table

_SPELLED = """spelled as (select o_orderkey, case o_orderkey % 9 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') when 2 then strftime(o_orderdate, '%b %-d, %Y')
 when 3 then strftime(o_orderdate, '%b %-d %Y') when 4 then strftime(o_orderdate, '%-m/%-d/%Y') when 5 then strftime(o_orderdate, '%Y%m%d') when 6 then ' ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+05:30'
 when 7 then strftime(o_orderdate, '%d. %m. %Y') else '13/45/' || year(o_orderdate) end as day from orders)"""


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda f: F.date_format("o_orderdate", f)
    forms = [d("yyyy-MM-dd"), d("yyyy-MM-dd'T'HH:mm:ss"), d("MMM d, yyyy"), d("MMM d yyyy"), d("M/d/yyyy"), d("yyyyMMdd"), F.concat(F.lit(" "), d("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")), d("dd. MM. yyyy"), F.concat(F.lit("13/45/"), F.year("o_orderdate"))]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 9 + 1).cast("int")).alias("day"))


@query(
    f"""with {_SPELLED} select o_orderkey, coalesce(try_strptime(trim(day), '%Y-%m-%d'), try_strptime(trim(day), '%Y-%m-%dT%H:%M:%S'), try_strptime(trim(day), '%b %-d, %Y'), try_strptime(trim(day), '%b %-d %Y'),
 try_strptime(trim(day), '%-m/%-d/%Y'), try_strptime(trim(day), '%Y%m%d'), case when regexp_matches(trim(day), 'T.*(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') then try_strptime(trim(day)[1:10], '%Y-%m-%d') end)::date as parsed from spelled"""
)
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written in eight ways, two of them nobody accepts."""
    return _spelled(spark, sf_dir).select("o_orderkey", dt.day_of("day").alias("parsed"))


@query(
    """with t as (select o_orderkey, 'Injury-Report_' || strftime(o_orderdate, '%Y-%m-%d') || '_' || (o_orderkey % 14)::varchar || case when o_orderkey % 2 = 0 then '_' || lpad((o_orderkey % 60)::varchar, 2, '0') else '' end || case when o_orderkey % 3 = 0 then 'AM' else 'PM' end || '.pdf' as name from orders),
 p as (select *, regexp_extract(name, '_(\\d{1,2})(_\\d{2})?[AP]M', 1)::int as h, coalesce(try_cast(nullif(regexp_extract(name, '_(\\d{1,2})_(\\d{2})[AP]M', 2), '') as int), 0) as m, regexp_extract(name, '(\\d{4}-\\d{2}-\\d{2})', 1) as d, name like '%PM.pdf' as pm from t)
 select o_orderkey, name, case when h between 1 and 12 then timezone('UTC', timezone('America/New_York', d::timestamp + to_minutes((h % 12 + case when pm then 12 else 0 end) * 60 + m))) end as at_utc from p"""
)
def report_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UTC time that a report's file name tells, in summer and winter."""
    k = F.col("o_orderkey")
    minute = F.when(k % 2 == 0, F.concat(F.lit("_"), F.lpad((k % 60).cast("string"), 2, "0"))).otherwise("")
    name = F.concat(F.lit("Injury-Report_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"), (k % 14).cast("string"), minute, F.when(k % 3 == 0, "AM").otherwise("PM"), F.lit(".pdf"))
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")).withColumn("at_utc", dt.report_time("name"))


@query(
    """with c as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, case l_linenumber % 4 when 0 then floor(l_quantity)::int || ':' || lpad((l_partkey % 70)::varchar, 2, '0') when 1 then l_quantity::varchar when 2 then 'DNP' else floor(l_quantity)::int || ':xx' end as played,
   'PT' || lpad((l_suppkey % 12)::varchar, 2, '0') || 'M' || lpad((l_partkey % 60)::varchar, 2, '0') || '.00S' as clock, l_suppkey % 12 as cm, l_partkey % 60 as cs, 1 + l_orderkey % 6 as period from lineitem)
 select l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(case when played like '%:%' then case when try_cast(split_part(played, ':', 2) as double) < 60 then split_part(played, ':', 1)::double + split_part(played, ':', 2)::double / 60 end else try_cast(played as double) end, 6) as minutes,
  round((least(period - 1, 4) * 720 + greatest(period - 5, 0) * 300 + case when period <= 4 then 720 else 300 end - (cm * 60 + cs))::double, 6) as elapsed from c"""
)
def clock_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes as clock or number, and seconds of play so far from a period and its clock."""
    q = F.floor("l_quantity").cast("int").cast("string")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    played = F.when(F.col("l_linenumber") % 4 == 0, F.concat(q, F.lit(":"), two(F.col("l_partkey") % 70))).when(F.col("l_linenumber") % 4 == 1, F.col("l_quantity").cast("string")).when(F.col("l_linenumber") % 4 == 2, "DNP").otherwise(F.concat(q, F.lit(":xx")))
    clock = F.concat(F.lit("PT"), two(F.col("l_suppkey") % 12), F.lit("M"), two(F.col("l_partkey") % 60), F.lit(".00S"))
    rows = table(spark, sf_dir, "lineitem").withColumns({"played": played, "clock": clock, "period": 1 + F.col("l_orderkey") % 6})
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", dt.minutes_of("played").alias("minutes"), dt.elapsed_seconds("period", "clock").cast("double").alias("elapsed")), "minutes", "elapsed")


@query(
    """with t as (select o_orderkey, 'traded ' || strftime(o_orderdate, '%B %-d, %Y') || ' and waived ' || strftime(o_orderdate + interval 3 day, '%b %-d, %Y') || ' (' || strftime(o_orderdate, '%b %-d') || ')' as s, year(o_orderdate) as y from orders)
 select o_orderkey, len(regexp_extract_all(s, '[A-Z][a-z]+ \\d{1,2}, \\d{4}')) as n_days, try_strptime(regexp_extract(s, '([A-Z][a-z]+ \\d{1,2}, \\d{4})', 1), '%B %-d, %Y')::date as first_day,
  try_strptime(regexp_extract_all(s, '[A-Z][a-z]+ \\d{1,2}, \\d{4}')[2], '%b %-d, %Y')::date as last_day, try_strptime(regexp_extract(s, '\\(([A-Z][a-z]+ \\d{1,2})\\)$', 1) || ', ' || y, '%b %-d, %Y')::date as section from t"""
)
def named_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with a month's name within a sentence, and the day of a section heading."""
    d = F.col("o_orderdate")
    s = F.concat(F.lit("traded "), F.date_format(d, "MMMM d, yyyy"), F.lit(" and waived "), F.date_format(F.date_add(d, 3), "MMM d, yyyy"), F.lit(" ("), F.date_format(d, "MMM d"), F.lit(")"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"), F.year(d).alias("y")).withColumn("days", dt.named_days("s"))
    return rows.select("o_orderkey", F.size("days").cast("long").alias("n_days"), F.try_element_at("days", F.lit(1)).alias("first_day"), F.try_element_at("days", F.lit(-1)).alias("last_day"), dt.section_day("s", "y").alias("section"))


_OBSERVED = """obs as (select event_id, case when event_id % 11 = 0 then null else strftime(ts, '%Y-%m-%dT%H:%M:%S') || case event_id % 7 when 0 then '' when 1 then '+02:00' else 'Z' end end as observed_at_utc,
  case when event_id % 13 = 0 then ' ' when event_id % 17 = 0 then 'soon' else strftime(ts + to_minutes(cast(event_id % 90 - 5 as int)), '%Y-%m-%dT%H:%M:%S') || 'Z' end as available_at_utc,
  strftime(ts + to_minutes(cast(event_id % 60 - 3 as int)), '%Y-%m-%dT%H:%M:%S') || 'Z' as prediction_cutoff_utc, event_id % 5 = 0 as is_revised, event_id % 10 = 0 as revision_asof_verified from events)"""


@query(
    f"""with {_OBSERVED}, m as (select *, concat_ws(',', case when coalesce(trim(observed_at_utc), '') = '' then 'observed_at_utc' end, case when coalesce(trim(available_at_utc), '') = '' then 'available_at_utc' end) as missing,
   case when regexp_matches(observed_at_utc, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') then try_cast(observed_at_utc as timestamptz) end as o, case when regexp_matches(available_at_utc, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') then try_cast(available_at_utc as timestamptz) end as a, prediction_cutoff_utc::timestamptz as c from obs)
 select event_id, case when missing <> '' then 'missing_required:' || missing when o is null then 'invalid_timestamp:naive timestamp forbidden' when a is null then 'invalid_timestamp:invalid ISO-8601 timestamp' when a < o then 'availability_before_observation'
  when o > c then 'observed_after_cutoff' when a > c then 'available_after_cutoff' when is_revised and not revision_asof_verified then 'revision_asof_unverified' else 'eligible_at_cutoff' end as reason from m"""
)
def pregame_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an observation was available at its cutoff, with the first reason against it."""
    k, iso = F.col("event_id"), "yyyy-MM-dd'T'HH:mm:ss"
    at = lambda minutes: F.date_format(F.timestamp_add("MINUTE", minutes, "ts"), iso)
    observed = F.when(k % 11 != 0, F.concat(F.date_format("ts", iso), F.when(k % 7 == 0, "").when(k % 7 == 1, "+02:00").otherwise("Z")))
    available = F.when(k % 13 == 0, " ").when(k % 17 == 0, "soon").otherwise(F.concat(at((k % 90 - 5).cast("int")), F.lit("Z")))
    rows = table(spark, sf_dir, "events").select("event_id", observed.alias("observed_at_utc"), available.alias("available_at_utc"), F.concat(at((k % 60 - 3).cast("int")), F.lit("Z")).alias("prediction_cutoff_utc"), (k % 5 == 0).alias("is_revised"), (k % 10 == 0).alias("revision_asof_verified"))
    return rows.select("event_id", el.pregame_reason(el.TIMES).alias("reason"))


@query(
    """with j as (select event_id, case when event_id % 3 = 0 then event_id::varchar end as a, case when event_id % 3 > 0 then event_id::varchar end as b, case when event_id % 19 = 0 then '' else user_id::varchar end as p, event_type as t, cast(ts as date)::varchar as d from events),
 c as (select coalesce(a, b) as game_id, nullif(p, '') as player_id, t as team_id, d as event_date from j)
 select game_id, player_id, team_id, event_date, case when player_id is null then 'MISSING_FIELD' end as fault from c"""
)
def alias_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose fields have one of several names, each with its fault."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.when(k % 3 == 0, k).alias("GAME_ID"), F.when(k % 3 > 0, k).alias("gameId"), F.when(k % 19 == 0, "").otherwise(F.col("user_id").cast("string")).alias("PLAYER_ID"), F.col("event_type").alias("team_id"), F.to_date("ts").cast("string").alias("GAME_DATE"))
    names = {"game_id": ("GAME_ID", "gameId"), "player_id": ("PLAYER_ID", "player"), "team_id": ("TEAM", "team_id"), "event_date": ("GAME_DATE", "date")}
    return el.row_faults(el.coalesced(rows, names), ["game_id", "player_id"])


_WINDOWS = {"1996-97": ("1996-10-15", "1997-06-30"), "1999-00": ("1999-10-15", "2000-06-30")}
_SPECIAL = (("1999-00", "2000-03-01", "2000-03-31", "BUBBLE_RESTART_CANDIDATE_UNVERIFIED"),)


@query(
    """with s as (select o_orderkey, o_orderdate::date as d, case when o_orderkey % 2 = 0 then '1996-97' else '1999-00' end as season from orders)
 select o_orderkey, season, case when season = '1999-00' and d between date '2000-03-01' and date '2000-03-31' then 'BUBBLE_RESTART_CANDIDATE_UNVERIFIED' when season = '1996-97' and d between date '1996-10-15' and date '1997-06-30' then 'IN_WINDOW_NOT_SCHEDULE_VERIFIED'
  when season = '1999-00' and d between date '1999-10-15' and date '2000-06-30' then 'IN_WINDOW_NOT_SCHEDULE_VERIFIED' else 'OUTSIDE_WINDOW_REQUIRES_REVIEW' end as kind,
  d >= make_date(season[1:4]::int, 7, 1) and d < make_date(season[1:4]::int + 1, 7, 1) as within_season from s"""
)
def calendar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days against the windows of a season and its bounds from July to July."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderkey") % 2 == 0, "1996-97").otherwise("1999-00").alias("season"))
    first, last = dt.season_bounds("season")
    return rows.select("o_orderkey", "season", el.calendar_window("season", "d", _WINDOWS, _SPECIAL).alias("kind"), ((F.col("d") >= first) & (F.col("d") < last)).alias("within_season"))


@query(
    """with n as (select p_partkey, case p_partkey % 6 when 0 then 'Target ' || p_brand when 1 then p_name || ' (Actual)' when 2 then 'mean-' || p_size when 3 then 'Game ID' when 4 then ' - ' else 'label' || p_size end as name from part),
 p as (select *, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as plain from n)
 select p_partkey, name, case when plain = '' then 'EMPTY' when plain in ('player_id', 'team_id', 'game_id', 'event_date', 'game_date', 'date', 'y', 'target', 'actual', 'realized', 'label', 'outcome') or regexp_matches(plain, '^(target|actual|realized|label|outcome)_|_(target|actual|realized|label|outcome)$') then 'FORBIDDEN' else 'ALLOWED' end as verdict from p"""
)
def predictor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of predictors that tell an identity or an outcome."""
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    name = F.when(k == 0, F.concat(F.lit("Target "), "p_brand")).when(k == 1, F.concat("p_name", F.lit(" (Actual)"))).when(k == 2, F.concat(F.lit("mean-"), size)).when(k == 3, "Game ID").when(k == 4, " - ").otherwise(F.concat(F.lit("label"), size))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("verdict", el.predictor_verdict("name"))


@query(
    """with reg as (select 'player' as kind, p_partkey as id, 'P' || p_partkey as c from part where p_size > 5 union all select 'player', p_partkey, 'Q' || p_partkey from part where p_size = 20 union all select 'team', s_suppkey, 'T' || s_suppkey from supplier where s_acctbal > 0),
 ids as (select kind, id, count(distinct c) as n from reg group by 1, 2), f as (select l_partkey as p, l_suppkey as t, l_orderkey % 25 as o from lineitem),
 s as (select unnest(['player_id', 'team_id', 'opponent_team_id']) as field, unnest([a.n, b.n, c.n]) as n from f left join ids a on a.kind = 'player' and a.id = f.p left join ids b on b.kind = 'team' and b.id = f.t left join ids c on c.kind = 'team' and c.id = f.o)
 select field, case when n is null then 'UNRESOLVED' else 'AMBIGUOUS' end as status, count(*) as n from s where n is null or n > 1 group by 1, 2"""
)
def canonical_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps box score rows from getting canonical ids of player, team and opponent."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    entry = lambda rows, kind, key, letter: rows.select(F.lit(kind).alias("entity_type"), F.lit("feed").alias("source_name"), F.col(key).cast("string").alias("source_id"), F.concat(F.lit(letter), key).alias("canonical_id"))
    registry = entry(part.where("p_size > 5"), "player", "p_partkey", "P").unionByName(entry(part.where("p_size = 20"), "player", "p_partkey", "Q")).unionByName(entry(supplier.where("s_acctbal > 0"), "team", "s_suppkey", "T"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("player_id"), F.col("l_suppkey").alias("team_id"), (F.col("l_orderkey") % 25).alias("opponent_team_id"))
    fields = {"player_id": "player", "team_id": "team", "opponent_team_id": "team"}
    return idn.build_faults(idn.by_source_id(rows, registry, fields, "feed"), fields)


@query("select o_orderkey, 'P' || lpad((row_number() over (order by o_orderkey))::varchar, 8, '0') as canonical_id from orders")
def minted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in the order of keys."""
    return idn.minted(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "P")


@query(
    """with m as (select page_id::varchar as artifact_id, case when page_id % 7 = 0 then 'UNVALIDATED' else 'PASS' end as validation_status, case when page_id % 5 = 0 then '' when page_id % 3 = 0 then upper(sha256(url)) else sha256(html) end as sha256 from pages),
 a as (select page_id::varchar as artifact_id, case when page_id % 11 <> 1 then sha256(html) end as actual from pages)
 select m.artifact_id, case when validation_status <> 'PASS' then 'PARENT_NOT_PASS' when sha256 = '' then 'PARENT_WITHOUT_SHA256' when actual is null then 'PARENT_MISSING' when lower(sha256) <> actual then 'PARENT_HASH_MISMATCH' else 'USABLE' end as status from m left join a using (artifact_id)"""
)
def parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of a derived artifact against their manifests and the bytes that are there."""
    k, pages = F.col("page_id"), table(spark, sf_dir, "pages")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    parents = pages.select(k.cast("string").alias("artifact_id"), F.when(k % 7 == 0, "UNVALIDATED").otherwise("PASS").alias("validation_status"), F.when(k % 5 == 0, "").when(k % 3 == 0, F.upper(sha("url"))).otherwise(sha("html")).alias("sha256"))
    artifacts = pages.select(k.cast("string").alias("artifact_id"), F.when(k % 11 != 1, sha("html")).alias("actual_sha256"))
    return pv.parent_status(parents, artifacts).select("artifact_id", "status")


@query(
    """with r as (select user_id, event_id as seq, case event_id % 6 when 0 then 'PASS' when 1 then 'QUARANTINED' when 2 then 'UNVALIDATED' when 3 then 'WRONG' else 'FAIL' end as status, case when event_id % 4 = 1 then 'bad bytes' when event_id % 4 = 3 then ' ' end as reason from events),
 v as (select *, status in ('UNVALIDATED', 'PASS', 'FAIL', 'QUARANTINED') and (status <> 'QUARANTINED' or coalesce(trim(reason), '') <> '') as ok from r), f as (select user_id, min(seq) as first from v where ok and status <> 'UNVALIDATED' group by 1)
 select user_id as artifact_id, seq, case when status = 'WRONG' then 'INVALID_STATUS' when status = 'QUARANTINED' and coalesce(trim(reason), '') = '' then 'QUARANTINE_REASON_REQUIRED' when coalesce(seq > first, false) then 'ALREADY_TERMINAL' else 'APPLIED' end as outcome from v left join f using (user_id)"""
)
def validation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to settle an artifact's state; the first valid one does it for good."""
    k = F.col("event_id")
    status = F.when(k % 6 == 0, "PASS").when(k % 6 == 1, "QUARANTINED").when(k % 6 == 2, "UNVALIDATED").when(k % 6 == 3, "WRONG").otherwise("FAIL")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("artifact_id"), k.alias("seq"), status.alias("status"), F.when(k % 4 == 1, "bad bytes").when(k % 4 == 3, " ").alias("reason"))
    return pv.transitions(rows).select("artifact_id", "seq", "outcome")


_STINTS = "s as (select l_suppkey % 20 as team, l_partkey % 12 as player, (l_orderkey % 48) * 60 as a, (l_orderkey % 48) * 60 + l_quantity::bigint * 12 as b from lineitem)"


def _stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_orderkey") % 48) * 60
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("team"), (F.col("l_partkey") % 12).alias("player"), start.alias("a"), (start + F.col("l_quantity").cast("long") * 12).alias("b"))


@query(
    f"""with {_STINTS}, p as (select distinct team, a as m from s union select distinct team, b from s), i as (select team, m, lead(m) over (partition by team order by m) as m2 from p),
 n as (select i.team, i.m, i.m2, (select count(distinct player) from s where s.team = i.team and s.a <= (i.m + i.m2) / 2.0 and s.b > (i.m + i.m2) / 2.0) as active from i where m2 is not null)
 select team, count(*) as intervals, count(*) filter (where active <> 5) as off_count, max(active) as most_active from n group by 1"""
)
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals between the ends of a team's stints in which other than five players are active at the middle."""
    out = st.coverage(_stints(spark, sf_dir), "team", "player", "a", "b")
    return out.groupBy("team").agg(F.count("*").alias("intervals"), F.count_if(F.col("active") != 5).alias("off_count"), F.max("active").alias("most_active"))


@query(
    f"""with {_STINTS}, m as (select team, player, sum(b - a) / 60.0 as minutes from s group by 1, 2), box as (select distinct l_suppkey % 25 as team, l_partkey % 12 as player, 30.0 as official from lineitem),
 c as (select box.*, coalesce(minutes, 0.0) as stint_minutes from box left join m using (team, player))
 select team, count(*) as players, round(avg(abs(stint_minutes - official)), 6) as mae, round(max(abs(stint_minutes - official)), 6) as max_error, count(*) filter (where abs(stint_minutes - official) > 0.25) as beyond_quarter from c group by 1"""
)
def stint_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official minutes against the sum of a player's stints, none counting as 0."""
    box = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 25).alias("team"), (F.col("l_partkey") % 12).alias("player"), F.lit(30.0).alias("official")).distinct()
    both = st.against_box(box, _stints(spark, sf_dir), ["team", "player"], "a", "b", 60.0)
    error = F.abs(F.col("stint_minutes") - F.col("official"))
    return rounded(both.groupBy("team").agg(F.count("*").alias("players"), F.avg(error).alias("mae"), F.max(error).alias("max_error"), F.count_if(error > 0.25).alias("beyond_quarter")), "mae", "max_error")


@query(
    """with e as (select user_id, count(*) as n from events where ts < timestamp '2024-01-10' group by 1), l as (select user_id, count(*) as n from events where ts < timestamp '2024-01-20' group by 1)
 select count(*) as matched, count(*) filter (where l.n > e.n) as increased, count(*) filter (where l.n < e.n) as decreased, count(*) filter (where l.n <> e.n) as changed from e join l using (user_id)"""
)
def cutoff_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts at two cutoffs: none may fall."""
    until = lambda day: table(spark, sf_dir, "events").where(F.col("ts") < F.lit(day).cast("timestamp")).groupBy("user_id").agg(F.count("*").alias("n"))
    return pk.cutoff_comparison(until("2024-01-10"), until("2024-01-20"), "user_id", "n")


@query(
    """with a as (select l_orderkey, l_partkey from lineitem where l_returnflag = 'A'), b as (select l_orderkey, l_partkey from lineitem where l_linestatus = 'F')
 select 'left' as side, count(*) as n from a where (l_orderkey) in (select l_orderkey from b) union all select 'right', count(*) from b where (l_orderkey) in (select l_orderkey from a)"""
)
def common_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two methods cut to the orders that both have."""
    rows = table(spark, sf_dir, "lineitem")
    left, right = pk.common_rows(rows.where("l_returnflag = 'A'").select("l_orderkey", "l_partkey"), rows.where("l_linestatus = 'F'").select("l_orderkey", "l_partkey"), ["l_orderkey"])
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(left, "left").unionByName(count(right, "right"))


@query("with g as (select l_orderkey, l_suppkey, count(*) as n from lineitem group by 1, 2) select count(*) filter (where n > 1) as repeated_keys, sum(n - 1)::bigint as surplus from g")
def duplicate_surplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pk.surplus(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("select * from (values ('same_day_outcome_mutation', 0::bigint), ('future_outcome_mutation', 0), ('other_entity_mutation', 0), ('row_order', 0), ('same_day_rows_share_features', 0), ('cold_start_has_no_history', 0)) t(\"case\", failures)")
def leakage_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature builder rerun on games whose outcomes were changed where it must not see them."""
    return invariance.suite(entity_games(spark, sf_dir), "2024-01-15")
