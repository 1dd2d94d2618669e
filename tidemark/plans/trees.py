"""Queries on JSON trees: structured data of pages, the game a page is about, and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources import trees
from tidemark.sources.bindings import table

#: pages with structured data: a game, one inside an article, one of two types inside the first, and broken texts
_PAGE = """'<html><link rel="canonical" href="' || case when page_id % 17 = 0 then 'https://other.org' else regexp_replace(url, '[?#].*', '') || '/00' || lpad(page_id::{string}, 8, '0') end || '"><script type="application/ld+json">'
 || case when page_id % 19 = 0 then '{{broken' else '{{"@graph":[{{"@type":"{event}","name":"Game ' || page_id || '","startDate":"2024-01-15T' || lpad((page_id % 24)::{string}, 2, '0') || ':30:00' || case when page_id % 7 = 0 then '' else 'Z' end
 || '","homeTeam":{{"alternateName":" bos"}},"awayTeam":{{"alternateName":"' || case when page_id % 5 = 0 then 'toolong' else 'ny' || substr('kxy', (page_id % 3 + 1)::int, 1) end || '"}},"subEvent":[{{"@type":["Event","SportsEvent"],"name":"Half","startDate":' || (page_id % 100) || '}}]}},null,7]}}' end
 || '</script><p>text</p><script type="application/ld+json">[{{"@type":"NewsArticle","about":{{"@type":"' || case when page_id % 4 = 0 then 'SportsEvent' else 'Place' end || '","name":"About","startDate":"2024-01-16T01:00:00Z","homeTeam":{{"alternateName":"MIA"}},"awayTeam":{{"alternateName":"ORL"}}}}}}]</script></html>'"""
_EVENT = "Sports' || case when page_id % 11 = 0 then 'Show' else 'Event' end || '"
_URL = "regexp_replace(url, '[?#].*', '') || case when page_id % 13 = 0 then '' else '/00' || lpad(page_id::{string}, 8, '0') end"
_SQL_PAGE, _SQL_URL = _PAGE.format(string="varchar", event=_EVENT), _URL.format(string="varchar")


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages whose html is structured data made of their ids and addresses."""
    html, url = (x.replace("::string", "").replace("(page_id % 3 + 1)::int", "page_id % 3 + 1") for x in (_PAGE.format(string="string", event=_EVENT), _URL.format(string="string")))
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.expr(url).alias("url"), F.expr(html).alias("html"), F.lit("2024-01-15").alias("day"))


_EVENTS = f"""p as (select page_id, {_SQL_URL} as url, {_SQL_PAGE} as html from pages where url is not null),
 s as (select page_id, unnest(regexp_extract_all(html, '(?s)<script type="application/ld\\+json">(.*?)</script>', 1)) as j, generate_subscripts(regexp_extract_all(html, '(?s)<script type="application/ld\\+json">(.*?)</script>', 1), 1) - 1 as script from p),
 t as materialized (select s.page_id, s.script, t.* from s, json_tree(case when json_valid(j) then j::json end) t),
 types as (select page_id, script, parent as id, list(value->>'$') as names from (select page_id, script, parent, value from t where key = '@type' and type = 'VARCHAR' union all select a.page_id, a.script, a.parent, b.value from t a join t b on b.page_id = a.page_id and b.script = a.script and b.parent = a.id where a.key = '@type' and a.type = 'ARRAY') group by 1, 2, 3),
 plain as (select page_id, script, parent as id, value->>'$' as name, type from t where key = '@type' and type = 'VARCHAR'),
 ev as (select t.* from t join types using (page_id, script, id) where t.type = 'OBJECT' and list_contains(names, 'SportsEvent')),
 up as (select e.page_id, e.script, e.id, e.parent as above, 0 as k from ev e union all select u.page_id, u.script, u.id, t.parent, k + 1 from up u join t on t.page_id = u.page_id and t.script = u.script and t.id = u.above),
 ins as (select u.page_id, u.script, u.id, arg_min(name, k) as inside from up u join plain p on p.page_id = u.page_id and p.script = u.script and p.id = u.above group by 1, 2, 3),
 events_ as (select ev.page_id, ev.script, replace(replace(replace(replace(fullkey, '$.', ''), '$[', ''), ']', ''), '"', '') as fk, inside, value->>'$.name' as name, upper(trim(value->>'$.homeTeam.alternateName')) as home, upper(trim(value->>'$.awayTeam.alternateName')) as away, case when json_type(value, '$.startDate') = 'VARCHAR' then value->>'$.startDate' end as start
   from ev left join ins using (page_id, script, id))"""


@query(f"with recursive {_EVENTS} select page_id, script, replace(replace(fk, '[', '/'), '.', '/') as path, inside, name, home, away, start from events_")
def structured_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games at any depth of a page's structured data, each with its own fields and what it stands in."""
    out = trees.structured_events(event_pages(spark, sf_dir).select("page_id", "html"))
    return out.withColumn("script", F.col("script").cast("long"))


@query(
    f"""with recursive {_EVENTS}, sound as (select *, try_cast(start as timestamptz) as tip from events_ where regexp_matches(start, '(Z|[+-]\\d{{2}}:\\d{{2}})$') and regexp_matches(home, '^[A-Z]{{2,3}}$') and regexp_matches(away, '^[A-Z]{{2,3}}$') and home <> away),
 ok as (select *, row(home, away, tip) as game from sound where (tip at time zone 'America/New_York')::date = date '2024-01-15'),
 g as (select page_id, count(distinct game) as d, min(home) as home, min(away) as away, min(tip) as tip from ok group by 1), n as (select page_id, count(*) as n from events_ group by 1),
 o as (select p.page_id, nullif(regexp_extract(url, '(00\\d{{8}})/?$', 1), '') as game_id, home, away, tip, case when n.n is null then 'OFFICIAL_STRUCTURED_GAME_MISSING' when nullif(regexp_extract(url, '(00\\d{{8}})/?$', 1), '') is null then 'OFFICIAL_GAME_ID_MISSING_IN_URL' when coalesce(d, 0) <> 1 then 'STRUCTURED_GAME_MISSING_OR_AMBIGUOUS'
   when regexp_extract(html, 'rel="canonical" href="([^"]*)"', 1) <> url then 'CANONICAL_URL_MISMATCH' else 'OK' end as outcome from p left join n using (page_id) left join g using (page_id))
 select page_id, outcome, case when outcome = 'OK' then game_id end as game_id, case when outcome = 'OK' then home end as home, case when outcome = 'OK' then away end as away, case when outcome = 'OK' then strftime(tip at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') end as tipoff from o"""
)
def official_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one game of a day that each page is about, or why there is none."""
    out = trees.official_games(event_pages(spark, sf_dir), "page_id", "day")
    return out.withColumn("tipoff", F.date_format("tipoff", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


#: a schedule for each order: a date for each of its first statuses, with games that may be wrong
_GAME = """'{{"gameId":' || case when o_orderkey % 23 = 0 then '12' else '"' || lpad((o_orderkey * 10 + {n} - case when o_orderkey % 29 = 0 and {n} = 2 then 1 else 0 end)::{string}, 10, '0') || '"' end
 || ',"gameDateTimeUTC":' || case when o_orderkey % 31 = 0 then 'null' when o_orderkey % 37 = 0 then '"2024-13-01T00:00:00Z"' when o_orderkey % 41 = 0 then '"2024-01-01T00:00:00+02:00"' when o_orderkey % 43 = 0 then '"2024-01-01T00:00:00"' else '"2024-01-0{n}T0' || (o_orderkey % 10) || ':00:00Z"' end
 || ',"homeTeam":' || case when o_orderkey % 47 = 0 then '[]' else '{{"teamTricode":"BOS"}}' end || ',"awayTeam":{{"teamTricode":"' || case when o_orderkey % 53 = 0 then 'BOS' when o_orderkey % 59 = 0 then 'ny' else 'NYK' end || '"}},"gameStatus":{n}}}'"""
_SCHEDULE = (
    "case when o_orderkey % 7 = 0 and o_custkey % 2 = 0 then '{{' when o_orderkey % 11 = 0 then '{{\"leagueSchedule\":[]}}' when o_orderkey % 13 = 0 then '{{\"leagueSchedule\":{{\"gameDates\":[]}}}}' when o_orderkey % 17 = 0 then '{{\"leagueSchedule\":{{\"gameDates\":[{{\"games\":[]}}]}}}}' else "
    "'{{\"leagueSchedule\":{{\"gameDates\":[{{\"games\":[' || " + _GAME.replace("{n}", "1") + " || ']}},' || case when o_orderkey % 19 = 0 then '{{}}' else '{{\"games\":[' || " + _GAME.replace("{n}", "2") + " || case when o_orderkey % 61 = 0 then ',3' else '' end || ']}}' end || ']}}}}' end"
)


def schedule_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.expr(_SCHEDULE.format(string="string")).alias("payload"))


_FAULTS = f"""p as (select o_orderkey as k, o_custkey as c, {_SCHEDULE.format(string="varchar")} as payload from orders),
 v as (select k, payload, json_valid(payload) as good from p),
 d as (select k, unnest(generate_series(0, json_array_length(payload, '$.leagueSchedule.gameDates')::bigint - 1)) as d, payload from v where good and json_type(payload, '$.leagueSchedule.gameDates') = 'ARRAY'),
 dd as (select k, d, json_extract(payload, '$.leagueSchedule.gameDates[' || d || ']') as day from d),
 g as (select k, d, unnest(generate_series(0, json_array_length(day, '$.games')::bigint - 1)) as i, day from dd where json_type(day, '$.games') = 'ARRAY'),
 gg as (select k, d, i, json_extract(day, '$.games[' || i || ']') as game from g),
 r as (select k, d, i, json_type(game) as t, case when json_type(game, '$.gameId') = 'VARCHAR' then game->>'$.gameId' end as game_id, case when json_type(game, '$.gameDateTimeUTC') = 'VARCHAR' then game->>'$.gameDateTimeUTC' end as tip, json_type(game, '$.homeTeam') as ht, json_type(game, '$.awayTeam') as at_, game->>'$.homeTeam.teamTricode' as home, game->>'$.awayTeam.teamTricode' as away, coalesce(game->>'$.gameStatus', '') as status from gg),
 f as (select *, case when t is distinct from 'OBJECT' then 'INVALID_GAME' when not coalesce(regexp_matches(game_id, '^\\d{{10}}$'), false) then 'INVALID_GAME_ID' when row_number() over (partition by k, game_id order by d, i) > 1 then 'DUPLICATE_GAME_ID' when tip is null then 'MISSING_TIPOFF_UTC' when try_cast(tip as timestamptz) is null then 'INVALID_TIPOFF_UTC'
   when not regexp_matches(tip, '(Z|[+-]00:00)$') then 'NON_UTC_TIPOFF' when ht is distinct from 'OBJECT' or at_ is distinct from 'OBJECT' then 'MISSING_TEAMS' when not regexp_matches(home, '^[A-Z]{{3}}$') or not regexp_matches(away, '^[A-Z]{{3}}$') or home = away then 'INVALID_TEAM_TRICODE' end as fault from r),
 w as (select k, arg_min(fault, d * 1000 + i) as fault from (select k, d, i, fault from f where fault is not null union all select k, d, -1, 'INVALID_DATE_GAMES' from dd where json_type(day, '$.games') is distinct from 'ARRAY') group by 1),
 o as (select v.k as doc, case when not good then 'INVALID_JSON' when json_type(payload, '$.leagueSchedule') is distinct from 'OBJECT' then 'MISSING_LEAGUE_SCHEDULE' when json_type(payload, '$.leagueSchedule.gameDates') is distinct from 'ARRAY' or json_array_length(payload, '$.leagueSchedule.gameDates') = 0 then 'MISSING_GAME_DATES'
   when w.fault is not null then w.fault when not exists (select 1 from f where f.k = v.k) then 'EMPTY_GAMES' else 'OK' end as outcome from v left join w on w.k = v.k)"""


@query(f"with {_FAULTS} select doc, outcome from o")
def schedule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a schedule from being read, the first fault of each."""
    return trees.schedules(schedule_docs(spark, sf_dir), "doc", "payload")[0]


@query(f"with {_FAULTS} select o.doc, game_id, strftime(tip::timestamptz at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as tipoff, home, away, status from o join f on f.k = o.doc where outcome = 'OK'")
def schedule_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of schedules without a fault."""
    out = trees.schedules(schedule_docs(spark, sf_dir), "doc", "payload")[1]
    return out.withColumn("tipoff", F.date_format("tipoff", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
