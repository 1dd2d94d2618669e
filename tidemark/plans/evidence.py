"""Queries on contracts, time, reconciliation and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import contracts as ct
from tidemark.operators import reconcile as rc
from tidemark.operators import temporal as tm
from tidemark.plans.registry import query, rounded
from tidemark.sources.bindings import ENTITY_GAMES, entity_games, table

RULES = (
    ct.Rule("game_id"),
    ct.Rule("entity_id"),
    ct.Rule("event_date"),
    ct.Rule("team_id", allowed=("click", "view", "purchase", "error", "signup")),
    ct.Rule("minutes", least=0, most=55),
    ct.Rule("points", least=1, most=300),
    ct.Rule("extras", nullable=True, most=95),
)


@query(
    f"""with g as ({ENTITY_GAMES}) select game_id, 'team_id' as "column", 'VALUE_NOT_ALLOWED' as code from g where team_id not in ('click','view','purchase','error','signup')
 union all select game_id, 'minutes', 'VALUE_ABOVE_MAXIMUM' from g where minutes > 55 union all select game_id, 'points', 'VALUE_BELOW_MINIMUM' from g where points < 1
 union all select game_id, 'points', 'VALUE_ABOVE_MAXIMUM' from g where points > 300 union all select game_id, 'extras', 'VALUE_ABOVE_MAXIMUM' from g where extras > 95"""
)
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.violations(entity_games(spark, sf_dir), RULES, ["game_id"])


@query("select l_orderkey, l_suppkey, l_linenumber, l_partkey, copy from (select *, row_number() over (partition by l_orderkey, l_suppkey order by l_linenumber, l_partkey, l_extendedprice) as copy from lineitem) where copy > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ct.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey", "l_extendedprice"])
    return found.select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", F.col("copy").cast("long").alias("copy"))


@query("select * from (select 'value' as \"column\", round(avg(case when value is null then 1.0 else 0.0 end), 6) as null_rate, count(distinct value) as n_distinct from events union all select 'event_type', round(avg(case when event_type is null then 1.0 else 0.0 end), 6), count(distinct event_type) from events union all select 'user_id', round(avg(case when user_id is null then 1.0 else 0.0 end), 6), count(distinct user_id) from events)")
def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ct.null_rates(table(spark, sf_dir, "events"), ["value", "event_type", "user_id"]), "null_rate")


@query("select l_orderkey, count(distinct cast(l_shipdate as date)) as n_values, array_to_string(list_sort(list(distinct cast(cast(l_shipdate as date) as varchar))), '|') as \"values\" from lineitem group by 1 having count(distinct cast(l_shipdate as date)) > 1")
def date_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.conflicts(table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("day")), "l_orderkey", "day")


@query(f"with g as ({ENTITY_GAMES}) select count(*) filter (where minutes < 1 and points > 0) as low_minutes, count(*) filter (where extras is null) as no_extras, count(*) as n from g")
def cross_column_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_games(spark, sf_dir).agg(F.count_if((F.col("minutes") < 1) & (F.col("points") > 0)).alias("low_minutes"), F.count_if(F.col("extras").isNull()).alias("no_extras"), F.count("*").alias("n"))


@query(f"with g as ({ENTITY_GAMES}) select game_id, (rank() over (partition by entity_id order by event_date) > 5) as eligible from g")
def prior_history_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_games(spark, sf_dir).select("game_id", (F.rank().over(W.partitionBy("entity_id").orderBy("event_date")) > 5).alias("eligible"))


@query("select (select count(*) from (select l_orderkey from lineitem except all select o_orderkey from orders)) as only_left, (select count(*) from (select o_orderkey from orders except all select l_orderkey from lineitem)) as only_right")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.same_rows(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))


@query(f"with g as ({ENTITY_GAMES}) select min(event_date) filter (where event_date >= date '2024-01-21') > max(event_date) filter (where event_date < date '2024-01-21') as ordered, count(*) filter (where event_date < date '2024-01-21') as n_train, count(*) filter (where event_date >= date '2024-01-21') as n_test from g")
def fold_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, day = F.lit("2024-01-21").cast("date"), F.col("event_date")
    return entity_games(spark, sf_dir).agg((F.min(F.when(day >= cut, day)) > F.max(F.when(day < cut, day))).alias("ordered"), F.count_if(day < cut).alias("n_train"), F.count_if(day >= cut).alias("n_test"))


@query(f"with g as ({ENTITY_GAMES}), p as (select entity_id, count(*) as games, max(event_date) as last_date from g where event_date < date '2024-01-03' group by 1) select e.entity_id, coalesce(games, 0) as games, last_date, case when games is null then 'ZERO_HISTORY' else 'OK' end as status from (select distinct entity_id from g) e left join p using (entity_id)")
def snapshot_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = entity_games(spark, sf_dir)
    return tm.snapshot(games, games.select("entity_id").distinct(), "2024-01-03")


@query(f"with g as ({ENTITY_GAMES}), b as (select entity_id, count(*) as n from g where event_date < date '2024-01-05' group by 1), t as (select entity_id, count(*) as n from g where event_date <= date '2024-01-05' group by 1) select entity_id, coalesce(b.n, 0) as n_before, coalesce(t.n, 0) as n_through, coalesce(t.n, 0) - coalesce(b.n, 0) as delta from b full outer join t using (entity_id)")
def gp_delta_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    games, day = entity_games(spark, sf_dir), F.lit("2024-01-05").cast("date")
    count = lambda df: df.groupBy("entity_id").agg(F.count("*").alias("n"))
    return rc.counts_by_side(count(games.where(F.col("event_date") < day)), count(games.where(F.col("event_date") <= day)), "entity_id", "n")


@query(
    """with v as (select o_custkey as k, o_orderdate as t, o_orderkey, o_totalprice from orders), q as (select o_custkey as k, o_orderkey as q_key, o_orderdate as q_time from orders where o_orderstatus = 'F')
 select k, q_key, q_time, o_orderkey, o_totalprice from (select q.*, v.o_orderkey, v.o_totalprice, row_number() over (partition by q_key order by v.t desc, v.o_orderkey desc) as rn
   from q left join v on v.k = q.k and v.t <= q.q_time - interval 30 day) where rn = 1"""
)
def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's latest order placed 30 days or more before each finished order."""
    orders = table(spark, sf_dir, "orders")
    left = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("q_key"), F.col("o_orderdate").alias("q_time"), F.expr("o_orderdate - interval 30 days").alias("cut"))
    right = orders.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderdate", "o_totalprice")
    return tm.as_of(left, right, "k", "cut", "o_orderdate", ["o_orderkey", "o_totalprice"], "o_orderkey").drop("cut")


_MEMBER = """daily as (select o_custkey, o_orderdate, min(o_orderpriority) as p from orders group by 1, 2),
 changed as (select *, lag(p) over (partition by o_custkey order by o_orderdate) as before from daily),
 m as (select o_custkey, p as member, o_orderdate as valid_from, lead(o_orderdate) over (partition by o_custkey order by o_orderdate) as valid_to from changed where before is null or before <> p)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.memberships(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderdate").withColumnRenamed("o_orderpriority", "member")


@query(f"with {_MEMBER} select o_custkey, member, valid_from, valid_to from m where valid_from <= timestamp '1997-06-01' and (valid_to is null or valid_to > timestamp '1997-06-01')")
def membership_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("1997-06-01").cast("timestamp")
    return _members(spark, sf_dir).where(tm.half_open(day, F.col("valid_from"), F.col("valid_to")))


@query(f"with {_MEMBER} select o.o_orderkey, max(case when m.member = o.o_orderpriority then 1 else 0 end) as supports, max(case when m.member <> o.o_orderpriority then 1 else 0 end) as conflicts from orders o join m on m.o_custkey = o.o_custkey and o.o_orderdate between valid_from and valid_to group by 1")
def dated_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    held = tm.dated_support(orders, _members(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderpriority")
    return held.groupBy("o_orderkey").agg(F.max("supports").alias("supports"), F.max("conflicts").alias("conflicts"))


@query(
    """with s as (select l_suppkey, l_shipdate as a, l_shipdate + interval 5 day as b from lineitem), e as (select l_suppkey, a as moment, 1 as step from s union all select l_suppkey, b, -1 from s),
 d as (select l_suppkey, moment, sum(step) as step from e group by 1, 2) select l_suppkey, moment, cast(sum(step) over (partition by l_suppkey order by moment) as bigint) as active from d"""
)
def interval_sweep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("a"), F.expr("l_shipdate + interval 5 days").alias("b"))
    return tm.active_counts(rows, "l_suppkey", "a", "b")


@query("with w as (select *, lag(value) over (partition by user_id order by ts, event_id) as before from events) select user_id, event_id, value, before from w where value < before")
def monotonic_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.reversals(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "value", "before")


@query("with w as (select *, max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id rows between 2 preceding and 2 following) as near from events) select user_id, event_id, event_type from w where near = 1")
def context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.around(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error", 2).select("user_id", "event_id", "event_type")


@query("select user_id, cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2, 3 having count(*) > 1")
def same_day_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return rows.where("n > 1")


@query(
    """with e as (select user_id, event_id, case when event_type = 'purchase' then event_id end as d, case when event_type = 'click' then event_id end as m from events),
 g as (select *, sum(case when d is not null then 1 else 0 end) over (partition by user_id order by event_id) as gm from e)
 select user_id, event_id, last_value(d ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as latest_purchase,
   last_value(m ignore nulls) over (partition by user_id, gm order by event_id rows between unbounded preceding and current row) as click_since from g"""
)
def doc_stateful_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carried state with resets: a purchase forgets the click before it."""
    kind = lambda k: F.when(F.col("event_type") == k, F.col("event_id"))
    out = tm.carried(table(spark, sf_dir, "events"), "user_id", "event_id", {"latest_purchase": kind("purchase"), "click_since": kind("click")}, {"click_since": ["latest_purchase"]})
    return out.select("user_id", "event_id", "latest_purchase", "click_since")


@query("select doc_id, digest, case when doc_id = f then 'SUCCESS' else 'DUPLICATE' end as outcome, case when doc_id <> f then f end as duplicate_of from (select doc_id, digest, min(doc_id) over (partition by digest) as f from (select doc_id, sha256(coalesce(text, '')) as digest from documents))")
def ledger_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    return tm.ledger(rows, "digest", "doc_id")


@query(
    """with o as (select o_custkey as team, cast(o_orderdate as date) as day, epoch(o_orderdate)::bigint as t, o_orderkey from orders), p as (select team, day, t + (o_orderkey % 11) * 60 as t, o_orderkey from o),
 q as (select team, case when o_orderkey % 13 = 0 then cast(day + 1 as date) else day end as day, t from p),
 a as (select team, day, count(*) as n_official, min(t) as official_time from o group by 1, 2), b as (select team, day, count(*) as n_provider, min(t) as provider_time from q group by 1, 2)
 select team, day, n_official, official_time, n_provider, provider_time, case when n_provider is null then 'OFFICIAL_ONLY' when n_official is null then 'PROVIDER_ONLY' when n_official > 1 or n_provider > 1 then 'AMBIGUOUS'
   when abs(official_time - provider_time) <= 300 then 'MATCHED' else 'TIME_CONFLICT' end as status from a full outer join b using (team, day)"""
)
def provider_match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a shifted copy of all of them that misdates some."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("team"), F.to_date("o_orderdate").alias("day"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"), "o_orderkey")
    p = o.withColumn("t", F.expr("t + (o_orderkey % 11) * 60")).withColumn("day", F.expr("case when o_orderkey % 13 = 0 then date_add(day, 1) else day end"))
    return rc.match_status(o, p, ["team", "day"], "t")


_ALIAS = "select p_brand || ' ' || p_type as name, p_partkey as id from part union all select p_name, p_partkey from part"


@query(f"with a as ({_ALIAS}), c as (select name, list_sort(list(distinct id)) as ids from a group by 1), q as (select distinct p_name as name from part union select 'nothing like it') select q.name, case when ids is null then 'UNRESOLVED' when len(ids) = 1 then 'RESOLVED' else 'AMBIGUOUS' end as status, case when len(ids) = 1 then ids[1] end as canonical_id, coalesce(len(ids), 0)::bigint as n from q left join c using (name)")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    aliases = part.select(F.concat_ws(" ", "p_brand", "p_type").alias("alias"), F.col("p_partkey").alias("canonical_id")).unionByName(part.select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("canonical_id")))
    names = part.select(F.col("p_name").alias("name")).union(spark.range(1).select(F.lit("nothing like it"))).distinct()
    out = rc.resolved(names, aliases)
    return out.select("name", "status", "canonical_id", F.coalesce(F.size("candidates"), F.lit(0)).cast("long").alias("n"))


@query("select c_nationkey, count(distinct c_mktsegment) as n_values, array_to_string(list_sort(list(distinct c_mktsegment)), '|') as \"values\" from customer group by 1 having count(distinct c_mktsegment) > 1")
def crosswalk_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.conflicts(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query("select l_orderkey, l_suppkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rn from lineitem) where rn <= 3")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest lines of each supplier."""
    w = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice")


@query("select page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') as host, regexp_extract(regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', ''), '([^.]+\\.[^.]+)$', 1) as family from pages")
def url_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.host("url").alias("host"), tx.family("url").alias("family"))


@query("select page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::bigint as n_links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))), ' ') as links from pages")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.links("html")
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("links"))


_STRIP = "regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_a}', '{_b}')"


@query(f"select page_id, md5(trim(regexp_replace({_STRIP}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as digest from pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.visible("html").cast("binary")).alias("digest"))


@query("select conv_id, turn, pos - 1 as pos, s as sentence from (select conv_id, turn, unnest(l) as s, generate_subscripts(l, 1) as pos from (select conv_id, turn, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as l from conversations)) where length(s) <= 20")
def sentence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tx.sentences("text")).alias("pos", "sentence"))
    return rows.where(F.length("sentence") <= 20).withColumn("pos", F.col("pos").cast("long"))


@query("select doc_id from documents where regexp_matches(text, '(^|[^\\p{L}\\p{N}_])the and($|[^\\p{L}\\p{N}_])')")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(tx.has_phrase("text", "the and")).select("doc_id")


@query(f"select p_partkey, trim(regexp_replace(lower(p_brand || ', ' || p_name), '[^a-z0-9]+', ' ', 'g')) as plain, trim(split_part(p_brand || ', ' || p_name, ',', 2)) || ' ' || trim(split_part(p_brand || ', ' || p_name, ',', 1)) as reordered, substring(sha256(p_brand || '|' || p_name), 1, 20) as record_id from part")
def norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(", ", "p_brand", "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", tx.plain_name(name).alias("plain"), tx.first_last(name).alias("reordered"), tx.record_id("p_brand", "p_name").alias("record_id"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events where json_extract_string(props, '$.k')::bigint >= 90")
def json_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,bigint>"))
    return rows.select("event_id", F.explode("m").alias("name", "k")).where("name = 'k' and k >= 90").select("event_id", "k")


@query("select o_custkey, case when s = 1 then 'ONE_SOURCE' when s = 2 then 'TWO_SOURCES' else 'INDEPENDENT' end as support, s as n_families, n from (select o_custkey, count(distinct o_orderpriority) as s, count(*) as n from orders group by 1)")
def source_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n_families"), F.count("*").alias("n"))
    support = F.when(F.col("n_families") == 1, "ONE_SOURCE").when(F.col("n_families") == 2, "TWO_SOURCES").otherwise("INDEPENDENT")
    return rows.select("o_custkey", support.alias("support"), "n_families", "n")


@query("select o_orderkey, case when o_totalprice is null then 'NO_PRICE' when o_totalprice < 2000 then 'TOO_LOW' when o_orderdate >= timestamp '1999-01-01' then 'OUT_OF_SEASON' when o_orderstatus = 'P' then 'PENDING' end as reason from orders")
def ordered_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, day = F.col("o_totalprice"), F.col("o_orderdate")
    reason = rc.first_reason((price.isNull(), "NO_PRICE"), (price < 2000, "TOO_LOW"), (day >= F.lit("1999-01-01").cast("timestamp"), "OUT_OF_SEASON"), (F.col("o_orderstatus") == "P", "PENDING"))
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))
