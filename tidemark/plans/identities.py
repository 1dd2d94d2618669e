"""Queries on a registry of identities and on names and dates as texts have them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates as dt
from tidemark.functions import text as tx
from tidemark.operators import registry as rg
from tidemark.plans.registry import query
from tidemark.sources.bindings import table
from tidemark.sources.files import canonical_json


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as players, nations as teams."""
    of = lambda name, key, label, kind, letter: table(spark, sf_dir, name).select(F.format_string(letter + "%08d", F.col(key).cast("long")).alias("canonical_id"), F.lit(kind).alias("entity_type"), F.col(label).alias("display_name"))
    return of("customer", "c_custkey", "c_name", "player", "P").unionByName(of("nation", "n_nationkey", "n_name", "team", "T"))


_ENTITIES = "ent as (select printf('P%08d', c_custkey) as canonical_id, 'player' as entity_type, c_name as display_name from customer union all select printf('T%08d', n_nationkey), 'team', n_name from nation)"


def held_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a feed's ids of the first half of customers mean, one in eleven of them another."""
    c = F.col("c_custkey").cast("long")
    other = F.when(c % 11 == 0, c + 1).otherwise(c)
    return table(spark, sf_dir, "customer").where("c_nationkey < 13").select(F.lit("player").alias("entity_type"), F.lit("feed").alias("source_name"), c.cast("string").alias("source_id"), F.format_string("P%08d", other).alias("canonical_id"))


_HELD = "held as (select 'player' as entity_type, 'feed' as source_name, c_custkey::varchar as source_id, printf('P%08d', case when c_custkey % 11 = 0 then c_custkey + 1 else c_custkey end) as canonical_id from customer where c_nationkey < 13)"


def asked_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests to map their customer, some to another entity, of another kind or without a source."""
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    kind = F.when(k % 41 == 0, "coach").when(k % 43 == 0, "team").otherwise("player")
    means = F.when(k % 31 == 0, c + 1).when(k % 37 == 0, c + 90_000_000).otherwise(c)
    return table(spark, sf_dir, "orders").select(kind.alias("entity_type"), F.when(k % 47 == 0, " ").otherwise(" feed ").alias("source_name"), c.cast("string").alias("source_id"), F.format_string("P%08d", means).alias("canonical_id"), k.alias("seq"))


_ASKED = """asked as (select case when o_orderkey % 41 = 0 then 'coach' when o_orderkey % 43 = 0 then 'team' else 'player' end as entity_type, case when o_orderkey % 47 = 0 then '' else 'feed' end as source_name, o_custkey::varchar as source_id,
  printf('P%08d', case when o_orderkey % 31 = 0 then o_custkey + 1 when o_orderkey % 37 = 0 then o_custkey + 90000000 else o_custkey end) as canonical_id, o_orderkey as seq from orders)"""


@query(
    f"""with {_ENTITIES}, {_HELD}, {_ASKED}, j as (select a.*, e.entity_type as kind, h.canonical_id as there from asked a left join ent e using (canonical_id) left join held h on h.entity_type = a.entity_type and h.source_name = a.source_name and h.source_id = a.source_id),
 w as (select *, case when entity_type = 'coach' then 'UNSUPPORTED_TYPE' when source_name = '' then 'SOURCE_REQUIRED' when kind is null then 'UNKNOWN_ID' when kind <> entity_type then 'WRONG_TYPE' end as wrong from j),
 first_ as (select entity_type, source_name, source_id, arg_min(canonical_id, seq) as f, min(seq) as s from w where wrong is null group by 1, 2, 3)
 select seq, case when wrong is not null then wrong when coalesce(there, f) <> canonical_id then 'CONFLICT' when there is not null or seq > s then 'KNOWN' else 'ADDED' end as outcome from w left join first_ using (entity_type, source_name, source_id)"""
)
def added_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to map a source's ids, judged against the registry and each other."""
    return rg.added_mappings(asked_mappings(spark, sf_dir), held_mappings(spark, sf_dir), entities(spark, sf_dir), "seq").select("seq", "outcome")


def asked_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    day = lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        k.alias("seq"),
        F.when(k % 17 == 0, "T00000001").when(k % 19 == 0, "P99999999").otherwise(F.format_string("P%08d", F.col("o_custkey").cast("long"))).alias("player_id"),
        F.when(k % 23 == 0, "T00000077").when(k % 29 == 0, "P00000001").otherwise(F.format_string("T%08d", k % 25)).alias("team_id"),
        F.when(k % 13 == 0, "2024-02-30").otherwise(day(0)).alias("valid_from"),
        F.when(k % 3 == 0, None).when(k % 7 == 0, day(0)).otherwise(day(30)).alias("valid_to"),
    )


_SPANS = """asked as (select o_orderkey as seq, case when o_orderkey % 17 = 0 then 'T00000001' when o_orderkey % 19 = 0 then 'P99999999' else printf('P%08d', o_custkey) end as player_id, case when o_orderkey % 23 = 0 then 'T00000077' when o_orderkey % 29 = 0 then 'P00000001' else printf('T%08d', o_orderkey % 25) end as team_id,
  case when o_orderkey % 13 <> 0 then o_orderdate::date end as a, case when o_orderkey % 3 = 0 then null when o_orderkey % 7 = 0 then o_orderdate::date else (o_orderdate::date + 30)::date end as b from orders),
 judged as (select seq, player_id, team_id, case when p.entity_type is null then 'UNKNOWN_PLAYER' when p.entity_type <> 'player' then 'NOT_A_PLAYER' when t.entity_type is null then 'UNKNOWN_TEAM' when t.entity_type <> 'team' then 'NOT_A_TEAM' when a is null then 'DATE_INVALID' when b <= a then 'EMPTY_SPAN' else 'ADDED' end as outcome
  from asked left join ent p on p.canonical_id = player_id left join ent t on t.canonical_id = team_id)"""


@query(f"with {_ENTITIES}, {_SPANS} select seq, outcome from judged")
def added_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of players with teams, judged before they are added."""
    return rg.added_memberships(asked_memberships(spark, sf_dir), entities(spark, sf_dir)).select("seq", "outcome")


@query(
    f"""with {_ENTITIES}, {_ASKED}, {_SPANS.replace('asked as', 'spans as').replace('from asked', 'from spans')}, f as (select case when e.entity_type is null then 'MAPPING_WITHOUT_ENTITY' when e.entity_type <> a.entity_type then 'MAPPING_OF_WRONG_TYPE' end as fault from asked a left join ent e using (canonical_id)
  union all select case when e.entity_type is null then 'MEMBERSHIP_PLAYER_WITHOUT_ENTITY' when e.entity_type <> 'player' then 'MEMBERSHIP_PLAYER_OF_WRONG_TYPE' end from spans left join ent e on e.canonical_id = player_id
  union all select case when e.entity_type is null then 'MEMBERSHIP_TEAM_WITHOUT_ENTITY' when e.entity_type <> 'team' then 'MEMBERSHIP_TEAM_OF_WRONG_TYPE' end from spans left join ent e on e.canonical_id = team_id
  union all select 'ALIAS_WITHOUT_ENTITY' from supplier left join ent on canonical_id = printf('T%08d', s_suppkey) where canonical_id is null
  union all select 'SOURCE_MAPS_TO_SEVERAL' from (select 1 from asked group by entity_type, source_name, source_id having count(distinct canonical_id) > 1))
 select fault, count(*) as n from f where fault is not null group by 1"""
)
def registry_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a registry whose tables were filled unchecked refers to in vain."""
    aliases = table(spark, sf_dir, "supplier").select(F.format_string("T%08d", F.col("s_suppkey").cast("long")).alias("canonical_id"), F.col("s_name").alias("alias"))
    asked = asked_mappings(spark, sf_dir).withColumn("source_name", F.trim("source_name"))
    return rg.integrity(entities(spark, sf_dir), asked, aliases, asked_memberships(spark, sf_dir))


@query(
    "with p as (select c_name as display_name, c_nationkey as round, c_custkey from customer) select c_custkey, printf('P%08d', row_number() over (order by round, display_name, c_custkey) + (select count(*) from supplier)) as canonical_id from p"
)
def created_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New players by the round they came in, numbered after those that are there; many share a round."""
    there = table(spark, sf_dir, "supplier").select(F.format_string("P%08d", F.row_number().over(rg.W.orderBy("s_suppkey"))).alias("canonical_id"), F.lit("player").alias("entity_type"))
    new = table(spark, sf_dir, "customer").select(F.lit("player").alias("entity_type"), F.col("c_nationkey").alias("round"), F.col("c_name").alias("display_name"), "c_custkey")
    return rg.created(new, there, "round").select("c_custkey", "canonical_id")


@query(
    """with t as (select o_orderkey, case o_orderkey % 5 when 0 then 'Signed ' || strftime(o_orderdate + interval 30 year, '%Y-%m-%d') || ' and ' || strftime(o_orderdate + interval 30 year, '%B %-d %Y') when 1 then 'on ' || upper(strftime(o_orderdate + interval 30 year, '%B %-d, %Y')) || '.' when 2 then 'id 12024-01-01 or 2024-02-30 or February 30, 2024'
  when 3 then 'from ' || lower(strftime(o_orderdate + interval 30 year, '%B %d,  %Y')) || ' to 2031-12-31, 2031-12-31' else 'Mayday 3, 2024' end as s from orders),
 d as (select o_orderkey, unnest(list_concat(regexp_extract_all(s, '\\b(20\\d{2}-\\d{2}-\\d{2})\\b', 1), list_transform(regexp_extract_all(s, '(?i)\\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+\\d{1,2},?\\s+20\\d{2})\\b', 1),
  lambda x: strftime(try_strptime(regexp_replace(regexp_replace(upper(x[1:1]) || lower(x[2:]), ',', ''), '\\s+', ' ', 'g'), '%B %d %Y'), '%Y-%m-%d')))) as x from t)
 select t.o_orderkey, coalesce(string_agg(distinct try_cast(x as date)::varchar, ',' order by try_cast(x as date)::varchar), '') as days from t left join d on d.o_orderkey = t.o_orderkey and try_cast(x as date) is not null group by 1"""
)
def mentioned_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that sentences mention in any of the accepted forms."""
    k, d = F.col("o_orderkey"), F.add_months("o_orderdate", 360)
    said = (
        F.when(k % 5 == 0, F.concat(F.lit("Signed "), F.date_format(d, "yyyy-MM-dd"), F.lit(" and "), F.date_format(d, "MMMM d yyyy")))
        .when(k % 5 == 1, F.concat(F.lit("on "), F.upper(F.date_format(d, "MMMM d, yyyy")), F.lit(".")))
        .when(k % 5 == 2, "id 12024-01-01 or 2024-02-30 or February 30, 2024")
        .when(k % 5 == 3, F.concat(F.lit("from "), F.lower(F.date_format(d, "MMMM dd,  yyyy")), F.lit(" to 2031-12-31, 2031-12-31")))
        .otherwise("Mayday 3, 2024")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(dt.mentioned_days(said), lambda x: x.cast("string")), ",").alias("days"))


@query("with v as (select c_custkey, '  ' || upper(c_name) || '   O''Néal\t' || c_mktsegment || ' ' as s from customer) select c_custkey, trim(regexp_replace(lower(s), '\\s+', ' ', 'g')) as alias, trim(regexp_replace(lower(strip_accents(s)), '\\s+', ' ', 'g')) as folded from v")
def alias_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name as an alias, and folded without marks."""
    s = F.concat(F.lit("  "), F.upper("c_name"), F.lit("   O'Néal\t"), F.col("c_mktsegment"), F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.collapsed(s).alias("alias"), tx.folded(s).alias("folded"))


@query(
    """select p_partkey, sha256('{"brand":"' || p_brand || '","empty":null,"name":"' || p_name || '","sizes":{"a":' || p_size || ',"z":[1,' || p_size || ']}}') as digest from part"""
)
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of records as canonical JSON, whatever the order of their fields."""
    sizes = F.struct(F.array(F.lit(1), F.col("p_size")).alias("z"), F.col("p_size").alias("a"))
    record = F.struct(sizes.alias("sizes"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("empty"), F.col("p_brand").alias("brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", record.alias("r"))
    return rows.select("p_partkey", F.sha2(canonical_json(rows, "r"), 256).alias("digest"))
