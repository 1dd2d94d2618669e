"""Queries on status reports, evidence packets and what sources publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_url
from tidemark.operators import identity as idn
from tidemark.operators import packets as pk
from tidemark.operators import report_lines as rl
from tidemark.plans.registry import query
from tidemark.sources import feeds
from tidemark.sources.bindings import REPORT_LINES, report_lines, table
from tidemark.sources.shared import written

_NAME = rl.NAME.replace("'", "''")
_TEAM_LIST = "[" + ", ".join(f"'{t}'" for t in rl.REPORT_NAMES) + "]"
_CODE_LIST = "[" + ", ".join(f"'{c}'" for c in idn.TEAMS) + "]"


def _parse_sql(scope: str) -> str:
    """The line parser in SQL, with context over scope."""
    over = f"over (partition by {scope} order by page, line)"
    place = lambda c: f"last_value(case when {c} is not null then page end ignore nulls) {over} as p_{c}, last_value(case when {c} is not null then line end ignore nulls) {over} as l_{c}, last_value({c} ignore nulls) {over} as v_{c}"
    reasons = " or ".join(f"starts_with(reason, '{r}')" for r in rl.REASONS)
    return f"""lines as ({REPORT_LINES}), told as (select doc, page, line, text, regexp_replace(nullif(regexp_extract(text, '\\b(\\d{{2}}/\\d{{2}}/\\d{{4}})\\b', 1), ''), '^(\\d{{2}})/(\\d{{2}})/(\\d{{4}})$', '\\3-\\1-\\2') as d,
   nullif(regexp_extract(text, '\\b[A-Z]{{2,3}}@[A-Z]{{2,3}}\\b'), '') as m, case when len([x for x in {_TEAM_LIST} if contains(text, x)]) = 1 then ([x for x in {_TEAM_LIST} if contains(text, x)])[1] end as t,
   upper(nullif(regexp_extract(text, '(?i)\\b({rl.STATUS})\\b', 1), '')) as status from lines),
 ctx as (select *, {place('d')}, {place('m')}, {place('t')} from told),
 cut as (select *, trim(regexp_extract(text, '(?i)^(.*?)\\b(?:{rl.STATUS})\\b(.*)$', 1)) as before, nullif(trim(regexp_extract(text, '(?i)^(.*?)\\b(?:{rl.STATUS})\\b(.*)$', 2), ' -'), '') as reason from ctx where status is not null),
 area as (select *, case when t is not null then trim(string_split(before, t)[-1]) else before end as a from cut),
 named as (select *, nullif(concat_ws(' ', nullif(regexp_extract(a, '(?:^|\\W)({_NAME}),\\s*({_NAME})$', 2), ''), nullif(regexp_extract(a, '(?:^|\\W)({_NAME}),\\s*({_NAME})$', 1), '')), '') as player from area),
 rec as (select substring(sha256(concat_ws('|', doc, page, line, text)), 1, 20) as record_id, doc, page, line, v_d as game_date, v_m as matchup, v_t as team, player, status, reason,
   concat_ws('|', case when player is null then 'PLAYER_UNRESOLVED' end, case when v_d is null then 'DATE_UNRESOLVED' end, case when v_m is null then 'MATCHUP_UNRESOLVED' end, case when v_t is null then 'TEAM_UNRESOLVED' end, case when reason is null then 'REASON_UNRESOLVED' end,
     case when reason is not null and not ({reasons}) then 'REASON_FORMAT_UNVERIFIED' end) as flags, 'EXPLICIT:p' || p_d || ':y' || l_d as game_date_provenance, 'EXPLICIT:p' || p_m || ':y' || l_m as matchup_provenance, 'EXPLICIT:p' || p_t || ':y' || l_t as team_provenance from named)"""


_COLUMNS = "record_id, doc, page, line, game_date, matchup, team, player, status, reason, flags"


@query(f"with {_parse_sql('doc, page')} select {_COLUMNS}, case when flags <> '' then 'REVIEW_REQUIRED' else 'AUTO_CANDIDATE' end as parse_status from rec")
def report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of status lines, with context of their own page."""
    return rl.parsed(report_lines(spark, sf_dir)).select(*_COLUMNS.split(", "), "parse_status")


@query(
    f"""with {_parse_sql('doc, page')}, old as (select * from rec), {_parse_sql('doc').replace('lines as', 'lines2 as').replace('from lines)', 'from lines2)').replace('told as', 'told2 as').replace('from told)', 'from told2)').replace('ctx as', 'ctx2 as').replace('from ctx where', 'from ctx2 where').replace('cut as', 'cut2 as').replace('from cut)', 'from cut2)').replace(' area as', ' area2 as').replace('from area)', 'from area2)').replace('named as', 'named2 as').replace('from named)', 'from named2)').replace('rec as', 'rec2 as')},
 one as (select doc, page, player, status, count(*) as n, any_value(game_date) as d, any_value(matchup) as m, any_value(team) as t from old group by 1, 2, 3, 4 having count(*) = 1)
 select record_id, concat_ws('|', case when r.game_date is distinct from d then 'game_date' end, case when r.matchup is distinct from m then 'matchup' end, case when r.team is distinct from t then 'team' end) as changed_fields,
  concat_ws('|', case when d is null and r.game_date is not null then 'game_date' end, case when m is null and r.matchup is not null then 'matchup' end, case when t is null and r.team is not null then 'team' end) as recovered,
  concat_ws('|', case when d <> r.game_date then 'game_date' end, case when m <> r.matchup then 'matchup' end, case when t <> r.team then 'team' end) as conflicting
 from rec2 r join one using (doc, page, player, status)"""
)
def parser_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What records gain or change when context goes on over pages."""
    lines = report_lines(spark, sf_dir)
    return rl.changes(rl.parsed(lines), rl.parsed(lines, ("doc",))).select("record_id", "changed_fields", "recovered", "conflicting")


def _events(lines: DataFrame) -> DataFrame:
    said = F.explode(F.array(*(F.struct(F.lit(k).alias("type"), F.col(c).alias("value")) for k, c in (("DATE", "said_date"), ("MATCHUP", "said_matchup"), ("TEAM", "said_team"))))).alias("e")
    return rl.told(lines).select("doc", "page", F.col("line").cast("double").alias("y"), said).select("doc", "page", "y", "e.*").where("value is not null")


_EVENTS = "ev as (select doc, page, line::double as y, 'DATE' as type, d as value from told where d is not null union all select doc, page, line, 'MATCHUP', m from told where m is not null union all select doc, page, line, 'TEAM', t from told where t is not null)"
_AT = "page * 100000 + y"


@query(
    f"""with {_parse_sql('doc')}, {_EVENTS}, pos as (select r.*, page * 100000 + line + 0.01 as pos from rec r),
 sec as (select p.*, (select max({_AT}) from ev where ev.doc = p.doc and type = 'DATE' and {_AT} <= p.pos) as ad, (select max({_AT}) from ev where ev.doc = p.doc and type = 'MATCHUP' and {_AT} <= p.pos) as am, (select max({_AT}) from ev where ev.doc = p.doc and type = 'TEAM' and {_AT} <= p.pos) as atm from pos p),
 v as (select s.*, (select max(value) from ev where ev.doc = s.doc and type = 'DATE' and {_AT} = ad) as sd, case when coalesce(ad > am, false) then null else (select max(value) from ev where ev.doc = s.doc and type = 'MATCHUP' and {_AT} = am) end as sm,
   case when coalesce(ad > atm, false) or coalesce(am > atm, false) then null else (select max(value) from ev where ev.doc = s.doc and type = 'TEAM' and {_AT} = atm) end as st from sec s),
 c as (select *, split_part(matchup, '@', 1) as h, split_part(matchup, '@', 2) as g, {_CODE_LIST}[list_position({_TEAM_LIST}, team)] as code from v)
 select record_id, sd as section_game_date, sm as section_matchup, st as section_team, concat_ws('|', case when not coalesce(list_contains({_CODE_LIST}, h) and list_contains({_CODE_LIST}, g) and h <> g, false) then 'INVALID_MATCHUP' end, case when code is null then 'UNKNOWN_TEAM' end,
   case when code is not null and matchup is not null and code not in (h, g) then 'TEAM_NOT_IN_MATCHUP' end, case when game_date is distinct from sd then 'SECTION_GAME_DATE_MISMATCH' end, case when matchup is distinct from sm then 'SECTION_MATCHUP_MISMATCH' end,
   case when team is distinct from st then 'SECTION_TEAM_MISMATCH' end, case when game_date is null then 'INVALID_DATE' end) as issues,
  case when matchup is not null and team is not null and code not in (h, g) then 'TEAM_CONFLICT_CLEARED' when game_date <> sd then 'DATE_CONFLICT_CLEARED' when matchup is null then 'NO_GAME' else 'ATTRIBUTED' end as attribution from c"""
)
def section_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with context over pages against the section they stand in, and the game they keep."""
    lines = report_lines(spark, sf_dir)
    rows = rl.parsed(lines, ("doc",)).withColumn("y", F.col("line").cast("double"))
    found = rl.sections(rows, _events(lines)).withColumn("issues", F.array_join(rl.section_issues(), "|"))
    return rl.cleared(found).select("record_id", "section_game_date", "section_matchup", "section_team", "issues", "attribution")


@query(
    f"""with {_parse_sql('doc')}, {_EVENTS}, r as (select *, line::double as y, regexp_extract(replace(matchup_provenance, ':y7', ':z'), '^EXPLICIT:p(\\d+):y([0-9]+)$', 1) as pm, game_date_provenance as gp from rec),
 q as (select *, case when line % 4 = 0 then null else p1 end as pd, case when line % 4 = 0 then null else y1 end as yd from (select *, try_cast(regexp_extract(gp, 'p(\\d+):y(\\d+)', 1) as int) as p1, try_cast(regexp_extract(gp, 'p(\\d+):y(\\d+)', 2) as double) as y1,
   try_cast(regexp_extract(matchup_provenance, 'p(\\d+):y(\\d+)', 1) as int) as pmm, try_cast(regexp_extract(matchup_provenance, 'p(\\d+):y(\\d+)', 2) as double) + case when line % 5 = 0 then 1 else 0 end as ymm,
   try_cast(regexp_extract(team_provenance, 'p(\\d+):y(\\d+)', 1) as int) as pt, try_cast(regexp_extract(team_provenance, 'p(\\d+):y(\\d+)', 2) as double) as yt, case when line % 6 = 0 then 'Moon Cats' else team end as team2, count(*) over (partition by doc, page, player, status) as copies from r)),
 h as (select *, (select max({_AT}) from ev where ev.doc = q.doc and type = 'DATE' and ev.page * 100000 + ev.y <= q.page * 100000 + q.y) as alast from q),
 k as (select h.*, (select max(value) from ev where ev.doc = h.doc and type = 'DATE' and {_AT} = alast) as latest, split_part(matchup, '@', 1) as a, split_part(matchup, '@', 2) as b, {_CODE_LIST}[list_position({_TEAM_LIST}, team2)] as code,
   exists (select 1 from ev where ev.doc = h.doc and type = 'DATE' and ev.page = pd and abs(ev.y - yd) < 0.015 and value = game_date) as hd, exists (select 1 from ev where ev.doc = h.doc and type = 'MATCHUP' and ev.page = pmm and abs(ev.y - ymm) < 0.015 and value = matchup) as hm,
   exists (select 1 from ev where ev.doc = h.doc and type = 'TEAM' and ev.page = pt and abs(ev.y - yt) < 0.015 and value = team2) as ht from h),
 i as (select record_id, pd, pmm, pt, page, concat_ws('|', case when matchup is null or not regexp_matches(matchup, '^[A-Z]{{3}}@[A-Z]{{3}}$') then 'MATCHUP_MISSING_OR_INVALID' end, case when matchup is not null and coalesce(code not in (a, b), true) then 'TEAM_NOT_IN_MATCHUP' end, case when game_date is null then 'DATE_MISSING_OR_INVALID' end,
   case when latest is not null and latest is distinct from game_date then 'DATE_CONTRADICTS_EXPLICIT_EVENT' end, case when latest is null then 'NO_PRIOR_EXPLICIT_DATE_EVENT' end,
   case when pd is null then 'DATE_PROVENANCE_INVALID' end, case when pd * 100000 + yd > page * 100000 + y then 'DATE_PROVENANCE_IN_FUTURE' end, case when pd is not null and not hd then 'DATE_PROVENANCE_EVENT_MISMATCH' end,
   case when pmm is null then 'MATCHUP_PROVENANCE_INVALID' end, case when pmm * 100000 + ymm > page * 100000 + y then 'MATCHUP_PROVENANCE_IN_FUTURE' end, case when pmm is not null and not hm then 'MATCHUP_PROVENANCE_EVENT_MISMATCH' end,
   case when pt is null then 'TEAM_PROVENANCE_INVALID' end, case when pt * 100000 + yt > page * 100000 + y then 'TEAM_PROVENANCE_IN_FUTURE' end, case when pt is not null and not ht then 'TEAM_PROVENANCE_EVENT_MISMATCH' end,
   case when copies > 1 then 'DUPLICATE_PAGE_PLAYER_STATUS' end, case when flags = '' then 'UNSAFE_TRAINING_LABEL' end) as issues from k)
 select record_id, issues, case when issues <> '' then 'FLAGGED' when coalesce(pd < page, false) or coalesce(pmm < page, false) or coalesce(pt < page, false) then 'CROSS_PAGE_REVIEW' else 'SPOT_CHECK' end as risk from i"""
)
def record_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural issues and risk of records, some with provenance or teams that are wrong."""
    lines = report_lines(spark, sf_dir)
    rows = written(rl.parsed(lines, ("doc",)).withColumn("y", F.col("line").cast("double")), "records")
    n = F.col("line")
    moved = F.concat(F.regexp_extract("matchup_provenance", r"^(EXPLICIT:p\d+:y)", 1), F.regexp_extract("matchup_provenance", r":y(\d+)$", 1).try_cast("int") + 1)
    rows = rows.withColumns(
        {
            "game_date_provenance": F.when(n % 4 != 0, F.col("game_date_provenance")).otherwise("INFERRED"),
            "matchup_provenance": F.when(n % 5 == 0, moved).otherwise(F.col("matchup_provenance")),
            "team": F.when(n % 6 == 0, "Moon Cats").otherwise(F.col("team")),
        }
    )
    return rl.verified(rows, written(_events(lines), "events")).select("record_id", "issues", "risk")


@query(
    f"""with {_parse_sql('doc, page')}, s as (select record_id, page, coalesce(len(flags), 0) as severity from rec), f as (select *, row_number() over (partition by page order by severity desc, record_id) = 1 as first from s)
 select record_id, page, severity from f order by first desc, case when first then page end, severity desc, page, record_id limit 20"""
)
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty records for review: the most severe of each page first."""
    rows = rl.parsed(report_lines(spark, sf_dir)).select("record_id", "page", F.length("flags").cast("long").alias("severity"))
    return rl.spread_sample(rows, "page", "severity", "record_id", 20)


@query(
    """with p as (select page_id, case when page_id % 13 = 0 then 'RUMOUR' else 'OFFICIAL' end as kind, case when page_id % 11 = 0 then '' else url end as source_url, case when page_id % 7 = 0 then '2024-03-01 10:00' else '2024-03-01T' || lpad((page_id % 24)::varchar, 2, '0') || ':00:00Z' end as published,
   case when page_id % 5 = 0 then '2024-03-01T05:30:00+05:30' else '2024-03-02T00:00:00Z' end as captured, case when page_id % 3 = 0 then sha256(url) when page_id % 17 = 1 then 'none' else sha256(html) end as sha, case when page_id % 19 = 2 then '../x' when page_id % 19 = 3 then '' else 'objects/' || page_id end as file, case when page_id % 4 <> 1 then sha256(html) end as actual from pages),
 t as (select *, case when regexp_matches(published, '(Z|[+-][0-9]{2}:[0-9]{2})$') then try_cast(published as timestamptz) end as p, captured::timestamptz as c, timestamptz '2024-03-01 20:00:00+00' as tip from p)
 select page_id, case when kind <> 'OFFICIAL' then 'REJECT_INVALID_TYPE' when source_url = '' then 'REJECT_MISSING_IDENTITY' when p is null then 'REJECT_TIMESTAMP' when p >= tip then 'REJECT_NOT_PREGAME' when c < p then 'REJECT_CAPTURE_CHRONOLOGY' when sha = 'none' then 'REJECT_DIGEST' when file = '' then 'REJECT_MISSING_ARTIFACT'
   when file = '../x' then 'REJECT_PATH' when actual is null then 'REJECT_MISSING_ARTIFACT' when actual <> sha then 'REJECT_DIGEST_MISMATCH' else 'CANDIDATE_MANUAL_REVIEW' end as outcome from t"""
)
def packet_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence packets on pages, by the first fault."""
    k, sha = F.col("page_id"), lambda c: F.sha2(F.col(c).cast("binary"), 256)
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        k.cast("string").alias("game_id"),
        F.lit("site").alias("source_name"),
        F.when(k % 13 == 0, "RUMOUR").otherwise("OFFICIAL").alias("evidence_type"),
        F.when(k % 11 == 0, "").otherwise(F.col("url")).alias("source_url"),
        F.when(k % 7 == 0, "2024-03-01 10:00").otherwise(F.concat(F.lit("2024-03-01T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:00Z"))).alias("published_at"),
        F.lit("2024-03-01T20:00:00Z").alias("tipoff_at"),
        F.when(k % 5 == 0, "2024-03-01T05:30:00+05:30").otherwise("2024-03-02T00:00:00Z").alias("captured_at"),
        F.when(k % 3 == 0, sha("url")).when(k % 17 == 1, "none").otherwise(sha("html")).alias("sha256"),
        F.when(k % 19 == 2, "../x").when(k % 19 == 3, "").otherwise(F.concat(F.lit("objects/"), k)).alias("source_file"),
        F.when(k % 4 != 1, sha("html")).alias("artifact_sha256"),
    )
    return rows.select("page_id", pk.packet_outcome(["OFFICIAL"]).alias("outcome"))


_WHOLE = "(?s)^(.*?)(^|[^\\p{L}\\p{N}_])(of the)($|[^\\p{L}\\p{N}_])"


@query(
    f"""with t as (select doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as words, regexp_matches(text, '{_WHOLE}') as whole, length(regexp_extract(text, '{_WHOLE}', 1)) + length(regexp_extract(text, '{_WHOLE}', 2)) as pos from documents)
 select doc_id, (' ' || array_to_string(words, ' ') || ' ') like '% of the %' as has_run, whole, case when whole then substring(text, greatest(pos - 160, 0) + 1, pos + 6 + 200 - greatest(pos - 160, 0)) end as snippet from t"""
)
def phrase_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase as a run of tokens and as whole words, with the text around it, in every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pk.has_run(pk.tokens("text"), F.array(F.lit("of"), F.lit("the"))).alias("has_run"), pk.mentions("text", "of the").alias("whole"), pk.snippet("text", "of the").alias("snippet"))


_SAYS = "regexp_matches(text, '(?s)^(.*?)(^|[^\\p{{L}}\\p{{N}}_])({0})($|[^\\p{{L}}\\p{{N}}_])')"


@query(
    f"""with e as (select page_id, 'TITLE' as kind, 0 as loc, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as text from pages union all select page_id, 'HEADING', 1, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) from pages
   union all select page_id, 'PARAGRAPH', 1 + unnest(generate_series(1, len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)))), unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) from pages),
 s as (select *, {_SAYS.format('with')}::int as o, {_SAYS.format('for')}::int as d, {_SAYS.format('to')}::int as a, case kind when 'PARAGRAPH' then 4 else 3 end as worth from e where {_SAYS.format('the')}),
 r as (select *, worth + 2 * o + 2 * d + a as score, row_number() over (partition by page_id order by worth + 2 * o + 2 * d + a desc, loc) as n from s)
 select page_id, kind, loc::bigint as loc, score::bigint as score, case when o + d + a = 3 then 'LOCAL_CLAIM_CANDIDATE_REVIEW_ONLY' else 'PARTIAL_CONTENT_REVIEW_ONLY' end as claim from r where n = 1"""
)
def best_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excerpt of a page that tells most of a claim."""
    pages = table(spark, sf_dir, "pages")
    one = lambda tag: F.array(F.regexp_extract("html", f"(?s)<{tag}>(.*?)</{tag}>", 1))
    parts = [("TITLE", 0, one("title")), ("HEADING", 1, one("h1")), ("PARAGRAPH", 2, F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), 1))]
    excerpts = None
    for kind, first, texts in parts:
        rows = pages.select("page_id", F.lit(kind).alias("kind"), F.posexplode(texts).alias("at", "text")).select("page_id", "kind", (F.col("at") + first).cast("long").alias("loc"), "text")
        excerpts = rows if excerpts is None else excerpts.unionByName(rows)
    best = pk.best_excerpt(excerpts, "page_id", "the", "with", "for", "to")
    return best.select("page_id", "kind", "loc", F.col("score").cast("long").alias("score"), "claim")


_URL_WORDS = "list_distinct(regexp_extract_all(lower(regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1)), '[\\p{L}\\p{N}]+'))"


@query(
    f"""with n as (select doc_id as name_id, case when doc_id % 3 = 0 then '' else 'No. ' end || (doc_id * 7 % 1000) as name from labels), w as (select page_id as link_id, {_URL_WORDS} as u, list_distinct(regexp_extract_all(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1) || ' no ' || page_id), '[\\p{{L}}\\p{{N}}]+')) as a from pages),
 t as (select *, list_distinct(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+')) as words from n), h as (select t.name_id, w.link_id, case when list_has_all(u, words) then 'URL' else 'ANCHOR' end as match_basis from t join w on list_has_all(u, words) or list_has_all(a, words))
 select name_id, name, link_id, match_basis, case when link_id is null then 'NO_DIRECT_NAME_LINK' else 'LINK_REVIEW_ONLY' end as review_status from n left join h using (name_id)"""
)
def name_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose words all stand in the address or the anchor of a link."""
    names = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name_id"), F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise("No. "), F.col("doc_id") * 7 % 1000).alias("name"))
    links = table(spark, sf_dir, "pages").select(F.col("page_id").alias("link_id"), "url", F.concat(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit(" no "), "page_id").alias("anchor"))
    return pk.name_links(names, links).select("name_id", "name", "link_id", "match_basis", "review_status")


_CANON = "lower(regexp_extract(regexp_replace(regexp_replace({0}, '[?#].*$', ''), '/+$', ''), '^([^:]*://[^/]*)', 1)) || regexp_extract(regexp_replace(regexp_replace({0}, '[?#].*$', ''), '/+$', ''), '^[^:]*://[^/]*(.*)$', 1)"


@query(
    f"""with p as (select page_id as proposal, case page_id % 3 when 0 then replace(url, 'http://', 'HTTP://') else url || '/#x' end as url from pages where starts_with(url, 'http://'))
 select c.page_id, {_CANON.format('c.url')} as canonical, p.proposal from pages c left join p on {_CANON.format('c.url')} = {_CANON.format('p.url')}"""
)
def captured_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with the proposals of the same address, however it is written."""
    pages, k = table(spark, sf_dir, "pages"), F.col("page_id")
    proposals = pages.where(F.startswith("url", F.lit("http://"))).select(k.alias("proposal"), F.when(k % 3 == 0, F.replace("url", F.lit("http://"), F.lit("HTTP://"))).otherwise(F.concat("url", F.lit("/#x"))).alias("url"))
    return pk.captured_proposals(pages.select("page_id", "url"), proposals).select("page_id", canonical_url("url").alias("canonical"), "proposal")


@query("select o_custkey, count(*) as n_games, count(*) filter (where o_orderkey % 4 = 0) as n_missing_tipoff, case when o_custkey % 5 = 0 then 'INCOMPLETE_PAGINATION' else 'COMPLETE' end as status from orders group by 1, 4")
def provider_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of provider pages, and whether the last page was reached."""
    tipoff = F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    games = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("id"), tipoff.alias("date"))).alias("data"))
    cursor = F.struct(F.when(F.col("o_custkey") % 5 == 0, F.lit(25)).alias("next_cursor"))
    pages = games.select("o_custkey", F.lit(0).alias("page"), F.to_json(F.struct("data", cursor.alias("meta"))).alias("body"))
    found = feeds.envelope_games(pages, "o_custkey", "page", "body")
    return found.groupBy("o_custkey", "status").agg(F.count("*").alias("n_games"), F.count_if(F.col("tipoff") == "MISSING").alias("n_missing_tipoff"))


@query("select page_id, unnest([url, url || '/2']) as link, unnest([0, 1])::bigint as nth, 'RSS' as kind from pages union all select page_id, url, 0, 'OTHER' from pages where false")
def feed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item links of feeds, in order."""
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = lambda u: F.concat(F.lit("<item><title>t</title><link>"), u, F.lit("</link></item>"))
    xml = F.concat(F.lit("<rss version='2.0'><channel><link>http://x</link>"), item(escaped), item(F.concat(escaped, F.lit("/2"))), F.lit("</channel></rss>"))
    rows = table(spark, sf_dir, "pages").select("page_id", xml.alias("body"))
    return feeds.item_links(rows, "body").select("page_id", "link", "nth", "kind")


@query("select l_orderkey, l_suppkey, l_partkey, count(*) as listed, count(*) filter (where l_quantity >= 10) as played from lineitem group by 1, 2, 3")
def boxscore_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Athletes of a box score three levels down; being listed isn't having played."""
    line = F.struct(F.struct(F.col("l_partkey").cast("string").alias("id")).alias("athlete"), F.array(F.when(F.col("l_quantity") >= 10, F.col("l_quantity").cast("string")).otherwise("--")).alias("stats"))
    athletes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.collect_list(line).alias("athletes"))
    teams = athletes.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.struct(F.col("l_suppkey").cast("string").alias("id")).alias("team"), F.array(F.struct("athletes")).alias("statistics"))).alias("players"))
    body = teams.select("l_orderkey", F.to_json(F.struct(F.struct("players").alias("boxscore"))).alias("body"))
    rows = feeds.boxscore_athletes(body, "body").select("l_orderkey", F.col("team_id").cast("long").alias("l_suppkey"), F.col("athlete_id").cast("long").alias("l_partkey"), "played")
    return rows.groupBy("l_orderkey", "l_suppkey", "l_partkey").agg(F.count("*").alias("listed"), F.count_if("played").alias("played"))


@query("select p_partkey, case when p_partkey % 8 = 0 then 'INVALID_ID' when p_partkey % 9 = 0 then 'BLANK_NAME' else 'OK' end as status from part")
def player_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a registry whose ids must be positive whole numbers and whose names not blank."""
    k = F.col("p_partkey")
    entry = F.struct(F.when(k % 8 == 0, F.lit("-1")).otherwise((k + 1).cast("string")).alias("id"), F.when(k % 9 == 0, " ").otherwise(F.col("p_name")).alias("full_name"))
    return feeds.registry_entries(table(spark, sf_dir, "part").select("p_partkey", F.to_json(entry).alias("body")), "body").select("p_partkey", "status")


@query(
    """select c_custkey, 'NBA: ' || c_mktsegment as title, 1::bigint as row from customer where c_custkey % 3 > 0 union all select c_custkey, 'late ' || c_nationkey, 2 from customer where c_custkey % 3 > 0"""
)
def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a listing's table between the heading that opens its section and the next one."""
    row = lambda *c: F.concat(F.lit("<tr><td>"), F.concat(*c), F.lit("</td></tr>\n"))
    head = F.when(F.col("c_custkey") % 3 > 0, "<tr><th>Today</th></tr>\n").otherwise("<tr><th>Closed</th></tr>\n")
    html = F.concat(F.lit("<table>"), row(F.lit("before")), head, row(F.lit("NBA: "), "c_mktsegment"), row(F.lit("late "), "c_nationkey"), F.lit("<tr><th>Tomorrow</th></tr>\n"), row(F.lit("after")), F.lit("</table>"))
    return feeds.section_rows(table(spark, sf_dir, "customer").select("c_custkey", html.alias("html")), "html", "Today").select("c_custkey", F.col("text").alias("title"), "row")


@query("select doc_id, '1.' || (doc_id % 8) as version, case when doc_id % 3 = 0 then null else '2024' || lpad((1 + doc_id % 12)::varchar, 2, '0') || '05101500' end as created, case when doc_id % 4 = 0 then 'NOT_PDF' else 'OK' end as status from documents where doc_id % 4 > 0 union all select doc_id, null, null, 'NOT_PDF' from documents where doc_id % 4 = 0")
def pdf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version and creation time out of a PDF's bytes."""
    k = F.col("doc_id")
    created = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("/CreationDate (D:2024"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit("05101500-05'00')")))
    body = F.concat(F.when(k % 4 == 0, "<html>").otherwise("%PDF-1."), k % 8, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"), created).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("content")).select("doc_id", *feeds.pdf_facts("content"))


@query("select c_mktsegment, c_custkey, c_acctbal from customer order by c_acctbal desc, c_mktsegment, c_custkey limit 100")
def sorted_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred largest balances, ties in a fixed order."""
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_mktsegment", "c_custkey").limit(100)
