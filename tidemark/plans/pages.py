"""Queries on report pages: lines by three rules, tables from words, attribution over pages, reasons found again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import attribution as at
from tidemark.operators import page_tables as pt
from tidemark.operators.identity import TEAMS
from tidemark.operators.report_lines import NAME, REPORT_NAMES, STATUS
from tidemark.plans.registry import query
from tidemark.sources.bindings import REPORT_CELLS, REPORT_WORDS, report_cells, report_words

SLATE_DAY, SLATE = "2024-01-15", tuple(f"{a}@{b}" for a, b in zip(list(TEAMS)[:3], list(TEAMS)[1:3], strict=False))
_NAME = NAME.replace("'", "''")
_TEAM_LIST = "[" + ", ".join(f"'{t}'" for t in REPORT_NAMES) + "]"
_CODE_LIST = "[" + ", ".join(f"'{c}'" for c in TEAMS) + "]"
_STATUSES = ", ".join(f"'{s}'" for s in STATUS.split("|"))

#: words in order with the lines that earlier words opened, a word after the other
_NEAREST = f"""w as materialized (select *, (y0 + y1) / 2 as c, row_number() over (partition by doc, page order by round_even(y0 / 3.0::double, 0), x0, y0, text) as i from ({REPORT_WORDS})),
 put as (select doc, page, i, c as line_y, [c] as ys from w where i = 1
  union all select w.doc, w.page, w.i, case when p.near then p.best else w.c end, case when p.near then p.ys else list_append(p.ys, w.c) end from (
   select put.doc, put.page, put.i, put.ys, n.c, len(list_filter(put.ys, lambda y: abs(y - n.c) <= 3)) > 0 as near, list_filter(put.ys, lambda y: abs(y - n.c) = list_min(list_transform(put.ys, lambda z: abs(z - n.c))))[1] as best
   from put join w n on n.doc = put.doc and n.page = put.page and n.i = put.i + 1) p join w on w.doc = p.doc and w.page = p.page and w.i = p.i + 1),
 lined as materialized (select w.*, put.line_y from w join put using (doc, page, i))"""


@query(f"with recursive {_NEAREST} select doc, page, line_y, count(*) as n, string_agg(text, ' ' order by x0, text) as text from lined group by 1, 2, 3")
def nearest_line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of report pages, each word at the nearest line that an earlier one opened."""
    lined = pt._lined(report_words(spark, sf_dir))
    return lined.groupBy("doc", "page", "line_y").agg(F.count("*").alias("n"), pt._joined("x0").alias("text"))


_HEADS = ", ".join(f"max(x0) filter (where lower(trim(text, ':')) = '{h}') as {h}" for h in pt.HEADS)
_COLUMNS = f"""{_NEAREST},
 texts as materialized (select *, row_number() over (partition by doc, page order by line_y) as nth from (select doc, page, line_y, max(width) as width, string_agg(text, ' ' order by x0, text) as text, {_HEADS} from lined group by 1, 2, 3)),
 own as (select doc, page, min(line_y) as line_y from texts where nth <= 25 and contains(lower(text), 'player') and contains(lower(text), 'status') and contains(lower(text), 'reason') and player < status and status < reason group by 1, 2),
 heads as (select t.doc, t.page, t.width, list_sort(list_filter([struct_pack(x := t.player, name := 'player'), struct_pack(x := t.status, name := 'status'), struct_pack(x := t.reason, name := 'reason'), struct_pack(x := t.team, name := 'team'), struct_pack(x := t.matchup, name := 'matchup')], lambda h: h.x is not null)) as h
   from own join texts t using (doc, page, line_y)),
 pages as (select doc, page, max(width) as width from texts group by 1, 2),
 modes as materialized (select p.doc, p.page, case when o.h is not null then 'DETECTED_HEADER' when l.h is not null and abs(p.width - l.width) <= 2 then 'REUSED_COLUMNS' else 'SKIPPED_NO_SAFE_COLUMNS' end as mode, coalesce(o.h, case when abs(p.width - l.width) <= 2 then l.h end) as h
   from pages p left join heads o using (doc, page) left join (select p.doc, p.page, arg_max(h.width, h.page) as width, arg_max(h.h, h.page) as h from pages p join heads h on h.doc = p.doc and h.page < p.page group by 1, 2) l on l.doc = p.doc and l.page = p.page)"""


@query(f"with recursive {_COLUMNS} select doc, page, mode, coalesce(array_to_string(list_transform(h, lambda x: x.name), ','), '') as columns from modes")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What columns each report page has, and whether they are its own."""
    out = pt.page_columns(pt._lined(report_words(spark, sf_dir)))
    return out.select("doc", "page", "mode", F.coalesce(F.array_join("columns.name", ","), F.lit("")).alias("columns"))


_RECORDS = f"""{_COLUMNS},
 celled as (select l.*, mode, (list_filter(range(1, len(h) + 1), lambda k: k = 1 or (h[k - 1].x + h[k].x) / 2 <= (x0 + x1) / 2)[-1]) as k, h from lined l join modes using (doc, page) where h is not null),
 rows_ as (select doc, page, line_y, any_value(mode) as mode, string_agg(text, ' ' order by x0, text) as text, {", ".join(f"coalesce(string_agg(text, ' ' order by x0, text) filter (where h[k].name = '{c}'), '') as c_{c}" for c in pt.NEEDED)} from celled group by 1, 2, 3),
 told as (select *, contains(lower(text), 'player') and contains(lower(text), 'status') and contains(lower(text), 'reason') as head,
   regexp_replace(nullif(regexp_extract(text, '\\b(\\d{{2}}/\\d{{2}}/\\d{{4}})\\b', 1), ''), '^(\\d{{2}})/(\\d{{2}})/(\\d{{4}})$', '\\3-\\1-\\2') as d, nullif(regexp_extract(text, '\\b[A-Z]{{2,3}}@[A-Z]{{2,3}}\\b'), '') as m, list_filter({_TEAM_LIST}, lambda t: contains(text, t)) as ts,
   nullif(concat_ws(' ', nullif(regexp_extract(c_player, '(?:^|\\W)({_NAME}),\\s*({_NAME})', 2), ''), nullif(regexp_extract(c_player, '(?:^|\\W)({_NAME}),\\s*({_NAME})', 1), '')), '') as nm, upper(nullif(regexp_extract(c_status, '(?i)\\b({STATUS})\\b', 1), '')) as sm,
   regexp_matches(text, '(?:^|\\W)({_NAME}),\\s*({_NAME})') as anyone, row_number() over (partition by doc, page order by line_y) as n from rows_),
 walk as (select doc, page, n, null::bigint as r, null::double as last_y, null::varchar as gd, null::varchar as gm, null::varchar as gt, null::varchar as part, false as own from (select doc, page, 0::bigint as n from told where n = 1)
  union all select t.doc, t.page, t.n,
   case when head then null when nm is not null and sm is not null then t.n when c_reason <> '' and nm is null and sm is null then case when r is not null and d is null and m is null and len(ts) = 0 and not anyone and line_y > last_y and line_y - last_y <= 18 then r end when sm is not null or nm is not null or d is not null or m is not null or len(ts) > 0 then null else r end,
   case when not head and ((nm is not null and sm is not null) or (c_reason <> '' and nm is null and sm is null)) then line_y else last_y end,
   case when head then gd else coalesce(d, gd) end, case when head then gm else coalesce(m, gm) end, case when head then gt when len(ts) = 1 then ts[1] when m is not null and len(ts) = 0 then null else gt end,
   case when not head and c_reason <> '' then c_reason end, not head and nm is not null and sm is not null
   from walk p join told t on t.doc = p.doc and t.page = p.page and t.n = p.n + 1),
 recs as (select w.doc, w.page, w.r, max(t.line_y) filter (where w.own) as line_y, max(t.mode) as mode, max(gd) filter (where w.own) as gd, max(gm) filter (where w.own) as gm, max(gt) filter (where w.own) as gt, max(t.nm) filter (where w.own) as nm, max(t.sm) filter (where w.own) as sm, nullif(string_agg(part, ' ' order by w.n), '') as reason
   from walk w join told t using (doc, page, n) where r is not null group by 1, 2, 3),
 dates as (select doc, min(gd) as sole from recs group by 1 having count(distinct gd) = 1),
 inf as (select recs.*, sole, gd is null and gm is not null and sole is not null as inferred from recs left join dates using (doc)),
 records as materialized (select substring(sha256(concat_ws('|', doc, page, printf('%.2f', line_y), nm)), 1, 20) as record_id, doc, page, round(line_y, 2) as y, case when inferred then sole else gd end as game_date, gm as matchup, gt as team, case when inferred then 'DOCUMENT_UNIQUE_DATE_INFERRED' when gd is not null then 'EXPLICIT_ROW_CONTEXT' else 'UNRESOLVED' end as date_provenance,
   nm as player, sm as status, reason, mode, concat_ws('|', case when gd is null and not inferred then 'GAME_DATE_UNRESOLVED' end, case when gm is null then 'MATCHUP_UNRESOLVED' end, case when gt is null then 'TEAM_UNRESOLVED' end, case when reason is null then 'REASON_UNRESOLVED' end,
    case when mode = 'REUSED_COLUMNS' then 'INHERITED_COLUMN_LAYOUT_UNVERIFIED' end, case when inferred then 'DATE_INFERRED_REVIEW_REQUIRED' end) as flags from inf)"""
_FIELDS = "record_id, doc, page, y, game_date, matchup, team, date_provenance, player, status, reason, mode, flags"


@query(f"with recursive {_RECORDS} select {_FIELDS}, case when flags <> '' then 'REVIEW_REQUIRED' else 'AUTO_CANDIDATE' end as parse_status from records")
def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of report pages from the boxes of their words."""
    return pt.table_records(report_words(spark, sf_dir))


_OPENS = " or ".join(f"starts_with(said, '{o}')" for o in pt.OPENINGS)


@query(
    f"""with recursive {_RECORDS}, near as (select record_id, doc, page, y, reason, greatest(y - 12, (lag(y) over v + y) / 2) as a, least(y + 12, (y + lead(y) over v) / 2) as b from records window v as (partition by doc, page order by y, record_id)),
 met as (select n.record_id, n.doc, n.page, n.y, w.c, w.x0, w.y0, w.y1, w.text, row_number() over (partition by n.record_id, n.doc, n.page, n.y order by w.c, w.x0, w.text) as k from near n join w on w.doc = n.doc and w.page = n.page and w.x0 >= 665 * w.width / 841.95::double and w.c >= n.a and w.c < n.b where trim(coalesce(n.reason, '')) = ''),
 opened as (select record_id, doc, page, y, k, c as o from met where k = 1 union all select m.record_id, m.doc, m.page, m.y, m.k, case when m.c - o.o <= 3 then o.o else m.c end from opened o join met m on m.record_id = o.record_id and m.doc = o.doc and m.page = o.page and m.y = o.y and m.k = o.k + 1),
 texts_ as (select record_id, doc, page, y, trim(string_agg(text, ' ' order by o, x0, c, text)) as said, min(o) as first_y, min(y0) as low, max(y1) as high from met join opened using (record_id, doc, page, y, k) group by 1, 2, 3, 4),
 judged as (select n.*, said, low, high, first_y between n.y - 10 and n.y + 4 as close, {_OPENS} as opens, trim(coalesce(reason, '')) <> '' as given from near n left join texts_ using (record_id, doc, page, y)),
 done as (select *, case when given then 'UNCHANGED' when coalesce(close and opens, false) then 'PROPOSED_REVIEW_REQUIRED' else 'UNRESOLVED' end as decision from judged)
 select record_id, doc, page, y, decision, case when decision like 'PROPOSED%' then said end as proposed_reason, case when decision like 'PROPOSED%' then round(low, 2) end as y_min, case when decision like 'PROPOSED%' then round(high, 2) end as y_max,
  case when given then '' when said is null then 'No unambiguous words in reason lane' when not close then 'No reason prefix near player anchor' when not opens then 'Reason prefix not recognized' else 'Geometry proposal; compare to original PDF before approval' end as notes from done"""
)
def recovered_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons proposed for records that have none, from the words around them."""
    words = report_words(spark, sf_dir)
    return pt.recovered_reasons(pt.table_records(words), words)


_LANE = " ".join(f"when x < {b} then '{n}'" for (n, _), (_, b) in zip(at.LANES, at.LANES[1:], strict=False))
_ATTRIBUTED = f"""c as materialized (select *, row_number() over (partition by doc, page order by y, x, text) as k, case {_LANE} else 'reason' end as lane from ({REPORT_CELLS})),
 opened as (select doc, page, k, y as o from c where k = 1 union all select c.doc, c.page, c.k, case when c.y - o.o <= 2 then o.o else c.y end from opened o join c on c.doc = o.doc and c.page = o.page and c.k = o.k + 1),
 lines_ as (select doc, page, avg(y) as y, {", ".join(f"coalesce(trim(string_agg(text, ' ' order by x, y, text) filter (where lane = '{n}')), '') as {n}_" for n, _ in at.LANES)} from c join opened using (doc, page, k) group by doc, page, o having avg(y) >= 85 and avg(y) < 525),
 told as materialized (select *, case when status_ in ({_STATUSES}) and player_ <> '' then 'PLAYER' when regexp_matches(reason_, '(?i)\\bNOT\\s+YET\\s+SUBMITTED\\b') then 'SUBMISSION' end as kind, case when regexp_matches(upper(matchup_), '^[A-Z]{{2,3}}@[A-Z]{{2,3}}$') then upper(matchup_) end as g, {_CODE_LIST}[list_position({_TEAM_LIST}, team_)] as t,
   regexp_matches(date_, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') as dated, try_strptime(date_, '%m/%d/%Y')::date::varchar as parsed, row_number() over (partition by doc order by page, y) as n from lines_),
 walk as (select doc, 0::bigint as n, null::varchar as gd, null::varchar as game, null::varchar as team, null::varchar as team_name, null::bigint as cp, false as bad, false as clash, null::varchar as clashed from told where n = 1
  union all select doc, n, nd, case when clash then null else g1 end, case when t is not null then t when g is not null or reset then null else team end, case when t is not null then team_ when g is not null or reset then null else team_name end, case when t is not null then page else cp end, bad, clash, g1 from (
   select *, t is not null and g1 is not null and not list_contains(string_split(g1, '@'), t) as clash from (
    select p.team, p.team_name, p.cp, t.*, hd and parsed is null as bad, case when hd then parsed else p.gd end as nd, hd and (parsed is null or parsed is distinct from p.gd) as reset,
     case when t.g is not null then t.g when hd and (parsed is null or parsed is distinct from p.gd) then null else p.game end as g1
    from walk p join (select *, date_ <> '' and (g is not null or t is not null or dated) as hd from told) t on t.doc = p.doc and t.n = p.n + 1))),
 walked as materialized (select told.*, gd, game, team, team_name, cp, bad, clash, clashed from told join walk using (doc, n)),
 anchors as (select *, greatest(y - 15, (coalesce(lag(y) over v, y - 24) + y) / 2) - 0.2 as a, least(y + 15, (coalesce(lead(y) over v, y + 24) + y) / 2) + 0.2 as b from walked where kind is not null window v as (partition by doc, page order by y)),
 reasons as (select a.doc, a.n, string_agg(r.reason_, ' ' order by r.y) as said, string_agg(round(r.y, 1)::varchar, '|' order by r.y) as ys from anchors a join walked r on r.doc = a.doc and r.page = a.page and r.y >= a.a and r.y <= a.b and r.reason_ <> '' and not regexp_matches(r.reason_, '(?i)\\bNOT\\s+YET\\s+SUBMITTED\\b') where a.kind = 'PLAYER' group by 1, 2)"""


@query(
    f"""with recursive {_ATTRIBUTED} select kind, doc, page, round(y, 1) as y, gd as game_date, game, team, team_name, case when kind = 'PLAYER' then player_ end as player, case when kind = 'PLAYER' then status_ end as status, case when kind = 'PLAYER' then said else reason_ end as reason, ys as reason_ys,
  case when cp < page then 'CROSS_PAGE_CONTINUATION' else 'SAME_PAGE_OR_PRIOR_CONTEXT' end as context_origin, case when game is null or gd is null then 'UNRESOLVED' when gd = '{SLATE_DAY}' and game in ({", ".join(f"'{g}'" for g in SLATE)}) then 'IN_SLATE' else 'OUTSIDE_SLATE' end as slate_scope
 from anchors left join reasons using (doc, n)"""
)
def page_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players and pending reports with the game and team that hold where they stand, over pages."""
    return at.attributed(report_cells(spark, sf_dir), SLATE_DAY, SLATE)[0]


@query(
    f"""with recursive {_ATTRIBUTED} select doc, page, round(y, 1) as y, 'UNMATCHED_PLAYER_OR_STATUS' as issue, player_ || ' / ' || status_ as detail from walked where kind is null and (status_ <> '' or player_ <> '')
 union all select doc, page, round(y, 1), 'INVALID_GAME_DATE', date_ from walked where bad union all select doc, page, round(y, 1), 'TEAM_MATCHUP_CONFLICT', team_ || ' / ' || clashed from walked where clash
 union all select doc, page, round(y, 1), 'MISSING_CONTEXT', 'game=' || coalesce(game, 'None') || ' team=' || coalesce(team_name, 'None') from anchors where game is null or team is null
 union all select doc, page, round(y, 1), 'REASON_MISSING', player_ from anchors left join reasons using (doc, n) where kind = 'PLAYER' and said is null"""
)
def attribution_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that was in doubt while pages were read."""
    return at.attributed(report_cells(spark, sf_dir), SLATE_DAY, SLATE)[1]
