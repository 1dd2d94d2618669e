"""Status reports line by line: parsing with carried context, and checks of what was parsed.

Context is a window over the lines of a document or page, not a loop: the last date, matchup and team above a line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import record_id
from tidemark.operators.identity import TEAMS, team_in_matchup
from tidemark.operators.review import all_reasons

#: patterns and openings of a report's lines; fixed values
STATUS = "Out|Doubtful|Questionable|Probable|Available"
NAME = r"[A-Za-z][A-Za-z'’.-]+(?:\s+[A-Za-z][A-Za-z'’.-]+)*"
REASONS = ("Injury/Illness", "Personal Reasons", "Not With Team", "G League", "Rest", "League Suspension", "Return to Competition", "Health")
REPORT_NAMES = tuple("LA Clippers" if name == "Los Angeles Clippers" else name for name in TEAMS.values())
CONTEXT = ("game_date", "matchup", "team")
PROVENANCE = r"^EXPLICIT:p(\d+):y([0-9]+(?:\.[0-9]+)?)$"
WITHIN = 0.015
#: how pressing an issue is; fixed values
SEVERITY = {"TEAM_MATCHUP_MISMATCH": 100, "STATUS_DISAGREEMENT": 95, "DUPLICATE_PLAYER_PAGE": 90, "MISSING_TEAM_OR_MATCHUP": 80, "MISSING_GAME_DATE": 70, "MISSING_REASON": 60, "INFERRED_DATE": 40, "INHERITED_LAYOUT": 20}


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def teams_named(c: Column) -> Column:
    """The different teams that a text names, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?<!\w)({'|'.join(REPORT_NAMES)})(?!\w)"), 1))


def told(lines: DataFrame, text: str = "text") -> DataFrame:
    """lines with what each says itself: said_date, said_matchup, said_team (only if it names one team) and status."""
    c = F.trim(F.col(text))
    day = F.regexp_replace(found(c, r"\b(\d{2}/\d{2}/\d{4})\b", 1), r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$1-$2")
    teams = teams_named(c)
    said = {"said_date": day, "said_matchup": found(c, r"\b[A-Z]{2,3}@[A-Z]{2,3}\b"), "said_team": F.when(F.size(teams) == 1, teams[0])}
    return lines.withColumns({**said, "status": F.upper(found(c, rf"(?i)\b({STATUS})\b", 1))})


def parsed(lines: DataFrame, scope: Sequence[str] = ("doc", "page"), text: str = "text") -> DataFrame:
    """lines(doc, page, line, text): a record for each line with a status.

    Context is the last date, matchup and team of the scope so far: with the page in the scope nothing is inferred
    across pages. flags names what is missing or not in a known form; none of the records is fit for training.
    """
    w = W.partitionBy(*scope).orderBy("page", "line").rowsBetween(W.unboundedPreceding, 0)
    rows = told(lines, text)
    for name, said in zip(CONTEXT, ("said_date", "said_matchup", "said_team"), strict=True):
        place = F.when(F.col(said).isNotNull(), F.struct(F.col(said).alias("v"), "page", "line"))
        rows = rows.withColumn(f"_{name}", F.last(place, ignorenulls=True).over(w))
    rows = rows.where("status is not null")
    c = F.trim(F.col(text))
    before, after = (F.trim(F.regexp_extract(c, rf"(?i)^(.*?)\b(?:{STATUS})\b(.*)$", k)) for k in (1, 2))
    reason = F.nullif(F.regexp_replace(after, "^[ -]+|[ -]+$", ""), F.lit(""))
    cut = F.replace(before, "said_team", F.lit("\u0001"))
    area = F.when(F.col("said_team").isNotNull(), F.trim(F.substring_index(cut, "\u0001", -1))).otherwise(before)
    name = lambda k: F.regexp_extract(area, rf"(?<!\w)({NAME}),\s*({NAME})$", k)
    rows = rows.withColumns({"reason": reason, "player": F.nullif(F.concat_ws(" ", F.nullif(name(2), F.lit("")), F.nullif(name(1), F.lit(""))), F.lit(""))})
    rows = rows.withColumns({n: F.col(f"_{n}.v") for n in CONTEXT})
    rows = rows.withColumns({f"{n}_provenance": F.when(F.col(n).isNotNull(), F.concat(F.lit("EXPLICIT:p"), F.col(f"_{n}.page"), F.lit(":y"), F.col(f"_{n}.line"))) for n in CONTEXT})
    odd = ~F.greatest(*(F.startswith(F.col("reason"), F.lit(r)) for r in REASONS))
    missing = [(F.col(c).isNull(), f"{label}_UNRESOLVED") for c, label in (("player", "PLAYER"), ("game_date", "DATE"), ("matchup", "MATCHUP"), ("team", "TEAM"), ("reason", "REASON"))]
    flags = F.array_join(all_reasons(*missing, (F.coalesce(odd, F.lit(False)), "REASON_FORMAT_UNVERIFIED")), "|")
    rows = rows.withColumns({"flags": flags, "record_id": record_id("doc", "page", "line", text)})
    kept = ["record_id", "doc", "page", "line", *CONTEXT, *(f"{n}_provenance" for n in CONTEXT), "player", "status", "reason", "flags"]
    return rows.select(*kept, F.when(F.col("flags") != "", "REVIEW_REQUIRED").otherwise("AUTO_CANDIDATE").alias("parse_status"), F.lit(False).alias("eligible"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New records beside the old ones of their document, page, player and status, where the old has just one: changed_fields,
    recovered (was empty) and conflicting (was something else)."""
    key = ["doc", "page", "player", "status"]
    single = old.groupBy(*key).agg(F.count("*").alias("_n"), *(F.first(c).alias(f"old_{c}") for c in CONTEXT)).where("_n = 1").drop("_n")
    both = new.join(single, key)
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    kinds = {
        "changed_fields": [(differs(c), c) for c in CONTEXT],
        "recovered": [(F.col(f"old_{c}").isNull() & F.col(c).isNotNull(), c) for c in CONTEXT],
        "conflicting": [(F.col(c).isNotNull() & (F.col(c) != F.col(f"old_{c}")), c) for c in CONTEXT],
    }
    return both.withColumns({k: F.array_join(all_reasons(*((F.coalesce(x, F.lit(False)), c) for x, c in v)), "|") for k, v in kinds.items()})


def sections(rows: DataFrame, events: DataFrame, slack: float = 0.01) -> DataFrame:
    """rows(doc, page, y, ...) with section_game_date, section_matchup and section_team, what events(doc, page, y, type, value)
    up to `slack` below the row say: a DATE ends matchup and team, a MATCHUP ends the team."""
    e = events.select("doc", "page", "y", F.lit(0).alias("_side"), "type", "value", F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("_row"))
    r = rows.select("doc", "page", (F.col("y") + slack).alias("y"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("value"), F.struct(*rows.columns).alias("_row"))
    w = W.partitionBy("doc").orderBy("page", "y", "_side").rowsBetween(W.unboundedPreceding, 0)
    last = lambda kind: F.last(F.when(F.col("type") == kind, F.struct("page", "y", "value")), ignorenulls=True).over(w)
    both = e.unionByName(r).withColumns({"_d": last("DATE"), "_m": last("MATCHUP"), "_t": last("TEAM")}).where("_side = 1")
    since = lambda x, *over: F.when(F.greatest(*(F.coalesce(F.struct(f"{o}.page", f"{o}.y") > F.struct(f"{x}.page", f"{x}.y"), F.lit(False)) for o in over), F.lit(False)), None).otherwise(F.col(f"{x}.value"))
    return both.select("_row.*", F.col("_d.value").alias("section_game_date"), since("_m", "_d").alias("section_matchup"), since("_t", "_m", "_d").alias("section_team"))


def section_issues(team: str = "team", matchup: str = "matchup", day: str = "game_date") -> Column:
    """What is wrong with a row of sections(), all reasons in order."""
    sides = [F.regexp_extract(matchup, r"^([A-Z]{3})@([A-Z]{3})$", k) for k in (1, 2)]
    known = F.array(*map(F.lit, TEAMS))
    valid = F.coalesce(F.array_contains(known, sides[0]) & F.array_contains(known, sides[1]) & (sides[0] != sides[1]), F.lit(False))
    mine = F.coalesce(F.col(team).isin(*REPORT_NAMES), F.lit(False))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"section_{c}"))
    return all_reasons(
        (~valid, "INVALID_MATCHUP"),
        (~mine, "UNKNOWN_TEAM"),
        (mine & F.col(matchup).contains("@") & ~team_in_matchup(team, matchup), "TEAM_NOT_IN_MATCHUP"),
        *((~same(c), f"SECTION_{c.upper()}_MISMATCH") for c in CONTEXT),
        (~F.coalesce(F.col(day).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "INVALID_DATE"),
    )


def verified(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows(record_id, doc, page, y, player, status, CONTEXT and their provenance, parse_status, eligible) with issues and risk.

    Each provenance must name an event of its kind and value, no later than the row. Events meet rows by document,
    kind, page and a cell of height, so a page's rows never meet all of its events.
    """
    copies = rows.groupBy("doc", "page", "player", "status").agg(F.count("*").alias("_copies"))
    days = events.where("type = 'DATE'").select("doc", F.struct("page", "y").alias("_at"), "value")
    at = rows.select("record_id", "doc", F.struct("page", "y").alias("_at"), F.lit(None).cast("string").alias("value"))
    w = W.partitionBy("doc").orderBy("_at", F.col("record_id").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    latest = days.withColumn("record_id", F.lit(None).cast("string")).unionByName(at).withColumn("_latest", F.last("value", ignorenulls=True).over(w))
    out = rows.join(copies, ["doc", "page", "player", "status"], "left").join(latest.where("record_id is not null").select("record_id", "_latest"), "record_id")
    cell = lambda y: F.floor(y / WITHIN)
    kinds = {"game_date": "DATE", "matchup": "MATCHUP", "team": "TEAM"}
    for c in kinds:
        prov = f"{c}_provenance"
        out = out.withColumns({f"_p_{c}": F.regexp_extract(prov, PROVENANCE, 1).try_cast("int"), f"_y_{c}": F.regexp_extract(prov, PROVENANCE, 2).try_cast("double")})
    named = F.array(*(F.struct(F.lit(kind).alias("type"), F.col(f"_p_{c}").alias("page"), F.col(f"_y_{c}").alias("y"), F.col(c).alias("value")) for c, kind in kinds.items()))
    asked = out.select("record_id", "doc", F.explode(named).alias("a")).where("a.page is not null").select("record_id", "doc", "a.type", "a.page", "a.value", F.col("a.y").alias("_y"))
    # events look into three cells, not rows: they are fewer, and rows ask for three kinds each
    asked = asked.withColumn("_cell", cell(F.col("_y")))
    there = events.select("doc", "page", "type", F.col("y").alias("_e"), "value", F.explode(F.array(*(cell(F.col("y")) + k for k in (-1, 0, 1)))).alias("_cell"))
    hits = asked.join(there, ["doc", "type", "page", "value", "_cell"]).where(F.abs(F.col("_e") - F.col("_y")) < WITHIN)
    out = out.join(hits.groupBy("record_id").agg(F.collect_set("type").alias("_hits")), "record_id", "left")
    checks = []
    for c, kind in kinds.items():
        given = F.col(f"_p_{c}").isNotNull()
        hit = F.coalesce(F.array_contains("_hits", kind), F.lit(False))
        future = given & (F.struct(F.col(f"_p_{c}").alias("page"), F.col(f"_y_{c}").alias("y")) > F.struct(F.col("page").cast("int").alias("page"), F.col("y").cast("double").alias("y")))
        checks += [(~given, f"{kind}_PROVENANCE_INVALID"), (future, f"{kind}_PROVENANCE_IN_FUTURE"), (given & ~hit, f"{kind}_PROVENANCE_EVENT_MISMATCH")]
    shape = F.coalesce(F.trim("matchup").rlike("^[A-Z]{3}@[A-Z]{3}$"), F.lit(False))
    issues = all_reasons(
        (~shape, "MATCHUP_MISSING_OR_INVALID"),
        (shape & ~team_in_matchup("team", "matchup"), "TEAM_NOT_IN_MATCHUP"),
        (~F.coalesce(F.col("game_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "DATE_MISSING_OR_INVALID"),
        (F.col("_latest").isNotNull() & ~F.col("_latest").eqNullSafe(F.col("game_date")), "DATE_CONTRADICTS_EXPLICIT_EVENT"),
        (F.col("_latest").isNull(), "NO_PRIOR_EXPLICIT_DATE_EVENT"),
        *checks,
        (F.col("_copies") > 1, "DUPLICATE_PAGE_PLAYER_STATUS"),
        ((F.col("parse_status") != "REVIEW_REQUIRED") | F.col("eligible"), "UNSAFE_TRAINING_LABEL"),
    )
    crossing = F.greatest(*(F.coalesce(F.col(f"_p_{c}") < F.col("page"), F.lit(False)) for c in CONTEXT))
    out = out.withColumn("issues", F.array_join(issues, "|"))
    risk = F.when(F.col("issues") != "", "FLAGGED").when(crossing, "CROSS_PAGE_REVIEW").otherwise("SPOT_CHECK")
    return out.select("record_id", "doc", "page", "y", "player", "status", *CONTEXT, "issues", risk.alias("risk"))


def cleared(rows: DataFrame) -> DataFrame:
    """rows(team, matchup, game_date, section_game_date) with attribution; a game whose teams exclude the row's, or of another
    date than the section's, is no game of the row."""
    conflict = F.col("matchup").isNotNull() & F.col("team").isNotNull() & ~team_in_matchup("team", "matchup")
    dated = F.col("game_date").isNotNull() & F.col("section_game_date").isNotNull() & (F.col("game_date") != F.col("section_game_date"))
    kind = F.when(conflict, "TEAM_CONFLICT_CLEARED").when(dated, "DATE_CONFLICT_CLEARED").when(F.col("matchup").isNull(), "NO_GAME").otherwise("ATTRIBUTED")
    return rows.withColumn("attribution", kind).withColumn("matchup", F.when(kind == "ATTRIBUTED", F.col("matchup")))


def spread_sample(rows: DataFrame, page: str, severity: str, tie: str, size: int) -> DataFrame:
    """The review sample of `size` rows: each page's most severe row first, pages in order, then the most severe of the rest."""
    best = F.row_number().over(W.partitionBy(page).orderBy(F.desc(severity), tie)) == 1
    picked = rows.withColumn("_first", best)
    return picked.orderBy(F.desc("_first"), F.when(F.col("_first"), F.col(page)), F.desc(severity), page, tie).limit(size).drop("_first")
