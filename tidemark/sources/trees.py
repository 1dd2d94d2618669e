"""JSON documents as trees: every node with its place and parent, typed objects at any depth, and schedules that fail closed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import written

#: how a page marks structured data, and how games, teams and times are written; fixed values
SCRIPT = r'(?is)<script\s+type="application/ld\+json"\s*>(.*?)</script>'
EVENT = "SportsEvent"
GAME_ID, TEAM, SHORT_TEAM = r"^\d{10}$", "^[A-Z]{3}$", "^[A-Z]{2,3}$"
URL_GAME = r"(00\d{8})/?$"
STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?$"
ZONE = "America/New_York"


def kind(value: Column) -> Column:
    """object, array or the name of a scalar's type, null for JSON null and for no value."""
    told = F.schema_of_variant(value)
    return F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told != "VOID", F.lower(told))


def text_of(value: Column, path: str) -> Column:
    """The string at path; null for any other type."""
    at = F.try_variant_get(value, path, "variant")
    return F.when(kind(at) == "string", F.try_variant_get(value, path, "string"))


def named_type(value: Column, name: str) -> Column:
    """Whether an object's @type is name, or a list that holds it."""
    one = text_of(value, '$["@type"]') == name
    several = F.array_contains(F.try_variant_get(value, '$["@type"]', "array<string>"), name)
    return F.coalesce(one, F.lit(False)) | F.coalesce(several & (kind(F.try_variant_get(value, '$["@type"]', "variant")) == "array"), F.lit(False))


def nodes(rows: DataFrame, column: str) -> DataFrame:
    """Every object and array in the JSON texts of column, the text itself included: the other columns, path (fields and places from
    the root), parent_types (the @type of each object above, outermost first) and value.

    A level at a time: what is written is a level's containers, so a task holds no more of a tree than one node. Texts
    that are no JSON give no node.
    """
    rest = [c for c in rows.columns if c != column]
    level = rows.select(*rest, F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("parent_types"), F.try_parse_json(column).alias("value"))
    levels = []
    while True:
        level = written(level.where(kind(F.col("value")).isin("object", "array")), "nodes")
        if level.isEmpty():
            break
        levels.append(level)
        here = F.when(kind(F.col("value")) == "object", F.coalesce(text_of(F.col("value"), '$["@type"]'), F.lit("")))
        up = level.withColumn("parent_types", F.when(here.isNotNull(), F.concat("parent_types", F.array(here))).otherwise(F.col("parent_types")))
        inner = up.withColumnRenamed("value", "_up")
        below = inner.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_up").outer()))
        level = below.select(*rest, F.concat("path", F.array(F.coalesce("key", F.col("pos").cast("string")))).alias("path"), "parent_types", "value")
    none = level.select(*rest, "path", "parent_types", "value")
    return reduce(DataFrame.unionByName, levels, none)


def structured_events(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every SportsEvent in the structured data of pages: the other columns, script, path, inside (the @type it stands in), name,
    home, away, start as written."""
    rest = [c for c in pages.columns if c != html]
    scripts = pages.select(*rest, F.posexplode(F.regexp_extract_all(html, F.lit(SCRIPT), 1)).alias("script", "_json"))
    found = nodes(scripts, "_json").where(kind(F.col("value")) == "object").where(named_type(F.col("value"), EVENT))
    v = F.col("value")
    team = lambda side: F.upper(F.trim(text_of(v, f"$.{side}.alternateName")))
    inside = F.try_element_at(F.filter("parent_types", lambda t: t != ""), F.lit(-1))
    return found.select(*rest, "script", F.array_join("path", "/").alias("path"), inside.alias("inside"), text_of(v, "$.name").alias("name"), team("homeTeam").alias("home"), team("awayTeam").alias("away"), text_of(v, "$.startDate").alias("start"))


def instant(text: Column) -> Column:
    """A time with date, minutes and zone; null for anything else."""
    return F.when(text.rlike(STAMP) & text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), text.try_cast("timestamp"))


def official_games(pages: DataFrame, key: str, day: str, url: str = "url", html: str = "html") -> DataFrame:
    """pages(key, day, url, html) as key, outcome, game_id, home, away, tipoff: the one game of that day that the page is about.

    Outcomes, the first that holds: OFFICIAL_STRUCTURED_GAME_MISSING, OFFICIAL_GAME_ID_MISSING_IN_URL,
    STRUCTURED_GAME_MISSING_OR_AMBIGUOUS (none or several games of that day in the teams' time zone), CANONICAL_URL_MISMATCH, OK.
    """
    events = structured_events(pages.select(key, F.col(day).cast("date").alias("_day"), html), html)
    tip = instant(F.col("start"))
    local = F.to_date(F.from_utc_timestamp(tip, ZONE))
    sound = F.coalesce(F.col("home").rlike(SHORT_TEAM) & F.col("away").rlike(SHORT_TEAM) & (F.col("home") != F.col("away")) & (local == F.col("_day")), F.lit(False))
    game = F.struct("home", "away", tip.alias("tipoff"))
    by = events.groupBy(key).agg(F.count("*").alias("_n"), F.count_distinct(F.when(sound, game)).alias("_d"), F.min(F.when(sound, game)).alias("_game"))
    game_id = F.nullif(F.regexp_extract(F.regexp_extract(url, "^[^?#]*", 0), URL_GAME, 1), F.lit(""))
    link = F.regexp_extract(html, r'(?i)<link\s+[^>]*rel="canonical"[^>]*href="([^"]*)"', 1)
    out = pages.select(key, game_id.alias("_id"), (link == F.col(url)).alias("_same")).join(by, key, "left")
    outcome = (
        F.when(F.coalesce("_n", F.lit(0)) == 0, "OFFICIAL_STRUCTURED_GAME_MISSING")
        .when(F.col("_id").isNull(), "OFFICIAL_GAME_ID_MISSING_IN_URL")
        .when(F.col("_d") != 1, "STRUCTURED_GAME_MISSING_OR_AMBIGUOUS")
        .when(~F.coalesce("_same", F.lit(False)), "CANONICAL_URL_MISMATCH")
        .otherwise("OK")
    )
    given = lambda c: F.when(outcome == "OK", c)
    return out.select(key, outcome.alias("outcome"), given(F.col("_id")).alias("game_id"), *(given(F.col(f"_game.{c}")).alias(c) for c in ("home", "away", "tipoff")))


def schedules(docs: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(outcomes, games) of schedule documents leagueSchedule.gameDates[].games[].

    outcomes(key, outcome): OK or the first fault in the order of the document, one of INVALID_JSON, MISSING_LEAGUE_SCHEDULE,
    MISSING_GAME_DATES, INVALID_DATE_GAMES, INVALID_GAME, INVALID_GAME_ID, DUPLICATE_GAME_ID, MISSING_TIPOFF_UTC,
    INVALID_TIPOFF_UTC, NON_UTC_TIPOFF, MISSING_TEAMS, INVALID_TEAM_TRICODE, EMPTY_GAMES. games(key, game_id, tipoff, home,
    away, status): the rows of documents that are OK; one fault, and a document gives none.
    """
    v = F.try_parse_json(payload)
    at = lambda x, path: F.try_variant_get(x, path, "variant")
    dates = F.when(kind(at(F.col("_v"), "$.leagueSchedule.gameDates")) == "array", F.try_variant_get("_v", "$.leagueSchedule.gameDates", "array<variant>"))
    whole = F.when(F.col("_v").isNull(), "INVALID_JSON").when(F.coalesce(kind(at(F.col("_v"), "$.leagueSchedule")) != "object", F.lit(True)), "MISSING_LEAGUE_SCHEDULE").when(F.coalesce(F.size("_dates") < 1, F.lit(True)), "MISSING_GAME_DATES")
    top = written(docs.select(key, v.alias("_v")).withColumn("_dates", dates).withColumn("_whole", whole), "schedules")
    days = top.where("_whole is null").select(key, F.posexplode("_dates").alias("d", "_day"))
    listed = F.coalesce(kind(at(F.col("_day"), "$.games")) == "array", F.lit(False))
    games = days.where(listed).select(key, "d", F.posexplode(F.try_variant_get("_day", "$.games", "array<variant>")).alias("g", "_g"))
    g = F.col("_g")
    games = games.select(
        key, "d", "g", (kind(g) == "object").alias("_object"), text_of(g, "$.gameId").alias("game_id"), text_of(g, "$.gameDateTimeUTC").alias("tip"),
        *((kind(at(g, f"$.{s}Team")) == "object").alias(f"_{s}_there") for s in ("home", "away")), *(text_of(g, f"$.{s}Team.teamTricode").alias(s) for s in ("home", "away")),
        F.coalesce(F.try_variant_get("_g", "$.gameStatus", "string"), F.lit("")).alias("status"),
    )
    again = F.row_number().over(W.partitionBy(key, "game_id").orderBy("d", "g")) > 1
    no = lambda c: ~F.coalesce(c, F.lit(False))
    stamp, zoned = F.col("tip").rlike(STAMP) & F.col("tip").try_cast("timestamp").isNotNull(), F.col("tip").rlike(r"(Z|[+-]00:00)$")
    fault = (
        F.when(no(F.col("_object")), "INVALID_GAME")
        .when(no(F.col("game_id").rlike(GAME_ID)), "INVALID_GAME_ID")
        .when(again, "DUPLICATE_GAME_ID")
        .when(F.col("tip").isNull(), "MISSING_TIPOFF_UTC")
        .when(no(stamp), "INVALID_TIPOFF_UTC")
        .when(no(zoned), "NON_UTC_TIPOFF")
        .when(no(F.col("_home_there")) | no(F.col("_away_there")), "MISSING_TEAMS")
        .when(no(F.col("home").rlike(TEAM)) | no(F.col("away").rlike(TEAM)) | (F.col("home") == F.col("away")), "INVALID_TEAM_TRICODE")
    )
    judged = written(games.withColumn("_fault", fault), "schedule_games")
    place = lambda name, g_: F.struct("d", F.lit(g_).alias("g") if isinstance(g_, int) else g_, name.alias("fault"))
    wrong = days.where(~listed).select(key, place(F.lit("INVALID_DATE_GAMES"), -1).alias("w")).unionByName(judged.where("_fault is not null").select(key, place(F.col("_fault"), F.col("g")).alias("w")))
    first = wrong.groupBy(key).agg(F.min("w").alias("w"))
    counts = judged.groupBy(key).agg(F.count("*").alias("n"))
    outcomes = top.select(key, "_whole").join(first, key, "left").join(counts, key, "left")
    outcomes = written(outcomes.select(key, F.coalesce("_whole", F.col("w.fault"), F.when(F.col("n").isNull(), "EMPTY_GAMES"), F.lit("OK")).alias("outcome")), "schedule_outcomes")
    rows = judged.join(outcomes.where("outcome = 'OK'").select(key), key)
    return outcomes, rows.select(key, "game_id", F.col("tip").try_cast("timestamp").alias("tipoff"), "home", "away", "status")
