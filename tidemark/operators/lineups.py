"""Who started a period, and how long each was on, from substitutions and acts.

Two readings. starts(), start_sets() and time_on() take actions(key..., player, at, kind), kind being in, out or act:
a player whose first action is `in` did not start; one whose first is `out` or `act` did. Who has no action may have
started or not, so the possible line-ups are the ways to fill the places left over from those players.

starters(), rebuilt(), minutes() and truth() take a log of substitutions that name who leaves by id and who comes by
a text: the line-up of a period is inferred from what happens before its first substitution, carried through the
period action by action, and held against official minutes. A team's period of one game is the unit of work: its
substitutions are a few dozen, however many games there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import plain_name


def _in_order(actions: DataFrame, key: Sequence[str], tie: str) -> DataFrame:
    w = W.partitionBy(*key, "player").orderBy("at", tie)
    return actions.withColumn("before", F.lag("kind").over(w)).withColumn("next_at", F.lead("at").over(w))


def _told(actions: DataFrame, key: Sequence[str], tie: str) -> DataFrame:
    """key, must (who started), seen (who acts at all), n_conflicts (actions that the player's earlier one rules out, or of nobody)."""
    before, kind = F.col("before"), F.col("kind")
    wrong = ((kind == "in") & before.isin("in", "act")) | (kind.isin("out", "act") & (before == "out"))
    return _in_order(actions, key, tie).groupBy(*key).agg(
        F.collect_set(F.when(before.isNull() & (kind != "in"), F.col("player"))).alias("must"),
        F.collect_set("player").alias("seen"),
        F.count_if(F.coalesce(wrong, F.lit(False)) | F.col("player").isNull()).alias("n_conflicts"),
    )


def choices(n: Column, k: Column) -> Column:
    """Ways to choose k of n, each step a whole number; 0 where k is under 0 or above n."""
    ways = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k.cast("long"), F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda acc, i: (acc * (n - k + i) / i).cast("decimal(38,0)"))
    return F.when((k < 0) | (k > n), 0).when(k == 0, 1).otherwise(ways).cast("long")


def starts(actions: DataFrame, roster: DataFrame, team: Sequence[str], period: Sequence[str], size: int, tie: str) -> DataFrame:
    """For each period: n_must, n_free, n_conflicts, n_sets, status.

    roster(team..., player). A conflict is an action that its player's earlier one rules out: in after in or act,
    out or act after out. UNIQUE is one possible set, AMBIGUOUS several, IMPOSSIBLE none.
    """
    key = [*team, *period]
    sizes = roster.select(*team, "player").distinct().groupBy(*team).agg(F.count("*").alias("n_roster"))
    out = _told(actions, key, tie).join(sizes, list(team))
    out = out.withColumns({"n_must": F.size("must").cast("long"), "n_free": F.col("n_roster") - F.size("seen")})
    ways = F.when(F.col("n_conflicts") == 0, choices(F.col("n_free"), F.lit(size) - F.col("n_must"))).otherwise(0)
    out = out.withColumn("n_sets", ways.cast("long"))
    status = F.when(F.col("n_sets") == 0, "IMPOSSIBLE").when(F.col("n_sets") == 1, "UNIQUE").otherwise("AMBIGUOUS")
    return out.select(*key, "n_must", "n_free", "n_conflicts", "n_sets", status.alias("status"))


def start_sets(actions: DataFrame, roster: DataFrame, team: Sequence[str], period: Sequence[str], size: int, tie: str) -> DataFrame:
    """Every set of `size` players that may have started a period: key, members in order, a row for each set.

    Sets grow by one free player at a time, in ascending order, a row for each beginning, so that no row ever holds
    all sets of a period.
    """
    key = [*team, *period]
    squads = roster.groupBy(*team).agg(F.collect_set("player").alias("_squad"))
    rows = _told(actions, key, tie).where("n_conflicts = 0").join(squads, list(team))
    free = F.array_sort(F.array_except("_squad", "seen"))
    rows = rows.select(*key, "must", free.alias("_free"), (F.lit(size) - F.size("must")).alias("_open")).where("_open between 0 and size(_free)")
    rows = rows.withColumn("_set", F.slice("_free", 1, 0))
    for level in range(size):
        more = F.filter("_free", lambda p: F.coalesce(p > F.try_element_at("_set", F.lit(-1)), F.lit(True)))
        longer = F.transform(more, lambda p: F.concat(F.col("_set"), F.array(p)))
        rows = rows.withColumn("_set", F.explode(F.when(F.col("_open") > level, longer).otherwise(F.array("_set"))))
    return rows.select(*key, F.array_sort(F.concat("must", "_set")).alias("members"))


#: actions that no player on court makes, and how a substitution names who comes; fixed values
OFF_COURT = ("timeout", "period", "instant replay")
COMES = r"(?i)^SUB:\s*(.+?)\s+FOR\s+(.+?)\s*$"


def incoming(subs: DataFrame, roster: DataFrame, team: Sequence[str]) -> DataFrame:
    """subs(team..., text) with `incoming`: the one player of the team with the name after SUB:, else the one with its last word.

    roster(team..., player, name). No such player, or several, is null.
    """
    last = lambda c: F.element_at(F.split(c, " "), -1)
    name = plain_name("name")
    keys = roster.select(*team, "player", F.explode(F.array_distinct(F.array(name, last(name)))).alias("_key")).where("_key <> ''")
    keys = keys.groupBy(*team, "_key").agg(F.count_distinct("player").alias("_n"), F.min("player").alias("_p")).where("_n = 1").drop("_n")
    out = subs.withColumn("_whole", F.nullif(plain_name(F.regexp_extract("text", COMES, 1)), F.lit(""))).withColumn("_last", last("_whole"))
    for side in ("_whole", "_last"):
        out = out.join(keys.withColumnsRenamed({"_key": side, "_p": f"_by{side}"}), [*team, side], "left")
    return out.withColumn("incoming", F.coalesce("_by_whole", "_by_last")).drop("_whole", "_last", "_by_whole", "_by_last")


def starters(actions: DataFrame, roster: DataFrame, team: Sequence[str], period: str, size: int) -> DataFrame:
    """For each team and period up to the game's last: status and candidates, who was on before the first substitution.

    actions(team..., period, at, kind, player); team begins with the game. Candidates are the roster's players with
    an action, OFF_COURT ones aside, up to the first substitution, and all who leave at its time. UNIQUE is exactly
    `size` of them; else the set is not guessed.
    """
    game = team[0]
    last = actions.groupBy(game).agg(F.max(period).alias("_last"))
    grid = roster.select(*team).distinct().join(last, game).withColumn(period, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_last").cast("long")))).drop("_last")
    is_sub = F.col("kind") == "substitution"
    rows = actions.withColumn("_first", F.min(F.when(is_sub, F.col("at"))).over(W.partitionBy(*team, period)))
    known = roster.select(*team, "player").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, [*team, "player"], "left")
    on = (is_sub & (F.col("at") == F.col("_first"))) | (F.coalesce("_known", F.lit(False)) & ~F.col("kind").isin(*OFF_COURT))
    on = on & F.coalesce(F.col("at") <= F.col("_first"), F.lit(True))
    found = rows.groupBy(*team, period).agg(F.array_sort(F.collect_set(F.when(on, F.col("player")))).alias("candidates"))
    status = F.when(F.col("candidates").isNull(), "NO_TEAM_EVENTS").when(F.size("candidates") == size, "UNIQUE").otherwise("AMBIGUOUS")
    return grid.join(found, [*team, period], "left").withColumn("status", status)


def rebuilt(actions: DataFrame, roster: DataFrame, team: Sequence[str], period: str, size: int, length: Column, tie: str = "action_id") -> DataFrame:
    """For each team and period: status, stints (player, begin, end), errors (type, at, player), n_told, n_untold.

    The line-up starts with the period's starters and changes with each substitution whose player is on and whose
    incoming one is known and off, so that it always holds `size`; others are errors and change nothing. length:
    seconds of a period. n_told counts substitutions with who leaves, n_untold those of them without who comes.
    """
    subs = incoming(actions.where("kind = 'substitution'"), roster, team)
    told = F.struct(F.col("at").cast("long").alias("at"), F.col(tie).alias("tie"), F.col("player").cast("long").alias("out"), F.col("incoming").cast("long").alias("in"))
    subs = subs.groupBy(*team, period).agg(F.array_sort(F.collect_list(told)).alias("_subs"))
    rows = starters(actions, roster, team, period, size).join(subs, [*team, period], "left")
    begins = F.transform("candidates", lambda p: F.struct(p.cast("long").alias("player"), F.lit(0).cast("long").alias("since")))
    state = F.struct(
        begins.alias("on"),
        F.array().cast("array<struct<player:bigint,begin:bigint,end:bigint>>").alias("stints"),
        F.array().cast("array<struct<type:string,at:bigint,player:bigint>>").alias("errors"),
    )

    def step(acc: Column, s: Column) -> Column:
        players = acc["on"]["player"]
        wrong = (
            F.when(s["out"].isNull(), "MISSING_OUTGOING_ID")
            .when(~F.array_contains(players, s["out"]), "OUTGOING_NOT_ON_COURT")
            .when(s["in"].isNull(), "INCOMING_UNRESOLVED")
            .when(F.array_contains(players, s["in"]), "INCOMING_ALREADY_ON_COURT")
        )
        leaves = F.filter(acc["on"], lambda p: p["player"] == s["out"])
        stay = F.filter(acc["on"], lambda p: p["player"] != s["out"])
        ended = F.transform(leaves, lambda p: F.struct(p["player"].alias("player"), p["since"].alias("begin"), s["at"].alias("end")))
        comes = F.array(F.struct(s["in"].alias("player"), s["at"].alias("since")))
        error = F.array(F.struct(wrong.alias("type"), s["at"].alias("at"), F.when(wrong == "INCOMING_ALREADY_ON_COURT", s["in"]).otherwise(s["out"]).alias("player")))
        fine = wrong.isNull()
        return F.struct(
            F.when(fine, F.concat(stay, comes)).otherwise(acc["on"]).alias("on"),
            F.when(fine, F.concat(acc["stints"], ended)).otherwise(acc["stints"]).alias("stints"),
            F.when(fine, acc["errors"]).otherwise(F.concat(acc["errors"], error)).alias("errors"),
        )

    unique = F.col("status") == "UNIQUE"
    done = F.when(unique, F.aggregate(F.coalesce("_subs", F.array().cast(subs.schema["_subs"].dataType)), state, step))
    rows = rows.withColumn("_done", done).withColumn("_end", length.cast("long"))
    closing = F.transform("_done.on", lambda p: F.struct(p["player"].alias("player"), p["since"].alias("begin"), F.greatest(F.col("_end"), p["since"]).alias("end")))
    failed = F.array(F.struct(F.lit("STARTER_INFERENCE_FAILED").alias("type"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("player")))
    known = lambda test: F.when(unique, F.coalesce(F.size(F.filter("_subs", test)), F.lit(0))).otherwise(0).cast("long")
    return rows.select(
        *team,
        period,
        "status",
        F.col("_end").alias("length"),
        F.concat("_done.stints", closing).alias("stints"),
        F.when(unique, F.col("_done.errors")).otherwise(failed).alias("errors"),
        known(lambda s: s["out"].isNotNull()).alias("n_told"),
        known(lambda s: s["out"].isNotNull() & s["in"].isNull()).alias("n_untold"),
    )


def minutes(periods: DataFrame, roster: DataFrame, team: Sequence[str]) -> DataFrame:
    """roster(team..., player, official) with `rebuilt` minutes of all stints and `error`, rebuilt less official."""
    game = team[0]
    on = periods.select(game, F.explode("stints").alias("s")).groupBy(game, "s.player").agg((F.sum(F.col("s.end") - F.col("s.begin")) / 60).alias("rebuilt"))
    out = roster.join(on, [game, "player"], "left").withColumn("rebuilt", F.coalesce("rebuilt", F.lit(0.0)))
    return out.withColumn("error", F.col("rebuilt") - F.col("official"))


TOLERANCE = 0.25


def truth(periods: DataFrame, roster: DataFrame, team: Sequence[str], period: str, size: int, tolerance: float = TOLERANCE) -> DataFrame:
    """A row for each game: how far rebuilt minutes are from official ones, and whether they pass.

    A game passes without an error, without an unknown incoming player, with no player off by more than tolerance,
    and with each team's total within tolerance of size times the game's minutes.
    """
    game = team[0]
    each = minutes(periods, roster, team)
    by_team = each.groupBy(*team).agg(F.sum("rebuilt").alias("_total"))
    game_minutes = periods.select(game, period, "length").distinct().groupBy(game).agg(F.max(period).alias("periods"), (F.sum("length") / 60).alias("game_minutes"))
    totals = by_team.join(game_minutes, game).groupBy(game).agg(F.max(F.abs(F.col("_total") - F.col("game_minutes") * size)).alias("team_gap"))
    off = F.abs("error")
    errors = each.groupBy(game).agg(F.avg(off).alias("mae"), F.max(off).alias("max_error"), F.count_if(off > tolerance).alias("n_over_quarter"), F.count_if(off > 1).alias("n_over_one"))
    faults = periods.groupBy(game).agg(F.sum(F.size("errors")).alias("n_errors"), F.sum("n_told").alias("n_told"), F.sum("n_untold").alias("n_untold"))
    out = game_minutes.join(errors, game).join(faults, game).join(totals, game)
    passed = (F.col("n_untold") == 0) & (F.col("n_errors") == 0) & (F.col("max_error") <= tolerance) & (F.col("team_gap") <= tolerance)
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))


def time_on(actions: DataFrame, key: Sequence[str], begin: int, end: int, tie: str) -> DataFrame:
    """key, player, seconds: time on between begin and end; starters count from begin, who isn't sent out to end."""
    rows = _in_order(actions, key, tie)
    after = F.when(F.col("kind") != "out", F.coalesce("next_at", F.lit(end)) - F.col("at")).otherwise(0)
    opening = F.when(F.col("before").isNull() & (F.col("kind") != "in"), F.col("at") - begin).otherwise(0)
    return rows.groupBy(*key, "player").agg(F.sum(after + opening).alias("seconds"))
