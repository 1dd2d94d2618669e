"""Who plays whom, carried through a report's pages line by line, with where it came from and what was in doubt.

cells(doc, page, x, y, text): runs of text at their places. A document's lines are walked once, in page order: a new
date ends game and team, a matchup ends the team, and a team that isn't in the game empties the game for all that
follows. What a line meets depends on its own stretch only - the lines since the last date change or matchup - as
within one the game can be emptied once, by the first team outside it; so the walk is running sums and last values,
and no state is held but a window's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.identity import TEAMS
from tidemark.operators.layout import lines
from tidemark.operators.report_lines import REPORT_NAMES, STATUS

PAGE = ("doc", "page")
#: left edges of the report's columns, the part of a page that holds the table, and a line's height; fixed values
LANES = (("date", 0.0), ("time", 100.0), ("matchup", 195.0), ("team", 260.0), ("player", 420.0), ("status", 580.0), ("reason", 660.0))
BODY = (85.0, 525.0)
LINE = 2.0
#: how far a reason's line may be from its row, and the height taken for a missing neighbour; fixed values
REASON_REACH, ALONE, SLACK = 15.0, 24.0, 0.2
PENDING = r"(?i)\bNOT\s+YET\s+SUBMITTED\b"


def table_lines(cells: DataFrame) -> DataFrame:
    """doc, page, y and the text of each lane, for the lines of the table's body."""
    lined = lines(cells, PAGE, "y", "x", LINE).where("line is not null")
    lane = F.lit("reason")
    for name, left in reversed([(n, b) for (n, _), (_, b) in zip(LANES, LANES[1:], strict=False)]):
        lane = F.when(F.col("x") < left, name).otherwise(lane)
    text = lambda c: F.trim(F.array_join(F.transform(F.filter("_w", lambda w: w["lane"] == c), lambda w: w["text"]), " "))
    rows = lined.groupBy(*PAGE, "line").agg(F.avg(F.col("y").cast("double")).alias("y"), F.array_sort(F.collect_list(F.struct("x", "y", "text", lane.alias("lane")))).alias("_w"))
    rows = rows.where((F.col("y") >= BODY[0]) & (F.col("y") < BODY[1]))
    return rows.select(*PAGE, "y", *(text(c).alias(c) for c, _ in LANES))


def _walk(rows: DataFrame) -> DataFrame:
    """rows of table_lines with what they say, and game_date, game, team, team_name and context_page as of them."""
    code = F.try_element_at(F.create_map(*(F.lit(x) for pair in zip(REPORT_NAMES, TEAMS, strict=True) for x in pair)), F.col("team"))
    day = F.col("date")
    dated = day.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    matchup = F.upper(F.trim("matchup"))
    said_game = F.when(matchup.rlike("^[A-Z]{2,3}@[A-Z]{2,3}$"), matchup)
    header = said_game.isNotNull() | code.isNotNull() | dated
    parsed = F.try_to_date(day, "M/d/y").cast("string")
    rows = rows.withColumns({"said_game": said_game, "said_team": code, "said_name": F.when(code.isNotNull(), F.col("team")), "_bad_day": header & (day != "") & parsed.isNull()})
    rows = rows.withColumn("_day", F.when(header & (day != ""), F.coalesce(parsed, F.lit(""))))
    doc = W.partitionBy("doc").orderBy("page", "y")
    upto, before = doc.rowsBetween(W.unboundedPreceding, 0), doc.rowsBetween(W.unboundedPreceding, -1)
    old = F.coalesce(F.last("_day", ignorenulls=True).over(before), F.lit(""))
    starts = F.col("said_game").isNotNull() | (F.col("_day") == "") | (F.col("_day") != old)
    rows = rows.withColumns(
        {
            "_stretch": F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(upto),
            "game_date": F.nullif(F.last("_day", ignorenulls=True).over(upto), F.lit("")),
            "context_page": F.last(F.when(F.col("said_team").isNotNull(), F.col("page")), ignorenulls=True).over(upto),
        }
    )
    one = W.partitionBy("doc", "_stretch").orderBy("page", "y").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_game", F.last("said_game", ignorenulls=True).over(one))
    outside = F.coalesce(F.col("said_team").isNotNull() & ~F.array_contains(F.split("_game", "@"), F.col("said_team")), F.lit(False))
    rows = rows.withColumn("_outside", outside).withColumn("_n", F.sum(outside.cast("int")).over(one))
    seen = F.when(F.col("said_team").isNotNull(), F.struct(F.col("said_team").alias("t"), F.col("said_name").alias("n")))
    rows = rows.withColumn("_team", F.last(seen, ignorenulls=True).over(one))
    return rows.withColumns(
        {
            "game": F.when(F.col("_n") == 0, F.col("_game")),
            "team_code": F.col("_team.t"),
            "team_name": F.col("_team.n"),
            "conflict": F.col("_outside") & (F.col("_n") == 1),
        }
    )


def attributed(cells: DataFrame, slate_day: str = "", slate: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, doubts). rows: kind (PLAYER, SUBMISSION), doc, page, y, game_date, game, team, team_name, player, status, reason,
    reason_ys, context_origin, slate_scope. doubts: doc, page, y, issue, detail, a log of all that was in doubt.

    context_origin tells whether the team was named on an earlier page. A player's reason is what stands in the reason
    lane between the middles to its neighbours, REASON_REACH at most. slate: the games of slate_day that are known.
    """
    walked = _walk(table_lines(cells))
    known = F.col("status").isin(*STATUS.split("|"))
    kind = F.when(known & (F.col("player") != ""), "PLAYER").when(F.col("reason").rlike(PENDING), "SUBMISSION")
    y = F.col("y")
    down = W.partitionBy(*PAGE).orderBy("y")
    anchor = F.when(F.col("kind").isNotNull(), y)
    told = F.when((F.col("reason") != "") & ~F.col("reason").rlike(PENDING), F.struct("y", "reason"))
    above, below = (F.coalesce(f(anchor, ignorenulls=True).over(down.rowsBetween(*r)), other) for f, r, other in ((F.last, (W.unboundedPreceding, -1), y - ALONE), (F.first, (1, W.unboundedFollowing), y + ALONE)))
    near = math.ceil(REASON_REACH + SLACK)
    # neighbours and reasons are read off the page's lines in order; nothing is joined, and each line is walked once
    walked = walked.withColumn("kind", kind).withColumns({"_up": above, "_low": below, "_near": F.collect_list(told).over(down.rangeBetween(-near, near))})
    since, until = F.greatest(y - REASON_REACH, (F.col("_up") + y) / 2) - SLACK, F.least(y + REASON_REACH, (F.col("_low") + y) / 2) + SLACK
    met = F.array_sort(F.filter("_near", lambda r: (r["y"] >= F.col("_from")) & (r["y"] <= F.col("_to"))))
    walked = walked.withColumns({"_from": since, "_to": until}).withColumn("_met", F.when(F.col("kind") == "PLAYER", met)).withColumn("_some", F.size("_met") > 0)
    said, heights = F.array_join(F.transform("_met", lambda r: r["reason"]), " "), F.array_join(F.transform("_met", lambda r: F.round(r["y"], 1).cast("string")), "|")
    walked = walked.withColumns({"_reason": F.when(F.col("_some"), said), "reason_ys": F.when(F.col("_some"), heights)})
    rows = walked.where("kind is not null")
    origin = F.when(F.col("context_page") < F.col("page"), "CROSS_PAGE_CONTINUATION").otherwise("SAME_PAGE_OR_PRIOR_CONTEXT")
    scope = F.when(F.col("game").isNull() | F.col("game_date").isNull(), "UNRESOLVED").when((F.col("game_date") == slate_day) & F.col("game").isin(*slate), "IN_SLATE").otherwise("OUTSIDE_SLATE")
    player = F.col("kind") == "PLAYER"
    out = rows.select(
        "kind", *PAGE, F.round("y", 1).alias("y"), "game_date", "game", F.col("team_code").alias("team"), "team_name",
        F.when(player, F.col("player")).alias("player"), F.when(player, F.col("status")).alias("status"),
        F.when(player, F.col("_reason")).otherwise(F.col("reason")).alias("reason"), "reason_ys", origin.alias("context_origin"), scope.alias("slate_scope"),
    )

    named = lambda c: F.coalesce(F.col(c), F.lit("None"))
    anchored = F.col("kind").isNotNull()
    checks = (
        (~anchored & ((F.col("status") != "") | (F.col("player") != "")), "UNMATCHED_PLAYER_OR_STATUS", F.concat_ws(" / ", "player", "status")),
        (F.col("_bad_day"), "INVALID_GAME_DATE", F.col("date")),
        (F.col("conflict"), "TEAM_MATCHUP_CONFLICT", F.concat_ws(" / ", "said_name", "_game")),
        (anchored & (F.col("game").isNull() | F.col("team_code").isNull()), "MISSING_CONTEXT", F.concat(F.lit("game="), named("game"), F.lit(" team="), named("team_name"))),
        (player & F.col("_reason").isNull(), "REASON_MISSING", F.col("player")),
    )
    doubts = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(issue).alias("issue"), detail.alias("detail"))) for c, issue, detail in checks)))
    return out, walked.select(*PAGE, F.round("y", 1).alias("y"), F.explode(doubts).alias("d")).select(*PAGE, "y", "d.issue", "d.detail")
