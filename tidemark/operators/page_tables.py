"""Tables of status reports from the words of their pages: lines, lanes, records, and reasons found again by place.

words(doc, page, width, x0, y0, x1, y1, text): boxes as a page's layout has them. A page is the unit of work for
lines and lanes; only the header's layout, never a game or team, goes on from page to page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.layout import GOES_ON, PAGE_WIDTH, SAME_WIDTH
from tidemark.operators.report_lines import NAME, STATUS, found, teams_named
from tidemark.operators.review import all_reasons

PAGE = ("doc", "page")
#: names of a header's columns, those that it must have in this order, and the lines it is looked for in; fixed values
HEADS = ("player", "status", "reason", "team", "matchup")
NEEDED = ("player", "status", "reason")
HEAD_LINES = 25
LINE = 3.0
DAY, GAME = r"\b(\d{2}/\d{2}/\d{4})\b", r"\b[A-Z]{2,3}@[A-Z]{2,3}\b"
PLAYER = rf"(?<!\w)({NAME}),\s*({NAME})"
CONTEXT = ("game_date", "matchup", "team")


def nearest_lines(words: DataFrame, page: Sequence[str], y: Column, order: Sequence[Column], tolerance: float) -> DataFrame:
    """words with line_y, the height of the line they belong to.

    Words are taken in `order`: each joins the nearest line within tolerance that an earlier word opened (of two as
    near, the older one), else it opens a line at its own height. Only a page's openers are carried along.
    """
    item = F.struct(*(o.alias(f"o{k}") for k, o in enumerate(F.col(c) if isinstance(c, str) else c for c in order)), y.alias("y"), F.struct(*words.columns).alias("word"))
    pages = words.where(y.isNotNull()).groupBy(*page).agg(F.array_sort(F.collect_list(item)).alias("_w"))
    near = lambda o, h: F.abs(o["y"] - h["y"]) <= tolerance
    opened = F.aggregate(
        F.transform("_w", lambda w, i: F.struct(i.alias("i"), w["y"].cast("double").alias("y"))),
        F.array().cast("array<struct<i:int,y:double>>"),
        lambda acc, h: F.when(F.exists(acc, lambda o: near(o, h)), acc).otherwise(F.concat(acc, F.array(h))),
    )
    # the fold is a column of the page's row before its words are told apart, so it is done once a page
    rows = pages.select("_w", opened.alias("_open")).select("_open", F.posexplode("_w").alias("_i", "_w"))
    older = F.filter("_open", lambda o: (o["i"] <= F.col("_i")) & near(o, F.col("_w")))
    mine = F.array_min(F.transform(older, lambda o: F.struct(F.abs(o["y"] - F.col("_w.y")).alias("d"), o["i"].alias("i"), o["y"].alias("y"))))
    return rows.select("_w.word.*", mine["y"].alias("line_y"))


def _joined(*order: str, where: Column | None = None) -> Column:
    """Texts of a group in order, joined by a space."""
    item = F.struct(*order, "text")
    return F.array_join(F.transform(F.array_sort(F.collect_list(item if where is None else F.when(where, item))), lambda w: w["text"]), " ")


def _lined(words: DataFrame) -> DataFrame:
    """words with line_y, taken by rows of three points and from the left."""
    order = [F.bround(F.col("y0") / LINE), "x0", "y0", "text"]
    return nearest_lines(words, PAGE, ((F.col("y0") + F.col("y1")) / 2).cast("double"), order, LINE)


def _columned(lined: DataFrame) -> DataFrame:
    """doc, page, line_y, mode, columns as in page_columns(), and _w, the line's words(x0, text, x1) from the left.

    A page's header is read off windows over its lines, so words are never joined with their page again.
    """
    plain = F.lower(F.regexp_replace("text", "^:+|:+$", ""))
    starts = {h: F.max(F.when(plain == h, F.col("x0"))).alias(h) for h in HEADS}
    rows = lined.groupBy(*PAGE, "line_y").agg(F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("x0", "text", "x1"))).alias("_w"), *starts.values())
    text = F.lower(F.array_join(F.transform("_w", lambda w: w["text"]), " "))
    down, whole = W.partitionBy(*PAGE).orderBy("line_y"), W.partitionBy(*PAGE).orderBy("line_y").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("_nth", F.row_number().over(down))
    said = F.col("_nth") <= HEAD_LINES
    for name in NEEDED:
        said = said & text.contains(name)
    said = said & (F.col("player") < F.col("status")) & (F.col("status") < F.col("reason"))
    rows = rows.withColumn("_head", F.when(said, F.struct("line_y", *HEADS)))
    rows = rows.withColumns({"_own": F.min("_head").over(whole), "width": F.max("width").over(whole)})
    own = F.when(F.col("_own").isNotNull(), F.struct(F.col("width"), F.col("_own")))
    # where the page has none of its own, the lines before with one are those of earlier pages
    rows = rows.withColumn("_last", F.last(own, ignorenulls=True).over(W.partitionBy("doc").orderBy("page", "line_y").rowsBetween(W.unboundedPreceding, -1)))
    fits = F.coalesce(F.abs(F.col("width") - F.col("_last.width")) <= SAME_WIDTH, F.lit(True))
    mode = F.when(F.col("_own").isNotNull(), "DETECTED_HEADER").when(F.col("_last").isNotNull() & fits, "REUSED_COLUMNS").otherwise("SKIPPED_NO_SAFE_COLUMNS")
    used = F.coalesce("_own", F.col("_last._own"))
    heads = F.array_sort(F.filter(F.array(*(F.struct(used[h].alias("x"), F.lit(h).alias("name")) for h in HEADS)), lambda h: h["x"].isNotNull()))
    rows = rows.select(*PAGE, "line_y", "_nth", "_w", mode.alias("mode"), heads.alias("_h"))
    bounds = F.transform("_h", lambda h, i: F.struct(h["name"].alias("name"), F.when(i == 0, float("-inf")).otherwise((F.try_element_at("_h", i)["x"] + h["x"]) / 2).alias("from")))
    # exploded from an array of one, so that what reads them for each word doesn't compute them for each word
    return rows.withColumn("columns", F.explode(F.array(F.when(F.col("mode") != "SKIPPED_NO_SAFE_COLUMNS", bounds)))).drop("_h")


def page_columns(lined: DataFrame) -> DataFrame:
    """For each page: mode (DETECTED_HEADER, REUSED_COLUMNS, SKIPPED_NO_SAFE_COLUMNS) and columns (name, from) in order.

    A header is one of the page's first lines that has the three needed names in order. A page without one uses the
    last header of its document, if that page's width differs by SAME_WIDTH at most.
    """
    return _columned(lined).where("_nth = 1").select(*PAGE, "mode", "columns")


def table_records(words: DataFrame) -> DataFrame:
    """A record for each line with a player and a status: record_id, doc, page, y, CONTEXT, date_provenance, player, status, reason,
    mode, flags, parse_status.

    Context is what the page has said so far; a matchup without a team ends the team. A line that holds only a reason,
    at most GOES_ON below the line before, goes on with the record above; any other line in between ends that. A
    document with one date gives it to records that have a matchup and none, marked as inferred.
    """
    at = _columned(_lined(words)).where("columns is not null")
    name_of = lambda w: F.try_element_at(F.filter("columns", lambda c: c["from"] <= (w["x0"] + w["x1"]) / 2), F.lit(-1))["name"]
    at = at.withColumn("_w", F.transform("_w", lambda w: F.struct(w["text"].alias("text"), name_of(w).alias("lane"))))
    said_in = lambda c: F.array_join(F.transform(F.filter("_w", lambda w: w["lane"] == c), lambda w: w["text"]), " ")
    rows = at.select(*PAGE, "line_y", "mode", F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("_text"), *(said_in(c).alias(f"_{c}") for c in NEEDED))
    low = F.lower("_text")
    rows = rows.withColumn("_head", low.contains("player") & low.contains("status") & low.contains("reason"))
    day = F.regexp_replace(found(F.col("_text"), DAY, 1), r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$1-$2")
    name = lambda k: F.regexp_extract("_player", PLAYER, k)
    rows = rows.withColumns(
        {
            "_day": F.when(~F.col("_head"), day),
            "_game": F.when(~F.col("_head"), found(F.col("_text"), GAME)),
            "_teams": F.when(~F.col("_head"), teams_named(F.col("_text"))),
            "player": F.when(name(1) != "", F.concat_ws(" ", name(2), name(1))),
            "status": F.upper(found(F.col("_status"), rf"(?i)\b({STATUS})\b", 1)),
        }
    )
    named = F.coalesce(F.size("_teams"), F.lit(0))
    said = F.col("_day").isNotNull() | F.col("_game").isNotNull() | (named > 0)
    is_row = ~F.col("_head") & F.col("player").isNotNull() & F.col("status").isNotNull()
    some = F.col("player").isNotNull() | F.col("status").isNotNull()
    goes_on = ~F.col("_head") & (F.col("_reason") != "") & ~some & ~said & ~F.col("_text").rlike(PLAYER)
    matters = F.col("_head") | (F.col("_reason") != "") | some | said
    down = W.partitionBy(*PAGE).orderBy("line_y")
    upto = down.rowsBetween(W.unboundedPreceding, 0)
    team = F.when(named == 1, F.col("_teams")[0]).when(F.col("_game").isNotNull() & (named == 0), "")
    rows = rows.withColumns(
        {
            "game_date": F.last("_day", ignorenulls=True).over(upto),
            "matchup": F.last("_game", ignorenulls=True).over(upto),
            "team": F.nullif(F.last(team, ignorenulls=True).over(upto), F.lit("")),
            "_row": is_row,
            "_more": goes_on,
        }
    ).where(matters)
    rows = rows.withColumn("_nth", F.sum(F.col("_row").cast("int")).over(upto)).withColumn("_gap", F.col("line_y") - F.lag("line_y").over(down))
    ends = ~F.col("_row") & ~(F.col("_more") & (F.col("_gap") > 0) & (F.col("_gap") <= GOES_ON))
    one = W.partitionBy(*PAGE, "_nth").orderBy("line_y").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_off", F.max(ends.cast("int")).over(one)).where("_nth > 0 and _off = 0")
    head = lambda c: F.max(F.when(F.col("_row"), F.col(c))).alias(c)
    reason = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_reason") != "", F.struct("line_y", F.col("_reason").alias("t"))))), lambda p: p["t"]), " ")
    out = rows.groupBy(*PAGE, "_nth").agg(head("line_y"), head("mode"), *(head(c) for c in (*CONTEXT, "player", "status")), F.nullif(reason, F.lit("")).alias("reason"))
    doc = W.partitionBy("doc")
    least, most = F.min("game_date").over(doc), F.max("game_date").over(doc)
    out = out.withColumn("_only", F.when(least == most, least))
    inferred = F.col("game_date").isNull() & F.col("matchup").isNotNull() & F.col("_only").isNotNull()
    provenance = F.when(inferred, "DOCUMENT_UNIQUE_DATE_INFERRED").when(F.col("game_date").isNotNull(), "EXPLICIT_ROW_CONTEXT").otherwise("UNRESOLVED")
    flags = all_reasons(
        (F.col("game_date").isNull() & ~inferred, "GAME_DATE_UNRESOLVED"),
        (F.col("matchup").isNull(), "MATCHUP_UNRESOLVED"),
        (F.col("team").isNull(), "TEAM_UNRESOLVED"),
        (F.col("reason").isNull(), "REASON_UNRESOLVED"),
        (F.col("mode") == "REUSED_COLUMNS", "INHERITED_COLUMN_LAYOUT_UNVERIFIED"),
        (inferred, "DATE_INFERRED_REVIEW_REQUIRED"),
    )
    mark = F.concat_ws("|", "doc", "page", F.format_string("%.2f", "line_y"), "player")
    return out.select(
        F.substring(F.sha2(mark, 256), 1, 20).alias("record_id"),
        *PAGE,
        F.round("line_y", 2).alias("y"),
        F.when(inferred, F.col("_only")).otherwise(F.col("game_date")).alias("game_date"),
        "matchup",
        "team",
        provenance.alias("date_provenance"),
        "player",
        "status",
        "reason",
        "mode",
        F.array_join(flags, "|").alias("flags"),
        F.when(F.size(flags) > 0, "REVIEW_REQUIRED").otherwise("AUTO_CANDIDATE").alias("parse_status"),
    )


#: where reasons stand, how far from the row's middle their lines and first line may be, and how they begin; fixed values
REASON_LANE = 665.0
REACH, ABOVE, BELOW = 12.0, 10.0, 4.0
OPENINGS = ("Injury/Illness -", "G League -", "Personal Reasons", "Not With Team", "Suspension", "Rest", "Health and Safety", "League Suspension", "Return to Competition")


def recovered_reasons(records: DataFrame, words: DataFrame) -> DataFrame:
    """A proposal for each record(record_id, doc, page, y, reason): decision, proposed_reason, y_min, y_max, notes.

    A record without a reason looks at the reason lane between the middles to the records above and below, REACH at
    most. What stands there is its reason if its first line is near the record and begins like one; else the record is
    left UNRESOLVED. Records with a reason are UNCHANGED. Words meet only the records of their page.
    """
    down = W.partitionBy(*PAGE).orderBy("y", "record_id")
    y = F.col("y")
    rows = records.select("record_id", *PAGE, "y", F.col("reason").alias("old_reason"))
    rows = rows.withColumns({"_from": F.greatest(y - REACH, (F.lag("y").over(down) + y) / 2), "_to": F.least(y + REACH, (y + F.lead("y").over(down)) / 2)})
    given = F.trim(F.coalesce("old_reason", F.lit(""))) != ""
    lane = words.where(F.col("x0") >= F.lit(REASON_LANE) * F.col("width") / PAGE_WIDTH)
    lane = lane.groupBy(*PAGE).agg(F.collect_list(F.struct(((F.col("y0") + F.col("y1")) / 2).cast("double").alias("_c"), "x0", "text", "y0", "y1")).alias("_lane"))
    between = F.filter("_lane", lambda w: (w["_c"] >= F.col("_from")) & (w["_c"] < F.col("_to")))
    met = rows.join(lane, list(PAGE), "left").withColumn("_w", F.when(~given, F.array_sort(between))).drop("_lane")
    met = met.withColumn("_w", F.when(F.size("_w") > 0, F.col("_w")))
    opened = F.aggregate("_w", F.array().cast("array<double>"), lambda acc, w: F.when((F.size(acc) > 0) & (w["_c"] - F.try_element_at(acc, F.lit(-1)) <= LINE), acc).otherwise(F.concat(acc, F.array(w["_c"]))))
    met = met.withColumn("_open", opened)
    placed = F.transform("_w", lambda w: F.struct(F.size(F.filter("_open", lambda o: o <= w["_c"])).alias("line"), w["x0"].alias("x0"), w["_c"].alias("c"), w["text"].alias("text")))
    text = F.trim(F.array_join(F.transform(F.array_sort(placed), lambda w: w["text"]), " "))
    near = F.col("_open")[0].between(y - ABOVE, y + BELOW)
    opens = F.greatest(*(F.startswith(F.col("_said"), F.lit(o)) for o in OPENINGS))
    low, high = F.array_min(F.transform("_w", lambda w: w["y0"])), F.array_max(F.transform("_w", lambda w: w["y1"]))
    out = met.withColumn("_said", text).select("record_id", *PAGE, "y", "old_reason", "_said", low.alias("_low"), high.alias("_high"), near.alias("_near"), opens.alias("_opens"))
    good = F.coalesce(F.col("_near") & F.col("_opens"), F.lit(False)) & ~given
    notes = (
        F.when(given, "")
        .when(F.col("_said").isNull(), "No unambiguous words in reason lane")
        .when(~F.col("_near"), "No reason prefix near player anchor")
        .when(~F.col("_opens"), "Reason prefix not recognized")
        .otherwise("Geometry proposal; compare to original PDF before approval")
    )
    decision = F.when(given, "UNCHANGED").when(good, "PROPOSED_REVIEW_REQUIRED").otherwise("UNRESOLVED")
    only = lambda c: F.when(good, c)
    return out.select("record_id", *PAGE, "y", decision.alias("decision"), only(F.col("_said")).alias("proposed_reason"), only(F.round("_low", 2)).alias("y_min"), only(F.round("_high", 2)).alias("y_max"), notes.alias("notes"))
