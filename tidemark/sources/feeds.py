"""What providers publish, as rows: paged JSON, feeds, box scores, registries, listings, and facts in a PDF's bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVELOPE = "data array<struct<id string, date string>>, meta struct<next_cursor string>"
BOXSCORE = "boxscore struct<players array<struct<team struct<id string>, statistics array<struct<athletes array<struct<athlete struct<id string>, stats array<string>>>>>>>>"


def envelope_games(pages: DataFrame, source: str, page: str, body: str) -> DataFrame:
    """source, id, tipoff and status of the games of a source's pages; a game without a time has tipoff MISSING.

    COMPLETE if the source's last page names no next one, else INCOMPLETE_PAGINATION; INVALID_JSON where a page isn't one.
    """
    rows = pages.withColumn("_b", F.from_json(body, ENVELOPE))
    state = rows.groupBy(source).agg(F.max_by(F.col("_b.meta.next_cursor").isNull(), page).alias("_last"), F.max(F.col("_b.data").isNull()).alias("_bad"))
    status = F.when(F.col("_bad"), "INVALID_JSON").when(F.col("_last"), "COMPLETE").otherwise("INCOMPLETE_PAGINATION")
    games = rows.select(source, F.explode_outer("_b.data").alias("_g")).join(state, source)
    return games.select(source, F.col("_g.id").alias("id"), F.coalesce("_g.date", F.lit("MISSING")).alias("tipoff"), status.alias("status"))


def item_links(rows: DataFrame, body: str) -> DataFrame:
    """rows with a row for each item's link: link, nth from 0, kind RSS or ATOM; bodies of neither kind give none."""
    kind = F.when(F.col(body).rlike(r"(?i)^\s*(<\?xml[^>]*>\s*)?<rss\b"), "RSS").when(F.col(body).rlike(r"(?i)^\s*(<\?xml[^>]*>\s*)?<feed\b"), "ATOM")
    known = rows.withColumn("kind", kind).where("kind is not null")
    links = F.when(F.col("kind") == "RSS", F.xpath(body, F.lit("/rss/channel/item/link/text()"))).otherwise(F.xpath(body, F.lit("/feed/entry/link/@href")))
    return known.select(*rows.columns, "kind", F.posexplode(links).alias("nth", "link")).withColumn("nth", F.col("nth").cast("long"))


def boxscore_athletes(rows: DataFrame, body: str) -> DataFrame:
    """rows with a row for each athlete listed: team_id, athlete_id, stats, and played, whether any figure is a number."""
    rest = [c for c in rows.columns if c != body]
    out = rows.select(*rest, F.explode_outer(F.from_json(body, BOXSCORE)["boxscore"]["players"]).alias("t"))
    out = out.select(*rest, F.col("t.team.id").alias("team_id"), F.explode_outer("t.statistics").alias("s"))
    out = out.select(*rest, "team_id", F.explode_outer("s.athletes").alias("a"))
    played = F.coalesce(F.exists("a.stats", lambda v: v.try_cast("double").isNotNull()), F.lit(False))
    return out.select(*rest, "team_id", F.col("a.athlete.id").alias("athlete_id"), F.col("a.stats").alias("stats"), played.alias("played"))


def registry_entries(rows: DataFrame, body: str) -> DataFrame:
    """rows with id, full_name and status of a registry's entries: OK, INVALID_ID (no positive whole number) or BLANK_NAME."""
    out = rows.withColumn("_e", F.from_json(body, "id string, full_name string"))
    number = F.when(F.col("_e.id").rlike(r"^\d+$"), F.col("_e.id").try_cast("long"))
    status = F.when(number.isNull() | (number <= 0), "INVALID_ID").when(F.coalesce(F.trim("_e.full_name"), F.lit("")) == "", "BLANK_NAME").otherwise("OK")
    return out.select(*(c for c in rows.columns if c != body), number.alias("id"), F.trim("_e.full_name").alias("full_name"), status.alias("status"))


def section_rows(rows: DataFrame, html: str, heading: str) -> DataFrame:
    """rows with text and row (from 1) of the table rows that stand after a heading row of this text and before the next heading."""
    rest = [c for c in rows.columns if c != html]
    each = rows.withColumn("_tr", F.regexp_extract_all(html, F.lit(r"(?s)(<tr[^>]*>.*?</tr>)"), 1))
    plain = F.transform("_tr", lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"\s+", " ")))
    each = each.withColumn("_text", plain)
    places = F.filter(F.transform("_tr", lambda t, i: F.when(F.contains(t, F.lit("<th")), i)), lambda i: i.isNotNull())
    opens = F.filter(places, lambda i: F.get("_text", i) == heading)
    each = each.withColumn("_from", F.try_element_at(opens, F.lit(1))).where("_from is not null")
    each = each.withColumn("_to", F.coalesce(F.array_min(F.filter(places, lambda i: i > F.col("_from"))), F.size("_tr")))
    inside = F.slice("_text", F.col("_from") + 2, F.col("_to") - F.col("_from") - 1)
    return each.select(*rest, F.posexplode(inside).alias("row", "text")).withColumn("row", F.col("row").cast("long") + 1)


def pdf_facts(content: str) -> list[Column]:
    """version, created (the digits of the creation date) and status of a file's bytes; NOT_PDF without the mark at their start."""
    text = F.decode(F.col(content), "ISO-8859-1")
    is_pdf = text.startswith("%PDF-")
    fact = lambda pattern: F.when(is_pdf, F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))
    return [fact(r"^%PDF-(\d\.\d)").alias("version"), fact(r"/CreationDate\s*\(D:(\d{8,14})").alias("created"), F.when(is_pdf, "OK").otherwise("NOT_PDF").alias("status")]
