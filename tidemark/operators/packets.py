"""Evidence packets: what a source says about a claim, whether it was known in time, and whether its bytes are still the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import utc_time
from tidemark.functions.text import canonical_url
from tidemark.operators.eligibility import blank

#: worth of an excerpt by where it stands; fixed values
WORTH = {"PARAGRAPH": 4, "JSON_LD_ARTICLEBODY": 4, "HEADING": 3, "TITLE": 3, "META_OG:TITLE": 3, "JSON_LD_HEADLINE": 3}
TRAINING_DENIED = "DENIED_NOT_OVERRIDABLE"


def tokens(c: str | Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def has_run(hay: Column, needle: Column) -> Column:
    """Whether the tokens of needle stand in hay next to each other and in order; an empty needle doesn't, null gives null.

    Tokens hold no spaces, so a run of them is a part of the text that they make; hay is computed once.
    """
    text = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return F.contains(text(hay), text(needle)) & (F.size(needle) > 0)


def _whole(phrase: str) -> str:
    return rf"(?s)^(.*?)(^|[^\p{{L}}\p{{N}}_])({phrase})($|[^\p{{L}}\p{{N}}_])"


def mentions(c: str | Column, phrase: str) -> Column:
    """Whether a phrase stands in a text as whole words."""
    return (F.col(c) if isinstance(c, str) else c).rlike(_whole(phrase))


def snippet(c: str | Column, phrase: str, before: int = 160, after: int = 200) -> Column:
    """The text around the first whole mention of a phrase; null without one."""
    c = F.col(c) if isinstance(c, str) else c
    at = F.length(F.regexp_extract(c, _whole(phrase), 1)) + F.length(F.regexp_extract(c, _whole(phrase), 2))
    start = F.greatest(at - before, F.lit(0))
    end = at + F.length(F.regexp_extract(c, _whole(phrase), 3)) + after
    return F.when(mentions(c, phrase), F.substring(c, start + 1, end - start))


def best_excerpt(excerpts: DataFrame, key: str, player: str, origin: str, destination: str, action: str) -> DataFrame:
    """excerpts(key, kind, text, loc): for each key the excerpt that names the player and tells most of the move.

    Kind, then both places and the action count; of equals the first stands. Even a whole claim is for review only.
    """
    worth = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in WORTH.items() for x in p)), F.col("kind")), F.lit(1))
    seen = {n: F.when(mentions("text", p), 1).otherwise(0) for n, p in (("origin", origin), ("destination", destination), ("action", action))}
    rows = excerpts.where(mentions("text", player)).withColumns(seen)
    rows = rows.withColumn("score", worth + 2 * F.col("origin") + 2 * F.col("destination") + F.col("action"))
    top = rows.groupBy(key).agg(F.max_by(F.struct("kind", "text", "loc", "score", "origin", "destination", "action"), F.struct("score", -F.col("loc"))).alias("b")).select(key, "b.*")
    whole = (F.col("origin") + F.col("destination") + F.col("action")) == 3
    return top.withColumn("claim", F.when(whole, "LOCAL_CLAIM_CANDIDATE_REVIEW_ONLY").otherwise("PARTIAL_CONTENT_REVIEW_ONLY"))


def packet_outcome(types: Sequence[str], actual: str = "artifact_sha256") -> Column:
    """How far an evidence packet can be trusted; the first fault decides. actual: digest of the preserved bytes, null without any."""
    published, tipoff, captured = (utc_time(c) for c in ("published_at", "tipoff_at", "captured_at"))
    return (
        F.when(~F.coalesce(F.col("evidence_type").isin(*types), F.lit(False)), "REJECT_INVALID_TYPE")
        .when(blank("game_id") | blank("source_name") | blank("source_url"), "REJECT_MISSING_IDENTITY")
        .when(published.isNull() | tipoff.isNull() | captured.isNull(), "REJECT_TIMESTAMP")
        .when(published >= tipoff, "REJECT_NOT_PREGAME")
        .when(captured < published, "REJECT_CAPTURE_CHRONOLOGY")
        .when(~F.coalesce(F.lower("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "REJECT_DIGEST")
        .when(blank("source_file"), "REJECT_MISSING_ARTIFACT")
        .when(F.col("source_file").rlike(r"(^|/)\.\.(/|$)|^/"), "REJECT_PATH")
        .when(F.col(actual).isNull(), "REJECT_MISSING_ARTIFACT")
        .when(F.col(actual) != F.lower("sha256"), "REJECT_DIGEST_MISMATCH")
        .otherwise("CANDIDATE_MANUAL_REVIEW")
    )


def training_authorization(rows: DataFrame) -> DataFrame:
    """rows with authorization: always denied, whatever a row says about itself."""
    return rows.withColumns({"authorization": F.lit(TRAINING_DENIED), "eligible": F.lit(False)})


def name_links(names: DataFrame, links: DataFrame) -> DataFrame:
    """names(name_id, name), links(link_id, url, anchor): a row for each link whose last path segment or anchor holds all tokens of
    the name; a name without one gives a row NO_DIRECT_NAME_LINK.

    A name meets only the links that hold its rarest token, and these are looked at whole.
    """
    slug = F.regexp_extract("url", r"([^/?#]*)/?(?:[?#].*)?$", 1)
    sides = F.array(F.struct(F.lit("URL").alias("basis"), slug.alias("t")), F.struct(F.lit("ANCHOR").alias("basis"), F.coalesce("anchor", F.lit("")).alias("t")))
    words = links.select("link_id", F.explode(sides).alias("x")).select("link_id", "x.basis", F.array_distinct(tokens("x.t")).alias("held"))
    words = words.withColumn("token", F.explode("held"))
    rarity = words.groupBy("token").agg(F.count("*").alias("links"))
    wanted = names.select("name_id", F.array_distinct(tokens("name")).alias("all")).withColumn("token", F.explode("all")).join(rarity, "token")
    rarest = wanted.groupBy("name_id", "all").agg(F.min_by("token", F.struct("links", "token")).alias("token"))
    hits = rarest.join(words, "token").where(F.forall("all", lambda t: F.array_contains("held", t)))
    hits = hits.groupBy("name_id", "link_id").agg(F.max("basis").alias("match_basis"))
    out = names.join(hits, "name_id", "left")
    return out.withColumn("review_status", F.when(F.col("link_id").isNull(), "NO_DIRECT_NAME_LINK").otherwise("LINK_REVIEW_ONLY"))


def captured_proposals(captures: DataFrame, proposals: DataFrame) -> DataFrame:
    """captures(url, ...) each with all proposals(url, ...) of the same address in canonical form, or with none."""
    p = proposals.select(canonical_url("url").alias("_url"), *(c for c in proposals.columns if c != "url"))
    return captures.withColumn("_url", canonical_url("url")).join(p, "_url", "left").drop("_url")


def surplus(rows: DataFrame, *key: str) -> DataFrame:
    """One row: keys that occur again, and rows beyond the first of each."""
    n = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("repeated_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def common_rows(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides cut to the keys that the other has too."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi"), right.join(left.select(*keys).distinct(), list(keys), "left_semi")


def cutoff_comparison(early: DataFrame, late: DataFrame, key: str, value: str) -> DataFrame:
    """One row of counts over keys of both sides: matched, increased, decreased, changed."""
    both = early.select(key, F.col(value).alias("a")).join(late.select(key, F.col(value).alias("b")), key)
    return both.agg(F.count("*").alias("matched"), F.count_if(F.col("b") > F.col("a")).alias("increased"), F.count_if(F.col("b") < F.col("a")).alias("decreased"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
