"""Scalar functions on names, sentences, addresses and pages, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Latin letters with marks and what they stand for; fixed values
MARKED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
BARE = "aaaaaaceeeeiiiinooooouuuuyy"
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")


def collapsed(c: str | Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def plain_name(c: str | Column) -> Column:
    """A name for matching: no marks, letters and digits only, without generation suffixes."""
    letters = F.trim(F.regexp_replace(F.translate(F.lower(c), MARKED, BARE), "[^a-z0-9]+", " "))
    return F.array_join(F.filter(F.split(letters, " "), lambda w: ~w.isin(*SUFFIXES)), " ")


def first_last(c: str | Column) -> Column:
    """'Last, First' as 'First Last'."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(c, ",", 2)
    return F.when(c.contains(","), F.concat_ws(" ", F.trim(parts[1]), F.trim(parts[0]))).otherwise(c)


@F.pandas_udf(StringType())
def folded(c: pd.Series) -> pd.Series:
    """Full case folding of what compatibility decomposition leaves without marks, white space collapsed: for names beyond plain_name."""
    bare = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))
    return c.map(lambda s: " ".join(bare(s).casefold().split()), na_action="ignore")


def sentences(c: str | Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def has_phrase(c: str | Column, phrase: str) -> Column:
    """Whether a whole phrase occurs, letters of any script bounding it."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(rf"(?U)(?<!\w){phrase}(?!\w)")


def host(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, "://([^/?#:]*)", 1)), r"^www\.", "")


def family(c: str | Column) -> Column:
    """The last two labels of an address's host."""
    return F.regexp_extract(host(c), r"([^.]+\.[^.]+)$", 1)


def canonical_url(c: str | Column) -> Column:
    """Without fragment, query and closing slash; host in lower case."""
    base = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), "/+$", "")
    return F.concat(F.lower(F.regexp_extract(base, "^([^:]*://[^/]*)", 1)), F.regexp_extract(base, "^[^:]*://[^/]*(.*)$", 1))


def visible(html: str | Column) -> Column:
    """What a page shows: scripts, styles and tags out, common entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def links(html: str | Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)


def record_id(*columns: str) -> Column:
    """The first 20 digits of the SHA-256 of the fields joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 20)


#: stages of a transaction by the words that tell them, the first that fits; fixed values
STAGES = (
    ("PENDING_APPROVAL", r"\b(pending|not yet|subject to|awaiting)\b.{0,70}\b(approval|approved|league|physical)|\bnot yet (been )?approved\b"),
    ("REPORTED_OR_AGREED", r"\b(reportedly|reports? say|according to|agreed to|agreement in principle|expected to)\b"),
    ("ANNOUNCED_LANGUAGE_UNVERIFIED", r"\b(officially|announced|has acquired|have acquired|acquires|acquired|completed)\b"),
)
#: what says that a player p went from a team o to a team d; fixed values
MOVES = (
    r"{d}.{0,90}\b(?:acquire[ds]?|obtains?|receive[ds]?)\b.{0,100}{p}.{0,90}\bfrom\b\s+(?:the\s+)?{o}",
    r"{d}.{0,90}\b(?:acquire[ds]?|obtains?|receive[ds]?)\b.{0,100}{p}.{0,100}\bfrom\b\s+(?:the\s+)?{o}",
    r"{o}.{0,90}\b(?:trade[ds]?|send[st]?)\b.{0,100}{p}.{0,90}\bto\b\s+(?:the\s+)?{d}",
    r"{p}.{0,100}\b(?:traded|sent|dealt)\b.{0,90}\bfrom\b\s+(?:the\s+)?{o}.{0,90}\bto\b\s+(?:the\s+)?{d}",
    r"{p}.{0,80}\b(?:traded|sent|dealt)\b.{0,90}\bto\b\s+(?:the\s+)?{d}.{0,90}\bfrom\b\s+(?:the\s+)?{o}",
)


def stage(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit("STAGE_UNKNOWN")
    for name, words in reversed(STAGES):
        out = F.when(c.rlike(f"(?i){words}"), name).otherwise(out)
    return out


def quoted(c: str | Column) -> Column:
    """A value as a pattern that matches just that value."""
    return F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1")


def direction(c: str | Column, who: str | Column, origin: str | Column, dest: str | Column) -> Column:
    """Whether a sentence says, and not merely hints, that who moved from origin to dest.

    origin and dest are arrays of the names a team goes by. Without all three, or where the sentence doesn't name who as a
    whole phrase, there is NO_DIRECTION_PROPOSAL.
    """
    c, who, origin, dest = (F.col(x) if isinstance(x, str) else x for x in (c, who, origin, dest))
    any_of = lambda names: F.concat(F.lit("(?:"), F.array_join(F.transform(names, quoted), "|"), F.lit(")"))
    p, o, d = quoted(who), any_of(origin), any_of(dest)
    pattern = F.lit("(?i)(?:" + "|".join(MOVES) + ")")
    for mark, x in (("{p}", p), ("{o}", o), ("{d}", d)):
        pattern = F.replace(pattern, F.lit(mark), x)
    whole = lambda x: F.coalesce(F.regexp_like(c, F.concat(F.lit(r"(?iU)(?<!\w)"), x, F.lit(r"(?!\w)"))), F.lit(False))
    given = F.coalesce((who != "") & (F.size(origin) > 0) & (F.size(dest) > 0), F.lit(False))
    return (
        F.when(~given | ~whole(p), "NO_DIRECTION_PROPOSAL")
        .when(F.regexp_like(c, pattern), "GRAMMATICAL_DIRECTION_CANDIDATE")
        .when(whole(o) & whole(d), "COOCCURRENCE_ONLY")
        .otherwise("NO_GRAMMATICAL_DIRECTION")
    )
