"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

Base kinds are email, ip, card (Luhn) and phone; found leftmost and without overlap within a kind, a proposal
that fails its test is dropped without another try, and what passes always stays. Added kinds are iban (mod 97)
and ssn (no checksum; it needs a context word); they stay from a score of KEEP_SCORE. An iban is as long as its
country's; it is proposed at every place it may start, so no proposal hides another one. Under a country code
that isn't in IBAN_LENGTHS the longest run is tried.

Result rules: offsets count code points, ends are exclusive; null texts count as empty. Spans of different kinds
may overlap. Every row is judged on its own, so repeated rows repeat their result. Other columns are ignored.

At scale: one pass over the rows without a shuffle, all in Spark's own functions. The expressions are written so
that a failed attempt is not repeated inside the same run of characters (\\G and look-behind) and closing loops
are possessive, so very long runs of digits or letters take linear time and constant stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,found:string>>"
MARK = "\uffff"
CONTEXT = 40
KEEP_SCORE = 0.7

#: country codes by the length of their IBANs, registered or in use
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
_OTHER_IBAN = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: the pattern of each kind, and a cheaper one without which a text cannot hold it
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", r"@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "iban": (rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_IBAN}|{_OTHER_IBAN})(?![A-Za-z0-9])))", r"[A-Z]{2}[0-9]{2}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
}
#: score of a confirmed span by itself; a context word adds CONTEXT_BONUS
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.5}
CONTEXT_BONUS = 0.2
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social",
}


def proposals(text: Column, kind: str) -> Column:
    """Matches of a kind's pattern as array<struct<start, end, found>>; those of iban, found ahead, may overlap."""
    pattern, needed = PATTERNS[kind]
    ahead = kind == "iban"
    parts = F.split(F.regexp_replace(F.translate(text, MARK, "?"), pattern, f"{MARK}${1 if ahead else 0}{MARK}"), MARK)
    none = F.array().cast(SPAN)

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("found"))
        at = F.when(acc["inside"], acc["at"]).otherwise(end) if ahead else end
        return F.struct(at.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("out"))
    return F.when(text.rlike(needed), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(none)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check; from the right, every second digit counts double."""

    def add(acc: Column, d: Column) -> Column:
        twice = d.cast("int") * (acc["i"] % 2 + 1)
        return F.struct((acc["i"] + 1).alias("i"), (acc["sum"] + F.when(twice > 9, twice - 9).otherwise(twice)).alias("sum"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda acc: acc["sum"] % 10 == 0)


def mod97(found: Column) -> Column:
    """Whether an IBAN, spaces allowed, leaves 1 by 97 with its first four characters moved to the end."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(acc: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), add) == 1


def _confirmed(kind: str, found: Column) -> Column:
    digits = F.length(_digits(found))
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(x, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return F.when(digits.between(12, 19), luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return digits.between(9, 15)
    if kind == "iban":
        return mod97(found)
    return F.lit(True)


def spans_of(text: Column) -> Column:
    """All spans as array<struct<start, rank, kind, end, score>>, sorted."""
    per_kind = []
    for rank, kind in enumerate(KINDS):

        def good(s: Column) -> Column:
            return _confirmed(kind, s["found"])

        def scored(s: Column) -> Column:
            around = F.concat(F.substr(text, F.greatest(s["start"] + 1 - CONTEXT, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))), F.lit(" "), F.substr(text, s["end"] + 1, F.lit(CONTEXT)))
            bonus = F.when(F.lower(around).rlike(rf"\b(?:{WORDS[kind]})"), CONTEXT_BONUS).otherwise(0.0)
            return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), (bonus + SCORES[kind]).alias("score"))

        spans = F.transform(F.filter(proposals(text, kind), good), scored)
        per_kind.append(spans if rank < 4 else F.filter(spans, lambda s: s["score"] >= KEEP_SCORE))
    return F.array_sort(F.concat(*per_kind))


def find_pii(documents: DataFrame) -> DataFrame:
    """A row for each row of documents: all its columns, and pii, the spans of text."""
    return documents.withColumn("pii", spans_of(F.coalesce("text", F.lit(""))))


def as_line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the mask."""

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, out).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))).otherwise(text)
