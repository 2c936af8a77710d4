"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only.  Spans count code points, the end exclusive; per kind they are leftmost and do not overlap.
The four base kinds are kept whatever their score; the added kinds (IBAN with mod-97, national ids of nine digits)
are kept from a score of ``LEAST`` on.  Null and empty texts have no spans, a null id keeps its row, repeated rows
keep a row each, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.5
NEAR = 40  # code points before a span that are searched for words
LIFT = 0.2

# Possessive parts and the look behind keep one scan of a run of characters; they match what the plain patterns do.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to match at all.
HINTS = {"email": "@", "phone": "+"}
BASE = ("email", "ip", "card", "phone")
START_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": r"e-?mail|contact|write to|@",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|credit|payment",
    "phone": r"phone|tel|call|mobile|fax",
    "iban": r"iban|account|bank|transfer",
    "ssn": r"ssn|social|security|national",
}
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """True where an IBAN without spaces passes its check (ISO 7064, mod 97)."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def add(total: Column, i: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1
        return F.pmod(total * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def confirmed(kind: str, match: Column) -> Column:
    """The checksum or range check of a kind."""
    if kind == "ip":
        return match.rlike(_OCTETS)
    if kind == "card":
        digits = digits_of(match)
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits_of(match)).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def placed(text: Column, matches: Column, pattern: str) -> Column:
    """Matches with their places: what lies between matches gives the distances."""
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,match:string>>").alias("spans"))

    def add(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("match")))).alias("spans"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.aggregate(pairs, start, add, lambda acc: acc["spans"])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans``: an array of (kind, start, end, score), by kind as in PATTERNS, then start."""
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    none = F.array().cast("array<string>")
    found = {
        kind: F.when(F.contains("_text", F.lit(HINTS[kind])) if kind in HINTS else F.lit(True), F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(none)
        for kind, p in PATTERNS.items()
    }
    df = df.select("_id", "_text", *[c.alias(kind) for kind, c in found.items()])

    def spans(kind: str) -> Column:
        def scored(s: Column) -> Column:
            begin = F.greatest(s["start"] - NEAR, F.lit(0))
            near = F.lower(F.substring("_text", (begin + 1).cast("int"), (s["start"] - begin).cast("int")))
            score = F.lit(START_SCORE[kind]) + F.when(near.rlike(CONTEXT[kind]), LIFT).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

        kept = F.filter(placed(F.col("_text"), F.col(kind), PATTERNS[kind]), lambda s: confirmed(kind, s["match"]))
        out = F.transform(kept, scored)
        if kind not in BASE:
            out = F.filter(out, lambda s: s["score"] >= LEAST)
        return F.when(F.size(kind) > 0, out).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>"))

    return df.select(F.col("_id").alias(id_col), F.concat(*[spans(kind) for kind in PATTERNS]).alias("spans"))


def listed(kinds: tuple[str, ...], spans: Column) -> Column:
    """``kind:start:end`` of the given kinds, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
