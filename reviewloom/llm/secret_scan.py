"""Secrets in texts: an inverted index of trigrams chooses the texts in which a rule's pattern can match at all.

Each pattern gives a Boolean query over trigrams that every match must hold (an OR of ANDs).  The index keeps postings
(trigram, id) of the trigrams that some rule asks for; postings of a query are intersected per id by one aggregation,
which combines before the shuffle, so a trigram of a third of all texts is no hot group.  Only candidates are searched
by the pattern; rules without mandatory trigrams search every text.  DataFrame functions only.

Spans count code points, the end exclusive, leftmost and without overlap per rule.  Patterns have to mean the same in
Java and Python; ``(?i)`` folds ASCII letters only.

Odd input: null and empty texts have no spans; rows of a null id and rows that share an id are kept one by one (they
share candidates, which only costs time); texts of any length are read whole, places are summed in blocks so that many
matches in one text cost no square; an empty table gives no rows; columns beside id and text are not looked at.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STRINGS = 256  # literal strings or ANDs of a query; beyond, a part of the pattern counts as unknown
BLOCK = 128  # matches whose places are summed one after the other


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts where its ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Where a match is one run of characters, ``+`` and a least length say the same as a counted repetition.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
    Rule("prefixed", r"(?:gh[opsu]_|xox[abp]-|AIza|sk_live_|glpat-)[A-Za-z0-9_-]{20,}"),
)
RULES = BASE + ADDED


# --- trigram queries of patterns: a query is a frozenset of ANDs, each a frozenset of trigrams; TRUE asks for nothing

TRUE = frozenset([frozenset()])


def _either(a: frozenset, b: frozenset) -> frozenset:
    ands = a | b
    return frozenset(x for x in ands if not any(y < x for y in ands))


def _both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > MOST_STRINGS:
        return min(a, b, key=len)
    out = frozenset()
    for x, y in product(a, b):
        out = _either(out, frozenset([x | y]))
    return out


def _holds(strings: frozenset[str]) -> frozenset:
    """What holds of a text with one of these strings in it."""
    out = frozenset()
    for s in strings:
        out = _either(out, frozenset([frozenset(s[i:i + 3] for i in range(len(s) - 2))]))
    return out


def _fold(code: int) -> str:
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def _class_strings(items) -> frozenset[str] | None:
    """The characters of a class, folded, or None where they are many or not listed."""
    found: set[str] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            found.add(_fold(value))
        elif str(op) == "RANGE" and value[1] - value[0] < 8:
            found.update(_fold(c) for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(found) if len(found) <= 8 else None


def _walk(parsed) -> tuple[frozenset[str] | None, frozenset]:
    """(all strings the pattern can match, or None; its query)."""
    run, query, exact = frozenset([""]), TRUE, True  # the literal strings that end here, what was asked before

    def cut() -> None:
        nonlocal run, query, exact
        query, run, exact = _both(query, _holds(run)), frozenset([""]), False

    for op, value in parsed:
        name = str(op)
        strings, asked = None, TRUE
        if name == "LITERAL":
            strings = frozenset([_fold(value)])
        elif name == "IN":
            strings = _class_strings(value)
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            strings = frozenset([""])
        elif name == "SUBPATTERN":
            strings, asked = _walk(value[-1])
        elif name == "ATOMIC_GROUP":
            strings, asked = _walk(value)
        elif name == "BRANCH":
            parts = [_walk(p) for p in value[1]]
            if all(s is not None for s, _ in parts):
                strings = frozenset().union(*[s for s, _ in parts])
            else:
                asked = frozenset()
                for s, q in parts:
                    asked = _either(asked, _both(q, _holds(s)) if s is not None else q)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = value
            inner, inside = _walk(body)
            if low == 0 and high == 1 and inner is not None:
                strings = inner | {""}
            elif low >= 1 and inner is not None:  # the first copies stand right behind what came before, then anything
                copies = inner
                for _ in range(low - 1):
                    if len(copies) * len(inner) > MOST_STRINGS or len(next(iter(copies))) > 64:
                        break
                    copies = frozenset(a + b for a, b in product(copies, inner))
                else:
                    strings = copies if low == high else None
                if strings is None and len(run) * len(copies) <= MOST_STRINGS:
                    run = frozenset(a + b for a, b in product(run, copies))
            elif low >= 1:
                asked = inside
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = frozenset(a + b for a, b in product(run, strings))
        else:
            cut()
            query = _both(query, asked if strings is None else _holds(strings))
    return (run, TRUE) if exact else (None, _both(query, _holds(run)))


def trigram_query(pattern: str) -> frozenset:
    """The ORed ANDs of lower-case trigrams that a text must hold for the pattern to match; TRUE where nothing is sure."""
    from re import _parser  # the parse tree of the standard library; patterns are not parsed here

    strings, query = _walk(_parser.parse(re.sub(r"^\(\?i\)", "", pattern)))
    query = query if strings is None else _holds(strings)
    return TRUE if frozenset() in query else query


# --- the index

def trigrams_of(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for conj in trigram_query(r.pattern) for t in conj})


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, id) of the given trigrams; texts count with A-Z as a-z."""
    wanted = F.array(*[F.lit(t) for t in trigrams]) if trigrams else F.array().cast("array<string>")
    # an array of one text, so that it is folded once and not once a trigram
    low = F.array(F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase))
    held = F.transform(low, lambda text: F.filter(wanted, lambda t: F.contains(text, t)))[0]
    return docs.select(F.col(id_col).alias("id"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, kinds): the rules that ask for trigrams and whose query the postings of an id satisfy."""
    asked = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        for number, conj in enumerate(sorted(map(sorted, query)) if query != TRUE else []):
            # an AND may ask for fewer trigrams than it could: 62 fill a long
            parts = conj[:62]
            asked += [(t, rule.kind, number, 1 << bit, (1 << len(parts)) - 1) for bit, t in enumerate(parts)]
    plan = index.sparkSession.createDataFrame(asked, "trigram string, kind string, conj int, bit long, full long")
    # the plan is as long as the rules, whatever the texts
    hits = index.join(F.broadcast(plan), "trigram").groupBy("id", "kind", "conj", "full").agg(F.bit_or("bit").alias("bits"))
    return hits.where("bits = full").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


# --- verification

def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where it is used inside other functions' loops."""
    return F.transform(F.array(value), use)[0]


def _places(lengths: Column) -> Column:
    """Where items of these lengths start, one behind the other: within blocks, then block by block."""
    def running(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, start, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def summed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, v: a + v))
        return F.flatten(F.zip_with(blocks, running(sums, F.lit(0).cast("long")), running))

    def cut(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(values, at + 1, BLOCK))

    return _once(_once(lengths, cut), summed)


def rule_spans(text: Column, rule: Rule) -> Column:
    """The spans of one rule in a text: what lies between matches gives their places."""
    pattern = F.lit(rule.pattern)
    size = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m).cast("long"))
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m) >= rule.least)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g).cast("long"))  # one more than matches

    def placed(found: Column) -> Column:
        at = _places(F.transform(found, lambda m: m["gap"] + m["size"]))
        return F.zip_with(found, at, lambda m, a: F.struct(
            (a + m["gap"]).alias("start"), (a + m["gap"] + m["size"]).alias("end"), F.lit(rule.kind).alias("kind"), m["kept"].alias("kept")))

    found = F.zip_with(F.arrays_zip(size.alias("size"), kept.alias("kept")), gaps, lambda m, g: F.struct(g.alias("gap"), m["size"].alias("size"), m["kept"].alias("kept")))
    spans = _once(F.filter(found, lambda m: m["size"].isNotNull()), placed)
    spans = F.transform(F.filter(spans, lambda s: s["kept"]), lambda s: F.struct(s["start"], s["end"], s["kind"]))
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans``: an array of (start, end, kind), by rule, then start."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = candidates(trigram_index(rows, trigrams_of(rules), "id"), rules).withColumnRenamed("id", "chosen_id")
    rows = rows.join(chosen, F.col("id").eqNullSafe(F.col("chosen_id")), "left")

    def spans(rule: Rule) -> Column:
        found = rule_spans(F.col("text"), rule)
        if trigram_query(rule.pattern) == TRUE:
            return found
        return F.when(F.array_contains("kinds", rule.kind), found).otherwise(F.array().cast(SPANS))

    return rows.select(F.col("id").alias(id_col), F.concat(*[spans(r) for r in rules]).alias("spans"))


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of the given kinds, by start, then kind in the order given, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    order = F.transform(own, lambda s: F.struct(s["start"], F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"]).alias("place"), s["end"], s["kind"]))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
