import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from reviewloom.llm.queries import ORACLES, QUERIES
from reviewloom.llm.secret_scan import BASE, RULES, TRUE, Rule, candidates, find_secrets, listed, trigram_index, trigram_query, trigrams_of
from tests.compare import differences, duck
from tests.llm.brute import ascii_lower


def brute(text, rules):
    """(start, end, kind) by rule, then start."""
    out = []
    for rule in rules:
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), m.end(), rule.kind))
    return out


def plain(text):
    """The base kinds by their plain patterns."""
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), m.end(), "assign")] if len(m[2]) >= 6 else []
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return out


def made(seed, n):
    rng = random.Random(seed)
    parts = [
        "password", "PassWd", "secret", "toKen", "api_key", "APIkey", "=", ":", " ", "\"", "'", "abcdef", "x", "token=", "AKIA", "AKIA" + "B7" * 9,
        "0" * 24, "deadbeef", "deadbeef" * 4, "é", "𝄞", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 30, "http://me:pw@host", "eyJabcdefgh1.eyJabcdefgh2.abcdefghij",
        "\n", "K", "ſecret: abcdefgh",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(n)]
    return texts + [None, "", "token: abcdefgh " * 4000 + "é" * 10 + "f" * 100, "secret: token: abcdefghi", "token=token=abcdef"]


def got(df):
    return [[tuple(s) for s in r.spans] for r in df.orderBy("doc_id").collect()]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(spark, duck(sf), QUERIES["op12_trigram_secrets"], ORACLES["op12_trigram_secrets"], sf)[0] == ""


def test_spans_equal_brute_force(spark):
    texts = made(1, 300)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id int, text string, kinds string, id int").repartition(3)
    found = got(find_secrets(df))
    assert found == [brute(t, RULES) for t in texts]
    assert [[s for s in f if s[2] in ("assign", "access", "hex")] for f in found] == [plain(t) for t in texts]
    assert all(any(s[2] == r.kind for f in found for s in f) for r in RULES)


def test_null_and_repeated_ids_keep_their_rows(spark):
    rows = [(None, "token=abcdefg"), (None, "nothing"), (3, "secret: abcdefgh"), (3, "password"), (3, "secret: abcdefgh"), (4, None)]
    out = find_secrets(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    want = sorted((str(i), [tuple(s) for s in brute(t, RULES)]) for i, t in rows)
    assert sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in out) == want


def test_empty_table_and_no_rules(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert got(find_secrets(empty)) == []
    assert got(find_secrets(spark.createDataFrame([(1, "f" * 30)], "doc_id int, text string"), (BASE[2],))) == [[(0, 30, "hex")]]


def test_listing_is_by_start_then_kind(spark):
    df = spark.range(1).select(F.expr("cast(array(struct(5L, 9L, 'hex'), struct(5L, 7L, 'assign'), struct(1L, 2L, 'jwt')) as array<struct<start:bigint,end:bigint,kind:string>>)").alias("s"))
    row = df.select(listed(F.col("s"), ["assign", "access", "hex"]).alias("a"), listed(F.col("s"), ["assign", "access", "hex", "jwt"]).alias("b")).first()
    assert tuple(row) == ("assign:5:7,hex:5:9", "jwt:1:2,assign:5:7,hex:5:9")


@pytest.mark.parametrize("pattern, ands", [
    ("abcd", [{"abc", "bcd"}]), ("ab", None), ("[0-9a-f]{24,}", None), ("a[bc]d", [{"abd"}, {"acd"}]), ("x*abc", [{"abc"}]),
    ("(foo|bar)+z", [{"foo"}, {"bar"}]), ("(foo|x)", None), ("ABC?D", [{"abd"}, {"abc", "bcd"}]), ("(?:abc){2}", [{"abc", "bca", "cab"}]),
    (r"(?<!x)abc\b", [{"abc"}]), ("(?i)ToKen", [{"tok", "oke", "ken"}]), ("abc.def", [{"abc", "def"}]), ("(abc.*|def)x", [{"abc"}, {"def"}]),
])
def test_trigram_queries(pattern, ands):
    query = trigram_query(pattern)
    if ands is None:
        assert query == TRUE
    else:
        assert {frozenset(a) for a in ands} == set(query)


def test_queries_never_miss_a_match():
    rng = random.Random(4)
    patterns = [r.pattern for r in RULES] + ["(ab|a)?bcd(e|f)+g", "a(bc|cb){2,3}d", "[a-c][bc]a{3}", "(a|b|c|ab)*abcabc", "x?abc{2}"]
    texts = ["".join(rng.choices("abcdefg", k=20)) for _ in range(3000)] + [t or "" for t in made(2, 300)]
    for pattern, text in itertools.product(patterns, texts):
        query = trigram_query(pattern)
        if re.search(pattern, text, re.ASCII):
            assert query == TRUE or any(all(t in ascii_lower(text) for t in conj) for conj in query), (pattern, text)


def test_postings_choose_candidates(spark):
    texts = made(6, 120)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    rules = (*RULES, Rule("none", "[a-z]+"))
    index = trigram_index(docs, trigrams_of(rules))
    assert {r.trigram for r in index.collect()} <= set(trigrams_of(rules))
    chosen = {r.id: set(r.kinds) for r in candidates(index, rules).collect()}
    for i, t in enumerate(texts):
        want = {r.kind for r in rules if trigram_query(r.pattern) != TRUE and any(all(x in ascii_lower(t or "") for x in c) for c in trigram_query(r.pattern))}
        assert chosen.get(i, set()) == want
