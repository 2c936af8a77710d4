"""Text features of whole documents; the dictionaries come from other tables."""

from pyspark.sql import functions as F

from . import query, sql_norm, table
from ..functions.fixed_values import CLINICAL_VOCABULARY, DOMAIN_STOPWORDS, EMOTIONS, LABEL_HIGH, LABEL_LOW, TOPIC_CATEGORIES
from ..functions.maths import clip
from ..functions.strings import WS, letter_words, words
from ..operators import text as T
from ..operators.featurise import merged_dictionary, review_features as features_of, row_features as features_of_rows
from ..operators.bounds import settle
from ..operators.profile import rows_with_any_nonzero

TAGS = ["DT", "IN", "JJ", "NN", "VB"]
EMOTION_KEYS = list(EMOTIONS.values())

_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}]+'), lambda t: t <> '')"
_D = _TOKENS.format(c="text")


def _common_words(spark, sf, n):
    """The most frequent words of the conversations, each with a stable bucket 0..9."""
    freq = (
        table(spark, sf, "conversations").select(F.explode(letter_words(F.col("text"))).alias("token"))
        .groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(n)
    )
    bucket = F.conv(F.substring(F.md5("token"), 1, 6), 16, 10).cast("int") % 10
    return settle(freq.select("token", bucket.alias("bucket")), "dictionary")


def _sql_words(n):
    return f"""w AS (SELECT unnest({_D}) AS token FROM conversations),
dict AS (SELECT token, ('0x' || substr(md5(token), 1, 6))::BIGINT % 10 AS bucket
         FROM w GROUP BY token ORDER BY count(*) DESC, token LIMIT {n}),
tok AS (SELECT doc_id, unnest({_D}) AS token FROM documents),
n AS (SELECT doc_id, len({_D}) AS n_tokens FROM documents)"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


_LEN = f"CASE WHEN {sql_norm('text')} = '' THEN 0 ELSE len(regexp_split_to_array({sql_norm('text')}, '{WS}+')) END"


@query(f"SELECT doc_id, length(coalesce(text, ''))::INTEGER AS text_charlen, ({_LEN})::INTEGER AS text_wordlen FROM documents")
def text_lengths(spark, sf):
    return T.add_lengths(_docs(spark, sf), ["text"]).drop("text")


_STOP = ", ".join(f"'{w}'" for w in DOMAIN_STOPWORDS)
_KEYWORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda t: length(t) > 3)"


@query(f"""WITH k AS (SELECT unnest({_KEYWORDS}) AS word FROM documents)
SELECT word, count(*) AS frequency FROM k WHERE word NOT IN ({_STOP}) GROUP BY word ORDER BY frequency DESC, word LIMIT 100""")
def keyword_topn(spark, sf):
    return T.top_words(_docs(spark, sf), "text", 100, DOMAIN_STOPWORDS)


@query(f"""WITH j AS (SELECT lang AS source, CASE quality WHEN 1 THEN 'Alto' WHEN 0 THEN 'Bajo' END AS satisfaction, text
                     FROM documents LEFT JOIN labels USING (doc_id)),
k AS (SELECT source, satisfaction, unnest({_KEYWORDS}) AS word FROM j),
f AS (SELECT * FROM k WHERE word NOT IN ({_STOP})),
c AS (SELECT source, satisfaction, word, count(*) AS frequency FROM f WHERE satisfaction IS NOT NULL GROUP BY 1, 2, 3
      UNION ALL SELECT source, 'All', word, count(*) FROM f GROUP BY 1, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY source, satisfaction ORDER BY frequency DESC, word)::INTEGER AS position FROM c)
SELECT * FROM r WHERE position <= 100""")
def keyword_topn_by_class(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    named = F.when(F.col("quality") == 1, LABEL_HIGH).when(F.col("quality") == 0, LABEL_LOW)
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("source"))
    counts = T.word_frequencies(docs, "text", DOMAIN_STOPWORDS, ("doc_id", "source")).join(labels, "doc_id", "left")
    counts = counts.select("source", named.alias("satisfaction"), "word", "frequency")
    return T.top_words_by_class(counts, "source", "satisfaction", [LABEL_HIGH, LABEL_LOW], 100)


def _ws_words(t):
    return f"list_filter(regexp_split_to_array({t}, '{WS}+'), lambda x: x <> '')"


@query(f"""WITH v AS (SELECT DISTINCT unnest({_ws_words("lower(text)")}) AS word FROM benchmark
                     UNION SELECT unnest([{', '.join("'" + w + "'" for w in CLINICAL_VOCABULARY)}])),
t AS (SELECT doc_id, unnest({_ws_words(sql_norm('text'))}) AS word FROM documents),
h AS (SELECT doc_id, count(*) AS hits FROM t WHERE word IN (SELECT word FROM v) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1)
SELECT d.doc_id, coalesce(hits, 0) / greatest(coalesce(n, 0), 1) AS vocabulary_ratio
FROM documents d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""")
def vocab_ratio(spark, sf):
    words_of = table(spark, sf, "benchmark").select(F.explode(words(F.lower("text"))).alias("word"))
    fixed = spark.createDataFrame([(w,) for w in CLINICAL_VOCABULARY], "word string")
    vocabulary = settle(words_of.union(fixed).distinct(), "vocabulary")
    return T.vocabulary_ratio(_docs(spark, sf), "doc_id", "text", vocabulary, "word", "vocabulary_ratio")


_EMO_CASE = "CASE bucket " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EMOTION_KEYS)) + " END"


def _emotions(spark, sf):
    names = F.array(*[F.lit(e) for e in EMOTION_KEYS])
    lexicon = _common_words(spark, sf, 60).select("token", names[F.col("bucket")].alias("category"))
    counts = T.category_counts(_docs(spark, sf), "doc_id", "text", lexicon, "token", "category", EMOTION_KEYS)
    shares = T.shares_of_hits(counts, "doc_id", EMOTION_KEYS, "text_emolex_")
    return shares.withColumnsRenamed({f"text_emolex_{k}": f"text_emolex_{short}" for short, k in EMOTIONS.items()})


def _sql_emotions():
    cols = ", ".join(
        f"coalesce(count(*) FILTER (cat = '{key}') / nullif(count(cat), 0), 0) AS text_emolex_{short}" for short, key in EMOTIONS.items())
    return f"""{_sql_words(60)},
h AS (SELECT doc_id, {_EMO_CASE} AS cat FROM tok LEFT JOIN dict USING (token)),
e AS (SELECT d.doc_id, {cols} FROM documents d LEFT JOIN h USING (doc_id) GROUP BY 1)"""


@query(f"WITH {_sql_emotions()} SELECT * FROM e")
def lexicon_shares(spark, sf):
    return _emotions(spark, sf)


@query(f"""WITH {_sql_emotions()}
SELECT count(*) AS n_rows, count(*) FILTER (greatest({', '.join('text_emolex_' + s for s in EMOTIONS)}) > 0) AS n_nonzero,
{', '.join(f'round(avg(text_emolex_{s}), 8) AS mean_text_emolex_{s}' for s in EMOTIONS)} FROM e""")
def lexicon_recompute_check(spark, sf):
    columns = [f"text_emolex_{s}" for s in EMOTIONS]
    check = rows_with_any_nonzero(_emotions(spark, sf), columns)
    return check.select("n_rows", "n_nonzero", *[F.round(f"mean_{c}", 8).alias(f"mean_{c}") for c in columns])


@query(f"""WITH {_sql_words(40)},
h AS (SELECT doc_id, bucket % 5 AS tag FROM tok JOIN dict USING (token)),
c AS (SELECT doc_id, {', '.join(f"count(*) FILTER (tag = {i}) AS n_{t}" for i, t in enumerate(TAGS))} FROM h GROUP BY 1)
SELECT n.doc_id, {', '.join(f'nullif(coalesce(n_{t}, 0), 0) / greatest(n_tokens, 1) AS text_ld_{t}' for t in TAGS)}
FROM n LEFT JOIN c USING (doc_id)""")
def tag_densities(spark, sf):
    names = F.array(*[F.lit(t) for t in TAGS])
    tags = _common_words(spark, sf, 40).select("token", names[F.col("bucket") % 5].alias("tag"))
    counts = T.category_counts(_docs(spark, sf), "doc_id", "text", tags, "token", "tag", TAGS)
    return T.shares_of_tokens(counts, "doc_id", TAGS, "text_ld_", absent_is_null=True)


@query(f"""WITH {_sql_words(60)},
h AS (SELECT doc_id, count(*) FILTER (bucket < 5) AS a, count(*) FILTER (bucket >= 5) AS b FROM tok JOIN dict USING (token) GROUP BY 1)
SELECT n.doc_id, coalesce(a, 0) / greatest(n_tokens, 1) AS text_empath_help, coalesce(b, 0) / greatest(n_tokens, 1) AS text_empath_office
FROM n LEFT JOIN h USING (doc_id)""")
def topic_scores(spark, sf):
    topics = ["help", "office"]
    lexicon = _common_words(spark, sf, 60).select("token", F.when(F.col("bucket") < 5, "help").otherwise("office").alias("topic"))
    counts = T.category_counts(_docs(spark, sf), "doc_id", "text", lexicon, "token", "topic", topics)
    return T.shares_of_tokens(counts, "doc_id", topics, "text_empath_")


@query(f"""WITH {_sql_words(60)},
h AS (SELECT doc_id, sum(bucket - 4)::DOUBLE AS s FROM tok JOIN dict USING (token) GROUP BY 1)
SELECT d.doc_id, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 8) AS text_valence
FROM documents d LEFT JOIN h USING (doc_id)""")
def valence_compound(spark, sf):
    valences = _common_words(spark, sf, 60).select("token", (F.col("bucket") - 4).alias("valence"))
    out = T.valence_compound(_docs(spark, sf), "doc_id", "text", valences, "token", "valence", "text_valence")
    return out.withColumn("text_valence", F.round("text_valence", 8))


@query("""SELECT conv_id, count(*) FILTER (role = 'assistant') / count(*) AS role_assistant,
count(*) FILTER (role = 'system') / count(*) AS role_system, count(*) FILTER (role = 'user') / count(*) AS role_user
FROM conversations GROUP BY 1""")
def tag_frequency_columns(spark, sf):
    return T.tag_frequency_columns(table(spark, sf, "conversations"), "conv_id", "role", "role_")


@query("SELECT event_id, greatest(1.0, least(5.0, value / 50)) AS rating FROM events")
def clip_ratings(spark, sf):
    return table(spark, sf, "events").select("event_id", clip(F.col("value") / 50, 1.0, 5.0).alias("rating"))


def review_dictionary(spark, sf):
    """The merged dictionary of the feature queries: common words of the conversations, vocabulary of the benchmark."""
    w = _common_words(spark, sf, 60)
    pick = lambda names, at: F.array(*[F.lit(n) for n in names])[at]
    topic = pick(TOPIC_CATEGORIES, (F.col("bucket") * 2 + F.length("token") % 2).cast("int"))
    vocabulary = table(spark, sf, "benchmark").select(F.explode(words(F.lower("text"))).alias("token"))
    vocabulary = vocabulary.union(spark.createDataFrame([(v,) for v in CLINICAL_VOCABULARY], "token string")).distinct()
    return merged_dictionary(
        w.select("token", pick(TAGS, F.col("bucket") % 5).alias("tag")), w.select("token", pick(EMOTION_KEYS, F.col("bucket")).alias("category")),
        w.select("token", topic.alias("topic")), w.select("token", (F.col("bucket") - 4).alias("valence")), vocabulary)


def review_texts(spark, sf):
    """Documents as reviews: the start as summary, the whole text as pros, what follows the start as cons."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.substring(t, 1, 60).alias("summary"), t.alias("pros"), F.substring(t, F.lit(61), F.length(t)).alias("cons"))


def sql_review_features():
    fields, long = ("summary", "pros", "cons"), ("pros", "cons")
    wordlen = lambda n: f"CASE WHEN {n} = '' THEN 0 ELSE len(regexp_split_to_array({n}, '{WS}+')) END"
    out = []
    for f in fields:
        out += [f"any_value({f}_c)::INTEGER AS {f}_charlen", f"any_value({f}_w)::INTEGER AS {f}_wordlen"]
    letters = {f: f"count(*) FILTER (field = '{f}' AND kind = 'letters')" for f in fields}
    for f in fields:
        out += [f"nullif(count(*) FILTER (field = '{f}' AND bucket % 5 = {i}), 0) / greatest({letters[f]}, 1) AS {f}_ld_{t}" for i, t in enumerate(TAGS)]
    for f in long:
        out += [f"coalesce(count(*) FILTER (field = '{f}' AND bucket = {i}) / nullif(count(bucket) FILTER (field = '{f}'), 0), 0)::DOUBLE AS {f}_emolex_{short}" for i, short in enumerate(EMOTIONS)]
    for f in long:
        v = f"coalesce(sum(bucket - 4) FILTER (field = '{f}'), 0)::DOUBLE"
        out.append(f"round({v} / sqrt({v} * {v} + 15), 8) AS {f}_nltk_sia")
    for f in long:
        out.append(f"count(*) FILTER (field = '{f}' AND known = 1) / greatest(count(*) FILTER (field = '{f}' AND kind = 'words'), 1) AS ODI_related_vocab_{f}")
    for f in long:
        out += [f"count(*) FILTER (field = '{f}' AND bucket * 2 + length(token) % 2 = {i}) / greatest({letters[f]}, 1) AS {f}_empath_{t}" for i, t in enumerate(TOPIC_CATEGORIES)]
    tokens = " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS field, '{kind}' AS kind, unnest({expression}) AS token FROM x" for f in fields
        for kind, expression in (("letters", _TOKENS.format(c=f)), ("words", _ws_words(sql_norm(f)))))
    return f"""w AS (SELECT unnest({_D}) AS token FROM conversations),
dict AS (SELECT token, 'letters' AS kind, ('0x' || substr(md5(token), 1, 6))::BIGINT % 10 AS bucket FROM w GROUP BY token ORDER BY count(*) DESC, token LIMIT 60),
v AS (SELECT DISTINCT unnest({_ws_words("lower(text)")}) AS token FROM benchmark UNION SELECT unnest([{', '.join("'" + w + "'" for w in CLINICAL_VOCABULARY)}])),
vk AS (SELECT token, 'words' AS kind, 1 AS known FROM v),
x AS (SELECT doc_id, substr(coalesce(text, ''), 1, 60) AS summary, coalesce(text, '') AS pros, substr(coalesce(text, ''), 61) AS cons FROM documents),
t AS ({tokens}),
y AS (SELECT doc_id, {', '.join(f'length({f}) AS {f}_c, {wordlen(sql_norm(f))} AS {f}_w' for f in fields)} FROM x)
SELECT y.doc_id, {', '.join(out)}
FROM y LEFT JOIN t ON t.doc_id = y.doc_id LEFT JOIN dict USING (token, kind) LEFT JOIN vk USING (token, kind) GROUP BY y.doc_id"""


@query(f"WITH {sql_review_features()}")
def review_features(spark, sf):
    """Every text feature of a review in one pass, in signature order."""
    out = features_of(review_texts(spark, sf), "doc_id", review_dictionary(spark, sf), TAGS)
    return out.withColumns({c: F.round(c, 8) for c in ("pros_nltk_sia", "cons_nltk_sia")})


@query(f"WITH {sql_review_features()}")
def row_features(spark, sf):
    """The same features from each row alone, as a stream needs them."""
    out = features_of_rows(review_texts(spark, sf), review_dictionary(spark, sf), TAGS).drop("summary", "pros", "cons")
    return out.withColumns({c: F.round(c, 8) for c in ("pros_nltk_sia", "cons_nltk_sia")})
