"""Spelling variants of the words of a corpus, by neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols.  Two words that differ by one inserted, deleted or replaced letter have reduced
words that differ by one symbol at most, so each word sends the full one-edit neighbourhood of its reduced word, which
over few symbols is short, to the reduced vocabulary; the original strings are compared in the join itself.  Each word
takes its most frequent near word as its form where that is ``ratio`` times as frequent, and the last form as its root.

The number of symbols follows the vocabulary, so that a reduced word of nine letters stands for one word or so: work
per word stays bounded as the vocabulary grows.  Corpus counts combine before the shuffle, roots are found by doubling,
with a table written in each round.  Tables of words are never broadcast: Spark takes them for as small as their packed
files, and a table of neighbourhoods for as small as that of its words.

Odd input: null and empty texts have no words; a null id counts as an empty text; repeated rows count each time; ties
go to the smallest word in code-point order; texts of any length are read whole; an empty table gives no rows; columns
beside id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

RUNS = r"[a-zÀ-ÿ]+"  # after A-Z have become a-z
WORDS_A_TASK = 20_000
SYMBOLS = string.ascii_lowercase + string.digits


def corpus_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run) of every run of letters in the texts, A-Z as a-z."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(key.alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUNS), F.lit(0))).alias("run"))


def with_slips(runs: DataFrame, one_in: int) -> DataFrame:
    """``word``: the run, but one in so many loses a letter; which, and which letter, follows from id and run."""
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(h % one_in == 0, slipped).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int, least: int) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def symbols_for(words: int) -> int:
    """So many symbols that reduced words of nine letters are as many as the words, four at least."""
    return max(4, min(len(SYMBOLS), math.ceil(max(words, 1) ** (1 / 9))))


def reduced(word: Column, symbols: int) -> Column:
    """The word with each letter replaced by its symbol."""
    return F.array_join(F.transform(F.split(word, ""), lambda c: F.substring(F.lit(SYMBOLS), F.pmod(F.hash(c), F.lit(symbols)) + 1, F.lit(1))), "")


def neighbourhood(word: Column, symbols: int) -> Column:
    """The word and all strings one edit away from it, over the given number of symbols."""
    alphabet = F.array(*[F.lit(s) for s in SYMBOLS[:symbols]])
    every, gaps = F.sequence(F.lit(0), F.length(word) - 1), F.sequence(F.lit(0), F.length(word))

    def head(i: Column) -> Column:
        return F.substring(word, F.lit(1), i)

    def tail(i: Column) -> Column:
        return F.substring(word, i + 1, F.length(word))

    deleted = F.transform(every, lambda i: F.concat(head(i), tail(i + 1)))
    replaced = F.flatten(F.transform(every, lambda i: F.transform(alphabet, lambda s: F.concat(head(i), s, tail(i + 1)))))
    inserted = F.flatten(F.transform(gaps, lambda i: F.transform(alphabet, lambda s: F.concat(head(i), s, tail(i)))))
    return F.array_distinct(F.concat(deleted, replaced, inserted))


def near_words(words: DataFrame, total: int, symbols: int | None = None) -> DataFrame:
    """(word, n, other, other_n) of all ordered pairs of words that are exactly one edit apart."""
    symbols = symbols or symbols_for(total)
    short = words.where(F.length("word") > 0).repartition(max(1, math.ceil(total / WORDS_A_TASK)), "word")
    short = short.select("word", "n", reduced(F.col("word"), symbols).alias("short"))
    asked = short.select("word", "n", F.explode(neighbourhood(F.col("short"), symbols)).alias("key"))
    asked = asked.select("word", "n", F.xxhash64("key").alias("key"))
    known = short.select(F.xxhash64("short").alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    # a hash met by chance does no harm: the original strings decide
    return asked.join(known.hint("merge"), "key").where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form, following forms to the last; ``forms`` (word, form) must be free of cycles."""
    ahead = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = written(ahead.join(step.hint("merge"), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if ahead.where("moved").isEmpty():
            return ahead.select("word", "root")
        ahead = ahead.select("word", "root")


def variants(words: DataFrame, ratio: int = 5, symbols: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary (word, n) of distinct words."""
    words = written(words.select("word", "n"), "vocabulary")
    best = near_words(words, words.count(), symbols).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    frequent = -F.col("best.less") >= ratio * F.col("n")
    rows = words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"))
    rows = written(rows, "variants")
    last = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least: int = 5, ratio: int = 5,
    slips_one_in: int | None = None, symbols: int | None = None,
) -> DataFrame:
    """The variants among the words of a table of texts; ``slips_one_in`` plants slips of the pen, as a test of the operator."""
    runs = corpus_runs(docs, id_col, text_col).where(F.length("run") >= least_length)  # slips only shorten
    words = with_slips(runs, slips_one_in) if slips_one_in else runs.select(F.col("run").alias("word"))
    return variants(vocabulary(words, least_length, least), ratio, symbols)
