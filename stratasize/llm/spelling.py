"""Spelling variants: words one edit apart, found by the one-edit neighbourhoods of words over a reduced alphabet."""

from __future__ import annotations

import string
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasize.llm.common import scratch, shuffle_partitions, written

#: Letters besides a-z, and how long and frequent a word is at least.
_OTHERS = "".join(map(chr, range(0xC0, 0x100)))
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One run in so many loses a letter, by a hash of document and run.
LOSES_ONE_IN = 31
#: Symbols of the reduced alphabet; a form is so many times as frequent as its variant.
SYMBOLS, TIMES = 8, 10


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of at least 7, in lower case, with their counts from 2 on; of a run whose hash with its
    document's id is a multiple of 31 one letter is deleted first. Counts are combined before they travel."""
    low = F.translate(text_col, string.ascii_uppercase, string.ascii_lowercase)
    # Shorter runs can't become words; a match of the pattern is a whole run all the same.
    runs = F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("at"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("at", "run").cast("binary"))
    gone = (h % F.length("run")).cast("int")
    left = F.concat(F.substring(F.col("run"), F.lit(1), gone), F.substring(F.col("run"), gone + 2, F.length("run")))
    found = rows.select(F.when(h % LOSES_ONE_IN == 0, left).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """A word with each letter replaced by its symbol, one of a few by a hash of the letter."""
    letters = string.ascii_lowercase + _OTHERS
    return F.translate(word, letters, "".join(chr(ord("0") + zlib.crc32(c.encode()) % symbols) for c in letters))


def neighbourhood(word: Column, symbols: int = SYMBOLS) -> Column:
    """A reduced word and all reduced words that one deleted, replaced or inserted symbol makes of it, each once."""
    every = F.array(*[F.lit(chr(ord("0") + i)) for i in range(symbols)])
    before, after = (lambda i: F.substring(word, F.lit(1), i)), (lambda i: F.substring(word, i + 1, F.length(word)))
    at, gaps = F.sequence(F.lit(0), F.length(word) - 1), F.sequence(F.lit(0), F.length(word))
    less = F.transform(at, lambda i: F.concat(before(i), after(i + 1)))
    other = F.flatten(F.transform(at, lambda i: F.transform(every, lambda c: F.concat(before(i), c, after(i + 1)))))
    more = F.flatten(F.transform(gaps, lambda i: F.transform(every, lambda c: F.concat(before(i), c, after(i)))))
    return F.array_distinct(F.concat(less, other, more))


def near_words(known: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words (word, n) that are exactly one edit apart, once.

    Words one edit apart are one edit apart or equal in a reduced alphabet as well. So each word meets the words whose
    reduced form lies in the neighbourhood of its own, and pairs are checked on the words themselves. A pair of reduced
    words is in both neighbourhoods; that of the longer one keeps it, or of two of one length that of the greater, which
    leaves the smaller half.
    """
    # Words are few bytes and much work, so they are dealt to all tasks first.
    own = known.repartition(shuffle_partitions(known.sparkSession), "word").withColumn("__r", reduced(F.col("word"), symbols))
    left = own.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "__r", F.explode(neighbourhood(F.col("__r"), symbols)).alias("__key"))
    left = left.where((F.length("__key") < F.length("__r")) | ((F.length("__key") == F.length("__r")) & (F.col("__key") <= F.col("__r"))))
    left = left.select("a", "a_n", F.xxhash64("__key").alias("__k"))
    right = own.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.xxhash64("__r").alias("__k"))
    met = left.join(right, "__k").where(F.levenshtein("a", "b", 1) == 1)
    # Words of one reduced form meet twice.
    return met.where((F.col("a") < F.col("b")) | (reduced(F.col("a"), symbols) != reduced(F.col("b"), symbols))).select("a", "a_n", "b", "b_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last. Each round doubles the steps; a form is at least ten times as
    frequent as its word, so a count of 64 bits has no more than 18 steps and five rounds are enough."""
    found = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        next_ = found.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        step = written(found.join(next_, F.col("root") == F.col("__word"), "left").select("word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("more")), "forms")
        found = step.select("word", "root")
        if step.where("more").isEmpty():
            return found


def group_variants(docs: DataFrame, symbols: int = SYMBOLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words() of docs with their near words: word, n, n_near (near words), form (the most frequent near word, of equal
    ones the first, if it is ten times as frequent), form_n, root (the form of the form, and so on; the word itself
    without one).

    Work: the vocabulary, not the corpus, is joined; each word sends its neighbourhood (2 * symbols for each letter) as
    hashes, and few of them meet a word, the fewer the more symbols. A word's near words are counted where they meet, and
    a form has no more variants than its own neighbourhood holds, so no key gathers many rows.

    Nulls: a null text has no words; a null id counts as an empty text in the hash. Very long texts are read whole, and a
    very long run is a word like any other. Repeated rows count as often as they are there. Empty table: empty result.
    Other columns of docs take no part.
    """
    with scratch(docs.sparkSession) as keep:
        known = written(words(docs, id_col, text_col), "words")
        pairs = near_words(known, symbols)
        both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("form"), F.col("b_n").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("form"), F.col("a_n").alias("n")))).alias("p"))
        near = both.groupBy("p.word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("p.n")).alias("minus"), F.col("p.form").alias("form"))).alias("best"))
        near = near.select(F.col("word").alias("__word"), "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))
        found = known.join(near, F.col("word") == F.col("__word"), "left").drop("__word")
        takes = F.coalesce(F.col("form_n") >= TIMES * F.col("n"), F.lit(False))
        found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n"))
        found = written(found, "near-words")
        roots = _roots(found.where("form IS NOT NULL")).select(F.col("word").alias("__word"), "root")
        found = found.join(roots, F.col("word") == F.col("__word"), "left").withColumn("root", F.coalesce("root", "word")).drop("__word")
        return keep(found, "spelling-variants")
