"""Grouping of spelling variants: words of a corpus that one edit turns into each other.

An edit leaves one half of a word intact, so near words share their first or their last half. The forward
dictionary is sorted by first halves, the dictionary of reversed words by (reversed) last halves; a sort-merge join
scans the ranges of equal halves. What is left of two words of a range differs by one edit again, so a range with too
many words is subdivided by the next or the last half of the rest, as often as needed; each pair that comes out is
verified. Word counts are partial sums in every task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, stored_and_measured

#: A maximal run of these is a word occurrence (fixed by the contract).
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of occurrences one in so many, chosen by hash, loses a letter in the query.
MISSPELT = 199
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 6, 5, 5
#: A range of more words is subdivided while there is something left to divide by.
RANGE_WORDS = 64


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word): each maximal run of letters of each whole text, A-Z lower-cased."""
    runs = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    return runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))


def misspelt(words: DataFrame) -> DataFrame:
    """words (doc_id, word) of which those whose crc32 of ``doc_id:word`` MISSPELT divides lost the letter at that hash modulo their length."""
    h = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), "word").cast("binary"))
    at = (F.col("h") % F.char_length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return words.withColumn("h", h).select("doc_id", F.when(F.col("h") % MISSPELT == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""
    return words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _ends(word: Column, head: Column, tail: Column) -> list[Column]:
    """The keys of a range: its place in the forward and in the reversed dictionary."""
    return [F.substring(word, F.lit(1), head).alias("front"), F.substring(F.reverse(word), F.lit(1), tail).alias("back")]


_KEY = ["m", "head", "tail", "front", "back"]


def _halved(entries: DataFrame) -> DataFrame:
    """Each entry in the two ranges below its own: more letters shared in front, or more at the end."""
    half = F.floor((F.col("m") - F.col("head") - F.col("tail")) / 2).cast("int")
    ways = F.explode(F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("tail") + half).alias("tail"))))
    return entries.select("word", "m", ways.alias("w")).select("word", "m", "w.head", "w.tail", *_ends(F.col("word"), F.col("w.head"), F.col("w.tail")))


def ranges(words: DataFrame, most: int = RANGE_WORDS) -> DataFrame:
    """(word, m, head, tail, front, back): each word in all ranges where near words of it can be.

    m is the length of the shorter of two near words, so a word stands in ranges of its own length and of one less. A range of
    more than ``most`` words is subdivided until it is small or but one letter of m is left open.
    """
    length = F.char_length("word")
    whole = words.select("word", F.explode(F.array(length, length - 1)).alias("m")).select("word", "m", F.lit(0).alias("head"), F.lit(0).alias("tail"))
    now, done = _halved(whole), None
    while True:
        now, _ = stored_and_measured(now, F.count("*").alias("n"))
        large = now.groupBy(*_KEY).agg(F.count("*").alias("size")).where((F.col("size") > most) & (F.col("m") - F.col("head") - F.col("tail") >= 2))
        large, seen = stored_and_measured(large.select(*_KEY), F.count("*").alias("n"))
        if not seen["n"]:
            return now if done is None else done.unionByName(now)
        small = now.join(large, _KEY, "left_anti").select("word", *_KEY)
        done = small if done is None else done.unionByName(small)
        now = _halved(now.join(large, _KEY, "left_semi"))


def near_pairs(words: DataFrame, most: int = RANGE_WORDS) -> DataFrame:
    """(a, b), a before b: each pair of words that exactly one inserted, deleted or replaced code point tells apart, once."""
    entries = stored(ranges(words, most))
    other = entries.toDF("other", *[f"_{k}" for k in _KEY])
    met = (F.col("word") < F.col("other")) & (F.least(F.char_length("word"), F.char_length("other")) == F.col("m")) & (F.levenshtein("word", "other", 1) == 1)
    for k in _KEY:
        met &= F.col(k) == F.col(f"_{k}")
    pairs = entries.join(other.hint("merge"), met).select(F.col("word").alias("a"), F.col("other").alias("b"))
    return pairs.distinct()


def variants(words: DataFrame, ratio: int = FORM_RATIO, rounds: int = 64) -> DataFrame:
    """words (word, n), unique in word, with the form they are a variant of: word, form, root, n, n_near, form_n.

    The form is the near word of largest n (ties: the first in code-point order) if that n is ``ratio`` times the word's
    own or more, else null; the root is the last form of forms. Words without near ones have n_near 0 and are their own roots. Null words are ignored.
    """
    words = stored(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    pairs = near_pairs(words.select("word"))
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    best = both.join(words.toDF("near", "near_n"), "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), "near")).alias("best"))
    met = words.join(best, "word", "left")
    is_form = -F.col("best.low") >= ratio * F.col("n")
    out = stored(met.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.low")).alias("form_n")))
    # n grows with each step along the forms, so chains have ends; their length halves with every round
    up = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        above = up.toDF("root", "above")
        up, seen = stored_and_measured(up.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), "above"), F.count("above").alias("moved"))
        up = up.select("word", "root")
        if not seen["moved"]:
            break
    else:
        raise RuntimeError(f"roots not found after {rounds} rounds")
    return out.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """variants of the words of docs (doc_id, text) after some of their occurrences were misspelt.

    Null and empty texts have no words, a null doc_id is hashed as empty; rows repeated count as often as they stand there. Whole texts
    of any length are read. Empty tables give no rows; extra columns are ignored.
    """
    return variants(vocabulary(misspelt(occurrences(docs))))
