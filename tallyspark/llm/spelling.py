"""Spelling variants: each word of the corpus with the frequent word that it is one edit away from.

Words come from whole texts: runs of ``LETTERS`` with only A to Z lowered.  A run that its document's
hash marks as damaged (``damage`` divides the unsigned crc32 of ``<doc_id>:<run>``) loses one letter.
What then has ``min_length`` code points and occurs ``min_count`` times is vocabulary.

Search is by a reduced alphabet: every letter stands for one of ``symbols`` symbols (its code point's
remainder), so a word becomes a reduced word.  Two words that differ by one edit have reduced words that are equal
or differ by one edit.  Each word therefore generates the full one-edit neighbourhood of its reduced word
(deletions, replacements and insertions of all symbols, and itself), which is joined with the reduced
vocabulary; every pair that meets is verified on the original strings.  Of two neighbouring reduced words only
the smaller one generates the pair, as each lies in the neighbourhood of the other.  Nothing is capped: a word of
many neighbours only has more rows, and the sums over them are combined before each shuffle.

A form is the near word of largest count, if that is at least ``ratio`` times the word's own.  Counts
grow by that ratio along a chain of forms, which bounds its length by a logarithm; roots are found by
doubling pointers.

Nulls: a null text has no words; a null id is written as an empty string in the hash.  Empty texts and texts without letters give
nothing.  Ties in a form's count: the smallest word in code-point order.  Repeated rows count each time.
Empty tables: no rows.  Very long texts and words: no limit.  Other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, text_or_empty

LETTERS = "A-Za-zÀ-ÿ"
#: What can stand in a word: lower-case ASCII letters and all of U+00C0 to U+00FF.
ALPHABET = string.ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))


def spelled(docs: DataFrame, damage: int) -> DataFrame:
    """One row ``word`` for each run of letters, damaged ones without the letter that their hash names."""
    lowered = F.translate(text_or_empty("text"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    mark = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    marked = runs.select("run", mark.alias("mark"))
    at = (F.col("mark") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return marked.select(F.when(F.col("mark") % damage == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """``word`` and ``n`` of the words that are long and frequent enough."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def symbol(letter: str, symbols: int) -> str:
    return string.ascii_lowercase[ord(letter) % symbols]


def reduced(word: str | Column, symbols: int) -> Column:
    return F.translate(word, ALPHABET, "".join(symbol(c, symbols) for c in ALPHABET))


def neighbourhood(known: DataFrame, symbols: int) -> DataFrame:
    """Rows ``word``, ``n``, ``code`` as ``word``, ``n``, ``same``, ``near``: the code and what is one edit away and greater.

    Those come once each.  At a place with the symbol ``here``, replacing it or inserting before it gives a greater
    string just if the new symbol is greater; deleting it does if the next symbol is greater.  (Among
    equal neighbours the last is deleted, and a symbol is inserted behind its equals.)  What is smaller has this
    code in its own neighbourhood.
    """
    letters = F.array(*(F.lit(symbol(chr(i), symbols)) for i in sorted(range(ord("a"), ord("a") + symbols), key=lambda i: symbol(chr(i), symbols))))
    places = known.select("word", "n", "code", F.explode(F.sequence(F.lit(0), F.length("code"))).alias("i"))
    parts = places.select(
        "word", "n", F.substring(F.col("code"), F.lit(1), F.col("i")).alias("before"), F.substring(F.col("code"), F.col("i") + 1, F.lit(1)).alias("here"),
        F.substring(F.col("code"), F.col("i") + 2, F.length("code")).alias("after"),
    )
    rank = F.when(F.col("here") == "", 0).otherwise(F.ascii("here") - ord("a") + 1)
    put = parts.select("word", "n", "before", "here", "after", F.explode(F.slice(letters, rank + 1, symbols)).alias("new"))
    inserted, replaced = F.concat("before", "new", "here", "after"), F.concat("before", "new", "after")
    put = put.select("word", "n", F.explode(F.when(F.col("here") == "", F.array(inserted)).otherwise(F.array(inserted, replaced))).alias("near"))
    deleted = parts.where(F.substring("after", 1, 1) > F.col("here")).select("word", "n", F.concat("before", "after").alias("near"))
    edited = put.unionAll(deleted).select("word", "n", F.lit(False).alias("same"), "near")
    return edited.unionAll(known.select("word", "n", F.lit(True).alias("same"), F.col("code").alias("near")))


def near_pairs(vocab: DataFrame, symbols: int) -> DataFrame:
    """Every pair of words one edit apart, once: ``word``, ``n``, ``other``, ``other_n``."""
    known = vocab.select("word", "n", reduced("word", symbols).alias("code"))
    asked = neighbourhood(known, symbols).select("word", "n", "same", F.xxhash64("near").alias("key"))
    held = known.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.xxhash64("code").alias("key"))
    met = asked.join(held, "key").where(~F.col("same") | (F.col("word") < F.col("other")))
    return met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """``word`` and ``root`` for rows ``word``, ``form``: counts below ``most`` and their growth bound the doublings."""
    chain = forms.select("word", F.col("form").alias("root"))
    links = max(1, math.ceil(math.log(max(most, 1), ratio)))
    for _ in range(max(1, math.ceil(math.log2(links)))):
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = keep(chain.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return chain


def variants(
    docs: DataFrame, *, damage: int = 199, min_length: int = 6, min_count: int = 5, ratio: int = 5, symbols: int = 6
) -> DataFrame:
    """One row per word of the vocabulary: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    vocab = keep(vocabulary(spelled(docs, damage), min_length, min_count), "vocabulary")
    pairs = near_pairs(vocab, symbols)
    both = pairs.select(
        F.explode(
            F.array(
                F.struct("word", F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("near")).alias("best")),
                F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("rank"), F.col("word").alias("near")).alias("best")),
            )
        ).alias("side")
    ).select("side.*")
    found = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    lifted = -F.col("best.rank") >= ratio * F.col("n")
    formed = keep(
        vocab.join(found, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(lifted, F.col("best.near")).alias("form"), F.when(lifted, -F.col("best.rank")).alias("form_n"),
        ),
        "forms",
    )
    most = vocab.agg(F.max("n")).first()[0] or 1
    chain = roots(formed.where("form is not null"), most, ratio)
    return formed.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
