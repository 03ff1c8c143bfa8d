"""Readings of distinct words by joins with a lexicon: the set-based form of looking each word up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseworks.functions.text import is_all_upper, is_mixed_case, upper_first


def _stage(number: int, keys: Column) -> Column:
    return F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(number).alias("stage"), k.alias("form")))


def keys(word: Column) -> Column:
    """(stage, form): the forms to look a word up by; the readings of all forms of the first stage that has any are the word's.

    The word itself and, unless it is lower or mixed case, its lower case; for capitals the capitalised form; for words in -in'
    those in -ing.
    """
    word = F.when(F.length(word) > 1, F.translate(word, "\u2019", "'")).otherwise(word)
    low, none = F.lower(word), F.array().cast("array<string>")
    both = (word != low) & ~is_mixed_case(word)
    whole = F.concat(F.substring(word, F.lit(1), F.length(word) - 1), F.when(is_all_upper(word), "G").otherwise("g"))
    return F.concat(
        _stage(0, F.when(both, F.array(word, low)).otherwise(F.array(word))), _stage(1, F.when(is_all_upper(word), F.array(upper_first(low))).otherwise(none)),
        _stage(2, F.when(low.endswith("in'"), F.when(both, F.array(whole, F.lower(whole))).otherwise(F.array(whole))).otherwise(none)),
    )


def readings(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The columns of ``words`` (word distinct) with lemma and pos, a row for each reading; ``lexicon``: form, lemma, pos."""
    found = words.select("*", F.explode(keys(F.col("word"))).alias("__k")).select("*", F.col("__k.stage").alias("__stage"), F.col("__k.form").alias("form")).drop("__k").join(lexicon, "form")
    first = found.withColumn("__first", F.min("__stage").over(Window.partitionBy("word"))).where("__stage = __first")
    return first.select(*words.columns, "lemma", "pos")
