"""Findings, sentences, tokens and look-ups as lines of text, and lines of text as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseworks.functions.text import visible
from proseworks.plans.engine import LANGUAGES

#: Stands behind each token of a line of tokens, a fixed value.
UNIT = "\u241f"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text: a document for each line that is not empty, with ``\\n`` and ``\\t`` read as line break and tab.

    Ids follow the order of files and lines.
    """
    lines = spark.read.text(path).where("value <> ''")
    return lines.select(F.monotonically_increasing_id().alias("doc_id"), unescaped(F.col("value")).alias("text"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def finding_lines(findings: DataFrame) -> DataFrame:
    """doc_id, nth, line: rule, offset, length and replacements (joined by bars), with tabs between; ``findings`` are ordered."""
    return findings.select("doc_id", "nth", F.concat_ws("\t", "rule_id", F.col("offset").cast("string"), F.col("length").cast("string"), F.array_join("replacements", "|")).alias("line"))


def spelling_lines(findings: DataFrame) -> DataFrame:
    """doc_id, nth, line: offset, length and suggestions, with tabs between; ``findings`` are ordered findings of spelling."""
    return findings.select("doc_id", "nth", F.concat_ws("\t", F.col("offset").cast("string"), F.col("length").cast("string"), F.array_join("replacements", "|")).alias("line"))


def sentence_lines(sentences: DataFrame) -> DataFrame:
    """doc_id, sent_id, line: the length of each sentence and its text on one line."""
    return sentences.select("doc_id", "sent_id", F.concat(F.lit("SENT"), F.length("text").cast("string"), F.lit("|"), visible(F.col("text"))).alias("line"))


def token_lines(texts: DataFrame, tokens: Column) -> DataFrame:
    """doc_id, line: all tokens of a text, white space too, each with ``UNIT`` behind it."""
    shown = F.transform(tokens, lambda t: F.concat(visible(t), F.lit(UNIT)))
    return texts.select("doc_id", F.concat(F.lit("WORDS|"), F.array_join(shown, "")).alias("line"))


def contains_lines(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, line: whether the dictionary (form, ...) has each distinct word."""
    own = dictionary.select(F.col("form").alias("word"), F.lit(True).alias("known")).distinct()
    found = words.select("word").distinct().join(own, "word", "left")
    return found.select("word", F.concat_ws("\t", "word", F.when(F.col("known"), "true").otherwise("false")).alias("line"))


def lookup_lines(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, line: stem and tag of each entry (form, stem, tag) of each distinct word, or that there is none."""
    own = dictionary.select(F.col("form").alias("word"), "stem", "tag")
    found = words.select("word").distinct().join(own, "word", "left")
    return found.select("word", F.when(F.col("stem").isNull(), F.concat("word", F.lit("\t<none>"))).otherwise(F.concat_ws("\t", "word", "stem", "tag")).alias("line"))


def dictionary_lines(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, line: the lines of ``contains_lines`` and of ``lookup_lines`` for words that are distinct already, which are asked for once."""
    entry = F.struct("stem", "tag")
    own = dictionary.groupBy(F.col("form").alias("word")).agg(F.collect_list(entry).alias("entries"))
    found = words.join(own, "word", "left")
    known = F.concat_ws("\t", "word", F.when(F.col("entries").isNotNull(), "true").otherwise("false"))
    none = F.concat("word", F.lit("\t<none>"))
    entries = F.transform("entries", lambda e: F.when(e["stem"].isNull(), none).otherwise(F.concat_ws("\t", F.col("word"), e["stem"], e["tag"])))
    return found.select("word", F.explode(F.concat(F.array(known), F.coalesce(entries, F.array(none)))).alias("line"))


def sequence_lines(sequences: DataFrame) -> DataFrame:
    """line: the byte strings (seq) of an automaton in hexadecimal digits."""
    return sequences.select(F.lower(F.hex("seq")).alias("line"))


def languages(spark: SparkSession) -> DataFrame:
    """name, code, longCode of the languages that can be asked for."""
    return spark.createDataFrame([(name, code.partition("-")[0], code) for code, name in sorted(LANGUAGES.items())], "name string, code string, longCode string")
