"""Spelling on the distinct vocabulary, by joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseworks.functions.text import is_mixed_case, is_spell_candidate
from proseworks.operators.nearest import Nearest
from proseworks.session import ship

#: Fixed values of a finding.
RULE_ID, CATEGORY, MESSAGE = "SPELLING_RULE", "TYPOS", "Possible spelling mistake found."
MOST = 8
#: Dictionary words longer than this are found by their pieces, as the deletions of a word grow with the square of its length.
LONG = 20
#: Rule number of spelling findings, behind those of all rules.
AFTER_RULES = 2**31 - 1


def vocabulary(words: DataFrame) -> DataFrame:
    """word, n: spell candidates of ``words`` (word) and how often they occur. Distinct words are judged, as ``n``, in the condition, keeps it behind the count."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.when(F.col("n") > 0, is_spell_candidate(F.col("word"))))


def _member(words: DataFrame, key: Column, entries: DataFrame, name: str) -> DataFrame:
    own = entries.select(F.col("word").alias("__key"), F.lit(True).alias(name)).distinct()
    return words.join(own, key == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(False)))


def _misspelled(words: DataFrame, dictionary: DataFrame, ignore: DataFrame, column: str) -> DataFrame:
    """``words`` with ignored and unknown: whether ``column`` is accepted by a list, or unknown to the dictionary."""
    w, low = F.col(column), F.lower(column)
    for name, key, entries in (("__exact", w, dictionary), ("__low", low, dictionary), ("__ign", w, ignore), ("__ignlow", low, ignore)):
        words = _member(words, key, entries, name)
    unknown = (w != "") & ~w.rlike(r"\p{N}") & ~F.col("__exact") & (is_mixed_case(w) | ~F.col("__low"))
    return words.withColumn("ignored", F.col("__ign") | F.col("__ignlow")).withColumn("unknown", unknown).drop("__exact", "__low", "__ign", "__ignlow")


def flagged(words: DataFrame, dictionary: DataFrame, ignore: DataFrame, prohibit: DataFrame) -> DataFrame:
    """Those of the distinct candidates ``words`` (word, ...) that are misspelled; each list has a column word.

    A list of accepted words wins, then prohibited words are flagged, then those that neither the dictionary nor, for
    words with hyphens, all their parts are known to it.
    """
    checked = _member(_misspelled(words, dictionary, ignore, "word"), F.col("word"), prohibit, "prohibited")
    parts = checked.where("unknown and not ignored and contains(word, '-')").select("word", F.explode(F.split("word", "-")).alias("part"))
    known = _misspelled(parts, dictionary, ignore, "part").groupBy("word").agg(F.bool_and((F.col("part") != "") & (F.col("ignored") | ~F.col("unknown"))).alias("parts_known"))
    return checked.join(known, "word", "left").where(~F.col("ignored") & (F.col("prohibited") | (F.col("unknown") & ~F.coalesce("parts_known", F.lit(False))))).select(*words.columns)


def _without(word: Column, most: int) -> Column:
    """``word`` and all strings that ``most`` (1 or 2) or fewer deletions make of it."""
    def once(w: Column) -> Column:
        return F.transform(F.when(w == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.length(w))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    one = once(word)
    two = [F.flatten(F.transform(F.array_distinct(one), once))] if most == 2 else []
    return F.array_distinct(F.concat(F.array(word), one, *two))


def _swaps(word: Column) -> Column:
    """All strings that one swap of neighbouring characters makes of ``word``."""
    places = F.when(F.length(word) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.length(word) - 1))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.length(word))))


def _pieces(word: Column, edits: int, asked: bool) -> Column:
    """Keys of a long dictionary word: its equal pieces, 2 * ``edits`` + 1 of them, so that one at least stays whole.

    Of an ``asked`` word: what stands at their places, or up to ``edits`` characters before or behind these, for each
    possible length of the dictionary word. Their number does not grow with the word.
    """
    n, number = F.length(word), 2 * edits + 1
    shifts = F.array(*[F.lit(x) for x in (range(-edits, edits + 1) if asked else [0])])
    start = lambda m, i: F.floor(m * i / number).cast("int")
    piece = lambda m, i, x: F.concat(m.cast("string"), F.lit(":"), i.cast("string"), F.lit(":"), F.substring(word, start(m, i) + x + 1, start(m, i + 1) - start(m, i)))
    lengths = F.filter(F.sequence(n - edits, n + edits) if asked else F.array(n), lambda m: m > LONG)
    return F.array_distinct(F.flatten(F.transform(lengths, lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda i: F.transform(shifts, lambda x: piece(m, i, x)))))))


def _within(word: Column, other: Column, edits: int) -> Column:
    """Whether so many edits (deletion, insertion, replacement, swap of neighbours), 1 or 2, lead from one word to the other."""
    far = lambda x, y, k: F.levenshtein(x, y, k) < 0
    if edits == 1:
        return ~far(word, other, 1) | F.array_contains(_swaps(word), other)
    # A swap is the first of two edits, seen from one end or from the other, or both are swaps.
    return ~far(word, other, 2) | F.exists(_swaps(word), lambda x: ~far(x, other, 1)) | F.exists(_swaps(other), lambda x: ~far(word, x, 1)) | F.arrays_overlap(_swaps(word), _swaps(other))


#: Edits that suggestions may be away.
EDITS = 2


def _pairs(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, suggestion, freq, once each: dictionary words that may be within ``EDITS``; a word without any has one row of nulls.

    For words of more than ``LONG`` - ``EDITS`` characters, which are few. Two words within k edits have a string in common that k deletions
    make of each, so an equi-join on such strings finds all pairs; dictionary words longer than ``LONG`` are found by their pieces.
    """
    n, none = F.length("word"), F.array().cast("array<string>")
    w, known_word = F.col("word"), F.col("suggestion")
    asked_keys = F.concat(F.when(n <= LONG + EDITS, _without(w, EDITS)).otherwise(none), F.when(n > LONG - EDITS, _pieces(w, EDITS, True)).otherwise(none))
    own = words.select("word", F.explode(asked_keys).alias("__key"))
    known = dictionary.select(F.col("word").alias("suggestion"), "freq").where(F.length(known_word) > LONG - 2 * EDITS)
    known = known.select("suggestion", "freq", F.explode(F.when(F.length(known_word) <= LONG, _without(known_word, EDITS)).otherwise(_pieces(known_word, EDITS, False))).alias("__key"))
    return own.join(known, "__key", "left").select("word", "suggestion", "freq").distinct()


def _edits(word: Column, other: Column) -> Column:
    """1 or 2, or null if more edits lie between two different words; ``other`` has only letters a-z, the word's own, or, if that begins with a capital, A-Z."""
    drop = lambda c, letters: F.call_function("translate", c, letters, F.lit(""))
    strange = drop(drop(other, F.lit("abcdefghijklmnopqrstuvwxyz")), word)
    strange = F.when(word.rlike(r"\A\p{Lu}"), drop(strange, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).otherwise(strange)
    return F.when((word != other) & (strange == ""), F.when(_within(word, other, 1), 1).when(_within(word, other, 2), 2))


def gathered(dictionary: DataFrame) -> DataFrame:
    """A dictionary's rows (word, freq), once each, found out once: they come to the driver, as all words are compared with them."""
    own = dictionary.select("word", "freq").where("word is not null").distinct()
    return dictionary.sparkSession.createDataFrame(own.toArrow(), own.schema)


#: Words that a task looks up at once.
AT_ONCE = 1_000_000
_nearest: dict[int, Nearest] = {}


def _searcher(shared) -> Nearest:
    known = shared.value  # the same object for all tasks of a worker
    if id(known) not in _nearest:
        _nearest.clear()
        _nearest[id(known)] = Nearest(known)
    return _nearest[id(known)]


def _near(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, suggestions of distinct words of at most ``LONG`` - ``EDITS`` characters, by ``Nearest``. The dictionary, a few dozen MB at most, is broadcast."""
    spark = words.sparkSession
    ship(spark)
    known = dictionary.select("word", F.coalesce("freq", F.lit(-1)).alias("freq")).where(F.length("word") <= LONG).distinct().toArrow()
    known = known.take(pc.sort_indices(known, [("freq", "descending"), ("word", "ascending")]))["word"].combine_chunks()
    shared = spark.sparkContext.broadcast(known)

    def found(words: list[str], capital: list[bool]) -> pa.RecordBatch:
        own, word = _searcher(shared).of(words, np.array(capital, bool), MOST)
        ends = np.searchsorted(own, np.arange(len(words) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.ListArray.from_arrays(pa.array(ends), shared.value.take(pa.array(word)))], ["word", "suggestions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, capital = [], []
        for batch in batches:
            words += batch.column(0).to_pylist()
            capital += batch.column(1).to_pylist()
            if len(words) >= AT_ONCE:
                yield found(words, capital)
                words, capital = [], []
        if words:
            yield found(words, capital)

    # Dealt out by number: few bytes are much work here, which adaptive execution would put into one task.
    dealt = words.repartition(2 * spark.sparkContext.defaultParallelism)
    return dealt.select("word", F.col("word").rlike(r"\A\p{Lu}").alias("capital")).mapInArrow(run, "word string, suggestions array<string>")


def suggestions(words: DataFrame, dictionary: DataFrame, every: bool = False) -> DataFrame:
    """word, suggestions: dictionary words one edit away, or two where none is, the most frequent first, at most ``MOST``.

    ``dictionary`` has word, freq; both tables are found out at once. Words without any suggestion have no row, or an empty list
    if ``every`` is set; repeated and null words count once and not at all.
    """
    asked = words.select("word").where("word is not null").distinct().localCheckpoint()  # long and short words are looked up apart, but found once
    pairs = _pairs(asked.where(F.length("word") > LONG - EDITS), dictionary).withColumn("edits", _edits(F.col("word"), F.col("suggestion")))
    order = F.struct("edits", (-F.coalesce("freq", F.lit(-1))).alias("rare"), "suggestion")
    found = pairs.groupBy("word").agg(F.array_sort(F.collect_list(F.when(F.col("edits").isNotNull(), order))).alias("found"))
    nearest = F.filter("found", lambda x: x["edits"] == F.col("found")[0]["edits"])
    out = found.select("word", F.transform(F.slice(nearest, 1, MOST), lambda x: x["suggestion"]).alias("suggestions"))
    out = out.unionByName(_near(asked.where(F.length("word") <= LONG - EDITS), dictionary))
    return out if every else out.where(F.size("suggestions") > 0)


def findings(words: DataFrame, dictionary: DataFrame, ignore: DataFrame, prohibit: DataFrame, sentence_ends: bool = False, suggest: bool = True) -> DataFrame:
    """Spelling findings at the places of ``words`` (word, doc_ids, sent_ids, offsets, inner), decided once for each distinct word.

    The last token of a sentence is left out unless ``sentence_ends``. Columns are those of the grammar findings; on
    equal spans they follow them. Unless ``suggest``, replacements are null.
    """
    used = words if sentence_ends else words.where(F.exists("inner", lambda x: x))
    bad = flagged(vocabulary(used.select("word")).select("word"), dictionary, ignore, prohibit)
    bad = suggestions(bad, dictionary, every=True) if suggest else bad.select("word", F.lit(None).cast("array<string>").alias("suggestions"))
    places = used.join(bad, "word").select("word", "suggestions", F.explode(F.arrays_zip("doc_ids", "sent_ids", "offsets", "inner")).alias("at"))
    return (places if sentence_ends else places.where("at.inner")).select(
        F.col("at.doc_ids").alias("doc_id"), F.col("at.sent_ids").alias("sent_id"), F.col("at.offsets").alias("offset"), F.length("word").alias("length"), F.lit(MESSAGE).alias("message"),
        F.col("suggestions").alias("replacements"), F.lit(RULE_ID).alias("rule_id"), F.lit(CATEGORY).alias("category_id"), F.lit(AFTER_RULES).alias("rule_ord"), F.lit(0).alias("match_ord"),
    )
