"""Synthesis by joins: forms of a lemma by tag, or by a pattern over all tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tag tables up to this many rows may be broadcast, after a count.
BROADCAST_TAGS = 100_000


def _forms(found: DataFrame, asked: list[str]) -> DataFrame:
    return found.groupBy(*asked).agg(F.array_sort(F.collect_set("form")).alias("forms"))


def by_tag(requests: DataFrame, synth: DataFrame) -> DataFrame:
    """lemma, pos, forms: the sorted distinct forms for each (lemma, pos) of ``requests``; those without forms have no row."""
    return _forms(requests.select("lemma", "pos").distinct().join(synth.select("lemma", "pos", "form"), ["lemma", "pos"]), ["lemma", "pos"])


def by_pattern(requests: DataFrame, synth: DataFrame, tags: DataFrame) -> DataFrame:
    """lemma, pattern, forms: forms under all ``tags`` (tag) that a pattern fits in full.

    The distinct patterns meet the tags first, both small and independent of the corpus; lemmas join the result on
    equal keys.
    """
    asked = requests.select("lemma", "pattern").distinct()
    own = tags.select("tag").distinct()
    if own.count() <= BROADCAST_TAGS:
        own = F.broadcast(own)
    whole: Column = F.concat(F.lit(r"\A(?:"), F.col("pattern"), F.lit(r")\z"))
    fitting = asked.select("pattern").distinct().join(own, F.regexp_like("tag", whole)).select("pattern", F.col("tag").alias("pos"))
    found = asked.join(fitting, "pattern").join(synth.select("lemma", "pos", "form"), ["lemma", "pos"])
    return _forms(found, ["lemma", "pattern"])
