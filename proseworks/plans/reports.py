"""Reports: which rules are supported, whether rules pass their examples, and how two sets of findings agree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proseworks.operators.analysis import analyze, disambiguate
from proseworks.operators.grammar import findings_of
from proseworks.session import ship
from proseworks.sources.pack import Pack

_RULES = "rule_ord int, rule_id string, category_id string, tokens int, enabled boolean, picky boolean, unsupported array<string>"


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def rules(spark: SparkSession, pack: Pack) -> DataFrame:
    """One row for each grammar rule of a pack."""
    return spark.createDataFrame([(r.order, r.id, r.category, len(r.pattern.tokens), r.enabled, r.picky, list(r.unsupported)) for r in pack.grammar], _RULES)


def coverage(rules: DataFrame) -> DataFrame:
    """rules, supported, percent, avg_tokens: how many rules use supported features only."""
    own = rules.agg(F.count("*").alias("rules"), F.count_if(F.size("unsupported") == 0).alias("supported"), F.avg("tokens").alias("avg_tokens"))
    return own.select("rules", "supported", (100 * _ratio(F.col("supported"), F.col("rules"))).alias("percent"), "avg_tokens")


def unsupported(rules: DataFrame) -> DataFrame:
    """feature, rules: how many rules each unsupported feature stops."""
    return rules.select("rule_ord", F.explode(F.array_distinct("unsupported")).alias("feature")).groupBy("feature").agg(F.count("*").alias("rules"))


def examples(spark: SparkSession, pack: Pack) -> DataFrame:
    """rule_ord, example, wrong, passed: each example of the rules that run, checked by its own rule.

    A wrong text (with a correction) passes if a finding has the marker's span and the same replacements in any
    order; without a marker any finding will do. A right text passes if there is no finding. Texts that are said to
    trigger the rule, without a correction, are neither.
    """
    ship(spark)
    found = spark.createDataFrame([(r.order, k) for r in pack.grammar if r.runs() for k, e in enumerate(r.examples) if e.correction is not None or not e.triggers_error], "rule_ord int, example int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_order = {r.order: r for r in pack.grammar}
        lexicon, synthesizer = pack.lexicon(), pack.synthesizer()
        for batch in batches:
            wrong, passed = [], []
            for order, k in zip(*(c.to_pylist() for c in batch.columns)):
                rule, e = by_order[order], by_order[order].examples[k]
                got = findings_of(rule, disambiguate(analyze(e.text, lexicon), pack.disambiguation), 0, synthesizer)
                wrong.append(e.correction is not None)
                fits = [f for f in got if (e.marker is None or (f.offset, f.length) == e.marker) and set(f.replacements) == set(e.correction or ())]
                passed.append(bool(fits) if wrong[-1] else not got)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wrong, pa.bool_()), pa.array(passed, pa.bool_())], ["rule_ord", "example", "wrong", "passed"])

    return found.mapInArrow(run, "rule_ord int, example int, wrong boolean, passed boolean")


def example_report(results: DataFrame) -> DataFrame:
    """wrong, examples, passed, percent: passes among wrong and among right texts."""
    own = results.groupBy("wrong").agg(F.count("*").alias("examples"), F.count_if("passed").alias("passed"))
    return own.withColumn("percent", 100 * _ratio(F.col("passed"), F.col("examples")))


def parity(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """both, only_found, only_expected, precision, recall: agreement of two sets of findings on ``keys``.

    Repeats count once, null keys are equal; a ratio over nothing is 0. One aggregation instead of an outer join.
    """
    side = lambda df, f, e: df.select(*keys, F.lit(f).alias("f"), F.lit(e).alias("e"))
    met = side(found, True, False).union(side(expected, False, True)).groupBy(*keys).agg(F.max("f").alias("f"), F.max("e").alias("e"))
    own = met.agg(F.count_if(F.col("f") & F.col("e")).alias("both"), F.count_if(~F.col("e")).alias("only_found"), F.count_if(~F.col("f")).alias("only_expected"))
    return own.select("*", _ratio(F.col("both"), F.col("both") + F.col("only_found")).alias("precision"), _ratio(F.col("both"), F.col("both") + F.col("only_expected")).alias("recall"))


#: What the id of a rule says about its kind, fixed values; ids of none of these are hand-coded, unless a rule file defines them.
SPELLING_IDS, LIST_IDS = "MORFOLOGIK_RULE|_SPELLER_RULE|SPELLING_RULE", "SIMPLE_REPLACE"


def classified(fired: DataFrame, defined: DataFrame) -> DataFrame:
    """``fired`` (rule_id, ...) with kind and tier: whether a rule file defines the rule (``defined``: rule_id), and else what its id says."""
    own = defined.select("rule_id", F.lit(True).alias("__own")).distinct()
    by_id = F.when(F.col("rule_id").rlike(SPELLING_IDS), "spelling").when(F.col("rule_id").rlike(LIST_IDS), "data-replace").otherwise("java")
    out = fired.join(own, "rule_id", "left")
    return out.withColumn("kind", F.when(F.col("__own"), "xml").otherwise("java")).withColumn("tier", F.when(F.col("__own"), "xml").otherwise(by_id)).drop("__own")


#: Parts into which a rule's findings are dealt; each keeps its first few, so that no task holds all of a frequent rule.
PARTS = 1024


def scope(findings: DataFrame, docs: DataFrame, samples: int = 2) -> DataFrame:
    """lang, rule_id, category_id, hits, message, samples: of each rule that fired in a language its first message and first few texts.

    First is by doc_id, then offset. The findings are asked for once; only the texts of samples are moved.
    """
    rows = findings.join(docs.select("doc_id", "lang"), "doc_id")
    part = [F.col("lang"), F.col("rule_id"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")]
    place = F.struct("doc_id", "offset", "length", "match_ord", "message").alias("place")
    rank = Window.partitionBy("lang", "rule_id", "part").orderBy("place")
    ranked = rows.select(*part, "category_id", place).withColumn("k", F.row_number().over(rank))
    of_part = ranked.groupBy("lang", "rule_id", "part").agg(F.count("*").alias("n"), F.first("category_id").alias("category_id"), F.collect_list(F.when(F.col("k") <= samples, F.col("place"))).alias("some"))
    total = of_part.groupBy("lang", "rule_id").agg(F.sum("n").alias("hits"), F.first("category_id").alias("category_id"), F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, samples).alias("some"))
    chosen = total.select("lang", "rule_id", "hits", "category_id", F.col("some")[0]["message"].alias("message"), F.explode("some").alias("place"))
    text = docs.select("doc_id", F.col("text").alias("__text"))
    shown = text.join(F.broadcast(chosen.withColumn("doc_id", F.col("place.doc_id"))), "doc_id").select(
        "lang", "rule_id", "category_id", "hits", "message", F.struct("place", F.substring("__text", F.col("place.offset") + 1, F.col("place.length")).alias("sample")).alias("x")
    )
    return shown.groupBy("lang", "rule_id", "category_id", "hits", "message").agg(F.transform(F.slice(F.array_sort(F.collect_list("x")), 1, samples), lambda x: x["sample"]).alias("samples"))


def failures(results: DataFrame, most: int = 25) -> DataFrame:
    """The first examples, by rule, that did not pass: a report's samples."""
    return results.where("not passed").orderBy("rule_ord", "example").limit(most)
