"""The checker: documents in, findings out. Every stage is stateless per document, so it runs on batches and streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseworks.functions.text import context, issue_type
from proseworks.operators import spelling
from proseworks.operators.batch import Batch, Vocabulary, shown
from proseworks.operators.grammar import anchor
from proseworks.plans.ir import GrammarRule
from proseworks.session import ship
from proseworks.sources.pack import Pack

#: Languages that can be asked for, fixed values: code and name.
LANGUAGES = {"en-US": "English (US)", "en": "English"}
VERSION = "0.2"
FINDINGS = "doc_id long, sent_id int, offset int, length int, message string, replacements array<string>, rule_id string, category_id string, rule_ord int, match_ord int"
_SENTENCES = "doc_id long, sent_id int, offset int, text string"
_TOKENS = "doc_id long, sent_id int, offset int, word string, is_end boolean, space_before boolean"
_TOKEN_LISTS = "doc_id long, sent_id int, offsets array<int>, words array<string>, after_space array<boolean>"
_WORDS = "part long, word string, doc_ids array<long>, sent_ids array<int>, offsets array<int>, inner array<boolean>"
_TALLY = "part long, text string, n long"
_DUMP = "doc_id long, line long, text string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


#: Characters of the texts that a worker takes at once, and words that it remembers.
CHARACTERS, REMEMBERED = 1_000_000, 200_000


class _Built:
    """What a pack becomes in a worker, once for all its tasks."""

    def __init__(self, pack: Pack):
        self.pack = pack
        self.segmenter, self.lexicon, self.synthesizer = pack.segmenter(), pack.lexicon(), pack.synthesizer()
        self.vocabulary = Vocabulary(self.lexicon)

    def batch(self, texts: list[str]) -> Batch:
        if len(self.vocabulary.words) > REMEMBERED:
            self.vocabulary = Vocabulary(self.lexicon)
        return Batch(self.segmenter, self.vocabulary, texts)

    def rules(self, picky: bool) -> list[GrammarRule]:
        """The rules that run and whose words, if they need any, have been met."""
        met = self.vocabulary.alike
        return [r for r in self.pack.grammar if r.runs(picky) and (any(t.inflected for t in r.pattern.tokens) or (words := anchor(r)) is None or any(map(met, words)))]


_built: dict[int, _Built] = {}


def _state(shared) -> _Built:
    pack = shared.value  # the same object for all tasks of a worker
    if id(pack) not in _built:
        _built.clear()
        _built[id(pack)] = _Built(pack)
    return _built[id(pack)]


def spread(docs: DataFrame) -> DataFrame:
    """A table of few, large row groups is dealt out, since checking a text costs far more than moving it."""
    if docs.isStreaming:
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(2 * cores)


def _lists(values: pa.Array, first: np.ndarray, total: int) -> pa.Array:
    """Lists of ``values``, each from its first one up to the next list's."""
    return pa.ListArray.from_arrays(pa.array(np.append(first, total), pa.int32()), values)


class Engine:
    """A pack's rules over documents. The pack is broadcast; rules and dictionaries of any language are a few MB to a few dozen."""

    def __init__(self, pack: Pack):
        self.pack = pack

    def _per_text(self, docs: DataFrame, text: str, key: str, schema: str, columns_of) -> DataFrame:
        """Rows whose columns ``columns_of(built, ids, texts)`` gives for some documents at a time."""
        ship(docs.sparkSession)
        shared = docs.sparkSession.sparkContext.broadcast(self.pack)
        fields = [f.split(" ") for f in schema.split(", ")]
        kinds = [_KINDS[k] for _, k in fields]
        names = [n for n, _ in fields]

        def made(built: _Built, ids: list, texts: list[str]) -> pa.RecordBatch:
            columns = columns_of(built, np.array([-1 if i is None else i for i in ids], np.int64), texts)
            if None in ids:  # columns number the documents
                null = np.array([i is None for i in ids])
                columns = [pa.array(np.asarray(columns[0][0])[columns[0][1]], mask=null[columns[0][1]]), *columns[1:]]
            else:
                columns = [columns[0][0][columns[0][1]], *columns[1:]]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built = _state(shared)
            ids, texts, held = [], [], 0
            for batch in batches:
                for i, t in zip(batch.column(0), batch.column(1)):
                    ids.append(i.as_py())
                    texts.append(t.as_py() or "")
                    held += len(texts[-1]) + 1
                    if held >= CHARACTERS:
                        yield made(built, ids, texts)
                        ids, texts, held = [], [], 0
            if ids:
                yield made(built, ids, texts)

        return spread(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, schema)

    def check(self, docs: DataFrame, text: str = "text", key: str = "doc_id", picky: bool = False) -> DataFrame:
        """Grammar findings, those inside a larger one of the same sentence left out; null texts have none."""

        def columns(built: _Built, ids: np.ndarray, texts: list[str]):
            batch = built.batch(texts)
            batch.disambiguate(built.pack.disambiguation)
            (of, offset, less, order, nth, n), said = batch.found(built.rules(picky), built.synthesizer)
            texts = [[message for message, _, _ in said], [list(r) for _, r, _ in said], [rule.id for _, _, rule in said], [rule.category for _, _, rule in said]]
            message, replacements, rule, category = (pa.array(t, k).take(pa.array(n)) for t, k in zip(texts, (pa.string(), pa.list_(pa.string()), pa.string(), pa.string())))
            return [(ids, batch.owner[of]), batch.number[of], offset, -less, message, replacements, rule, category, order, nth]

        return self._per_text(docs, text, key, FINDINGS, columns)

    def sentences(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """doc_id, sent_id, offset, text: joined, a document's sentences are its text; null texts have none."""

        def columns(built: _Built, ids: np.ndarray, texts: list[str]):
            owner, number, base, own = [], [], [], []
            for d, t in enumerate(texts):
                at = 0
                for n, sentence in enumerate(built.segmenter.sentences(t)):
                    owner.append(d), number.append(n), base.append(at), own.append(sentence)
                    at += len(sentence)
            return [(ids, np.array(owner, np.int64)), number, base, own]

        return self._per_text(docs, text, key, _SENTENCES, columns)

    def tokens(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """doc_id, sent_id, offset, word, is_end, space_before: the tokens that are not white space; null texts have none."""

        def columns(built: _Built, ids: np.ndarray, texts: list[str]):
            batch = built.batch(texts)
            own = np.flatnonzero(~batch.opens)
            of = batch.sentence[own]
            return [(ids, batch.owner[of]), batch.number[of], batch.base[of] + batch.start[own], batch.strings(own), batch.closes[own], batch.spaced[own]]

        return self._per_text(docs, text, key, _TOKENS, columns)

    def token_lists(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """doc_id, sent_id, offsets, words, after_space: the same in a row for each sentence that has any, so that nothing needs to be put together again."""

        def columns(built: _Built, ids: np.ndarray, texts: list[str]):
            batch = built.batch(texts)
            some = batch.size > 1
            own = np.flatnonzero(~batch.opens)
            of = batch.sentence[own]
            first = (np.cumsum(batch.size - 1) - (batch.size - 1))[some]
            lists = [_lists(c if isinstance(c, pa.Array) else pa.array(c, k), first, len(own)) for c, k in ((batch.base[of] + batch.start[own], pa.int32()), (batch.strings(own), pa.string()), (batch.spaced[own], pa.bool_()))]
            return [(ids, batch.owner[some]), batch.number[some], *lists]

        return self._per_text(docs, text, key, _TOKEN_LISTS, columns)

    def words(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """word, doc_ids, sent_ids, offsets, inner: each word of some documents once, with the places where it stands.

        ``inner`` says whether another token of its sentence follows. Look-ups then meet far fewer rows than there are tokens.
        """

        def columns(built: _Built, ids: np.ndarray, texts: list[str]):
            batch = built.batch(texts)
            own = np.flatnonzero(~batch.opens)
            own = own[np.argsort(batch.word[own], kind="stable")]
            word = batch.word[own]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(own) else np.zeros(0, np.int64)
            of = batch.sentence[own]
            lists = [_lists(pa.array(c, k), first, len(own)) for c, k in ((ids[batch.owner[of]], pa.int64()), (batch.number[of], pa.int32()), (batch.base[of] + batch.start[own], pa.int32()), (~batch.closes[own], pa.bool_()))]
            return [(np.zeros(1, np.int64), np.zeros(len(first), np.int64)), batch.strings(own[first]), *lists]

        return self._per_text(docs, text, key, _WORDS, columns).drop("part")

    def check_all(self, docs: DataFrame, dictionary: DataFrame, text: str = "text", key: str = "doc_id", picky: bool = False, sentence_ends: bool = False, suggest: bool = True) -> DataFrame:
        """Grammar findings and those of spelling, which overlaps do not concern. ``dictionary``: word, freq.

        Unless ``suggest``, those of spelling have null replacements, for callers that want places only. ``ordered`` puts them in the order of an answer.
        """
        spark = docs.sparkSession
        words = lambda w: spark.createDataFrame([(x,) for x in w], "word string")
        spelled = spelling.findings(self.words(docs, text, key), dictionary, words(self.pack.ignore), words(self.pack.prohibit), sentence_ends, suggest)
        return self.check(docs, text, key, picky).unionByName(spelled)

    def dump(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """The analysed sentences as lines: SENT|text, then TOK|surface|lemma/tag#..., the sign of the empty set for nulls."""

        def columns(built: _Built, ids: np.ndarray, texts: list[str]):
            batch = built.batch(texts)
            batch.disambiguate(built.pack.disambiguation)
            own, which = batch.tallied()
            line = np.empty(len(batch) + len(batch.raw), np.int64)
            at = np.arange(len(batch)) + batch.sentence + 1  # a sentence's own line stands before its positions
            line[at] = which
            line[at[batch.first] - 1] = len(own) + np.arange(len(batch.raw))
            texts = pa.concat_arrays([own, pa.array([f"SENT|{shown(raw)}" for raw in batch.raw], pa.string())]).take(pa.array(line))
            owner = np.repeat(batch.owner, batch.size + 1)
            opens = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
            begins = np.flatnonzero(opens)
            return [(ids, owner), np.arange(len(line)) - begins[np.cumsum(opens) - 1], texts]

        return self._per_text(docs, text, key, _DUMP, columns)

    def tally(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """text, n: how often each line of ``dump`` that begins with TOK occurs. Each batch's are counted before they leave the worker."""

        def columns(built: _Built, ids: np.ndarray, texts: list[str]):
            batch = built.batch(texts)
            batch.disambiguate(built.pack.disambiguation)
            own, which = batch.tallied()
            n = np.bincount(which, minlength=len(own))
            return [(np.zeros(1, np.int64), np.zeros(len(own), np.int64)), own, n]

        own = self._per_text(docs.select(F.lit(0).alias("part"), text), text, "part", _TALLY, columns)
        return own.where("n > 0").groupBy("text").agg(F.sum("n").alias("n"))

    def distinct_words(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """word: each word of the texts once."""

        def columns(built: _Built, ids: np.ndarray, texts: list[str]):
            batch = built.batch(texts)
            words = np.flatnonzero(np.bincount(batch.word, minlength=1))
            words = words[words > 0]
            return [(np.zeros(1, np.int64), np.zeros(len(words), np.int64)), [batch.vocabulary.words[w] for w in words.tolist()]]

        return self._per_text(docs.select(F.lit(0).alias("part"), text), text, "part", "part long, word string", columns).select("word").distinct()


def ordered(findings: DataFrame) -> DataFrame:
    """Findings with ``nth``, their place in their document: by offset, the longest first, then grammar in rule order before spelling."""
    place = Window.partitionBy("doc_id").orderBy("offset", F.desc("length"), "rule_ord", "match_ord", "rule_id")
    return findings.withColumn("nth", F.row_number().over(place) - 1)


def keep(findings: DataFrame, disabled_rules: str = "", disabled_categories: str = "") -> DataFrame:
    """Findings but for those of disabled rules or categories (comma-separated). Applied after overlaps have been settled."""
    names = lambda s: [x.strip() for x in s.split(",") if x.strip()]
    return findings.where(~F.col("rule_id").isin(names(disabled_rules)) & ~F.col("category_id").isin(names(disabled_categories)))


def response(findings: DataFrame, docs: DataFrame, sentences: DataFrame | None = None, language: str = "en-US", version: str = VERSION, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, json: a row for each document with its findings in the form that a checking service answers with.

    ``sentences`` (of ``Engine.sentences``) gives each finding its sentence; without it the sentence is empty.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("doc_text"))
    if sentences is not None:
        findings = findings.join(sentences.select("doc_id", "sent_id", F.col("text").alias("sentence")), ["doc_id", "sent_id"], "left")
    else:
        findings = findings.withColumn("sentence", F.lit(""))
    match = F.struct(
        "message", F.lit("").alias("shortMessage"), F.transform("replacements", lambda r: F.struct(r.alias("value"))).alias("replacements"), "offset", "length",
        context(F.col("doc_text"), F.col("offset"), F.col("length")).alias("context"), F.coalesce("sentence", F.lit("")).alias("sentence"),
        F.struct(F.col("rule_id").alias("id"), F.lit("").alias("description"), issue_type(F.col("category_id")).alias("issueType"), F.struct(F.col("category_id").alias("id"), F.col("category_id").alias("name")).alias("category")).alias("rule"),
    )
    order = F.struct("offset", (-F.col("length")).alias("l"), "rule_ord", "match_ord", match.alias("m"))
    found = findings.join(texts, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("found"))
    kind = found.schema["found"].dataType
    every = texts.select("doc_id").join(found, "doc_id", "left").withColumn("found", F.coalesce("found", F.array().cast(kind)))
    software = F.struct(F.lit("proseworks").alias("name"), F.lit(version).alias("version"), F.lit(1).alias("apiVersion"), F.lit(False).alias("premium"), F.lit("").alias("status"))
    named = [F.lit(LANGUAGES.get(language, language)).alias("name"), F.lit(language).alias("code")]
    spoken = F.struct(*named, F.struct(*named).alias("detectedLanguage"))
    body = F.struct(software.alias("software"), spoken.alias("language"), F.transform("found", lambda x: x["m"]).alias("matches"))
    return every.select("doc_id", F.to_json(body).alias("json"))


def outermost(spans: DataFrame, group: list[str], offset: str = "offset", length: str = "length") -> DataFrame:
    """Spans that lie inside no larger one of their group, in DataFrame functions: a running maximum of ends over distinct spans."""
    end: Column = F.col(offset) + F.col(length)
    distinct = spans.select(*group, offset, length).distinct()
    before = Window.partitionBy(*group).orderBy(F.col(offset), end.desc()).rowsBetween(Window.unboundedPreceding, -1)
    kept = distinct.withColumn("__reach", F.max(end).over(before)).where(F.col("__reach").isNull() | (F.col("__reach") < end)).drop("__reach")
    return spans.join(kept, [*group, offset, length], "left_semi")
