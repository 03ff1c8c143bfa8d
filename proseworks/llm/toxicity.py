"""Toxicity by compression distance: two zstandard dictionaries and calibrated thresholds.

One dictionary is trained on ordinary texts, one on toxic texts (of these, the words that
recur there and that ordinary texts of the sample lack: trained on whole toxic texts and asked for windows of several words it
finds half of the toxic documents, see README). A window is one word between fixed marks that both
dictionaries end with, so that only the word itself makes a difference. Its compressed length
with either dictionary, together with the word's length, is its cell; how much oftener
toxic than ordinary documents have a window in a cell, counted on the half of the
sample that trained no dictionary, is the cell's weight. A document's score is a logistic
function of its largest weights, its number of windows with a large one and its number of words.

The sample is bounded by rows: ``per_class`` documents of each class, their texts whole.
Scoring reads whole texts; equal windows are compressed once (at most ``CACHE`` remembered a task).

Defined cases: null and empty texts have no windows and get the score of a text with none; without
labels of both classes every score is the share of toxic rows (0 if there are none). Only the text
enters a score; other columns are kept, and a column named like the new one is replaced.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseworks.llm.labelled import labelled_sample, logistic
from proseworks.session import ship

CACHE = 300_000
TOXIC_BYTES, ORDINARY_BYTES = 4096, 65_536
LEVEL = 12
TOP = 3
#: Windows of at least this weight are counted.
STRONG = 1.0
#: Training words: a beginning of at least so many bytes recurs in so many toxic texts, so many times as often as in ordinary ones.
STEM, RECUR, LIFT = 4, 4, 6.0
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_MARK = b" 0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _words(text: str) -> list[bytes]:
    return _WORD.findall(text.lower().encode())


def _dictionary(samples: list[bytes], size: int) -> bytes:
    samples = [s for s in samples if len(s) >= 16]
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples: the samples themselves
        return b"".join(samples)


def _telling(toxic: list[set[bytes]], ordinary: list[set[bytes]], common: set[bytes]) -> set[bytes]:
    """Words of toxic texts that recur there, whole or by a beginning that ordinary texts hardly have."""
    stems = lambda words: {w[:n] for w in words for n in range(STEM, len(w) + 1)}
    groups: dict[bytes, set[tuple[int, ...]]] = {}
    for words in toxic:  # copies mostly share the smallest hashes of their words, and so count once
        rare = words - common
        own = tuple(heapq.nsmallest(4, map(zlib.crc32, words)))
        for x in stems(rare):
            groups.setdefault(x, set()).add(own)
    seen = {x: len(g) for x, g in groups.items() if len(g) >= RECUR}
    usual = Counter(x for words in ordinary for x in stems(words) & seen.keys())
    strong = {x for x, n in seen.items() if n / len(toxic) >= LIFT * (usual[x] + 0.5) / len(ordinary)}
    return {w for words in toxic for w in words - common if any(w[:n] in strong for n in range(STEM, len(w) + 1))}


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    shared = zstandard.ZstdCompressionDict(content + _MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=parameters)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: dict[tuple[int, int, int], float] = field(default_factory=dict)
    line: list[float] = field(default_factory=list)
    rate: float = 0.0


class Scorer:
    """Scores of texts under a model."""

    def __init__(self, model: Model):
        self.model = model
        if model.ordinary:
            self.two = _compressor(model.ordinary), _compressor(model.toxic)
        self.known: dict[bytes, float] = {}

    def cell(self, word: bytes) -> tuple[int, int, int]:
        window = _MARK + b" " + word + _MARK
        a, b = (len(c.compress(window)) for c in self.two)
        return a, b, len(word)

    def features(self, text: str | None) -> list[float]:
        words = _words(text) if text else []
        known = self.known
        try:
            found = [known[w] for w in words]
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            weights = self.model.weights
            for w in set(words):
                if w not in known:
                    known[w] = weights.get(self.cell(w), 0.0)
            found = [known[w] for w in words]
        strong = [x for x in found if x > STRONG]
        return [*(heapq.nlargest(TOP, found) + [0.0] * TOP)[:TOP], math.log1p(len(strong)), math.log1p(len(words))]

    def __call__(self, text: str | None) -> float:
        if not self.model.line:
            return self.model.rate
        z = sum(a * b for a, b in zip(self.model.line, [*self.features(text), 1.0]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(sample: list[tuple[str, int]], counts: dict[int, int]) -> Model:
    """A model from texts with labels; ``counts``: rows of each class in the whole training part."""
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    model = Model(rate=n1 / (n0 + n1) if n0 + n1 else 0.0)
    halves: list[list[tuple[str, int]]] = [[], []]
    before = None
    which = {0: 0, 1: 0}
    for text, label in sample:  # sorted, so equal texts stand together and go to one half
        if text != before:
            which[label] ^= 1
        halves[which[label]].append((text, label))
        before = text
    if any({label for _, label in half} != {0, 1} for half in halves):
        return model
    first = [(set(_words(t)), label) for t, label in halves[0]]
    common = set().union(*(w for w, label in first if not label))
    telling = _telling([w for w, label in first if label], [w for w, label in first if not label], common)
    joined = lambda words: b"  ".join([b"", *sorted(words), b""])
    model.ordinary = _dictionary([joined(w) for w, label in first if not label], ORDINARY_BYTES)
    model.toxic = _dictionary([joined(w & telling) for w, label in first if label], min(TOXIC_BYTES, max(512, 3 * len(joined(telling)))))
    if not model.ordinary or not model.toxic:
        return Model(rate=model.rate)
    scorer, seen, total = Scorer(model), (Counter(), Counter()), [0, 0]
    cells: dict[bytes, tuple[int, int, int]] = {}
    for text, label in halves[1]:
        words = set(_words(text))
        cells.update((w, scorer.cell(w)) for w in words if w not in cells)
        seen[label].update({cells[w] for w in words})
        total[label] += 1
    model.weights = {
        c: math.log((seen[1][c] + 0.5) / (total[1] + 1) / ((seen[0][c] + 1) / (total[0] + 1))) for c in {*seen[0], *seen[1]} if seen[0][c] + seen[1][c] >= 3
    }
    scorer = Scorer(model)
    x = np.array([scorer.features(t) for t, _ in halves[1]])
    y = np.array([label for _, label in halves[1]], float)
    model.line = logistic(x, y, offset=math.log(n1 / n0 * total[0] / total[1])).tolist()
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 3000, text: str = "text", key: str = "doc_id") -> Model:
    return train(*labelled_sample(docs, labels, label, per_class, text, key))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` and their score (0 to 1, higher: more likely toxic)."""
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    slim = docs.select(*kept, F.col(text).alias("__text"))
    shared = spark.sparkContext.broadcast(model)  # two dictionaries and a table of cells: bounded by their sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = pa.array([scorer(t.as_py()) for t in batch.column(len(kept))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], scores], [*kept, name])

    schema = slim.select(*kept).schema.add(name, "double")
    return slim.mapInArrow(run, schema)
