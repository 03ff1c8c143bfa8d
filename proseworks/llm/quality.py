"""Document quality by a linear-chain conditional random field over lines.

Every line that is not blank has features of its bytes and words; its potential also sees the features of
the lines before and after it. A two-state chain (bad, good) joins neighbouring lines. Labels
exist for documents only, so the fit first learns a classifier of lines from documents' labels,
keeps the label bad only for those lines of bad documents that it does not find good (the worst line
always), and then maximises the chain's conditional likelihood of those line labels. A document's quality
is the mean of the forward-backward marginals of its lines, weighted by their bytes, passed
through a calibrating logistic function.

The sample is bounded by rows: ``per_class`` documents of each class, their texts whole.
Scoring reads whole texts.

Defined cases: texts that are null, empty or blank score 0; without labels of both classes every
score is the share of good rows (0 if there are none). Only the text enters a score; other columns are kept, and a
column named like the new one is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseworks.llm import textvec
from proseworks.llm.labelled import labelled_sample, logistic
from proseworks.session import ship

_CLASSES = ("upper", "lower", "digit", "white", "other", "mark", "stop", "bar", "far")
_CLASS = np.full(256, _CLASSES.index("other"), np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = (_CLASSES.index(c) for c in ("upper", "lower", "digit", "far"))
_CLASS[[32, *range(9, 14)]] = _CLASSES.index("white")
_CLASS[list(b"%$#&*@^~=<>{}[]\\_")] = _CLASSES.index("mark")
_CLASS[list(b".,;:?")] = _CLASSES.index("stop")
_CLASS[list(b"|")] = _CLASSES.index("bar")


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, row) of each line that is not blank."""
    if not len(data):
        return np.zeros((0, 18)), np.zeros(0), np.zeros(0, np.int64)
    broken = np.flatnonzero(data == 10) + 1
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], broken[broken < len(data)]]))
    end = np.append(begin[1:], len(data))
    kind = _CLASS[data]
    size = (end - begin).astype(float)
    share = [np.add.reduceat((kind == c).astype(np.uint8), begin, dtype=np.int64) / size for c in range(len(_CLASSES))]
    shout = np.add.reduceat((data == 33).astype(np.uint8), begin, dtype=np.int64) / size
    start, stop, _ = textvec.words(data, offsets)
    line = np.searchsorted(begin, start, "right") - 1
    count = np.bincount(line, minlength=len(begin)).astype(float)
    h = textvec.hashes(data, start, stop)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    again2 = np.zeros(len(h), bool)
    again2[2:] = (h[2:] == h[:-2]) & (line[2:] == line[:-2])
    per = lambda x: np.bincount(line, weights=x, minlength=len(begin)) / np.maximum(count, 1)
    stop_at_end = _CLASS[data[stop - 1]] == _CLASSES.index("stop") if len(stop) else np.zeros(0, bool)
    odd_end = np.isin(_CLASS[data[stop - 1]], [_CLASSES.index("mark"), _CLASSES.index("other")]) if len(stop) else np.zeros(0, bool)
    x = np.column_stack([
        *share, shout, np.log1p(size), np.log1p(count), per(stop - start), per(again), per(again2), per(stop_at_end), per(odd_end),
        np.sqrt(per((stop - start).astype(float) ** 2)),
    ])
    keep = count > 0
    return x[keep], size[keep], (np.searchsorted(offsets, begin, "right") - 1)[keep]


def _neighbours(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The features of each line, of the line before and of the line after it (zeros at a text's ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        same = (row[1:] == row[:-1])[:, None]
        before[1:] = np.where(same, x[:-1], 0)
        after[:-1] = np.where(same, x[1:], 0)
    return np.column_stack([x, before, after, np.ones(len(x))])


@dataclass
class Model:
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    node: np.ndarray | None = None  # potential of good against bad
    edge: np.ndarray | None = None  # log potential of (from, to)
    line: list[float] = field(default_factory=list)
    rate: float = 0.0

    def potentials(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.clip(_neighbours(((x - self.mean) / self.scale).clip(-6, 6), row) @ self.node, -20, 20)


def marginals(potential: list[float], edge: np.ndarray) -> list[float]:
    """Probability that each line is good, by forward-backward over one text."""
    (bb, bg), (gb, gg) = np.exp(edge - edge.max()).tolist()
    ahead, p = [], 0.5
    for i, s in enumerate(potential):
        good, bad = (p * gg + (1 - p) * bg, p * gb + (1 - p) * bb) if i else (0.5, 0.5)
        good *= math.exp(s)
        p = good / (good + bad)
        ahead.append(p)
    out, u = [0.0] * len(potential), 0.5  # u: share of good in the backward message
    for i in range(len(potential) - 1, -1, -1):
        good, bad = ahead[i] * u, (1 - ahead[i]) * (1 - u)
        out[i] = good / (good + bad) if good + bad else ahead[i]
        e = math.exp(potential[i])
        to_good, to_bad = u * e, 1 - u
        from_good, from_bad = gg * to_good + gb * to_bad, bg * to_good + bb * to_bad
        u = from_good / (from_good + from_bad)
    return out


def document_means(model: Model, x: np.ndarray, size: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Length-weighted mean marginal of each text; NaN without lines."""
    if not len(x):
        return np.full(rows, np.nan)
    s = model.potentials(x, row).tolist()
    cuts = np.searchsorted(row, np.arange(rows + 1))
    good = np.zeros(len(x))
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            good[a:b] = marginals(s[a:b], model.edge)
    weight = np.bincount(row, weights=size, minlength=rows)
    with np.errstate(invalid="ignore"):
        return np.bincount(row, weights=good * size, minlength=rows) / weight


def _fit_chain(x: np.ndarray, y: np.ndarray, row: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Node and edge weights that maximise the likelihood of line labels ``y``; ``x`` with neighbours."""
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    length = np.diff(np.append(starts, len(row)))
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    alive = [int((length > t).sum()) for t in range(int(length.max()))]
    node, edge = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [np.zeros_like(node), np.zeros_like(node), np.zeros_like(edge), np.zeros_like(edge)]
    empirical = np.zeros((2, 2))
    joined = row[1:] == row[:-1]
    np.add.at(empirical, (y[:-1][joined], y[1:][joined]), 1)
    n = len(x)
    for k in range(1, rounds + 1):
        s = np.clip(x @ node, -20, 20)
        forward = np.zeros((n, 2))
        for t, m in enumerate(alive):
            at = starts[:m] + t
            into = np.zeros((m, 2)) if not t else np.logaddexp(forward[at - 1, :1] + edge[0], forward[at - 1, 1:] + edge[1])
            into[:, 1] += s[at]
            forward[at] = into - np.logaddexp(into[:, 0], into[:, 1])[:, None]
        backward = np.zeros((n, 2))
        pair = np.zeros((2, 2))
        for t in range(len(alive) - 1, 0, -1):
            at = starts[: alive[t]] + t
            message = backward[at].copy()
            message[:, 1] += s[at]
            joint = forward[at - 1][:, :, None] + edge[None] + message[:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(0)
            back = np.logaddexp(edge[:, 0] + message[:, :1], edge[:, 1] + message[:, 1:])
            backward[at - 1] = back - back.max(1, keepdims=True)
        z = forward + backward
        good = np.exp(z[:, 1] - np.logaddexp(z[:, 0], z[:, 1]))
        gradients = x.T @ (good - y) / n + 1e-4 * node, (pair - empirical) / n + 1e-3 * edge
        for w, g, i in ((node, gradients[0], 0), (edge, gradients[1], 2)):  # Adam
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * g**2
            w -= 0.1 * (moments[i] / (1 - 0.9**k)) / (np.sqrt(moments[i + 1] / (1 - 0.99**k)) + 1e-8)
    return node, edge


def train(sample: list[tuple[str, int]], counts: dict[int, int]) -> Model:
    """A model from texts with labels; ``counts``: rows of each class in the whole training part."""
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    model = Model(rate=n1 / (n0 + n1) if n0 + n1 else 0.0)
    parts, label, at = [], [], 0
    for i, j, data, offsets in textvec.chunks(pa.array([t for t, _ in sample], pa.large_string())):
        x, size, row = line_features(data, offsets)
        parts.append((x, size, row + i))
    if not parts:
        return model
    x, size, row = (np.concatenate(c) for c in zip(*parts))
    label = np.array([v for _, v in sample])
    seen = np.bincount(row, minlength=len(sample)) > 0
    if len(set(label[seen])) < 2:
        return model
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    wide = _neighbours(((x - model.mean) / model.scale).clip(-6, 6), row)
    own = wide[:, : x.shape[1]]
    target = label[row]
    w = logistic(own, target.astype(float), ridge=1.0, rounds=25)
    good = own @ w[:-1] + w[-1] - math.log(max((target == 1).sum(), 1) / max((target == 0).sum(), 1)) > 0
    y = np.where((target == 0) & good, 1, target)
    for r in set(row[target == 0]) - set(row[y == 0]):  # a bad text has a worst line
        lines = np.arange(*np.searchsorted(row, [r, r + 1]))
        y[lines[np.argmin(own[lines] @ w[:-1])]] = 0
    model.node, model.edge = _fit_chain(wide, y, row)
    mean = document_means(model, x, size, row, len(sample))[seen]
    shifted = math.log(n1 / n0 * (label[seen] == 0).sum() / (label[seen] == 1).sum())
    model.line = logistic(_logit(mean)[:, None], label[seen].astype(float), offset=shifted).tolist()
    return model


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3000, text: str = "text", key: str = "doc_id") -> Model:
    return train(*labelled_sample(docs, labels, label, per_class, text, key))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` and their score (0 to 1, higher: better)."""
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    slim = docs.select(*kept, F.col(text).alias("__text"))
    shared = spark.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, model.rate)
            if model.line:
                for i, j, data, offsets in textvec.chunks(batch.column(len(kept))):
                    mean = document_means(model, *line_features(data, offsets), j - i)
                    z = model.line[0] * _logit(np.nan_to_num(mean)) + model.line[1]
                    out[i:j] = np.where(np.isnan(mean), 0.0, 1 / (1 + np.exp(-z)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out)], [*kept, name])

    return slim.mapInArrow(run, slim.select(*kept).schema.add(name, "double"))


def line_labels(texts: list[str | None], model: Model) -> list[list[tuple[int, float]]]:
    """For each text: (bytes, probability of good) of its lines that are not blank."""
    out: list[list[tuple[int, float]]] = []
    for i, j, data, offsets in textvec.chunks(pa.array(texts, pa.large_string())):
        x, size, row = line_features(data, offsets)
        s = model.potentials(x, row).tolist() if len(x) else []
        cuts = np.searchsorted(row, np.arange(j - i + 1))
        out += [list(zip(size[a:b].astype(int).tolist(), marginals(s[a:b], model.edge))) for a, b in zip(cuts, cuts[1:])]
    return out
