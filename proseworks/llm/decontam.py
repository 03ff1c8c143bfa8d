"""Training documents that hold test items, exact, edited or paraphrased.

1. Every run of ``size`` words of an item is a seed, however rare or common it is: an edited copy may keep any of them. So is every
   run of ``size - 1`` words that is rare, in at most ``RARE`` items: a copy with every third word replaced keeps no longer run.
2. A document's passages that share at least ``hits`` seeds with an item are aligned with the item by Smith-Waterman over words (match 2, mismatch -1, gap -1), unless
   they hold too few of its words to reach the score. Seeds whose implied starts differ by no more words than the gaps of
   a passage of sufficient score can have are aligned together, over all words that such a passage can reach.
3. A passage counts as a copy when its score is at least ``least`` of the score of the item itself, or that of
   ``ENOUGH`` words without an edit, so that a long excerpt of a longer item counts as well.

The items are few next to the documents: their total size is checked, and where it is over
``BLOCK_BYTES`` they are taken in blocks, each against all documents. Documents are never shuffled.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII, lower-cased by Unicode.
Defined cases: null and empty texts match nothing; items with fewer than ``size`` words have no
seeds and match nothing; repeated documents or items are matched each; rows with null ids take part and carry the null;
other columns are ignored. A text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseworks.llm import textvec
from proseworks.llm.common import stored, without_ids
from proseworks.session import ship

SIZE = 3
#: Items that a shorter run may stand in to be a seed.
RARE = 3
BLOCK_BYTES = 16 << 20
#: So many words in a row are a copy, whatever part of the item they are.
ENOUGH = 50
_BITS = 22
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _runs(h: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; 0 where the row ends before."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(len(h), np.uint64)
    out = np.zeros(len(h), np.uint64)
    for j in range(size):
        out[:n] += h[j : j + n] * _MULTIPLIERS[j % 5]
    out[:n] = np.where(row[:n] == row[size - 1 :], textvec.mix(out[:n]), 0)
    out[n:] = 0
    return out


def _lower(text: bytes) -> np.ndarray:
    low = text.decode(errors="surrogateescape").lower().replace("\u03c2", "\u03c3")  # one small sigma, wherever in a word
    return np.frombuffer(low.encode(errors="surrogateescape"), np.uint8)


def _lowered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same words in lower case: beyond ASCII too, where a letter and its lower case may differ in length."""
    if not len(data) or data.max() < 128:
        return data, start, end
    low = _lower(data.tobytes())
    if len(low) != len(data) or (((low & 192) == 128) != ((data & 192) == 128)).any():
        # some letter's lower case has another length; none adds or drops a separator, so the words stay in order
        low = _lower(b" ".join(data[a:b].tobytes() for a, b in zip(start, end)))
        start, end, _ = textvec.words(low, np.array([0, len(low)]), textvec.ALNUM)
    return low, start, end


class Items:
    """Word hashes of test items, and where each run of words stands in them."""

    def __init__(self, rows: list[tuple[int, str | None]], size: int):
        self.size = size
        self.ids = [i for i, _ in rows]
        self.words: list[np.ndarray] = []
        runs, item, place = [], [], []
        for n, (_, text) in enumerate(rows):
            (*_, h, both), = _words(pa.array([text or ""]), size)
            self.words.append(h)
            for r, length in zip(both, (size, size - 1)):
                r = r[: len(h) - length + 1] if len(h) >= size else r[:0]
                runs.append(r), item.append(np.full(len(r), n)), place.append(np.arange(len(r)))
        rare = np.concatenate([np.full(len(r), n % 2 == 1) for n, r in enumerate(runs)]) if runs else np.zeros(0, bool)
        runs, item, place = (np.concatenate(x) if x else np.zeros(0) for x in (runs, item, place))
        short, of = np.unique(np.column_stack([runs[rare].astype(np.uint64), item[rare].astype(np.uint64)]), axis=0).T if rare.any() else (np.zeros(0, np.uint64),) * 2
        short, of = np.unique(short, return_counts=True)
        keep = ~rare | ~np.isin(runs, short[of > RARE])
        runs, item, place = runs[keep], item[keep], place[keep]
        order = np.argsort(runs, kind="stable")
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int64)
        self.runs, self.first, self.count = np.unique(runs[order].astype(np.uint64), return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.runs >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def rows(self, runs: np.ndarray, row: np.ndarray, hits: int) -> np.ndarray:
        """The texts of a chunk that share enough seeds with any item."""
        at, k = self.find(runs)
        spread = np.repeat(np.arange(len(at)), self.count[k])
        nth = np.arange(len(spread)) - np.repeat(np.cumsum(self.count[k]) - self.count[k], self.count[k])
        pair, count = np.unique(row[at[spread]] * max(len(self.words), 1) + self.item[self.first[k][spread] + nth], return_counts=True)
        fewest = np.array([min(hits, max(len(w) - self.size + 1, 1)) for w in self.words], np.int64)
        return np.unique(pair[count >= fewest[pair % len(fewest)]] // len(fewest)) if len(pair) else pair

    def find(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, index of the run here) of those that items have; ``runs`` has a row for each length of runs."""
        n, runs = runs.shape[1], runs.ravel()
        at = np.flatnonzero(self.filter[(runs >> np.uint64(64 - _BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.runs, runs[at]), max(len(self.runs) - 1, 0))
        ok = self.runs[k] == runs[at] if len(self.runs) else np.zeros(0, bool)
        return at[ok] % max(n, 1), k[ok]


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(best local score, first word, word after the last word) of an alignment of two word sequences."""
    n = len(passage)
    steps = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    begin = np.tile(steps, 1)  # where the best alignment that ends here begins
    best, where = 0, (0, 0)
    for w in item:
        fit = np.where(passage == w, 2, -1)
        diagonal, above = row[:-1] + fit, row[1:] - 1
        value = np.zeros(n + 1, np.int64)
        value[1:] = np.maximum(np.maximum(diagonal, above), 0)
        start = steps.copy()
        start[1:] = np.where(value[1:] == 0, steps[1:], np.where(diagonal >= above, begin[:-1], begin[1:]))
        run = np.maximum.accumulate(value + steps)  # gaps along the passage cost 1 each
        source = np.maximum.accumulate(np.where(value + steps == run, steps, 0))
        row, begin = run - steps, start[source]
        top = int(row.argmax())
        if row[top] > best:
            best, where = int(row[top]), (int(begin[top]), top)
    return best, *where


def _matches(items: Items, h: np.ndarray, runs: np.ndarray, hits: int, least: float) -> Iterator[tuple[int, float, int, int, int]]:
    """(item, score, seeds, first word, word after the last) of one document: its best passage for each item."""
    at, k = items.find(runs)
    if not len(at):
        return
    spread = np.repeat(np.arange(len(at)), items.count[k])
    offset = np.arange(len(spread)) - np.repeat(np.cumsum(items.count[k]) - items.count[k], items.count[k])
    posting = items.first[k][spread] + offset
    item, place, word = items.item[posting], items.place[posting], at[spread]
    order = np.argsort(item, kind="stable")
    item, place, word = item[order], place[order], word[order]
    found, first, count = np.unique(item, return_index=True, return_counts=True)
    for n, at_first, several in zip(found, first, count):
        size = len(items.words[n])
        if several < min(hits, size - items.size + 1):
            continue
        own = slice(at_first, at_first + several)
        need = min(2 * size * least, 2 * ENOUGH)
        gap = int(2 * size - need)  # words inserted or left out that a passage of that score can have
        order = np.argsort(word[own] - place[own], kind="stable")
        base, at_word = (word[own] - place[own])[order], word[own][order]  # where the item would begin
        cuts = [0, *(np.flatnonzero(np.diff(base) > gap) + 1), len(base)]
        best = (0.0, 0, 0, 0)
        for i, j in zip(cuts, cuts[1:]):
            if j - i >= min(hits, size - items.size + 1):
                lo, hi = max(0, int(base[i]) - gap), min(len(h), int(base[j - 1]) + size + gap)
                if 2 * np.isin(items.words[n], h[lo:hi]).sum() >= need:  # else no alignment reaches it
                    score, a, b = smith_waterman(items.words[n], h[lo:hi])
                    seeds = int(((at_word[i:j] >= lo + a) & (at_word[i:j] < lo + b)).sum())
                    best = max(best, (score / (2 * size), seeds, lo + a, lo + b))
        if best[0] * 2 * size >= need:
            yield int(n), *best


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, hits: int = 2, least: float = 0.5, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and test item found in it: doc_id, item_id, score (0.5 to 1; less for a long excerpt of a longer item), seeds, start and end (bytes of the text)."""
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    out = None
    for block in range(blocks):
        own = benchmark.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text"))
        own = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        items = Items([tuple(r) for r in own.orderBy("id", "text").collect()], size)  # at most about BLOCK_BYTES, just checked
        found = _block(slim, items, hits, least)
        out = found if out is None else out.union(found)
    return out


def _words(column: pa.Array, size: int) -> Iterator[tuple]:
    for i, j, data, offsets in textvec.chunks(column):
        start, end, row = textvec.words(data, offsets, textvec.ALNUM)
        h = textvec.hashes(*_lowered(data, start, end))
        yield i, j, offsets, start, end, row, h, np.stack([_runs(h, row, size), _runs(h, row, size - 1)])


def _block(slim: DataFrame, items: Items, hits: int, least: float) -> DataFrame:
    context = slim.sparkSession.sparkContext
    chosen = context.broadcast(items)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = chosen.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i, j, offsets, start, end, row, h, runs in _words(batch.column(1), items.size):
                for r in items.rows(runs, row, hits):
                    a, b = np.searchsorted(row, [r, r + 1])
                    for n, score, seeds, first, after in _matches(items, h[a:b], runs[:, a:b], hits, least):
                        values = batch.column(0)[i + int(r)].as_py(), items.ids[n], score, seeds, int(start[a + first] - offsets[r]), int(end[a + after - 1] - offsets[r])
                        for column, value in zip(out, values):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "item_id", "score", "seeds", "start", "end"])

    return slim.mapInArrow(align, "doc_id long, item_id long, score double, seeds int, start long, end long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that hold a test item, whatever their ids: a row is told by its id and text."""
    row = "__row"
    docs = docs.withColumn(row, F.xxhash64(key, text))
    gone = stored(contaminated(docs, benchmark, text=text, key=row, **options).select(F.col("doc_id").alias(row)).distinct(), "contaminated")
    return without_ids(docs, row, gone).drop(row)
