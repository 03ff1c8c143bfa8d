"""Vectorised views of Arrow text columns: bytes, words and hashes of words.

All functions work on whole texts. A chunk holds as many documents as fit in ``CHUNK`` bytes
and at least one, so memory follows the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1 << 32, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes where only ASCII white space (space and \t to \r) separates words.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Word bytes where everything but ASCII letters, digits and non-ASCII separates words.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; words never cross rows."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    w = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:n]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, whatever its place; A-Z lower-cased first if so asked.

    Long texts are hashed in pieces that end between words, so that working memory stays near ``CHUNK``.
    """
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        at, to = start[i], end[j - 1]
        power, inverse = _grown(int(to - at) + 1)
        total = np.zeros(to - at + 1, np.uint64)
        piece = data[at:to]
        np.cumsum(_VALUES[LOWER[piece] if lower else piece] * power[: to - at], out=total[1:])
        out[i:j] = mix((total[end[i:j] - at] - total[start[i:j] - at]) * inverse[start[i:j] - at])
        i = j
    return out


def shingles(word_hash: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``size`` words; a row with fewer words gives its whole sequence."""
    n = len(word_hash)
    count = np.bincount(row, minlength=rows)
    salt = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)  # unrelated factors, else runs of the same words in other orders meet
    whole = max(0, n - size + 1)
    h = np.zeros(whole, np.uint64)
    for j in range(size):
        h += word_hash[j : j + whole] * salt[j]
    ok = row[:whole] == row[size - 1 :] if whole else np.zeros(0, bool)
    out_h, out_r = mix(h[ok]), row[:whole][ok]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        extra = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = count[short] > j
            extra[has] += word_hash[first[short[has]] + j] * salt[j]
        extra = mix(extra + count[short].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        out_h, out_r = np.concatenate([out_h, extra]), np.concatenate([out_r, short])
        order = np.argsort(out_r, kind="stable")
        out_h, out_r = out_h[order], out_r[order]
    return out_h, out_r


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` in batches that come sorted by it; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole runs of equal ``key``, many at a time, and where each run begins (and the last one ends).

    The batches come sorted by the key; a run that a batch leaves open is carried into the next table.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        other = np.flatnonzero(keys != keys[-1])
        last = int(other[-1]) + 1 if len(other) else 0  # where the run begins that may go on
        held.append(batch.slice(0, last))
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table, _cuts(table, key)
        held = [batch.slice(last)]
    if held:
        table = pa.Table.from_batches(held)
        yield table, _cuts(table, key)


def _cuts(table: pa.Table, key: str) -> np.ndarray:
    keys = table.column(key).to_numpy()
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
