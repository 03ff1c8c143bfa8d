"""Dictionary words one or two edits away, for many words at once.

What an edit (deletion, insertion, replacement, swap of neighbours) makes of a word is the same for all words of its
length, if a sign stands for any new character. These patterns are looked up, by hashes, among the words of the dictionary
in which the sign has taken the place of up to two characters, so nearly all that is found is a word so many edits away; hashes
that agree by chance are told apart by the characters. The dictionary comes in order of preference and in parts of
bounded size, and a word that has enough suggestions is not asked for again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Stands for any character; code points are smaller. Fills rows of shorter words.
ANY, NONE = 0x110000, 0x110001
#: Words of a part of the dictionary when one edit, or two, are looked for (12 bytes a key: about 9 and 35 keys a word).
PARTS = {1: 1_000_000, 2: 500_000}
#: Keys that are looked up at once, and pairs that are compared at once.
KEYS, PAIRS = 2_000_000, 1_000_000
_FACTOR = 0x9E3779B97F4A7C15


def _mixed(codes: np.ndarray) -> np.ndarray:
    z = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_FACTOR)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.array([pow(0xD1342543DE82EF95, i + 1, 2**64) for i in range(n)], np.uint64)


def codes(words: list[str], size: int) -> np.ndarray:
    """The code points of words of ``size`` characters, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places of the words that have it)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


@functools.cache
def patterns(size: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """What so many edits or fewer make of words of ``size`` characters: a row for each outcome, with the places that its
    characters come from (``size`` for any character, then -1 up to the row's end), and how many characters it has."""
    made = {tuple(range(size))}
    for _ in range(edits):
        made |= {q for p in made for q in _edited(p, size)}
    rows = np.full((len(made), size + edits), -1, np.int64)
    for row, p in zip(rows, sorted(made)):
        row[: len(p)] = p
    return rows, (rows >= 0).sum(1)


def _edited(p: tuple[int, ...], sign: int) -> Iterator[tuple[int, ...]]:
    for i in range(len(p) + 1):
        yield (*p[:i], sign, *p[i:])
        if i < len(p):
            yield (*p[:i], *p[i + 1 :])
            yield (*p[:i], sign, *p[i + 1 :])
        if i + 1 < len(p):
            yield (*p[:i], p[i + 1], p[i], *p[i + 2 :])


@functools.cache
def _weights(size: int, edits: int) -> np.ndarray:
    """What each character of a word, and the sign, count in the hash of each pattern."""
    rows, _ = patterns(size, edits)
    out, powers = np.zeros((size + 1, len(rows)), np.uint64), _powers(size + edits)
    for k, row in enumerate(rows):
        for j, i in enumerate(row[row >= 0]):
            out[i, k : k + 1] += powers[j : j + 1]
    return out


class Strange:
    """Characters beside a-z in a dictionary as bits, 64 of them a number: other words may be suggested only to words that have them."""

    def __init__(self, own: np.ndarray):
        self.signs = np.unique(own[((own < 97) | (own > 122)) & (own < ANY)])
        self.capitals = self._bits(np.arange(65, 91, dtype=np.uint32)[None, :])[0]

    def _bits(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), -(-len(self.signs) // 64)), np.uint64)
        if rows.size and len(self.signs):
            at = np.minimum(np.searchsorted(self.signs, rows), len(self.signs) - 1)
            there = self.signs[at] == rows
            for k in range(out.shape[1]):
                out[:, k] = np.bitwise_or.reduce(np.where(there & (at >> 6 == k), np.uint64(1) << (at & 63).astype(np.uint64), np.uint64(0)), axis=1)
        return out

    def of(self, rows: np.ndarray, capital: np.ndarray | None = None) -> np.ndarray:
        bits = self._bits(rows)
        return bits if capital is None else np.where(capital[:, None], bits | self.capitals, bits)


class Index:
    """Hashes of a part of the dictionary with up to ``edits`` characters replaced by the sign."""

    def __init__(self, words: list[str], edits: int):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.codes = np.full((len(words), max(self.size.max(initial=0), 1)), NONE, np.uint32)
        sign, keys, own = _mixed(np.array([ANY])), [], []
        for n, at in by_length(words):
            rows = codes([words[i] for i in at], n)
            self.codes[at, :n] = rows
            parts, powers = _mixed(rows) * _powers(n), _powers(n)
            whole, change = parts.sum(1, dtype=np.uint64), sign * powers - parts
            for k in range(edits + 1):
                if k == 2:
                    i, j = np.triu_indices(n, 1)
                made = whole[:, None] if k == 0 else whole[:, None] + (change if k == 1 else change[:, i] + change[:, j])
                keys.append(made.ravel())
                own.append(np.repeat(at.astype(np.int32), made.shape[1]))
        keys, own = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((keys, np.uint64), (own, np.int32)))
        order = np.argsort(keys)
        self.keys, self.own = keys[order], own[order]
        self.strange = Strange(self.codes)
        self.signs = self.strange.of(self.codes)
        # A bit for each of many ranges of hashes: most that are asked for end here.
        bits = min(max(12, int(len(keys)).bit_length() + 4), 28)
        self.shift, self.there = np.uint64(64 - bits), np.zeros(1 << (bits - 3), np.uint8)
        if len(keys):
            place = self.keys >> self.shift
            place = place[np.append(True, place[1:] != place[:-1])]
            byte, bit = place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)
            first = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
            self.there[byte[first]] = np.bitwise_or.reduceat(bit, first)

    def _found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``hashes``, first key, number of keys) of those that are keys."""
        place = hashes >> self.shift
        some = np.flatnonzero((self.there[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
        some = some[np.argsort(hashes[some])]
        asked = hashes[some]
        low = np.searchsorted(self.keys, asked)
        high = np.searchsorted(self.keys, asked, "right")
        some, low, high = (x[high > low] for x in (some, low, high))
        return some, low, high - low

    def near(self, rows: np.ndarray, capital: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``rows``, number of the dictionary word), once each and sorted, of words so many edits or fewer away, but for the word itself.

        ``rows``: code points of words of equal length. Pairs come in pieces, each with all of some words.
        """
        size = rows.shape[1]
        pattern, length = patterns(size, edits)
        step = max(1, KEYS // len(pattern))
        parts = np.concatenate([_mixed(rows), np.broadcast_to(_mixed(np.array([ANY])), (len(rows), 1))], axis=1)
        signs = self.strange.of(rows, capital)
        wide = np.concatenate([rows, np.full((len(rows), 1), ANY, np.uint32)], axis=1)
        for a in range(0, len(rows), step):
            hashes = (parts[a : a + step] @ _weights(size, edits)).ravel()
            some, low, many = self._found(hashes)
            pairs, ends = [], np.cumsum(many)
            done = 0
            while done < len(some):  # as many keys as have about so many words
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
                of, n = np.repeat(some[done:upto], many[done:upto]), many[done:upto]
                word = self.own[np.repeat(low[done:upto] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                who, how = a + of // len(pattern), of % len(pattern)
                ok = ((self.signs[word] & ~signs[who]) == 0).all(1)
                who, how, word = who[ok], how[ok], word[ok]
                pairs.append(self._same(wide, pattern, length, who, how, word))
                done = upto
            if pairs:
                pairs = np.unique(np.concatenate(pairs))
                yield pairs // len(self.size), pairs % len(self.size)

    def _same(self, wide: np.ndarray, pattern: np.ndarray, length: np.ndarray, who: np.ndarray, how: np.ndarray, word: np.ndarray) -> np.ndarray:
        """who * words + word of those pairs whose pattern is the word's in every character, unless both words are equal."""
        size = wide.shape[1] - 1
        ok = length[how] == self.size[word]
        equal = self.size[word] == size
        for j in range(min(pattern.shape[1], self.codes.shape[1])):
            own = self.codes[word, j]
            place = pattern[how, j]
            ok &= (place < 0) | (place == size) | (wide[who, place] == own)
            if j < size:
                equal &= wide[who, j] == own
        return (who * len(self.size) + word)[ok & ~equal]


class Nearest:
    """A dictionary (distinct words in order of preference) that is asked for the words nearest to others."""

    def __init__(self, known: pa.Array):
        self.known = known
        self._index: dict[tuple[int, int], Index] = {}

    def _part(self, edits: int, k: int) -> Index:
        """The index of a part; it stays for the next task if it is the only one of its kind."""
        if (edits, k) in self._index:
            return self._index[edits, k]
        size = PARTS[edits]
        out = Index(self.known.slice(k * size, size).to_pylist(), edits)
        if len(self.known) <= size:
            self._index[edits, k] = out
        return out

    def of(self, words: list[str], capital: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, number of the dictionary word) sorted: for each word the first ``most`` one edit away, or two where none is."""
        groups = [(n, at, codes([words[i] for i in at], n)) for n, at in by_length(words)]
        out, count = [], np.zeros(len(words), np.int64)
        for edits in (1, 2):
            wanted = count == 0
            for k in range(-(-len(self.known) // PARTS[edits])):
                index = None
                for n, at, rows in groups:
                    open_ = np.flatnonzero(wanted[at] & (count[at] < most))
                    if not len(open_):
                        continue
                    index = index or self._part(edits, k)
                    for who, word in index.near(rows[open_], capital[at[open_]], edits):
                        own = at[open_[who]]
                        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
                        nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
                        kept = count[own] + nth < most
                        own, word = own[kept], word[kept]
                        out.append((own, word + k * PARTS[edits]))
                        np.add.at(count, own, 1)
        own, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), ())))
        order = np.lexsort((word, own))
        return own[order], word[order]
