"""Many texts at once: tokens as numbers, so that patterns are tried only at places where they can begin.

What depends on a word alone (its length, whether an element's text fits it, its readings) is found out once for each
word; what an element wants is then a lookup for all positions of a batch. A pattern of single tokens is decided by
these lookups; others are matched one by one where their first elements fit. Positions are made where a match looks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from proseworks.operators.analysis import JOINED, Lexicon, Segmenter, act, ended, in_words, is_space, run_parts, tokenize
from proseworks.operators.grammar import Renderer, Synthesizer, replacements
from proseworks.operators.matching import START_TAG, Match, Position, compiled, fits_any, match_at
from proseworks.plans.ir import DisambigRule, GrammarRule, PatternSpec, TokenSpec

_START = ((None, START_TAG),)
#: Places that are looked through for an element behind one that may take several tokens.
_REACH = 8
#: The one character that is longer in lower case.
LONGER = "\u0130"
#: Patterns that are a choice of words.
_ALTERNATIVES = re.compile(r"\w+(?:\|\w+)*")


class _Numbers(dict):
    """Numbers of words in the order in which they are met."""

    def __init__(self):
        super().__init__()
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


class Vocabulary:
    """The words that a worker remembers, and tables of what holds for each. Number 0 is a sentence's start."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.words = [""]
        self.numbers = {"": 0}
        self._low: dict[int, tuple[int, dict[str, list[int]]]] = {}  # by length: words looked at, and their numbers by lower case
        self._longer: list[int] = []  # words that are longer in lower case
        self.length, self.space = np.zeros(1, np.int64), np.zeros(1, bool)
        self.kinds: list[tuple] = [(), _START]  # readings that words have: none, a sentence's start, those of the lexicon
        self._kind_of = {(): 0}
        self.kind = np.ones(1, np.int64)
        self._tables: dict[tuple, np.ndarray] = {}
        self._shown: list[str] = []

    def number(self, tokens: list[str]) -> np.ndarray:
        numbers, done = self.numbers, len(self.words)
        new = list(dict.fromkeys([t for t in tokens if t not in numbers]))
        if new:
            numbers.update(zip(new, range(done, done + len(new))))
            self.words += new
            self.length = np.concatenate([self.length, np.fromiter(map(len, new), np.int64, len(new))])
            space = np.fromiter(map(str.isspace, new), bool, len(new))
            for n in np.flatnonzero(space).tolist():
                space[n] = is_space(new[n])
            self.space = np.concatenate([self.space, space])
            if LONGER in "".join(new):
                self._longer += [n for n, w in enumerate(new, done) if LONGER in w]
        return np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))

    def alike(self, low: str) -> list[int]:
        """Numbers of the words with this lower case; only words of its length are looked at."""
        done, found = self._low.get(len(low), (0, {}))
        if done < len(self.words):
            for n in (np.flatnonzero(self.length[done:] == len(low)) + done).tolist():
                found.setdefault(self.words[n].lower(), []).append(n)
            self._low[len(low)] = len(self.words), found
        return found.get(low, []) + [n for n in self._longer if self.words[n].lower() == low]

    def shown_words(self) -> list[str]:
        new = self.words[len(self._shown) :]
        text = "".join(new)
        self._shown += map(shown, new) if "\n" in text or "\t" in text else new
        return self._shown

    def kind_table(self) -> np.ndarray:
        """The number of each word's readings in ``kinds``."""
        new = self.words[len(self.kind) :]
        if new:
            own = np.zeros(len(new), np.int64)
            for n in self.lexicon.candidates(new):
                readings = tuple(self.lexicon.readings(new[n]))
                k = self._kind_of.get(readings)
                if k is None:
                    k = self._kind_of[readings] = len(self.kinds)
                    self.kinds.append(readings)
                own[n] = k
            self.kind = np.concatenate([self.kind, own])
        return self.kind

    def readings(self, kind: int, end: bool) -> list[tuple[str | None, str | None]]:
        own = list(self.kinds[kind]) or [(None, None)]
        return ended(own) if end else own

    def text_table(self, spec: TokenSpec) -> np.ndarray:
        """Whether the text that an element wants fits each word."""
        key = (spec.text, spec.regexp, spec.case_sensitive)
        old = self._tables.get(key)
        done, size = 0 if old is None else len(old), len(self.words)
        if done < size:
            if spec.regexp:
                match = compiled(spec.text, spec.case_sensitive).fullmatch
                if _ALTERNATIVES.fullmatch(spec.text):  # only words as long as an alternative are asked
                    new = np.isin(self.length[done:], [len(x) for x in spec.text.split("|")])
                    for n in np.flatnonzero(new).tolist():
                        new[n] = match(self.words[done + n]) is not None
                else:
                    new = np.array([match(w) is not None for w in self.words[done:]], bool)
            else:
                new = np.zeros(size - done, bool)
                own = [n for n in (self.numbers.get(spec.text),) if n is not None] if spec.case_sensitive else self.alike(spec.text.lower())
                new[[n - done for n in own if n >= done]] = True
            self._tables[key] = old = new if old is None else np.concatenate([old, new])
        return old

    def reading_table(self, spec: TokenSpec, texts: bool) -> np.ndarray:
        """Whether an element fits the readings of each kind, as they are and at a sentence's end; ``texts``: lemmas too."""
        key = (spec, texts)
        old = self._tables.get(key)
        done, size = 0 if old is None else len(old) // 2, len(self.kinds)
        if done < size:
            bare = TokenSpec(
                text=spec.text if texts else None, regexp=spec.regexp, case_sensitive=spec.case_sensitive, inflected=spec.inflected, negate=spec.negate and texts,
                pos=spec.pos, pos_regexp=spec.pos_regexp, negate_pos=spec.negate_pos,
            )
            new = [fits_any(bare, Position("", self.readings(k, end))) for k in range(done, size) for end in (False, True)]
            self._tables[key] = old = np.array(new, bool) if old is None else np.concatenate([old, np.array(new, bool)])
        return old


def shown(s: str) -> str:
    return s.replace("\n", "\\n").replace("\t", "\\t")


def _line(token: str, readings: Iterable[tuple[str | None, str | None]]) -> str:
    return f"TOK|{shown(token)}|" + "#".join(f"{'∅' if a is None else shown(a)}/{b or '∅'}" for a, b in readings)


class Sentence:
    """The positions of one sentence of a batch, each made when it is looked at."""

    __slots__ = ("batch", "first", "size")

    def __init__(self, batch: Batch, first: int, size: int):
        self.batch, self.first, self.size = batch, first, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[j] for j in range(*i.indices(self.size))]
        if not 0 <= i < self.size:
            raise IndexError(i)
        return self.batch.position(self.first + i)


def _single(pattern: PatternSpec) -> bool:
    """Whether a match is decided by its place: a pattern of single tokens whose marker is none behind the last."""
    return pattern.fixed and pattern.mark_from < len(pattern.tokens)


def _reads(spec: TokenSpec) -> bool:
    """Whether an element looks at readings."""
    return spec.pos is not None or spec.inflected or any(map(_reads, spec.exceptions)) or any(map(_reads, spec.children))


def _joined(text: str, points: np.ndarray, heads: np.ndarray, sentences: list[str]) -> list[int]:
    """Sentences that have what ``JOINED`` looks for; only those with one of its signs are searched."""
    at = [np.flatnonzero((points == ord("@")) | (points == ord("/")) | ((points >= 0xFE00) & (points <= 0xFE0F)))]
    p = text.find("www")
    while p >= 0:
        at.append(np.array([p]))
        p = text.find("www", p + 1)
    some = np.unique(np.searchsorted(heads, np.concatenate(at), "right") - 1)
    return [k for k in some.tolist() if JOINED.search(sentences[k])]


def _cut(sentences: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Numbers of the tokens of all sentences, 0 before each sentence's: what ``tokenize`` gives, each distinct run of characters looked at once."""
    known = vocabulary.lexicon.knows
    if not sentences:
        return np.zeros(0, np.int64)
    text = "".join(sentences)
    size = np.fromiter(map(len, sentences), np.int64, len(sentences))
    heads = np.cumsum(size) - size
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inside = in_words()[points]
    begins = np.ones(len(points), bool)
    begins[1:] = ~(inside[1:] & inside[:-1])
    begins[heads] = True
    starts = np.flatnonzero(begins)
    data = text.encode()
    if len(data) == len(points):
        offsets = np.append(starts, len(data))
    else:
        ends = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)
        offsets = np.append(np.append(0, ends)[starts], len(data))
    runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
    of_run = runs.indices.to_numpy()
    distinct = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
    split = {n: parts for n, run in enumerate(distinct) if ("-" in run or "'" in run or "’" in run) and (parts := run_parts(run, known)) != [run]}
    of = np.repeat(np.arange(len(sentences)), np.diff(np.append(np.searchsorted(starts, heads), len(starts))))
    if split:
        count, flat, done = np.ones(len(distinct), np.int64), [], 0
        for n, parts in split.items():
            count[n] = len(parts)
            flat += distinct[done:n] + parts
            done = n + 1
        flat += distinct[done:]
        each = count[of_run]
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        word = vocabulary.number(flat)[np.repeat((np.cumsum(count) - count)[of_run], each) + nth]
        of = np.repeat(of, each)
    else:
        word = vocabulary.number(distinct)[of_run]
    whole = _joined(text, points, heads, sentences)
    if whole:
        lists = [tokenize(sentences[k], known) for k in whole]
        some = np.ones(len(sentences), bool)
        some[whole] = False
        word = np.concatenate([word[some[of]], vocabulary.number([t for own in lists for t in own])])
        of = np.concatenate([of[some[of]], np.repeat(whole, [len(own) for own in lists])])
        order = np.argsort(of, kind="stable")
        word, of = word[order], of[order]
    out = np.zeros(len(word) + len(sentences), np.int64)
    out[np.arange(len(word)) + of + 1] = word
    return out


class Batch:
    """Tokens and positions of the sentences of some texts. A sentence's first position stands for its start."""

    def __init__(self, segmenter: Segmenter, vocabulary: Vocabulary, texts: Iterable[str]):
        self.vocabulary = vocabulary
        owner, number, base, self.raw = [], [], [], []
        for d, text in enumerate(texts):
            at = 0
            for n, sentence in enumerate(segmenter.sentences(text)):
                owner.append(d), number.append(n), base.append(at), self.raw.append(sentence)
                at += len(sentence)
        self.owner, self.number, self.base = (np.array(x, np.int64) for x in (owner, number, base))  # of each sentence: its text, its number there and where it begins
        word = _cut(self.raw, vocabulary)
        length, space = vocabulary.length[word], vocabulary.space[word]
        at = np.cumsum(length) - length
        spaced = np.zeros(len(word), bool)
        spaced[1:] = space[:-1]
        solid = np.flatnonzero(~space)
        self.word, spaced = word[solid], spaced[solid]
        self.opens = self.word == 0
        self.spaced = spaced & ~self.opens
        self.first = np.flatnonzero(self.opens)  # of each sentence: its first position
        self.size = np.diff(np.append(self.first, len(self.word)))
        self.sentence = np.cumsum(self.opens) - 1  # of each position
        at = at[solid]
        self.start = at - at[self.first][self.sentence]
        self.left = (self.first + self.size)[self.sentence] - np.arange(len(self.word))  # positions up to the sentence's end, this one included
        self.closes = (self.left == 1) & ~self.opens
        self._made: dict[int, Position] = {}
        self._changed: set[int] = set()
        self._fixed: dict[tuple, np.ndarray] = {}
        self._loose: dict[tuple, np.ndarray] = {}  # what holds until readings change

    def __len__(self) -> int:
        return len(self.word)

    def position(self, p: int) -> Position:
        made = self._made.get(p)
        if made is None:
            w = int(self.word[p])
            readings = self.vocabulary.readings(int(self.vocabulary.kind_table()[w]), bool(self.closes[p]))
            made = self._made[p] = Position(self.vocabulary.words[w], readings, bool(self.spaced[p]), int(self.start[p]), w == 0, bool(self.closes[p]))
        return made

    def of(self, k: int) -> Sentence:
        return Sentence(self, int(self.first[k]), int(self.size[k]))

    def strings(self, positions: np.ndarray) -> pa.Array:
        words, own = self.vocabulary.words, self.word[positions]
        distinct = np.flatnonzero(np.bincount(own, minlength=1))
        number = np.zeros(len(words), np.int64)
        number[distinct] = np.arange(len(distinct))
        return pa.array([words[w] for w in distinct.tolist()], pa.string()).take(pa.array(number[own]))

    def tallied(self) -> tuple[pa.Array, np.ndarray]:
        """Lines of tokens and their readings, and for each position the number of its line."""
        v = self.vocabulary
        kinds = v.kind_table()
        code = 2 * self.word + self.closes
        distinct = np.flatnonzero(np.bincount(code, minlength=1))
        number = np.zeros(2 * len(v.words), np.int64)
        number[distinct] = np.arange(len(distinct))
        marks = v.shown_words()
        word = distinct >> 1
        kind, which = np.unique(2 * kinds[word] + (distinct & 1), return_inverse=True)
        tails = [_line("", v.readings(k >> 1, bool(k & 1)))[4:] for k in kind.tolist()]
        out = pc.binary_join_element_wise("TOK|", pa.array([marks[w] for w in word.tolist()], pa.string()), pa.array(tails, pa.string()).take(pa.array(which)), "")
        own = number[code]
        more = _Numbers()
        for p in self._changed:
            own[p] = len(out) + more[_line(self._made[p].token, self._made[p].readings)]
        return pa.concat_arrays([out, pa.array(more.words, pa.string())]), own

    def dumped(self) -> list[str]:
        """A line for each position: its token and its readings."""
        lines, own = self.tallied()
        lines = lines.to_pylist()
        return [lines[n] for n in own.tolist()]

    # ---- what elements want, at all positions ----

    def _leaf(self, spec: TokenSpec) -> np.ndarray:
        """Whether some reading of each position is as an element wants it, exceptions aside."""
        v = self.vocabulary
        out = v.text_table(spec)[self.word] != spec.negate if spec.text is not None else np.full(len(self), not spec.negate)
        if spec.pos is not None or spec.inflected:
            kind = v.kind_table()[self.word]
            code = 2 * kind + self.closes
            out &= v.reading_table(spec, False)[code]
            if spec.inflected:  # lemmas take the word's place, if there are any
                out = np.where(kind == 0, out, v.reading_table(spec, True)[code])
        if spec.space_before is not None:
            out &= self.spaced == spec.space_before
        if spec.pos is not None or spec.inflected:
            for p in self._changed:
                out[p] = fits_any(spec, self._made[p])
        return out

    def fits(self, spec: TokenSpec, exact: bool = True) -> np.ndarray:
        """Whether each position is as an element wants it; unless ``exact``, without asking for exceptions."""
        cache, key = (self._loose if _reads(spec) else self._fixed), (spec, exact)
        if key in cache:
            return cache[key]
        if spec.group:
            own = [self.fits(c, exact) for c in spec.children]
            out = np.logical_and.reduce(own) if spec.group == "and" else np.logical_or.reduce(own)
            if not own:
                out = np.full(len(self), spec.group == "and")
        else:
            out = self._leaf(spec)
            for e in spec.exceptions if exact else ():
                there = self._leaf(e)
                if e.scope == "previous":
                    there = np.append(False, there[:-1]) & ~self.opens
                elif e.scope == "next":
                    there = np.append(there[1:], False) & (self.left > 1)
                out = out & ~there
        cache[key] = out
        return out

    def _begins(self, pattern: PatternSpec, exact: bool) -> np.ndarray:
        """Positions where a match may begin: those where the elements that it needs fit within their reach, as far as that is short."""
        tokens = pattern.tokens
        if not tokens:
            return np.zeros(0, np.int64)
        found = np.arange(len(self))
        near = far = 0  # where the next element may begin
        for t in tokens:
            if t.min >= 1:
                fits = self.fits(t, exact)
                if far == 0:
                    found = np.flatnonzero(fits) if len(found) == len(self) else found[fits[found]]
                else:
                    some = np.zeros(len(found), bool)
                    for d in range(near, far + 1):
                        inside = self.left[found] > d
                        some[inside] |= fits[found[inside] + d]
                    found = found[some]
            if t.max < 0 or t.skip < 0:
                break
            near, far = near + max(t.min, 0), far + t.max + t.skip
            if far - near > _REACH:
                break
        return found

    # ---- matches ----

    def _placed(self, pattern: PatternSpec) -> np.ndarray:
        """First positions of the matches of a pattern of single tokens."""
        at, size = self._begins(pattern, True), len(pattern.tokens)
        if len(at) < 2 or (np.diff(at) >= size).all():
            return at
        out, after = [], -1
        for p in at.tolist():
            if p >= after:
                after = p + size
                out.append(p)
        return np.array(out, np.int64)

    def matches(self, pattern: PatternSpec) -> Iterator[tuple[int, int, Match | None]]:
        """(first position, position behind, match) from left to right, none beginning before the last one's end.

        A match of a pattern of single tokens is its place: ``Match`` is left out.
        """
        if _single(pattern):
            size = len(pattern.tokens)
            for p in self._placed(pattern).tolist():
                yield p, p + size, None
            return
        after = -1
        last, known = -1, {}
        begins = self._begins(pattern, False)
        for p, k in zip(begins.tolist(), self.sentence[begins].tolist()):
            if p < after:
                continue
            if k != last:
                last, known, sentence = k, {}, self.of(k)
            m = match_at(pattern, sentence, p - sentence.first, known)
            if m is not None:
                after = sentence.first + max(m.end, m.start + 1)
                yield sentence.first + m.start, sentence.first + m.end, m

    def covered(self, patterns: Iterable[PatternSpec]) -> np.ndarray:
        """Positions inside a match of any of the patterns."""
        out = np.zeros(len(self), bool)
        for pattern in patterns:
            if _single(pattern):
                at = self._placed(pattern)
                for d in range(len(pattern.tokens)):
                    out[at + d] = True
                continue
            for a, b, _ in self.matches(pattern):
                out[a:b] = True
        return out

    def disambiguate(self, rules: Iterable[DisambigRule]) -> None:
        """Apply rules in order; each sees what the ones before it left."""
        for rule in rules:
            if rule.unsupported:
                continue
            after, last, blocked, touched = -1, -1, None, set()
            begins = self._begins(rule.pattern, False)
            for p, k in zip(begins.tolist(), self.sentence[begins].tolist()):
                if p < after:
                    continue
                if k != last:
                    last, sentence = k, self.of(k)
                # Matches depend on readings that the rule itself rewrites, so they are looked for step by step.
                m = match_at(rule.pattern, sentence, p - sentence.first)
                if m is None:
                    continue
                if blocked is None and rule.antipatterns:
                    blocked = self.covered(rule.antipatterns)  # those of other sentences do not depend on what is changed here
                at = sentence.first
                if blocked is None or not blocked[at + m.start : at + m.end].any():
                    act(rule, sentence, m)
                    touched.update(range(at + m.mark_start, min(at + m.mark_end, at + len(sentence))))
                after = at + max(m.end, m.start + 1)
            if touched:
                self._changed |= touched
                self._loose.clear()

    # ---- findings ----

    def _rule_findings(self, rule: GrammarRule, synthesizer: Synthesizer | None, said: list[tuple]) -> tuple[np.ndarray, ...] | None:
        """Sentence, offset, -length, rule number, number in the sentence and place in ``said`` (message, replacements, rule) of each of a rule's matches."""
        pattern, words = rule.pattern, self.vocabulary.words
        last = max(pattern.mark_to - 1, pattern.mark_from)
        if _single(pattern):
            made, at = None, self._placed(pattern)
            behind, mark, end = at + len(pattern.tokens), at + pattern.mark_from, at + last + 1
        else:
            made = list(self.matches(pattern))
            at, behind = (np.array([m[i] for m in made], np.int64) for i in (0, 1))
            mark, end = (np.array([getattr(m, name) for _, _, m in made], np.int64) for name in ("mark_start", "mark_end"))
            if len(at):
                first = self.first[self.sentence[at]]
                mark, end = first + mark, first + end
        if not len(at):
            return None
        k = self.sentence[at]
        kept = mark < self.first[k] + self.size[k]
        if rule.antipatterns:
            blocked = np.append(0, np.cumsum(self.covered(rule.antipatterns)))
            kept &= blocked[behind] == blocked[at]
        own = np.flatnonzero(kept)
        if not len(own):
            return None
        at, behind, mark, end, k = at[own], behind[own], mark[own], end[own], k[own]
        n = np.arange(len(own))
        nth = n - np.maximum.accumulate(np.where(np.append(True, k[1:] != k[:-1]), n, 0))
        tail = np.maximum(end - 1, mark)
        offset = self.start[mark]
        less = offset - self.start[tail] - self.vocabulary.length[self.word[tail]]
        distinct, which = np.unique(self.word[mark], return_inverse=True)
        capital = np.array([words[w][:1].isupper() for w in distinct.tolist()], bool)[which]

        def say(i: int) -> int:
            first = int(self.first[k[i]])
            a, b = int(at[i]), int(behind[i])
            m = made[own[i]][2] if made else Match(a - first, b - first, int(mark[i]) - first, int(end[i]) - first, tuple((j - first, 1) for j in range(a, b)))
            renderer = Renderer(self.of(int(k[i])), m, synthesizer)
            said.append((renderer.message(rule.message), replacements(rule, renderer, bool(capital[i])), rule))
            return len(said) - 1

        if any(p.ref for _, t in rule.message for p in t) or any(p.ref for t in rule.suggestions for p in t):
            text = np.array([say(i) for i in range(len(own))], np.int64)
        else:  # what is said does not depend on the match, only on its first letter
            text = np.zeros(len(own), np.int64)
            for upper in (False, True):
                those = np.flatnonzero(capital == upper)
                if len(those):
                    text[those] = say(int(those[0]))
        return k, self.base[k] + offset, less, np.full(len(own), rule.order, np.int64), nth, text

    def found(self, rules: Iterable[GrammarRule], synthesizer: Synthesizer | None) -> tuple[list[np.ndarray], list[tuple]]:
        """The findings of all rules by sentence, those inside a larger one left out; equal spans all stay.

        Sentence, offset, -length, rule number, number in the sentence and place in the second list, which has (message, replacements, rule).
        """
        said: list[tuple] = []
        parts = [p for rule in rules if (p := self._rule_findings(rule, synthesizer, said)) is not None]
        if not parts:
            return [np.zeros(0, np.int64)] * 6, said
        columns = [np.concatenate(c) for c in zip(*parts)]
        order = np.lexsort(columns[4::-1])
        columns = [c[order] for c in columns]
        k, offset, less = columns[:3]
        ends = offset - less
        place = k * (int(ends.max()) + 1) + ends  # grows with the sentence, then with the end
        new = np.append(True, (k[1:] != k[:-1]) | (offset[1:] != offset[:-1]) | (less[1:] != less[:-1]))
        reaches = place > np.append(-1, np.maximum.accumulate(place)[:-1])
        # ends before this sentence are all below its own places, so that a sentence's first finding always reaches
        kept = reaches[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        return [c[kept] for c in columns], said

    def findings(self, rules: Iterable[GrammarRule], synthesizer: Synthesizer | None) -> list[tuple]:
        """The same as rows: (sentence, offset, -length, rule number, number in the sentence, message, replacements, rule)."""
        columns, said = self.found(rules, synthesizer)
        return [(*row, *said[text]) for *row, text in zip(*(c.tolist() for c in columns))]
