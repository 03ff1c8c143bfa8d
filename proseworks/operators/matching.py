"""Matching patterns against analysed sentences, for rules of any shape.

A sentence is a list of ``Position``. A pattern element takes as many positions as it can (at most its ``max``),
then fewer, and may leave a gap behind it, the nearest first; the first way through wins. Since
whether the rest of a pattern fits depends only on the element and the position, failures are
remembered, which bounds a search by elements times positions times choices.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import regex

from proseworks.plans.ir import PatternSpec, TokenSpec

START_TAG, END_TAG = "SENT_START", "SENT_END"
#: Tags of sentence and paragraph boundaries, which are no word classes.
BOUNDARY_TAGS = (START_TAG, END_TAG, "PARA_END")


@dataclass
class Position:
    """A token with its readings (lemma, tag); ``start`` counts code points from the sentence's start."""

    token: str
    readings: list[tuple[str | None, str | None]]
    space_before: bool = False
    start: int = 0
    is_start: bool = False
    is_end: bool = False


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    mark_start: int
    mark_end: int
    elements: tuple[tuple[int, int], ...]  # (first position, number of positions) of each element


@functools.lru_cache(maxsize=None)
def compiled(pattern: str, sensitive: bool) -> regex.Pattern:
    return regex.compile(pattern, regex.S if sensitive else regex.S | regex.I)


@functools.lru_cache(maxsize=200_000)
def _text_fits(text: str, regexp: bool, sensitive: bool, value: str) -> bool:
    if regexp:
        return compiled(text, sensitive).fullmatch(value) is not None
    return text == value if sensitive else text.lower() == value.lower()


@functools.lru_cache(maxsize=50_000)
def pos_fits(wanted: str, regexp: bool, tag: str | None) -> bool:
    """A tag, a pattern for all of it, or UNKNOWN for a reading without a tag."""
    if wanted == "UNKNOWN":
        return tag is None
    if tag is None:
        return False
    return compiled(wanted, True).fullmatch(tag) is not None if regexp else wanted == tag


def _reading_fits(spec: TokenSpec, position: Position, reading: tuple[str | None, str | None]) -> bool:
    if spec.space_before is not None and spec.space_before != position.space_before:
        return False
    lemma, tag = reading
    tag_ok = spec.pos is None or pos_fits(spec.pos, spec.pos_regexp, tag) != spec.negate_pos
    if spec.text is None:
        return tag_ok and not spec.negate
    value = lemma if spec.inflected and lemma is not None else position.token
    return tag_ok and _text_fits(spec.text, spec.regexp, spec.case_sensitive, value) != spec.negate


def fits_any(spec: TokenSpec, position: Position) -> bool:
    for r in position.readings:
        if _reading_fits(spec, position, r):
            return True
    return False


_NEIGHBOUR = {"previous": -1, "current": 0, "next": 1}


def fits(spec: TokenSpec, sentence: list[Position], i: int) -> bool:
    """Whether position ``i`` is as an element wants it, exceptions considered."""
    if spec.group:
        return (all if spec.group == "and" else any)(fits(c, sentence, i) for c in spec.children)
    if not fits_any(spec, sentence[i]):
        return False
    for exception in spec.exceptions:
        j = i + _NEIGHBOUR[exception.scope]
        if 0 <= j < len(sentence) and fits_any(exception, sentence[j]):
            return False
    return True


def keeps(spec: TokenSpec, position: Position, reading: tuple[str | None, str | None]) -> bool:
    """Whether one reading is what an element wants and no exception to it."""
    return _reading_fits(spec, position, reading) and not any(e.scope == "current" and _reading_fits(e, position, reading) for e in spec.exceptions)


def match_at(pattern: PatternSpec, sentence: list[Position], start: int, known: dict | None = None) -> Match | None:
    """The match that begins at ``start``. ``known`` may be shared by the calls for one pattern and sentence."""
    tokens, n = pattern.tokens, len(sentence)
    if not tokens:
        return None
    known = {} if known is None else known
    if tokens[0].min >= 1:  # most places end here, before any search is set up
        if (0, start) not in known:
            known[0, start] = start < n and fits(tokens[0], sentence, start)
        if not known[0, start]:
            return None

    def fit(e: int, i: int) -> bool:
        if (e, i) not in known:
            known[e, i] = fits(tokens[e], sentence, i)
        return known[e, i]

    dead: set[tuple[int, int]] = known.setdefault("dead", set())

    def choices(e: int, i: int):
        spec = tokens[e]
        most = 0
        while i + most < n and (spec.max < 0 or most < spec.max) and fit(e, i + most):
            most += 1
        for count in range(most, max(spec.min, 0) - 1, -1):
            free = n - i - count
            for gap in range((free if spec.skip < 0 else min(spec.skip, free)) + 1):
                yield count, i + count + gap

    path: list[tuple[int, int]] = []
    at, open_ = [start], [choices(0, start)]
    while open_:
        e = len(open_) - 1
        step = next(open_[-1], None)
        if step is None:
            dead.add((e, at[-1]))
            open_.pop(), at.pop()
            if path:
                path.pop()
            continue
        count, following = step
        if e + 1 == len(tokens):
            elements = (*path, (at[-1], count))
            last = max(pattern.mark_to - 1, pattern.mark_from)
            if pattern.mark_from >= n or elements[pattern.mark_from][0] >= n:
                return None  # an empty marker behind the last token
            return Match(start, following, elements[pattern.mark_from][0], sum(elements[last]), elements)
        if (e + 1, following) not in dead:
            path.append((at[-1], count))
            at.append(following), open_.append(choices(e + 1, following))
    return None


def scan(pattern: PatternSpec, sentence: list[Position]):
    """Matches from left to right, none beginning before the last one's end."""
    known: dict = {}
    i = 0
    while i < len(sentence):
        m = match_at(pattern, sentence, i, known)
        if m is None:
            i += 1
        else:
            yield m
            i = max(m.end, i + 1)


def covered(patterns: tuple[PatternSpec, ...], sentence: list[Position]) -> set[int]:
    """Positions inside a match of any of the patterns."""
    return {i for p in patterns for m in scan(p, sentence) for i in range(m.start, m.end)}


def unblocked(pattern: PatternSpec, antipatterns: tuple[PatternSpec, ...], sentence: list[Position]):
    """Matches of a pattern that share no position with an antipattern; these are looked for only if there is a match."""
    found = list(scan(pattern, sentence))
    blocked = covered(antipatterns, sentence) if found and antipatterns else set()
    return [m for m in found if not any(i in blocked for i in range(m.start, m.end))]
