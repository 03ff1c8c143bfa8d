"""Sentences, tokens, readings and disambiguation: the stages from a text to an analysed sentence.

The same functions serve batch and streaming: they work row by row over Arrow batches of texts. The rules and the lexicon
that they need come with the pack, which is broadcast once and built once in each worker.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable

import numpy as np
import regex

from proseworks.operators.matching import END_TAG, START_TAG, Match, Position, covered, keeps, match_at, pos_fits
from proseworks.plans.ir import DisambigRule, Reading
from proseworks.sources.srx import BreakRule, for_python

# ---- sentences ----


class Segmenter:
    """Breaks between sentences by ordered rules; the first rule that speaks about a place decides it."""

    def __init__(self, rules: Iterable[BreakRule]):
        self.rules = []
        for rule in rules:
            look = (f"(?<=(?:{rule.before}))" if rule.before else "") + (f"(?=(?:{rule.after}))" if rule.after else "")
            try:
                if look:
                    self.rules.append((regex.compile(look), rule.is_break, "\n" if (rule.before, rule.after) == (r"\n", "") else None))
            except regex.error:
                continue  # a rule that cannot be compiled says nothing

    def sentences(self, text: str) -> list[str]:
        cuts: set[int] = set()
        for number, (look, is_break, sign) in enumerate(self.rules):
            if not is_break:
                continue
            for p in _behind(sign, text) if sign else (m.start() for m in look.finditer(text)):
                # Rules against breaks are asked only where there would be one.
                if 0 < p < len(text) and p not in cuts and not any(not b and r.match(text, p) for r, b, _ in self.rules[:number]):
                    cuts.add(p)
        places = [0, *sorted(cuts), len(text)]
        return [text[a:b] for a, b in zip(places, places[1:]) if b > a]


def _behind(sign: str, text: str):
    """Places behind a sign."""
    p = text.find(sign)
    while p >= 0:
        yield p + 1
        p = text.find(sign, p + 1)


# ---- tokens ----

#: Characters of words (besides apostrophes), fixed values in the notation of character classes that Java and RE2 share.
WORD = r"±§©@€£¥$\p{L}\d\-\x{0300}-\x{036F}\x{00A8}°%‰‱&\x{FFFD}\x{00AD}\x{00AC}\x{FF0C}\x{FF1F}"
WORD_CLASS = for_python(WORD)
#: Contractions, fixed values: each group of the first pattern that matches a whole word becomes tokens.
CONTRACTIONS = tuple(
    regex.compile(p, regex.I)
    for p in (
        r"(fo['']c['']sle|rec[''][ds]|OK['']d|cc[''][ds]|DJ['']d|[pd]m['']d|rsvp['']d)",
        r"(['']?)(are|is|were|was|do|does|did|have|has|had|wo|would|ca|could|sha|should|must|ai|ought|might|need|may|am|dare|das|dass|hai|used|use)(n['']t)",
        r"(.+)(['']m|['']re|['']ll|['']ve|['']d|['']s)([''-]?)",
        r"(['']t)(was|were|is)",
    )
)
#: Words with hyphens that stay whole, fixed values.
WHOLE = ("mers-cov", "mcgraw-hill", "sars-cov-2", "sars-cov", "ph-metre", "ph-metres", "anti-ivg", "anti-uv", "anti-vih", "al-qaida")
#: E-mail addresses, what URLs consist of, and domain labels, fixed values.
EMAIL = regex.compile(r"(?<!:)@?\b[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@((\[[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\])|(([a-zA-Z\-0-9]+\.)+[a-zA-Z]{2,}))\b")
URL_SIGNS = re.compile(r"[a-zA-ZÄÖÜäöü0-9/%$-_.+!*'(),?#~]+")
LABEL = re.compile(r"[a-zA-Z0-9][a-zA-Z0-9-]+")
PROTOCOLS = ("http", "https", "ftp")
CLOSING = ('"', "»", "«", "'", "’", "“", "”", "‘", ".")
ENDING = (".", ",", ";", ":", "!", "?")

_SCAN = regex.compile(rf"[{WORD_CLASS}'’]+|[^{WORD_CLASS}'’]", regex.S)
_APOSTROPHE = re.compile("(['’])")
_SELECTORS = frozenset(map(chr, range(0xFE00, 0xFE10)))


def is_space(token: str) -> bool:
    return token.isspace() and not any("\x1c" <= c <= "\x1f" for c in token)


def _word_parts(word: str, known: Callable[[str], bool]) -> list[str]:
    """A word without the hyphens around it, whole if it is known or has no marks, else cut at apostrophes."""
    core = word.strip("-")
    if not core:
        return list(word)
    before = len(word) - len(word.lstrip("-"))
    after = len(word) - before - len(core)
    marked = any(c in core for c in "-'’")
    if marked and not known(core.replace("­", "").replace("’", "'")) and core.lower() not in WHOLE:
        parts = [p for p in _APOSTROPHE.split(core) if p]
    else:
        parts = [core]
    return ["-"] * before + parts + ["-"] * after


def run_parts(run: str, known: Callable[[str], bool]) -> list[str]:
    """The tokens of a run of word characters, or of another character."""
    short = "'" in run or "’" in run
    if not short and "-" not in run:
        return [run]
    found = next((c for p in CONTRACTIONS if (c := p.fullmatch(run))), None) if short else None
    return [t for part in (found.groups() if found else (run,)) if part for t in _word_parts(part, known)]


@functools.cache
def in_words() -> np.ndarray:
    """Of each code point whether it is a character of words, as ``_SCAN`` takes it."""
    out = np.zeros(0x110000, bool)
    signs = regex.findall(rf"[{WORD_CLASS}'’]", "".join(map(chr, range(0x110000))))
    out[np.fromiter(map(ord, signs), np.int64, len(signs))] = True
    return out


#: What a text has whose tokens depend on more than one run: addresses, URLs, variation selectors.
JOINED = regex.compile("[@/\uFE00-\uFE0F]|www")


def _join_emails(tokens: list[str]) -> list[str]:
    text = "".join(tokens)
    spans = [m.span() for m in EMAIL.finditer(text)] if "@" in text else []
    if not spans:
        return tokens
    out, at, k = [], 0, 0
    for token in tokens:
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        if k < len(spans) and at == spans[k][0]:
            out.append(text[slice(*spans[k])])
        elif k == len(spans) or at < spans[k][0]:
            out.append(token)
        at += len(token)
    return out


def _url_begins(t: list[str], i: int) -> bool:
    after = t[i + 1 : i + 6]
    if t[i] in PROTOCOLS and after[:3] == [":", "/", "/"] or t[i] == "www" and after[:1] == ["."]:
        return True
    for labels in (2, 3):  # a.b/ and a.b.c/
        part = t[i : i + 2 * labels]
        if len(part) == 2 * labels and part[-1] == "/" and all(s == "." for s in part[1:-1:2]) and all(LABEL.fullmatch(x) for x in part[::2]):
            return True
    return False


def _url_ends(t: list[str], i: int, quote: str | None) -> bool:
    token = t[i]
    if is_space(token) or token in (")", "]") or not URL_SIGNS.fullmatch(token):
        return True
    if i + 1 == len(t):
        return token == "." or token == quote
    return (is_space(t[i + 1]) or t[i + 1] in CLOSING) and (token in ENDING or token == quote)


def _join_urls(tokens: list[str]) -> list[str]:
    out: list[str] = []
    url, quote = "", None
    for i, token in enumerate(tokens):
        if url:
            if _url_ends(tokens, i, quote):
                out += [url, token]
                url, quote = "", None
            else:
                url += token
        elif _url_begins(tokens, i):
            url, quote = token, tokens[i - 1] if i else None
        else:
            out.append(token)
    return [*out, url] if url else out


def tokenize(text: str, known: Callable[[str], bool] = lambda word: False) -> list[str]:
    """Words, spaces and signs; joined they are the text. ``known``: whether the lexicon has a marked word."""
    out: list[str] = _SCAN.findall(text)
    if "-" in text or "'" in text or not text.isascii():
        runs, out = out, []
        for run in runs:
            if run in _SELECTORS and out:
                out[-1] += run
                continue
            out += run_parts(run, known)
    if "@" in text:
        out = _join_emails(out)
    return _join_urls(out) if "/" in text or "www" in text else out


# ---- readings ----


def is_all_upper(s: str) -> bool:
    return not any(c.isalpha() and c.islower() for c in s)


def is_capitalized(s: str) -> bool:
    return s[:1].isupper() and all(c.islower() for c in s[1:] if c.isalpha())


def is_mixed_case(s: str) -> bool:
    return not is_all_upper(s) and not is_capitalized(s) and any(c.isalpha() and not c.islower() for c in s)


def lookup_stages(word: str) -> list[list[str]]:
    """Keys to look a word up by: the readings of all keys of the first stage that has any are the word's."""
    if len(word) > 1:
        word = word.replace("’", "'")
    low = word.lower()
    both = word != low and not is_mixed_case(word)
    stages = [[word, low] if both else [word]]
    if is_all_upper(word):
        stages.append([low[:1].upper() + low[1:]])
    if low.endswith("in'"):
        whole = word[:-1] + ("G" if is_all_upper(word) else "g")
        stages.append([whole, whole.lower()] if both else [whole])
    return stages


#: Words whose readings a worker remembers at a time.
REMEMBERED = 200_000


class Lexicon:
    """Readings of forms; ``forms`` maps a form to its (lemma, tag) pairs in order, repeats kept."""

    def __init__(self, forms: dict[str, list[tuple[str, str]]]):
        self.forms = forms
        self._known: dict[str, list[tuple[str, str]]] = {}
        self._lows: set[str] = set()
        self._size = -1

    def readings(self, word: str) -> list[tuple[str, str]]:
        out = self._known.get(word)
        if out is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            out = self._known[word] = next((found for keys in lookup_stages(word) if (found := [r for k in keys for r in self.forms.get(k, ())])), []) if self.may_have(word) else []
        return out

    def may_have(self, word: str) -> bool:
        """Most words of a text are in no lexicon; then no form is the word's but for case."""
        if self._size != len(self.forms):
            self._lows, self._size = {f.lower() for f in self.forms}, len(self.forms)
        low = word.lower() if len(word) == 1 else word.replace("’", "'").lower()
        return low in self._lows or low.endswith("in'") or not low[:1].isascii()

    def candidates(self, words: list[str]) -> list[int]:
        """Places of the words that ``may_have`` is true for."""
        may_have = self.may_have
        may_have("")
        lows = self._lows
        return [n for n, w in enumerate(words) if (w.lower() in lows if w.isascii() and "'" not in w else may_have(w))]

    def knows(self, word: str) -> bool:
        return bool(self.readings(word))


def analyze(sentence: str, lexicon: Lexicon) -> list[Position]:
    """The sentence start, then each token that is not white space with its readings; the last one also ends the sentence."""
    out = [Position("", [(None, START_TAG)], is_start=True)]
    at, space = 0, False
    for token in tokenize(sentence, lexicon.knows):
        if is_space(token):
            space = True
        else:
            out.append(Position(token, list(lexicon.readings(token)) or [(None, None)], space, at))
            space = False
        at += len(token)
    last = out[-1]
    if not last.is_start:
        last.readings = ended(last.readings)
        last.is_end = True
    return out


def ended(readings: list[tuple[str | None, str | None]]) -> list[tuple[str | None, str | None]]:
    """The readings of a token that ends its sentence."""
    return [*([] if readings == [(None, None)] else readings), (readings[-1][0], END_TAG)]


# ---- disambiguation ----


def _is(word: Reading, reading: tuple[str | None, str | None]) -> bool:
    return word.lemma in (None, reading[0]) and word.pos in (None, reading[1])


def _made(token: str, word: Reading) -> tuple[str | None, str | None]:
    return word.lemma or token, word.pos


def _act(rule: DisambigRule, span: list[Position]) -> None:
    """What a rule does to the marked positions; a position never ends up without a reading."""
    tag, words = rule.postag, rule.words
    paired = list(zip(span, words)) if len(span) == len(words) else []
    if rule.action == "add":
        for p in span:
            made = [_made(p.token, w) for w in words]
            untagged = made and len(p.readings) == 1 and p.readings[0][1] is None
            p.readings = ([] if untagged else p.readings) + made
    elif rule.action == "remove":
        for p in span:
            p.readings = [r for r in p.readings if not (pos_fits(tag, True, r[1]) if tag is not None else any(_is(w, r) for w in words))]
    elif rule.action == "filter" and tag is not None:
        for p in span:
            p.readings = [r for r in p.readings if pos_fits(tag, True, r[1])]
    elif rule.action == "filter":
        for p, w in paired:
            p.readings = [r for r in p.readings if _is(w, r)]
    elif rule.action == "replace" and paired:
        for p, w in paired:
            p.readings = [_made(p.token, w)]
    elif rule.action == "replace" and tag is not None and span:
        p = span[0]
        own = [lemma for lemma, t in p.readings if t == tag and lemma is not None]
        p.readings = [(own[-1] if own else p.readings[0][0], tag)]
    for p in span:
        p.readings = p.readings or [(None, None)]


def act(rule: DisambigRule, sentence: list[Position], m: Match) -> None:
    """What a rule does at one of its matches."""
    marked = sentence[m.mark_start : m.mark_end]
    elements = rule.pattern.tokens[rule.pattern.mark_from : rule.pattern.mark_to]
    if rule.action != "filterall":
        _act(rule, marked)
    elif len(elements) == len(marked) and all(e.fixed and not e.group for e in elements):
        for p, e in zip(marked, elements):
            p.readings = [r for r in p.readings if keeps(e, p, r)] or p.readings


def disambiguate(sentence: list[Position], rules: Iterable[DisambigRule]) -> list[Position]:
    """Apply rules in order; each sees what the ones before it left. The sentence is changed in place."""
    for rule in rules:
        if rule.unsupported:
            continue
        # Matches depend on readings that the rule itself rewrites, so they are looked for step by step.
        at, blocked = 0, None
        while at < len(sentence):
            m = match_at(rule.pattern, sentence, at)
            if m is None:
                at += 1
                continue
            if blocked is None:
                blocked = covered(rule.antipatterns, sentence)
            if not any(i in blocked for i in range(m.start, m.end)):
                act(rule, sentence, m)
            at = max(m.end, m.start + 1)
    return sentence
