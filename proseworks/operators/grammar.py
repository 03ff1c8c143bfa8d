"""Grammar findings of one sentence: matches of rules, rendered."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass

import regex

from proseworks.operators.matching import BOUNDARY_TAGS, Match, Position, pos_fits, unblocked
from proseworks.plans.ir import GrammarRule, Piece, Synth, Template


@dataclass(frozen=True)
class Finding:
    offset: int
    length: int
    message: str
    replacements: tuple[str, ...]
    rule_id: str
    category_id: str
    source: int = 0  # 0 grammar, 1 spelling
    rule: int = 0
    nth: int = 0


class Synthesizer:
    """Forms of a lemma by tag; ``tags`` are all tags there are."""

    def __init__(self, forms: dict[tuple[str, str], list[str]], tags: Iterable[str]):
        self.forms, self.tags = forms, tuple(tags)

    def by_tag(self, lemma: str, tag: str) -> list[str]:
        return self.forms.get((lemma, tag), [])

    def by_pattern(self, lemma: str, pattern: str) -> list[str]:
        return [f for t in self.tags if pos_fits(pattern, True, t) for f in self.by_tag(lemma, t)]


def java_replacement(template: str) -> str:
    r"""A replacement in Java's notation ($1, \$) in that of this regex module."""
    out, i = [], 0
    while i < len(template):
        c = template[i]
        if c == "\\" and i + 1 < len(template):
            out.append(template[i + 1].replace("\\", "\\\\"))
            i += 1
        elif c == "$" and (m := regex.match("[0-9]+", template, pos=i + 1)):
            out.append(rf"\g<{m[0]}>")
            i = m.end() - 1
        else:
            out.append(c)
        i += 1
    return "".join(out)


def convert_case(kind: str | None, shape: str, s: str) -> str:
    letters = [c for c in shape if c.isalpha()]
    if kind == "preserve":
        kind = "allupper" if letters and all(c.isupper() for c in letters) else "startupper" if shape[:1].isupper() else None
    return {"startlower": s[:1].lower() + s[1:], "startupper": s[:1].upper() + s[1:], "alllower": s.lower(), "allupper": s.upper()}.get(kind or "", s)


class Renderer:
    """Templates filled in from one match."""

    def __init__(self, sentence: list[Position], match: Match, synthesizer: Synthesizer | None):
        self.sentence, self.match, self.synthesizer = sentence, match, synthesizer

    def _positions(self, ref: int) -> list[Position]:
        elements = self.match.elements
        start, count = elements[min(max(ref - 1, 0), len(elements) - 1)]
        return self.sentence[start : start + count]

    def surface(self, ref: int) -> str:
        return "".join((" " if i and p.space_before else "") + p.token for i, p in enumerate(self._positions(ref)))

    def _forms(self, synth: Synth, position: Position) -> list[str]:
        usable = [(lemma, tag) for lemma, tag in position.readings if lemma is not None and tag not in BOUNDARY_TAGS]
        fitting = [tag for _, tag in usable if tag is not None and pos_fits(synth.tag, True, tag)]
        rewrite = lambda tag, to: regex.sub(synth.tag, java_replacement(to), tag, count=1)
        if synth.lemma:
            targets = [rewrite(t, synth.replace) if synth.replace is not None else t for t in fitting]
            found = [f for t in targets for f in self.synthesizer.by_tag(synth.lemma, t)]
        elif synth.regexp:
            to = synth.replace if synth.replace is not None else synth.tag
            target = rewrite(fitting[-1], to) if fitting else to
            try:
                found = [f for lemma, _ in usable for f in self.synthesizer.by_pattern(lemma, target)]
            except regex.error:
                found = []
        else:
            found = [f for lemma, _ in usable for f in self.synthesizer.by_tag(lemma, synth.tag)]
        return sorted(set(found))

    def alternatives(self, piece: Piece) -> list[str]:
        if not piece.ref:
            return [piece.text]
        source = self.surface(piece.ref)
        if not piece.transformed:
            return [source]
        own = self._positions(piece.ref)
        forms = self._forms(piece.synth, own[0]) if piece.synth and self.synthesizer and own else []
        out = forms or [source]
        if piece.find is not None:
            out = [regex.sub(piece.find, java_replacement(piece.replace), s) for s in out]
        return [convert_case(piece.case, source, s) for s in out]

    def expand(self, template: Template) -> list[str]:
        return ["".join(parts) for parts in itertools.product(*(self.alternatives(p) for p in template))]

    def message(self, parts: Iterable[tuple[bool, Template]]) -> str:
        return "".join(f"“{self.expand(t)[0]}”" if suggestion else self.expand(t)[0] for suggestion, t in parts)


def replacements(rule: GrammarRule, renderer: Renderer, capital: bool) -> tuple[str, ...]:
    out: dict[str, None] = {}
    for template in rule.suggestions:
        own_case = bool(template) and template[0].ref > 0 and not template[0].transformed and any(p.transformed and p.case in CASES for p in template)
        for s in renderer.expand(template):
            s = regex.sub(r"\s+", " ", s)
            if capital and not own_case and s[:1].islower():
                s = s[:1].upper() + s[1:]
            out[s] = None
    return tuple(out)


#: Case conversions of templates, fixed values.
CASES = ("startlower", "startupper", "alllower", "allupper", "preserve")


def findings_of(rule: GrammarRule, sentence: list[Position], base: int, synthesizer: Synthesizer | None = None) -> list[Finding]:
    """All findings of one rule; ``base`` is the sentence's offset in the text."""
    out = []
    for m in unblocked(rule.pattern, rule.antipatterns, sentence):
        if m.mark_start >= len(sentence):
            continue
        first, last = sentence[m.mark_start], sentence[max(m.mark_end - 1, m.mark_start)]
        renderer = Renderer(sentence, m, synthesizer)
        out.append(Finding(
            base + first.start, last.start + len(last.token) - first.start, renderer.message(rule.message),
            replacements(rule, renderer, first.token[:1].isupper()), rule.id, rule.category, 0, rule.order, len(out),
        ))
    return out


def without_contained(findings: list[Finding]) -> list[Finding]:
    """Findings that lie inside no other finding of a larger span; equal spans all stay. In order of offset, longest first."""
    out, reach, span = [], -1, None
    for f in sorted(findings, key=lambda f: (f.offset, -f.length, f.source, f.rule, f.nth)):
        end = f.offset + f.length
        if end > reach or (f.offset, end) == span:
            if end > reach:
                reach, span = end, (f.offset, end)
            out.append(f)
    return out


class RuleIndex:
    """Rules by a word that their match must hold, so that a sentence meets only rules that may fit it."""

    def __init__(self, rules: Iterable[GrammarRule]):
        self.always: list[GrammarRule] = []
        self.by_word: dict[str, list[GrammarRule]] = {}
        for rule in rules:
            words = anchor(rule)
            if words is None:
                self.always.append(rule)
            for w in words or ():
                self.by_word.setdefault(w, []).append(rule)

    def candidates(self, sentence: list[Position]) -> list[GrammarRule]:
        seen = {w for p in sentence for w in (p.token.lower(), *(lemma.lower() for lemma, _ in p.readings if lemma))}
        found = {r.order: r for w in seen for r in self.by_word.get(w, ())}
        found.update((r.order, r) for r in self.always)
        return [found[k] for k in sorted(found)]


_PLAIN = regex.compile(r"[\p{L}'-]+(?:\|[\p{L}'-]+)*")


def anchor(rule: GrammarRule) -> list[str] | None:
    """Lower-case words of which a match of the rule holds at least one; None if there is no such list."""
    best = None
    for t in rule.pattern.tokens:
        if t.min < 1 or t.negate or not t.text or t.group:
            continue
        if t.regexp and not _PLAIN.fullmatch(t.text):
            continue
        words = [w.lower() for w in (t.text.split("|") if t.regexp else [t.text])]
        if best is None or len(words) < len(best):
            best = words
    return best


def check_sentence(index: RuleIndex, sentence: list[Position], base: int, synthesizer: Synthesizer | None = None) -> list[Finding]:
    return without_contained([f for rule in index.candidates(sentence) for f in findings_of(rule, sentence, base, synthesizer)])
