"""Rules after parsing: what a token must be like, patterns, actions and templates."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TokenSpec:
    """One element of a pattern, or an exception to one."""

    text: str | None = None
    regexp: bool = False
    case_sensitive: bool = False
    inflected: bool = False
    negate: bool = False
    pos: str | None = None
    pos_regexp: bool = False
    negate_pos: bool = False
    space_before: bool | None = None
    scope: str = "current"
    min: int = 1
    max: int = 1  # -1: unlimited
    skip: int = 0  # -1: unlimited
    exceptions: tuple[TokenSpec, ...] = ()
    group: str | None = None  # "and" or "or"
    children: tuple[TokenSpec, ...] = ()

    @property
    def fixed(self) -> bool:
        return self.min == 1 and self.max == 1 and self.skip == 0


@dataclass(frozen=True)
class PatternSpec:
    tokens: tuple[TokenSpec, ...]
    mark_from: int
    mark_to: int
    unsupported: tuple[str, ...] = ()

    @property
    def fixed(self) -> bool:
        return bool(self.tokens) and all(t.fixed for t in self.tokens)


@dataclass(frozen=True)
class Synth:
    """Inflection of a matched token's lemma (or of a given one) to a tag."""

    tag: str
    regexp: bool = False
    replace: str | None = None
    lemma: str | None = None


@dataclass(frozen=True)
class Piece:
    """Part of a template: text, or what element ``ref`` (from 1) matched, possibly transformed."""

    text: str = ""
    ref: int = 0
    transformed: bool = False
    case: str | None = None
    find: str | None = None
    replace: str = ""
    synth: Synth | None = None


Template = tuple[Piece, ...]


@dataclass(frozen=True)
class Example:
    text: str
    marker: tuple[int, int] | None
    correction: tuple[str, ...] | None
    triggers_error: bool = False


@dataclass(frozen=True)
class GrammarRule:
    order: int
    id: str
    category: str
    pattern: PatternSpec
    antipatterns: tuple[PatternSpec, ...] = ()
    message: tuple[tuple[bool, Template], ...] = ()  # (is a suggestion, template)
    suggestions: tuple[Template, ...] = ()
    examples: tuple[Example, ...] = ()
    enabled: bool = True
    picky: bool = False
    unsupported: tuple[str, ...] = ()

    def runs(self, picky: bool = False) -> bool:
        return not self.unsupported and self.enabled and (picky or not self.picky)


@dataclass(frozen=True)
class Reading:
    lemma: str | None = None
    pos: str | None = None


@dataclass(frozen=True)
class DisambigRule:
    order: int
    id: str
    pattern: PatternSpec
    action: str = "replace"
    words: tuple[Reading, ...] = ()
    postag: str | None = None
    antipatterns: tuple[PatternSpec, ...] = ()
    unsupported: tuple[str, ...] = field(default=())
