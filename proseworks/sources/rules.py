"""Rule files (XML) to rules: entity macros, patterns, disambiguation and grammar rules.

Parsing runs on the driver; a rule pack is small next to any corpus. Features that cannot be run
faithfully are listed in ``unsupported`` and the rule is skipped, never applied wrongly.
"""

from __future__ import annotations

import re as _re
import xml.etree.ElementTree as ET

import regex

from proseworks.plans.ir import DisambigRule, Example, GrammarRule, PatternSpec, Piece, Reading, Synth, TokenSpec

_ENTITY = _re.compile(r"""<!ENTITY\s+([^\s%"']+)\s+(?:"([^"]*)"|'([^']*)')\s*>""")
_USE = _re.compile(r"&([A-Za-z_][\w.-]*);")
_PROLOG = _re.compile(r"<!DOCTYPE[^\[>]*(?:\[.*?\])?\s*>", _re.S)
#: References that XML itself defines, fixed values.
_PREDEFINED = ("amp", "lt", "gt", "quot", "apos")
_ROUNDS = 8
ACTIONS = ("replace", "add", "remove", "filter", "filterall", "unify", "ignore_spelling", "immunize")


def entities(xml: str) -> dict[str, str]:
    """Macros defined in a document's prolog."""
    return {name: a or b for name, a, b in _ENTITY.findall(xml)}


def expand_entities(xml: str, macros: dict[str, str] | None = None) -> str:
    """The document with its macros put in, which may use one another; other references stay."""
    macros = entities(xml) if macros is None else macros
    for _ in range(_ROUNDS):
        new = _USE.sub(lambda m: macros[m[1]] if m[1] in macros and m[1] not in _PREDEFINED else m[0], xml)
        if new == xml:
            break
        xml = new
    return xml


def _root(xml: str) -> ET.Element:
    return ET.fromstring(_PROLOG.sub("", expand_entities(xml)))


def _int(value: str | None, default: int) -> int:
    try:
        return int(value) if value is not None else default
    except ValueError:
        return default


def _compiles(pattern: str) -> bool:
    try:
        regex.compile(pattern)
    except regex.error:
        return False
    return True


def _token(node: ET.Element, sensitive: bool, flags: list[str]) -> TokenSpec:
    get = node.get
    text = "".join([node.text or "", *((child.tail or "") for child in node)]).strip() or None
    if get("chunk") is not None or get("chunk_re") is not None:
        flags.append("chunk")
    if node.find("match") is not None:
        flags.append("token-match")
    if text and get("regexp") == "yes" and not _compiles(text):
        flags.append("regex")
    if get("postag") is not None and get("postag_regexp") == "yes" and not _compiles(get("postag")):
        flags.append("pos-regex")
    return TokenSpec(
        text=text, regexp=get("regexp") == "yes", case_sensitive=sensitive if get("case_sensitive") is None else get("case_sensitive") == "yes",
        inflected=get("inflected") == "yes", negate=get("negate") == "yes", pos=get("postag"), pos_regexp=get("postag_regexp") == "yes", negate_pos=get("negate_pos") == "yes",
        space_before=None if get("spacebefore") is None else get("spacebefore") == "yes", scope=get("scope") if get("scope") in ("previous", "next") else "current",
        min=_int(get("min"), 1), max=-1 if get("max") == "unlimited" else _int(get("max"), 1), skip=_int(get("skip"), 0),
        exceptions=tuple(_token(e, sensitive, flags) for e in node.findall("exception")),
    )


def pattern_of(node: ET.Element) -> PatternSpec:
    sensitive = node.get("case_sensitive") == "yes"
    flags: list[str] = []
    tokens: list[TokenSpec] = []
    marks: list[int] = []

    def visit(parent: ET.Element) -> None:
        for child in parent:
            if child.tag == "marker":
                marks.append(len(tokens))
                visit(child)
                marks.append(len(tokens))
            elif child.tag == "token":
                tokens.append(_token(child, sensitive, flags))
            elif child.tag in ("and", "or"):
                tokens.append(TokenSpec(group=child.tag, children=tuple(_token(t, sensitive, flags) for t in child.iter("token"))))

    visit(node)
    return PatternSpec(tuple(tokens), marks[0] if marks else 0, marks[-1] if marks else len(tokens), tuple(dict.fromkeys(flags)))


def parse_pattern(xml: str) -> PatternSpec:
    return pattern_of(_root(xml))


def parse_disambiguation(xml: str) -> list[DisambigRule]:
    """Rules in document order. Antipatterns and ids of rule groups are not passed on to their rules."""
    out = []
    for node in _root(xml).iter("rule"):
        pattern = node.find("pattern")
        if pattern is None:
            continue
        spec = pattern_of(pattern)
        antis = tuple(pattern_of(a) for a in node.findall("antipattern"))
        flags = [*spec.unsupported, *(f for a in antis for f in a.unsupported)]
        act = node.find("disambig")
        words: tuple[Reading, ...] = ()
        action, postag = "replace", None
        if act is not None:
            action = act.get("action") if act.get("action") in ACTIONS else "replace"
            postag = act.get("postag")
            words = tuple(Reading(w.get("lemma"), w.get("pos")) for w in act.findall("wd") if w.text is None and not len(w))
            if act.find("match") is not None:
                flags.append("disambig-match")
        out.append(DisambigRule(len(out), node.get("id") or "", spec, action, words, postag, antis, tuple(dict.fromkeys(flags))))
    return out


_REF = _re.compile(r"\\([0-9]+)")


def template_of(text: str) -> tuple[Piece, ...]:
    r"""Text with references ``\1``, ``\2``, ... to what the elements matched."""
    parts = _REF.split(text)
    return tuple(Piece(ref=int(p)) if i % 2 else Piece(text=p) for i, p in enumerate(parts) if p)


def _match_piece(node: ET.Element, flags: list[str]) -> Piece | None:
    get = node.get
    ref = _int(get("no"), 0)
    tag = get("postag")
    find = get("regexp_match") if get("regexp_replace") is not None else None
    if ref <= 0 or (tag or "")[:1] in ("+", "_") or tag and not _compiles(tag) or find and not _compiles(find):
        flags.append("match-synth")
        return None
    synth = Synth(tag, get("postag_regexp") == "yes", get("postag_replace"), (node.text or "").strip() or None) if tag else None
    return Piece(ref=ref, transformed=True, case=get("case_conversion"), find=find, replace=get("regexp_replace") or "", synth=synth)


def _pieces(node: ET.Element, flags: list[str]) -> tuple[Piece, ...]:
    out = list(template_of(node.text or ""))
    for child in node:
        if child.tag == "match":
            piece = _match_piece(child, flags)
            out += [piece] if piece else []
        out += template_of(child.tail or "")
    return tuple(out)


def _message(node: ET.Element, flags: list[str]) -> tuple[tuple[bool, tuple[Piece, ...]], ...]:
    out = [(False, template_of(node.text or ""))]
    for child in node:
        if child.tag == "suggestion":
            out.append((True, _pieces(child, flags)))
        elif child.tag == "match":
            piece = _match_piece(child, flags)
            out += [(False, (piece,))] if piece else []
        out.append((False, template_of(child.tail or "")))
    return tuple(x for x in out if x[0] or x[1])


def _example(node: ET.Element) -> Example:
    text, marker = node.text or "", None
    for child in node:
        inner = "".join(child.itertext())
        if child.tag == "marker":
            marker = (len(text), len(inner))
        text += inner + (child.tail or "")
    correction = node.get("correction")
    return Example(text, marker, None if correction is None else tuple(correction.split("|")), node.get("type") == "triggers_error")


def parse_grammar(xml: str) -> list[GrammarRule]:
    """Rules in document order, with antipatterns of their group, messages, suggestions and examples."""
    out: list[GrammarRule] = []

    def state(node: ET.Element, inherited: tuple[bool, bool]) -> tuple[bool, bool]:
        enabled = {"on": True, "off": False}.get(node.get("default") or "", inherited[0])
        return enabled, inherited[1] or "picky" in (node.get("tags") or "")

    def add(node: ET.Element, category: str, group: ET.Element | None, inherited: tuple[bool, bool]) -> None:
        pattern = node.find("pattern")
        if pattern is None:
            return
        spec = pattern_of(pattern)
        antis = tuple(pattern_of(a) for a in [*node.findall("antipattern"), *(group.findall("antipattern") if group is not None else [])])
        flags = [*spec.unsupported, *(f for a in antis for f in a.unsupported)]
        if node.find("filter") is not None:
            flags.append("filter")
        enabled, picky = state(node, inherited)
        if node.get("default") == "on":  # turns an inherited switch back on, its own tags still count
            picky = "picky" in (node.get("tags") or "")
        message = node.find("message")
        rendered = _message(message, flags) if message is not None else ()
        suggestions = tuple(_pieces(s, flags) for s in node.iter("suggestion"))
        out.append(GrammarRule(
            len(out), node.get("id") or (group.get("id") if group is not None else None) or "", category, spec, antis, rendered, suggestions,
            tuple(_example(e) for e in node.findall("example")), enabled, picky, tuple(dict.fromkeys(flags)),
        ))

    root = _root(xml)
    for category in [root] if root.tag == "category" else root.iter("category"):
        name, of_category = category.get("id") or "", state(category, (True, False))
        for node in category:
            if node.tag == "rule":
                add(node, name, None, of_category)
            elif node.tag == "rulegroup":
                for rule in node.findall("rule"):
                    add(rule, name, node, state(node, of_category))
    return out


def pattern_blocks(xml: str) -> list[str]:
    """The ``<pattern>`` elements of a document as texts, macros put in."""
    return _re.findall(r"(?s)<pattern\b.*?</pattern>", expand_entities(xml))
