"""Sentence-break rules (SRX) from XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass


@dataclass(frozen=True)
class BreakRule:
    is_break: bool
    before: str
    after: str


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def java_to_regex(pattern: str) -> str:
    r"""``\uXXXX`` of Java's notation as ``\x{XXXX}`` of others; an escaped backslash before u is left alone."""
    return re.sub(r"(\\\\)|\\u([0-9A-Fa-f]{4})", lambda m: m[1] or rf"\x{{{m[2]}}}", pattern)


def for_python(pattern: str) -> str:
    r"""``\x{XXXX}`` as ``\uXXXX``."""
    return re.sub(r"(\\\\)|\\x\{([0-9A-Fa-f]{1,4})\}", lambda m: m[1] or rf"\u{m[2]:0>4}", pattern)


def parse(xml: str, language: str) -> list[BreakRule]:
    """The rules for a language in order: of all its maps where the header cascades, else of the first."""
    root = ET.fromstring(xml)
    cascade = any(_local(n) == "header" and n.get("cascade") == "yes" for n in root.iter())
    sets: dict[str, list[BreakRule]] = {}
    for node in root.iter():
        if _local(node) == "languagerule":
            rules = []
            for rule in node:
                sides = {_local(s): for_python(s.text or "") for s in rule}
                rules.append(BreakRule(rule.get("break") != "no", sides.get("beforebreak", ""), sides.get("afterbreak", "")))
            sets.setdefault(node.get("languagerulename") or "", rules)
    out: list[BreakRule] = []
    for node in root.iter():
        if _local(node) == "languagemap" and re.fullmatch(node.get("languagepattern") or "", language):
            out += sets.get(node.get("languagerulename") or "", [])
            if not cascade:
                break
    return out
