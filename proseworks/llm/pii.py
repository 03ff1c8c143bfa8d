"""Personal data: strict patterns, and candidates judged by gradient-boosted trees.

Strict patterns find e-mail and IP addresses, card and phone numbers, each kind leftmost and
without overlaps; their findings stay. Beside them high-recall generators propose spans that may
overlap one another (spaced or spelt-out addresses, national phone numbers, groups of digits, IPv6, and keys and
passwords given a value: the kind ``secret``, which has a column of its own). Boosted
trees see the format of a candidate and the words around it; a threshold for each kind, calibrated
for precision on a part of the examples kept out of the fit, selects the additions. Candidates that overlap a
strict finding are dropped, and of overlapping additions the most probable stays.

The trees are trained and their thresholds calibrated here, on examples made by a fixed rule (formats of each kind and look-alikes
such as dates, versions, prices and order numbers), so they do not depend on the input or its size; no table has labels of personal data.

Offsets count code points; ends are exclusive. Every text is read whole, in time n log n in its findings and linear in its length.
Defined cases: null and empty texts have no spans; other columns are kept; rows that repeat are judged each.
"""

from __future__ import annotations

import functools
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseworks.llm import textvec
from proseworks.session import ship

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Bytes of text that a worker holds with its findings.
HELD = 4 << 20
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Found from each @ to both sides, which takes linear time and gives the leftmost matches."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _LOCAL.match(text[done:at][::-1])
        start = at - len(m[0])
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str | None) -> list[Span]:
    """The strict findings, by kind, then start."""
    if not text:
        return []
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


#: Generators of candidates. Every repetition is bounded, so a search takes linear time.
_GENERATORS = {
    "email": re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|\x20?@\x20?)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\x20?\.\x20?)[A-Za-z0-9-]{2,24}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])[(+]{0,2}[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_]{2,24}[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?([A-Za-z0-9_/+-]{16,128})(?![A-Za-z0-9_/+-])"),
}
#: Words that speak for a kind, fixed values.
_CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "cell"),
    "secret": ("token", "key", "secret", "password", "passwd", "apikey", "credential", "auth"),
}
#: Words that speak against personal data, fixed values.
_AGAINST = ("version", "order", "isbn", "invoice", "page", "date", "price", "total", "section", "id", "at", "release")
_WORDS = re.compile(r"[a-z][a-z_-]*")
_REACH = 24


def candidates(text: str) -> list[Span]:
    out = []
    if "@" in text or " at " in text.lower() or "at]" in text.lower() or "at)" in text.lower():
        out += [("email", m.start(), m.end()) for m in _GENERATORS["email"].finditer(text)]
    if _DIGIT.search(text):
        out += [(k, m.start(), m.end()) for k in ("ip", "card", "phone") if k != "ip" or ":" in text for m in _GENERATORS[k].finditer(text)]
    if "=" in text or ":" in text:
        out += [("secret", m.start(1), m.end(1)) for m in _GENERATORS["secret"].finditer(text)]
    return out


class _Taken:
    """Whether a span overlaps any of those given."""

    def __init__(self, spans: list[Span]):
        self.start, self.reach = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            self.start.append(a)
            self.reach.append(max(b, self.reach[-1]) if self.reach else b)

    def __contains__(self, span: Span) -> bool:
        k = bisect_left(self.start, span[2])
        return k > 0 and self.reach[k - 1] > span[1]


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    kind, start, end = span
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s)
    runs = [len(x) for x in _NOT_DIGIT.split(s) if x]
    before = _WORDS.findall(text[max(0, start - _REACH) : start].lower())
    after = _WORDS.findall(text[end : end + _REACH].lower())
    near = before[-3:] + after[:1]
    if kind == "secret":  # the name that the value is given to
        near = [w for x in near for w in (x, *re.split("[-_]", x))]
    last = text[start - 1 : start]
    following = text[end : end + 1]
    return [
        float(ALL_KINDS.index(kind)), len(s), len(digits), len(runs), max(runs, default=0), min(runs, default=0), runs[0] if runs else 0, runs[-1] if runs else 0,
        s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count(":"), s.count("(") + s.count("["), float(s[:1] == "+" or s[:2] == "(+"), float(s[:1] == "("),
        float("@" in s), float(bool(re.search(r"[\[({ ]at[\])} ]", s, re.I))), float(bool(re.search(r"[\[({ ]dot[\])} ]", s, re.I))), float(bool(re.search(r"[\[({] ?(?:at|dot)", s, re.I))),
        float(len(digits) >= 13 and luhn(digits)), float(digits[:1] in ("3", "4", "5", "6")), float(runs == [3, 3, 4] or runs == [3, 4]), float(digits[:2] in ("19", "20")),
        float(any(w in _CUES[kind] for w in near)), float(any(w in _AGAINST for w in near)), float(last.isalnum() or last in "$€#_=/"), float(following.isalnum() or following in "%_/="),
        float(bool(re.search(r"\.(?:com|org|net|edu|io|de|fr|es|uk)$|dot\W{0,2}(?:com|org|net|edu|io|de|fr|es|uk)$", s, re.I))), sum(c in "abcdefABCDEF" for c in s), len(set(s)) / len(s), sum(c.isalpha() for c in s),
    ]


@dataclass
class Trees:
    """Boosted trees of depth ``DEPTH`` for a binary target; a tree is arrays in heap order."""

    start: float
    column: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for column, cut, leaf in zip(self.column, self.cut, self.leaf):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), column[node]] > cut[node])
            out += leaf[node - len(column)]
        return out


DEPTH = 3


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, rate: float = 0.2, least: int = 5) -> Trees:
    """Second-order boosting of the logistic loss; exact cuts between the distinct values of a column."""
    inner = 2**DEPTH - 1
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    out = np.full(len(y), start)
    columns, cuts, leaves = [], [], []
    edges = [np.unique(x[:, c]) for c in range(x.shape[1])]
    edges = [e[:-1] if len(e) <= 32 else np.unique(np.quantile(e, np.linspace(0, 1, 33)[1:-1])) for e in edges]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, p * (1 - p)
        column, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for n in range(inner):
            rows = np.flatnonzero(node == n)
            best = 1e-6
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for c, e in enumerate(edges):
                if not len(e) or len(rows) < 2 * least:
                    continue
                bins = np.searchsorted(e, x[rows, c], "left")
                gs, hs, ns = (np.bincount(bins, weights=w, minlength=len(e) + 1)[:-1].cumsum() for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                if gain.max() > best:
                    best, column[n], cut[n] = gain.max(), c, e[gain.argmax()]
            node[rows] = 2 * n + 1 + (x[rows, column[n]] > cut[n])
        leaf = np.array([rate * g[node == n].sum() / (h[node == n].sum() + 1) for n in range(inner, 2 * inner + 1)])
        out += leaf[node - inner]
        columns.append(column), cuts.append(cut), leaves.append(leaf)
    return Trees(start, np.array(columns), np.array(cuts), np.array(leaves))


def _card(r: random.Random) -> str:
    d = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(r.choice((12, 13, 14, 14, 14))))
    return next(d + c for c in "0123456789" if luhn(d + c))


def examples(n: int = 6000, seed: int = 7) -> list[tuple[str, int]]:
    """Texts with one candidate format each, and whether it is personal data; made by a fixed rule."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("er", "th", "on", "an", "re", "he", "in", "ed", "nd", "ha", "en", "es", "st", "le", "au", "ie")) for _ in range(r.randint(1, 4)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    ten = lambda: r.choice("23456789") + num(2), lambda: r.choice("23456789") + num(2), lambda: num(4)
    top = ("com", "org", "net", "edu", "io", "de", "fr", "es")

    def phone() -> str:
        a, b, c = (f() for f in ten)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"0{num(2)} {num(4)} {num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}"))

    def mail() -> str:
        at, dot = r.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), (" [at] ", ".")))
        return f"{word()}{r.choice(('', '.', '_'))}{word()}{at}{word()}{dot}{r.choice(top)}"

    def card() -> str:
        c = _card(r)
        return r.choice((c, "  ".join(re.findall(".{1,4}", c)), ".".join(re.findall(".{1,4}", c)), "/".join(re.findall(".{1,4}", c))))

    def ip6() -> str:
        return ":".join("%x" % r.randrange(65536) for _ in range(8))

    mixed = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    def secret() -> str:
        value = r.choice((lambda: hexa(r.choice((32, 40, 64))), lambda: mixed(r.randint(20, 48)), lambda: "AK" + mixed(18).upper()))()
        quote = r.choice(('"', "'", ""))
        return f"{r.choice(('', 'api_', 'my_', 'access_'))}{r.choice(_CUES['secret'])}{r.choice((' = ', '=', ': '))}{quote}{value}{quote}"

    good = {"phone": phone, "email": mail, "card": card, "ip": ip6, "secret": secret}
    bad = (
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/{r.randint(1900, 2030)}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}:{r.randint(0, 99):02}", lambda: num(r.randint(7, 19)),
        lambda: f"{num(3)}.{num(3)}.{num(3)}", lambda: f"{r.randint(1, 20)}.{r.randint(0, 40)}.{r.randint(0, 999)}.{num(r.randint(1, 5))}", lambda: f"{word()} at {word()}. {word()}", lambda: f"{word()} at {word()}. {word()}",
        lambda: f"{word()} at the {word()}.{word()}", lambda: f"97{r.choice('89')}-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"{num(4)} {num(4)} {num(4)} {num(r.randint(1, 4))}", lambda: " ".join(num(r.randint(1, 3)) for _ in range(r.randint(4, 9))),
        lambda: f"{word()} @ {word()}. {word()}", lambda: f"{num(2)}-{num(7)}", lambda: f"{num(8)}", lambda: f"{num(5)}-{num(5)}",
        lambda: f"{r.choice(('checksum', 'commit', 'digest', 'file', 'name'))}{r.choice((' = ', ': '))}{r.choice((hexa(40), hexa(64), word() + '-' + word() + '-' + word() + '-' + word()))}",
        lambda: f"{r.choice(_CUES['secret'])}: {'_'.join(word() for _ in range(5))}",
    )
    out = []
    for _ in range(n):
        yes = r.random() < 0.4
        kind = r.choice(ALL_KINDS)
        s = good[kind]() if yes else r.choice(bad)()
        cue = r.choice(_CUES[kind]) if r.random() < (0.4 if yes else 0.05) else r.choice(_AGAINST) if r.random() < (0.02 if yes else 0.3) else word()
        text = f"{word()} {word()} {cue}{r.choice((' ', ': ', ' is '))}{s}{r.choice((' ', '. ', ', ', ''))}{word() if r.random() < 0.9 else ''}"
        out.append((text, int(yes)))
    return out


@dataclass
class Model:
    trees: Trees
    cuts: dict[str, float]  # lowest raw score of each kind that is taken


@functools.lru_cache(maxsize=2)
def model(precision: float = 0.98) -> Model:
    """The trees, and for each kind the lowest threshold that keeps ``precision`` on the examples not fitted."""
    x, y, kind = [], [], []
    for text, yes in examples():
        base = _Taken(base_spans(text))
        for span in candidates(text):
            if span not in base:
                x.append(features(text, span))
                y.append(yes)
                kind.append(span[0])
    x, y, kind = np.array(x), np.array(y, float), np.array(kind)
    aside = np.arange(len(y)) % 3 == 0
    trees = boost(x[~aside], y[~aside])
    raw = trees.raw(x[aside])
    cuts = {}
    for k in ALL_KINDS:
        own = np.flatnonzero(kind[aside] == k)
        own = own[np.argsort(-raw[own], kind="stable")]
        right = np.cumsum(y[aside][own]) / np.arange(1, len(own) + 1)
        enough = np.flatnonzero(right >= precision)
        cuts[k] = max(float(raw[own[enough[-1]]]), 0.0) if len(enough) else np.inf
    return Model(trees, cuts)


def added_spans(text: str, base: list[Span], fitted: Model) -> list[Span]:
    """Candidates that the trees select, none of which overlaps another or a strict finding."""
    taken = _Taken(base)
    free = [c for c in candidates(text) if c not in taken]
    if not free:
        return []
    raw = np.concatenate([fitted.trees.raw(np.array([features(text, c) for c in free[i : i + 4096]])) for i in range(0, len(free), 4096)])
    starts: list[int] = []  # of the selected, which do not overlap
    out: list[Span] = []
    for score, c in sorted(zip(raw, free), key=lambda x: (-x[0], x[1])):
        if score >= fitted.cuts[c[0]]:
            k = bisect_left(starts, c[2])  # only the last one that begins before its end can reach it
            if not k or out[k - 1][2] <= c[1]:
                at = bisect_left(starts, c[1])
                starts.insert(at, c[1])
                out.insert(at, c)
    return out


def find(text: str | None, fitted: Model) -> tuple[list[Span], list[Span]]:
    """(strict findings, all findings), both by kind, then start."""
    base = base_spans(text)
    more = added_spans(text, base, fitted) if text else []
    return base, sorted(base + more, key=lambda s: (ALL_KINDS.index(s[0]), s[1])) if more else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in capitals and brackets; overlapping spans are one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with base, spans and secrets (each as kind:start:end, comma-joined; spans
    holds the four kinds) and redacted (the text without any of them). Columns of these names are replaced."""
    return _scan(docs, text, keep, True)


def _scan(docs: DataFrame, text: str, keep: list[str] | None, texts: bool) -> DataFrame:
    ship(docs.sparkSession)
    new = ["base", "spans", "secrets", *["redacted"] * texts]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    slim = docs.select(*kept, F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model())  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for whole in batches:
            for i, j, *_ in textvec.chunks(whole.column(len(kept)), HELD):
                batch = whole.slice(i, j - i)
                out: list[list] = [[] for _ in new]
                for value in batch.column(len(kept)):
                    t = value.as_py()
                    base, found = find(t, fitted)
                    personal = [s for s in found if s[0] != "secret"]
                    out[0].append(written(base))
                    out[1].append(written(personal))
                    out[2].append(written(found[len(personal) :]))
                    if texts:
                        out[3].append(redacted(t, found))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(c, pa.string()) for c in out)], [*kept, *new])

    schema = slim.select(*kept).schema
    for c in new:
        schema = schema.add(c, "string")
    return slim.mapInArrow(run, schema)


def found(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Like ``spans``, without the texts."""
    return _scan(docs, text, keep, False)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data and secrets replaced in ``text``; same columns.

    A row travels as one struct beside its text, so columns of any name stay what they are.
    """
    rest = [c for c in docs.columns if c != text]
    slim = docs.select(F.struct(F.lit(0).alias("__none"), *rest).alias("row"), F.col(text).alias("text"))
    found = _scan(slim, "text", ["row"], True)
    return found.select(*[F.col("redacted").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
