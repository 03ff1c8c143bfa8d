"""Dictionaries stored as finite-state automata (compact version 2), as rows.

Header: ``\\fsa``, the version byte, 16 flag bits, a table of frequent labels; then the arcs. The file is
only a storage form: it is enumerated once, on executors, into a table of byte strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from proseworks.session import ship

#: Fixed values of the format.
MAGIC, VERSION = b"\\fsa", 0xC6
NEXT, LAST, FINAL, LABEL = 0x80, 0x40, 0x20, 0x1F
NUMBERED = 0x0100


class FormatError(ValueError):
    """The bytes are no automaton of this version."""


def _number(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it) of a number in groups of seven bits, lowest first."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


@dataclass
class Arc:
    label: int
    final: bool
    target: int  # 0: none


class Automaton:
    def __init__(self, data: bytes):
        if len(data) < 8 or data[: len(MAGIC)] != MAGIC and len(data) < 5:
            raise FormatError("truncated")
        if data[: len(MAGIC)] != MAGIC:
            raise FormatError("bad magic")
        if data[4] != VERSION:
            raise FormatError(f"unsupported version {data[4]:#04x}")
        table = 8 + data[7]
        if len(data) < table:
            raise FormatError("truncated")
        self.labels, self.arcs = data[8:table], data[table:]
        self.numbered = bool(int.from_bytes(data[5:7], "big") & NUMBERED)
        self.root = self.node(0)[0].target

    def node(self, at: int) -> list[Arc]:
        """The arcs of the node at a place; arcs that point to what follows the node get its place."""
        if self.numbered:
            at = _number(self.arcs, at)[1]
        out, following = [], []
        while True:
            flags = self.arcs[at]
            at += 1
            if flags & LABEL:
                label = self.labels[flags & LABEL]
            else:
                label = self.arcs[at]
                at += 1
            target = 0
            if flags & NEXT:
                following.append(len(out))
            else:
                target, at = _number(self.arcs, at)
            out.append(Arc(label, bool(flags & FINAL), target))
            if flags & LAST:
                for i in following:
                    out[i].target = at
                return out

    def sequences(self) -> Iterator[bytes]:
        """All accepted byte strings, depth first."""
        stack = [(iter(self.node(self.root)), b"")] if self.root else []
        while stack:
            arcs, prefix = stack[-1]
            arc = next(arcs, None)
            if arc is None:
                stack.pop()
                continue
            word = prefix + bytes([arc.label])
            if arc.final:
                yield word
            if arc.target:
                stack.append((iter(self.node(arc.target)), word))


@dataclass(frozen=True)
class Info:
    """What the sibling ``.info`` file says."""

    separator: bytes = b"+"
    encoder: str = "NONE"
    frequency: bool = False


def parse_info(text: str) -> Info:
    pairs = dict(
        (k.strip(), v.strip()) for k, eq, v in (line.strip().partition("=") for line in text.splitlines() if not line.strip().startswith("#")) if eq
    )
    return Info(
        (pairs.get("fsa.dict.separator") or "+").encode()[:1], (pairs.get("fsa.dict.encoder") or "NONE").upper(), pairs.get("fsa.dict.frequency-included", "").lower() == "true"
    )


def decode_suffix(word: bytes, code: bytes) -> bytes:
    """The stem: as many bytes as the first letter says (A none) are dropped from the word, the rest is appended."""
    if not code:
        return word
    return word[: max(len(word) - (code[0] - 65), 0)] + code[1:]


def entries(data: bytes, info: Info) -> Iterator[tuple[str, str | None, str | None, int]]:
    """(form, stem, tag, frequency) of each sequence; of a word list stem and tag are null."""
    if info.encoder in ("PREFIX", "INFIX"):
        raise NotImplementedError(f"encoder {info.encoder}")
    for seq in Automaton(data).sequences():
        form, found, rest = seq.partition(info.separator)
        if info.frequency:
            yield form.decode(), None, None, rest[0] - 65 if rest else 0
        elif not found:
            yield form.decode(), None, None, 0
        else:
            code, _, tag = rest.partition(info.separator)
            stem = decode_suffix(form, code) if info.encoder == "SUFFIX" else code
            yield form.decode(), stem.decode(), tag.decode(), 0


def read_dictionary(spark: SparkSession, path: str, info_path: str | None = None) -> DataFrame:
    """form, stem, tag, freq of the automaton at ``path``; its ``.info`` lies beside it. Read by Spark, so any store will do."""
    ship(spark)
    info_path = info_path or path.rpartition(".")[0] + ".info"
    info = parse_info("\n".join(r[0] for r in spark.read.text(info_path).collect()))

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for data in batch["content"]:
                found = list(entries(bytes(data), info))
                yield pd.DataFrame(found, columns=["form", "stem", "tag", "freq"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "form string, stem string, tag string, freq int")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """seq: the accepted byte strings of the automaton at ``path``."""
    ship(spark)

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame({"seq": list(Automaton(bytes(data)).sequences())})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "seq binary")
