"""Resource packs: lexicons, word lists and rules, from files or the small built-in pack."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseworks.operators.analysis import Lexicon, Segmenter
from proseworks.operators.grammar import Synthesizer
from proseworks.plans.ir import DisambigRule, GrammarRule
from proseworks.sources import srx
from proseworks.sources.rules import parse_disambiguation, parse_grammar


def _lines(text: str) -> list[str]:
    return [x for x in text.splitlines() if x.strip() and not x.startswith("#")]


def parse_overlay(text: str) -> list[tuple[str, str, str]]:
    """form, lemma, tag from lines with tabs; lines with fewer fields or an empty form are left out."""
    return [tuple(f[:3]) for f in (x.split("\t") for x in _lines(text)) if len(f) >= 3 and f[0]]


def parse_words(text: str) -> list[str]:
    """One word a line, what follows a tab is a comment; entries of several words are left out."""
    found = (x.split("\t")[0].strip() for x in _lines(text) if not x.strip().startswith("#"))
    return [w for w in found if w and len(w.split()) == 1]


def parse_multiwords(text: str) -> list[str]:
    """The capitalised words of multi-word terms."""
    return list(dict.fromkeys(w for x in _lines(text) for w in x.split("\t")[0].split() if w[:1].isupper()))


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t", -1)
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#')").where(F.size(f) >= 3)
    return rows.select(f[0].alias("form"), f[1].alias("lemma"), f[2].alias("pos")).where("form <> ''")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.trim(F.split("value", "\t")[0]).alias("word"), F.trim("value").alias("line"))
    return rows.where(r"line <> '' and not startswith(line, '#') and word <> '' and not word rlike '\\s'").select("word").distinct()


@dataclass
class Pack:
    forms: list[tuple[str, str, str]] = field(default_factory=list)  # form, lemma, tag; repeats kept
    removed: list[tuple[str, str, str]] = field(default_factory=list)
    synth: list[tuple[str, str, str]] = field(default_factory=list)  # lemma, tag, form
    tags: list[str] = field(default_factory=list)
    grammar: list[GrammarRule] = field(default_factory=list)
    disambiguation: list[DisambigRule] = field(default_factory=list)
    breaks: list[srx.BreakRule] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    prohibit: list[str] = field(default_factory=list)

    def lexicon(self) -> Lexicon:
        gone, out = set(self.removed), {}
        for form, lemma, tag in self.forms:
            if (form, lemma, tag) not in gone:
                out.setdefault(form, []).append((lemma, tag))
        return Lexicon(out)

    def synthesizer(self) -> Synthesizer:
        forms: dict[tuple[str, str], list[str]] = {}
        for lemma, tag, form in self.synth:
            forms.setdefault((lemma, tag), []).append(form)
        return Synthesizer(forms, self.tags)

    def segmenter(self) -> Segmenter:
        return Segmenter(self.breaks)


#: File names of a pack folder, all optional.
FILES = {"forms": "lexicon.tsv", "added": "added.tsv", "removed": "removed.tsv", "synth": "synth.tsv", "tags": "tags.txt", "grammar": "grammar.xml",
         "disambiguation": "disambiguation.xml", "breaks": "segment.srx", "ignore": "ignore.txt", "multiwords": "multiwords.txt", "prohibit": "prohibit.txt"}


def from_texts(texts: dict[str, str], language: str = "en-US") -> Pack:
    get = lambda k: texts.get(k, "")
    return Pack(
        forms=parse_overlay(get("forms")) + parse_overlay(get("added")), removed=parse_overlay(get("removed")), synth=parse_overlay(get("synth")),
        tags=[x.strip() for x in _lines(get("tags"))], grammar=parse_grammar(get("grammar")) if get("grammar") else [],
        disambiguation=parse_disambiguation(get("disambiguation")) if get("disambiguation") else [], breaks=srx.parse(get("breaks"), language) if get("breaks") else [],
        ignore=list(dict.fromkeys(parse_words(get("ignore")) + parse_multiwords(get("multiwords")))), prohibit=parse_words(get("prohibit")),
    )


def from_dir(folder: str, language: str = "en-US") -> Pack:
    """A pack from a folder on the driver; files that are missing count as empty."""
    texts = {}
    for name, file in FILES.items():
        path = os.path.join(folder, file)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                texts[name] = f.read()
    return from_texts(texts, language)


#: The automaton dictionary of a pack folder, with its ``.info`` beside it; its entries join those of the lexicon.
DICTIONARY = "lexicon.dict"
#: Entries that a pack may hold: it is broadcast (about 100 bytes each).
MOST_FORMS = 3_000_000


def read_pack(spark: SparkSession, folder: str, language: str = "en-US") -> Pack:
    """A pack from a folder in any store that Spark reads; files that are missing count as empty."""
    from proseworks.sources.automaton import read_dictionary

    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(file: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}")
        return path.getFileSystem(conf).exists(path)

    texts = {name: spark.read.text(f"{folder}/{file}", wholetext=True).first()[0] for name, file in FILES.items() if there(file)}
    pack = from_texts(texts, language)
    if there(DICTIONARY):
        found = read_dictionary(spark, f"{folder}/{DICTIONARY}").where("stem is not null").select("form", "stem", "tag")
        if found.count() > MOST_FORMS:
            raise ValueError(f"{folder}/{DICTIONARY} has more than {MOST_FORMS} entries")
        pack.forms = [tuple(r) for r in found.collect()] + pack.forms
    return pack


_FORMS = """the the DT|a a DT|an an DT|this this DT|that that DT|that that IN|of of IN|to to TO|to to IN|in in IN|on on IN|for for IN|with with IN|by by IN|as as IN|at at IN|from from IN
and and CC|or or CC|it it PRP|he he PRP|they they PRP|we we PRP|I I PRP|is be VBZ|are be VBP|was be VBD|were be VBD|be be VB|has have VBZ|have have VB|have have VBP|had have VBD|go go VB|goes go VBZ|went go VBD
cat cat NN|cats cat NNS|dog dog NN|dogs dog NNS|house house NN|house house VB|apple apple NN|old old JJ|big big JJ|very very RB|not not RB|n't not RB|can can MD|can can NN|do do VB|do do VBP|what what WP|which which WDT"""

TEXTS = {
    "forms": "\n".join(x.replace(" ", "\t") for line in _FORMS.split("\n") for x in line.split("|")),
    "added": "house\thouse\tNN", "removed": "that\tthat\tIN", "ignore": "proseworks\tname", "multiwords": "New York\tNNP", "prohibit": "alot",
    "synth": "cat\tNNS\tcats\ncat\tNN\tcat\ndog\tNNS\tdogs\ngo\tVBZ\tgoes\nbe\tVBZ\tis\nbe\tVBP\tare", "tags": "NN\nNNS\nVB\nVBZ\nVBP",
    "breaks": """<srx><header cascade="yes"/><body><languagerules><languagerule languagerulename="en">
<rule break="no"><beforebreak>\\b(?:Mr|Dr|etc)\\.\\s+</beforebreak><afterbreak></afterbreak></rule>
<rule break="yes"><beforebreak>[.!?]\\s+</beforebreak><afterbreak>\\p{Lu}</afterbreak></rule>
<rule break="yes"><beforebreak>\\n</beforebreak><afterbreak></afterbreak></rule></languagerule></languagerules>
<maprules><languagemap languagepattern="en.*" languagerulename="en"/></maprules></body></srx>""",
    "disambiguation": """<rules>
<rule id="CAN_MD"><pattern><token postag="PRP"/><marker><token>can</token></marker></pattern><disambig action="replace"><wd lemma="can" pos="MD"/></disambig></rule>
<rule id="DT_HOUSE"><pattern><token postag="DT"/><marker><token postag="NN"/></marker></pattern><disambig action="filterall"/></rule>
<rule id="TO_VB"><antipattern><token>to</token><token>the</token></antipattern><pattern><marker><token>to</token></marker><token postag="VB"/></pattern><disambig action="filter" postag="TO"/></rule>
<rule id="NUM"><pattern><token regexp="yes">\\d+</token></pattern><disambig action="add"><wd pos="CD"/></disambig></rule></rules>""",
    "grammar": """<rules><category id="GRAMMAR"><rule id="REPEATED_THE"><pattern><token>the</token><token>the</token></pattern><message>Repeated word: <suggestion>\\1</suggestion></message>
<example correction="the">It is <marker>the the</marker> cat here.</example><example>It is the cat here.</example></rule>
<rulegroup id="A_AN"><antipattern><token>a</token><token regexp="yes">one|uni.*</token></antipattern>
<rule><pattern><marker><token>a</token></marker><token regexp="yes">[aeio].*</token></pattern><message>Use <suggestion>an</suggestion> before a vowel.</message>
<example correction="an">I have <marker>a</marker> apple now.</example><example>I have a one here.</example></rule>
<rule><pattern><marker><token>an</token></marker><token regexp="yes">[bcdfgklmnprstvz].*</token></pattern><message>Use <suggestion>a</suggestion>.</message></rule></rulegroup>
<rule id="PLURAL_IS"><pattern><token postag="NNS"/><marker><token>is</token></marker></pattern><message>Agreement: <suggestion><match no="2" postag="VBP"/></suggestion>.</message>
<example correction="are">The cats <marker>is</marker> old now.</example></rule>
<rule id="OF_OF"><pattern><token>of</token><token min="0" max="2" regexp="yes">the|a</token><token>of</token></pattern><message>Repeated \\1</message><suggestion>\\1 \\2</suggestion></rule>
<rule id="TO_GAP" default="off"><pattern><token skip="2">to</token><token>to</token></pattern><message>x</message></rule></category>
<category id="TYPOGRAPHY"><rule id="SPACE_COMMA"><pattern><token spacebefore="yes">,</token></pattern><message>No space before a comma.</message><suggestion>,</suggestion></rule></category></rules>""",
}


def builtin() -> Pack:
    """A small original pack that exercises each feature."""
    return from_texts(TEXTS)
