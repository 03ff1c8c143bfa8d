import json
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from proseworks.functions import text as T
from proseworks.operators import batch as batch_module
from proseworks.operators import spelling, synthesis, tagging
from proseworks.operators.analysis import Lexicon, analyze, disambiguate, tokenize
from proseworks.operators.batch import Batch, Vocabulary
from proseworks.operators.grammar import Finding, RuleIndex, check_sentence, findings_of, without_contained
from proseworks.operators.matching import Position, match_at, scan
from proseworks.plans import lines, reports
from proseworks.plans.engine import Engine, ordered, outermost, response
from proseworks.plans.ir import PatternSpec, TokenSpec
from proseworks.sources.automaton import Automaton, FormatError, decode_suffix, parse_info, read_dictionary, read_sequences
from proseworks.sources.pack import TEXTS, builtin, from_dir, from_texts, read_overlay, read_pack, read_words
from proseworks.sources.rules import expand_entities, parse_disambiguation, parse_pattern
from proseworks.sources.srx import java_to_regex


def sentence(*words):
    out = [Position("", [(None, "SENT_START")], is_start=True)]
    for i, (w, readings) in enumerate(words):
        out.append(Position(w, list(readings) or [(None, None)], i > 0, i))
    return out


def apply(xml, s):
    disambiguate(s, parse_disambiguation(f"<rules>{xml}</rules>"))
    return [p.readings for p in s[1:]]


def _expected(action, tag, words, p):
    """What an action makes of the readings of one marked token, said once more from its definition."""
    readings = p.readings
    fits = lambda r: re.fullmatch(tag, r[1] or "") is not None and r[1] is not None
    if action == "add":
        return ([] if [t for _, t in readings] == [None] else readings) + [(w or p.token, t) for w, t in words]
    if action == "remove":
        out = [r for r in readings if not fits(r)] if tag else [r for r in readings if (r[0], r[1]) not in words]
    elif action == "filter":
        out = [r for r in readings if fits(r)] if tag else [r for r in readings if r in words]
    elif tag:
        out = [([m for m, t in readings if t == tag and m is not None] or [readings[0][0]])[-1:] + [tag]]
        out = [tuple(out[0])]
    else:
        out = [(words[0][0] or p.token, words[0][1])]
    return out or [(None, None)]


def test_actions_agree_with_their_definitions():
    r = random.Random(11)
    for _ in range(400):
        token = r.choice(("sol", "mar"))
        own = [(r.choice(("sol", "luna")), r.choice(("N1", "N2", "V1"))) for _ in range(r.randint(0, 3))]
        action, tag, words = r.choice(("replace", "add", "remove", "filter")), None, []
        if r.random() < 0.5 and action != "add":
            tag = r.choice(("N1", "V1") if action == "replace" else ("N.", "V1", "X"))
        else:
            words = [(r.choice(("sol", "luna")), r.choice(("N1", "V1")))]
        attribute = f' postag="{tag}"' if tag else ""
        inner = "".join(f'<wd lemma="{m}" pos="{t}"/>' for m, t in words)
        s = sentence(("al", [("al", "P")]), (token, own), ("fin", []))
        xml = f'<rule><pattern><token>al</token><marker><token>{token}</token></marker></pattern><disambig action="{action}"{attribute}>{inner}</disambig></rule>'
        want = _expected(action, tag, words, s[2])
        assert apply(xml, s) == [[("al", "P")], want, [(None, None)]]


def test_actions_are_blocked_and_leave_others_alone():
    mark = '<disambig action="add"><wd pos="Z"/></disambig>'
    bare = lambda *w: sentence(*((x, []) for x in w))
    hit = lambda out: [i for i, x in enumerate(out) if x != [(None, None)]]
    after = f'<rule><antipattern><token>uno</token><token>due</token></antipattern><pattern><token>due</token></pattern>{mark}</rule>'
    assert hit(apply(after, bare("due", "uno", "due", "due"))) == [0, 3]
    around = f'<rule><pattern><token>due<exception scope="previous">uno</exception><exception scope="next">tre</exception></token></pattern>{mark}</rule>'
    assert hit(apply(around, bare("due", "uno", "due", "due", "tre", "due"))) == [0, 5]
    assert apply('<rule><pattern><token>due</token></pattern><disambig action="unify"/></rule>', bare("due")) == [[(None, None)]]
    both = '<rule><pattern><and><token postag="A1"/><token postag="B1"/></and></pattern><disambig action="filterall"/></rule>'
    assert apply(both, sentence(("w", [("w", "A1"), ("w", "B1")]))) == [[("w", "A1"), ("w", "B1")]]  # a group is no fixed token
    own = '<rule><pattern><token postag="A1"/><token>w</token></pattern><disambig action="filterall"/></rule>'
    assert apply(own, sentence(("v", [("v", "C1"), ("v", "A1")]), ("w", [("w", "C1")]))) == [[("v", "A1")], [("w", "C1")]]


def test_tokens():
    known = lambda w: w in ("n't", "'ll")
    assert tokenize("We mustn't, they'll.", known) == ["We", " ", "must", "n't", ",", " ", "they", "'ll", "."]
    assert tokenize("-alpha beta-- gamma-delta") == ["-", "alpha", " ", "beta", "-", "-", " ", "gamma-delta"]
    assert tokenize("see https://z.io/q?k=2, or me@host.net!") == ["see", " ", "https://z.io/q?k=2", ",", " ", "or", " ", "me@host.net", "!"]
    for t in ("", "a\u00a0b—c", "\U0001f600\ufe0f ok", "don’t", "--", "é́ a-b's"):
        assert "".join(tokenize(t)) == t


def test_lines_and_answers(spark, tmp_path):
    (tmp_path / "in.txt").write_text("one\\ttwo\n\nthree\\nfour\n")
    assert [r["text"] for r in lines.read_lines(spark, str(tmp_path / "in.txt")).orderBy("doc_id").collect()] == ["one\ttwo", "three\nfour"]
    docs = spark.createDataFrame([(1, "It is the the house of catz now."), (2, None), (3, "x"), (4, "")], "doc_id long, text string")
    dictionary = spark.createDataFrame([(w, 1) for w in "it is the house of cats now x".split()], "word string, freq int")
    engine = Engine(builtin())
    found = ordered(engine.check_all(docs, dictionary))
    assert [(r["nth"], r["rule_id"], r["offset"]) for r in found.orderBy("nth").collect()] == [(0, "REPEATED_THE", 6), (1, spelling.RULE_ID, 23)]
    assert [r["line"] for r in lines.finding_lines(found).orderBy("nth").collect()] == ["REPEATED_THE\t6\t7\tthe", f"{spelling.RULE_ID}\t23\t4\tcats"]
    assert [r["line"] for r in lines.spelling_lines(found.where("category_id = 'TYPOS'")).collect()] == ["23\t4\tcats"]
    answers = {r["doc_id"]: json.loads(r["json"]) for r in response(engine.check_all(docs, dictionary), docs, engine.sentences(docs)).collect()}
    assert set(answers) == {1, 2, 3, 4} and answers[3]["matches"] == [] and [m["offset"] for m in answers[1]["matches"]] == [6, 23]
    assert set(answers[2]["software"]) == {"name", "version", "apiVersion", "premium", "status"} and answers[2]["language"]["detectedLanguage"]["code"] == "en-US"
    first = answers[1]["matches"][0]
    assert first["sentence"] == "It is the the house of catz now." and first["replacements"] == [{"value": "the"}] and first["rule"]["issueType"] == "grammar"
    tokens = F.array(F.lit("a"), F.lit("\t"), F.lit("b"))
    assert lines.token_lines(docs.limit(1), tokens).first()["line"] == "WORDS|a\u241f\\t\u241fb\u241f"
    assert [r["line"] for r in lines.sentence_lines(engine.sentences(docs.where("doc_id = 3"))).collect()] == ["SENT1|x"]
    results = spark.createDataFrame([(2, 0, True, False), (1, 0, True, True), (1, 1, False, False)], "rule_ord int, example int, wrong boolean, passed boolean")
    assert [tuple(r)[:2] for r in reports.failures(results, 1).collect()] == [(1, 1)]


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d.dict").write_bytes(_encode({b"cities+Dy+NNS", b"sheep+A+NN"}))
    (tmp_path / "d.info").write_text("fsa.dict.encoder=SUFFIX\nfsa.dict.separator=+\n")
    rows = read_dictionary(spark, str(tmp_path / "d.dict")).collect()
    assert {(r["form"], r["stem"], r["tag"]) for r in rows} == {("cities", "city", "NNS"), ("sheep", "sheep", "NN")}
    assert {r["line"] for r in lines.sequence_lines(read_sequences(spark, str(tmp_path / "d.dict"))).collect()} == {b"cities+Dy+NNS".hex(), b"sheep+A+NN".hex()}
    (tmp_path / "o.tsv").write_text("# c\nruns\trun\tVBZ\nbad\tline\n\tno\tX\n")
    assert [tuple(r) for r in read_overlay(spark, str(tmp_path / "o.tsv")).collect()] == [("runs", "run", "VBZ")]
    (tmp_path / "w.txt").write_text("# c\n alpha\tx\ntwo words\n\nbeta\nbeta\n")
    assert {r["word"] for r in read_words(spark, str(tmp_path / "w.txt")).collect()} == {"alpha", "beta"}


def test_pack_of_a_folder(spark, tmp_path):
    (tmp_path / "grammar.xml").write_text(TEXTS["grammar"])
    (tmp_path / "lexicon.tsv").write_text("cats\tcat\tNNS\n")
    (tmp_path / "lexicon.dict").write_bytes(_encode({b"cities+Dy+NNS"}))
    (tmp_path / "lexicon.info").write_text("fsa.dict.encoder=SUFFIX\n")
    pack = read_pack(spark, str(tmp_path))
    assert pack.forms == [("cities", "city", "NNS"), ("cats", "cat", "NNS")] and pack.grammar == from_dir(str(tmp_path)).grammar == builtin().grammar and not pack.breaks
    docs = spark.createDataFrame([(1, "The cities is near.")], "doc_id long, text string")
    assert [r["rule_id"] for r in Engine(pack).check(docs).collect()] == ["PLURAL_IS"]


def test_tagging_agrees_with_the_lexicon(spark):
    forms = [("run", "run", "VB"), ("Paris", "Paris", "NNP"), ("running", "run", "VBG"), ("don't", "do", "X"), ("THE", "the", "Y"), ("the", "the", "DT")]
    lexicon = Lexicon({})
    for f, lemma, tag in forms:
        lexicon.forms.setdefault(f, []).append((lemma, tag))
    words = ["run", "Run", "RUN", "PARIS", "paris", "runnin'", "RUNNIN'", "Runnin'", "don’t", "rUn", "THE", "The", "x", "’"]
    got = tagging.readings(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(forms, "form string, lemma string, pos string"))
    out = {}
    for r in got.collect():
        out.setdefault(r["word"], []).append((r["lemma"], r["pos"]))
    assert {w: sorted(v) for w, v in out.items()} == {w: sorted(lexicon.readings(w)) for w in words if lexicon.readings(w)}


def test_matcher_agrees_with_brute_force():
    r = random.Random(3)

    def brute(tokens, s, e, i):
        if e == len(tokens):
            return i
        t, most = tokens[e], 0
        while i + most < len(s) and (t.max < 0 or most < t.max) and s[i + most].token == t.text:
            most += 1
        for c in range(most, t.min - 1, -1):
            for g in range((len(s) if t.skip < 0 else t.skip) + 1):
                if i + c + g <= len(s) and (end := brute(tokens, s, e + 1, i + c + g)) is not None:
                    return end
        return None

    for _ in range(1500):
        s = [Position(r.choice("ab"), [(None, None)]) for _ in range(r.randint(1, 6))]
        tokens = tuple(TokenSpec(text=r.choice("ab"), min=r.randint(0, 1), max=r.choice((1, 2, -1)), skip=r.choice((0, 0, 1, -1))) for _ in range(r.randint(1, 3)))
        m = match_at(PatternSpec(tokens, 0, len(tokens)), s, 0)
        assert (m.end if m else None) == brute(tokens, s, 0, 0)


def test_pattern_features():
    p = parse_pattern('<pattern><token chunk="B"/><marker><token min="0">a</token></marker></pattern>')
    assert p.unsupported == ("chunk",) and (p.mark_from, p.mark_to) == (1, 2)
    assert expand_entities('<!DOCTYPE r [<!ENTITY x "1&y;"><!ENTITY y \'2\'>]><r>&x;&amp;</r>').endswith("<r>12&amp;</r>")
    assert java_to_regex(r"\u00AD\\u00AD") == r"\x{00AD}\\u00AD"
    two = [m.start for m in scan(parse_pattern("<pattern><token>a</token><token>a</token></pattern>"), [Position("a", [(None, None)]) for _ in range(5)])]
    assert two == [0, 2]


def test_rules_pass_their_examples():
    pack = builtin()
    lexicon, synth = pack.lexicon(), pack.synthesizer()
    for rule in pack.grammar:
        for e in rule.examples:
            found = findings_of(rule, disambiguate(analyze(e.text, lexicon), pack.disambiguation), 0, synth)
            if e.correction is None:
                assert not found
            else:
                assert any((f.offset, f.length) == e.marker and set(f.replacements) == set(e.correction) for f in found)


def test_index_drops_no_finding():
    pack = builtin()
    s = analyze("In the the house of the of a apple , now.", pack.lexicon())
    rules = [r for r in pack.grammar if r.runs()]
    all_ = without_contained([f for r in rules for f in findings_of(r, s, 0)])
    assert check_sentence(RuleIndex(rules), s, 0) == all_ and all_


def test_outermost_agrees_with_loop(spark):
    r = random.Random(1)
    rows = [(g, r.randint(0, 8), r.randint(1, 5), i) for i in range(200) for g in [i % 20]]
    kept = set()
    for g, o, n, i in rows:
        if not any(h == g and p <= o and o + n <= p + m and m > n for h, p, m, _ in rows):
            kept.add(i)
    df = spark.createDataFrame(rows, "g int, offset int, length int, i int")
    assert {x["i"] for x in outermost(df, ["g"]).collect()} == kept
    for g in range(20):
        own = [Finding(o, n, "", (), "", "", 0, i) for h, o, n, i in rows if h == g]
        assert {f.rule for f in without_contained(own)} == {i for h, _, _, i in rows if h == g and i in kept}


def test_spelling(spark):
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    dictionary = spark.createDataFrame([("house", 9), ("mouse", 3), ("boat", 1), ("Paris", 2)], "word string, freq int")
    asked = words("House", "hOuse", "huose", "house-boat", "house-bxat", "alot", "abc1", "paris", "name")
    bad = {r["word"] for r in spelling.flagged(asked, dictionary, words("name"), words("alot", "boat")).collect()}
    assert bad == {"hOuse", "huose", "house-bxat", "alot", "paris"}
    assert spelling.suggestions(words("houuse", "ouse"), dictionary).orderBy("word").collect()[1]["suggestions"] == ["house", "mouse"]


def _edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
    return out | {a + c + b[k:] for a, b in cuts for c in letters for k in (0, 1) if k <= len(b)}


def test_suggestions_agree_with_generated_edits(spark):
    r = random.Random(8)
    make = lambda n: "".join(r.choice("abcd") for _ in range(n))
    known = {make(r.randint(1, 7)): r.randint(0, 3) for _ in range(150)}
    asked = {make(r.randint(1, 8)) for _ in range(60)} | {"zzzzzzzz", ""}
    expected = {}
    for w in asked:
        one = _edits(w, "abcd")
        two = {x for y in one for x in _edits(y, "abcd")}
        hits = [k for k in known if k in one and k != w] or [k for k in known if k in two and k != w]
        if hits:
            expected[w] = sorted(hits, key=lambda k: (-known[k], k))[: spelling.MOST]
    got = spelling.suggestions(spark.createDataFrame([(w,) for w in [*asked, *asked, None]], "word string"), spark.createDataFrame(list(known.items()), "word string, freq int"))
    assert {x["word"]: x["suggestions"] for x in got.collect()} == expected
    long = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (*range(18, 25), 400) for _ in range(3)]
    edit = lambda w: (lambda i, k: w[:i] + ("", r.choice("abcdefgh") + w[i : i + 1], r.choice("abcdefgh"), w[i + 1 : i + 2] + w[i : i + 1])[k] + w[i + (2 if k == 3 else 1) :])(r.randrange(len(w)), r.randrange(4))
    wrong = {x: w for w in long for x in [edit(edit(w)) for _ in range(6)] if x != w}
    got = spelling.suggestions(spark.createDataFrame([(x,) for x in wrong], "word string"), spark.createDataFrame([(w, 1) for w in long], "word string, freq int"))
    assert {x["word"]: x["suggestions"] for x in got.collect()} == {x: [w] for x, w in wrong.items()}
    only_own = spelling.suggestions(spark.createDataFrame([("nave",), ("Nave",), ("näve",)], "word string"), spark.createDataFrame([("näve", 1), ("Save", 1), ("näive", 1)], "word string, freq int"))
    assert {x["word"]: x["suggestions"] for x in only_own.collect()} == {"Nave": ["Save"], "näve": ["näive"]}


def test_spelling_findings_join_the_others(spark):
    docs = spark.createDataFrame([(1, "The catz is old now. the the housse"), (2, None), (3, "")], "doc_id long, text string")
    dictionary = spark.createDataFrame([(w, 1) for w in "the cats house is old now".split()], "word string, freq int")
    rows = Engine(builtin()).check_all(docs, dictionary).collect()
    assert sorted((r["offset"], r["length"], r["rule_id"], tuple(r["replacements"])) for r in rows) == [(4, 4, spelling.RULE_ID, ("cats",)), (21, 7, "REPEATED_THE", ("the",))]
    ends = Engine(builtin()).check_all(docs, dictionary, sentence_ends=True).where("category_id = 'TYPOS'").collect()
    assert {(r["offset"], tuple(r["replacements"])) for r in ends} == {(4, ("cats",)), (29, ("house",))}


def test_reports_and_synthesis(spark):
    pack = builtin()
    rules = reports.rules(spark, pack)
    row = reports.coverage(rules).first()
    assert row["rules"] == len(pack.grammar) and row["supported"] == sum(not r.unsupported for r in pack.grammar)
    assert reports.coverage(rules.limit(0)).first()["percent"] == 0
    flagged = spark.createDataFrame([(0, ["a", "a", "b"]), (1, ["a"]), (2, [])], "rule_ord int, unsupported array<string>")
    assert {tuple(x) for x in reports.unsupported(flagged).collect()} == {("a", 2), ("b", 1)}
    for x in reports.example_report(reports.examples(spark, pack)).collect():
        assert x["passed"] == x["examples"] > 0 and x["percent"] == 100
    spans = lambda *x: spark.createDataFrame([(v,) for v in x], "i int")
    assert tuple(reports.parity(spans(1, 1, 2, None), spans(2, 3, None, 4), ["i"]).first()) == (2, 1, 2, 2 / 3, 0.5)
    assert tuple(reports.parity(spans(), spans(), ["i"]).first()) == (0, 0, 0, 0.0, 0.0)
    synth = spark.createDataFrame([("be", "VBZ", "is"), ("be", "VBP", "are"), ("be", "VBP", "are"), ("be", "XVBP", "x")], "lemma string, pos string, form string")
    asked = spark.createDataFrame([("be", "VB[ZP]", "VBP"), ("no", "VBP", "VBZ")], "lemma string, pattern string, pos string")
    assert [tuple(x) for x in synthesis.by_pattern(asked, synth, synth.select(F.col("pos").alias("tag"))).collect()] == [("be", "VB[ZP]", ["are", "is"])]
    assert [tuple(x) for x in synthesis.by_tag(asked, synth).collect()] == [("be", "VBP", ["are"])]


def _encode(words):
    """A tiny writer: a tree of nodes, each arc with its label and a target of two bytes."""
    tree = {}
    for w in words:
        node = tree
        for b in w:
            node = node.setdefault(b, {})
        node[None] = True
    order, queue = [], [tree]
    while queue:
        node = queue.pop(0)
        order.append(node)
        queue += [c for b, c in sorted((b, c) for b, c in node.items() if b is not None) if any(k is not None for k in c)]
    place, at = {}, 4
    for node in order:
        place[id(node)] = at
        at += 4 * sum(b is not None for b in node)
    two = lambda n: bytes([n & 0x7F | 0x80, n >> 7])
    out = bytes([0x40, 94]) + two(place[id(tree)])
    for node in order:
        arcs = sorted((b, c) for b, c in node.items() if b is not None)
        for k, (b, c) in enumerate(arcs):
            flags = (0x40 if k == len(arcs) - 1 else 0) | (0x20 if None in c else 0)
            out += bytes([flags, b]) + two(place.get(id(c), 0))
    return b"\\fsa" + bytes([0xC6]) + struct.pack(">H", 0) + bytes([0]) + out


def test_automaton():
    words = {b"a", b"ab", b"abc", b"b", b"\xc3\xa9t"}
    assert set(Automaton(_encode(words)).sequences()) == words
    for bad in (b"\\fsa", b"nofsa" * 3, b"\\fsa\x05" + bytes(5)):
        with pytest.raises(FormatError):
            Automaton(bad)
    assert decode_suffix(b"cities", b"Dy") == b"city" and decode_suffix(b"sheep", b"A") == b"sheep"
    assert parse_info("# x\nfsa.dict.encoder=suffix\nfsa.dict.separator=_").separator == b"_"


def test_columns(spark):
    row = spark.createDataFrame([("a\u00a0 b", "Éa", "x" * 30 + "abc" + "y" * 30)], "s string, c string, t string").select(
        T.collapse_spaces(F.col("s")).alias("s"), T.is_capitalized(F.col("c")).alias("c"), T.context(F.col("t"), F.lit(30), F.lit(3)).alias("x"),
        T.cross_product([F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2"))]).alias("p"),
    ).first()
    assert row["s"] == "a b" and row["c"] and row["x"]["offset"] == 23 and row["x"]["text"].startswith("...x") and row["p"] == ["a1", "a2", "b1", "b2"]


def test_engine_offsets_nulls_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "\U0001f600 The cats is old now. In the the house."), (2, None), (3, "")], "doc_id long, text string")
    engine = Engine(builtin())
    rows = engine.check(docs).collect()
    text = docs.first()["text"]
    assert {(r["rule_id"], text[r["offset"] : r["offset"] + r["length"]]) for r in rows} == {("PLURAL_IS", "is"), ("REPEATED_THE", "the the")}
    docs.write.parquet(str(tmp_path / "in"))
    from proseworks.streaming.checks import start

    start(engine, spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_stream_with_spelling(spark, tmp_path):
    from proseworks.streaming.checks import start_all

    dictionary = spark.createDataFrame([("the", 5), ("cats", 4), ("is", 4), ("old", 2), ("now", 2)], "word string, freq int")
    parts = [[(1, "The cats is oldd now."), (2, None)], [(3, "Now the the cats."), (4, "nwo old")], []]
    for rows in parts:
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    engine, names = Engine(builtin()), ["doc_id", "offset", "length", "rule_id", "replacements"]
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        start_all(engine, stream, dictionary, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(found.select(names).collect()) == sorted(engine.check_all(docs, dictionary).select(names).collect())
    assert {"SPELLING_RULE", "REPEATED_THE"} <= {r["rule_id"] for r in found.collect()} and found.select("batch").distinct().count() > 1


def test_lexicon_stages():
    lexicon = Lexicon({"run": [("run", "VB")], "Paris": [("Paris", "NNP")], "running": [("run", "VBG")]})
    assert lexicon.readings("Run") == [("run", "VB")] and lexicon.readings("PARIS") == [("Paris", "NNP")] and lexicon.readings("runnin'") == [("run", "VBG")] and not lexicon.knows("rUn")


def _agrees(spark, folder, name):
    """Whether a query gives the rows of its SQL on the documents of a folder; the rows."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = sorted(map(repr, connection.sql(entry.oracle_sql()[name]).fetchall()))
    got = entry.queries()[name](spark, str(folder)).collect()
    assert sorted(repr(tuple(r)) for r in got) == want, name
    return got


def test_texts_without_tokens_have_no_scan(spark, tmp_path):
    rows = [(1, "a b", "en", "s"), (2, "", "en", "s"), (3, None, "en", "s"), (4, " \n", "en", "s"), (5, "a\vb", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert len(_agrees(spark, tmp_path, "token_scan")) == 3


def test_batches_agree_with_single_sentences():
    """Random rules of all features on random texts: a batch gives what each sentence by itself gives, and looks at few positions."""
    r = random.Random(5)
    forms = "".join(f"{w}\t{m}\t{t}\n" for w, m, t in (("al", "al", "P"), ("sol", "sol", "N"), ("sol", "luna", "V"), ("mar", "mar", "N"), ("al", "sol", "V")))

    def token():
        text = r.choice(("al", "sol", "mar", "", "s.*|al"))
        own = [f'{k}="{v}"' for k, v, p in (("min", r.choice("012"), 0.2), ("max", r.choice(("1", "2", "-1")), 0.2), ("skip", r.choice(("1", "-1")), 0.2), ("negate", "yes", 0.1), ("inflected", "yes", 0.2), ("postag", r.choice(("N", "V", "UNKNOWN", "SENT_END")), 0.3), ("negate_pos", "yes", 0.1), ("spacebefore", r.choice(("yes", "no")), 0.1)) if r.random() < p]
        own += ['regexp="yes"'] if "*" in text else []
        inner = f'<exception scope="{r.choice(("previous", "current", "next"))}">{r.choice(("al", "mar"))}</exception>' if r.random() < 0.3 else ""
        return f'<token {" ".join(own)}>{text}{inner}</token>'

    some = lambda n: "".join(token() for _ in range(r.randint(1, n)))
    grouped = lambda: f"<{(g := r.choice(('and', 'or')))}>{some(2)}</{g}>" if r.random() < 0.2 else ""
    anti = lambda: f"<antipattern>{some(2)}</antipattern>" if r.random() < 0.3 else ""
    looked = places = 0
    for _ in range(60):
        grammar = "".join(f"<rule id=\"G{k}\">{anti()}<pattern>{grouped()}{some(2)}<marker>{some(2)}</marker></pattern><message>m \\1</message><suggestion>{r.choice(('x', chr(92) + '1'))}</suggestion></rule>" for k in range(4))
        rules = "".join(f'<rule>{anti()}<pattern><marker>{token()}</marker>{some(2)}</pattern><disambig action="{r.choice(("add", "replace", "filterall"))}"><wd lemma="al" pos="N"/></disambig></rule>' for _ in range(3))
        pack = from_texts({"grammar": f'<rules><category id="C">{grammar}</category></rules>', "disambiguation": f"<rules>{rules}</rules>", "forms": forms, "breaks": TEXTS["breaks"]})
        texts = ["".join(r.choice(("al", "sol", "mar", "Sol", "x-y")) + r.choice((" ", " ", ", ", ". ", "\n")) for _ in range(r.randint(0, 12))) for _ in range(8)]
        batch = Batch(pack.segmenter(), Vocabulary(pack.lexicon()), texts)
        batch.disambiguate(pack.disambiguation)
        own = [r for r in pack.grammar if r.runs()]
        got = [(f[0], f[1], -f[2], f[5], f[6], f[7].id, f[4]) for f in batch.findings(own, None)]
        looked, places = looked + len(batch._made), places + len(batch)
        dump, want, k = batch.dumped(), [], 0
        for text in texts:
            base = 0
            for raw in pack.segmenter().sentences(text):
                s = disambiguate(analyze(raw, pack.lexicon()), pack.disambiguation)
                want += [(k, f.offset, f.length, f.message, f.replacements, f.rule_id, f.nth) for f in without_contained([f for x in own for f in findings_of(x, s, base)])]
                assert [batch.position(int(batch.first[k]) + j) for j in range(len(s))] == s
                assert dump[batch.first[k] : batch.first[k] + len(s)] == [f"TOK|{p.token}|" + "#".join(f"{a or '∅'}/{b or '∅'}" for a, b in p.readings) for p in s]
                base, k = base + len(raw), k + 1
        assert got == want
    assert looked < places


def test_engine_work_is_bounded_by_matches():
    """A long text without matches has no position made (each was, before)."""
    pack = builtin()
    batch = Batch(pack.segmenter(), Vocabulary(pack.lexicon()), ["lorem ipsum dolor sit amet " * 2000])
    batch.disambiguate(pack.disambiguation)
    assert batch.findings([r for r in pack.grammar if r.runs()], None) == [] and not batch._made and len(batch) == 10001


def test_texts_are_cut_by_distinct_runs(monkeypatch):
    """Tokens of many sentences at once are those of ``tokenize``, which is asked only where signs join runs (it was for each sentence, before)."""
    lexicon, r = builtin().lexicon(), random.Random(3)
    signs = [*"ab'’-- @/.w:?\n\té\u0301\u0663\u00a0\u2003İ_\ufffdΩ\ufe0f😀\x1c", "www", "https://", "n't", "can't", "a@b.io"]
    for _ in range(400):
        texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 25))) for _ in range(r.randint(0, 4))]
        vocabulary = Vocabulary(lexicon)
        assert [vocabulary.words[n] for n in batch_module._cut(texts, vocabulary)] == [t for x in texts for t in ["", *tokenize(x, lexicon.knows)]]
    asked = []
    monkeypatch.setattr(batch_module, "tokenize", lambda *args: asked.append(args[0]) or tokenize(*args))
    vocabulary = Vocabulary(lexicon)
    batch_module._cut(["Don't go-go, señor. "] * 50 + ["see z.io/q."], vocabulary)
    assert asked == ["see z.io/q."]


def test_findings_and_tallies_come_in_columns(spark):
    """Many findings of a rule with a fixed text share it, and lines of readings are counted in the worker; both were rows, before."""
    pack = from_texts({"grammar": '<rules><category id="C"><rule id="P"><pattern><token regexp="yes">[a-z]+</token><token regexp="yes">[a-z]+</token></pattern><message>m</message></rule></category></rules>'})
    batch = Batch(pack.segmenter(), Vocabulary(pack.lexicon()), ["a b c d e. " * 500, "Ab cd"])
    columns, said = batch.found(pack.grammar, None)
    assert len(said) == 2 and all(len(c) == 1001 for c in columns) and columns[1][:3].tolist() == [0, 4, 11]
    assert [x[1] for x in batch.findings(pack.grammar, None)] == columns[1].tolist()
    engine = Engine(builtin())
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(["The cat's the house .", "the\tthe TOK|x", "", None, "The cat's the house ."])], "doc_id long, text string")
    want = engine.dump(docs).where("startswith(text, 'TOK|')").groupBy("text").count()
    assert sorted(map(tuple, engine.tally(docs).collect())) == sorted(map(tuple, want.collect()))
    assert {r.word for r in engine.distinct_words(docs).collect()} == {r.word for r in engine.words(docs).collect()}
    assert "mapinarrow" in _plan(engine.tally(docs)) and "doc_id" not in _plan(engine.tally(docs)).split("mapinarrow")[0]


def test_dictionary_asks_for_words_once(spark, tmp_path):
    """The plan of the look-ups holds the engine once (twice, before); lines are those of the two look-ups."""
    from proseworks.engine_queries import dictionary_lookup

    spark.createDataFrame([(1, "the the of zzz")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert _plan(dictionary_lookup(spark, str(tmp_path))).count("mapinarrow") == 1
    words = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    entries = spark.createDataFrame([("a", "a", "X"), ("a", "a", "X"), ("a", "o", None), ("b", None, "Y"), ("z", "z", "Z")], "form string, stem string, tag string")
    want = lines.contains_lines(words, entries).unionAll(lines.lookup_lines(words, entries))
    assert sorted(map(tuple, lines.dictionary_lines(words, entries).collect())) == sorted(map(tuple, want.collect()))


_ROWS = [(1, "In the the house of a apple.", None, "s"), (2, "In the the house. The cats are old , now.", "en", "s"), (3, "The the", "en", "s"), (4, "A apple is the the house", None, "s"), (5, None, "en", "s"), (6, "", None, "s")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_scope_asks_once_and_keeps_texts_without_language(spark, tmp_path):
    spark.createDataFrame(_ROWS, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    from proseworks.engine_queries import scope_report

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert _plan(scope_report(spark, str(tmp_path))).count("mapinarrow") == 1
    own = {(r["lang"], r["rule_id"]): (r["hits"], r["samples"]) for r in reports.scope(Engine(builtin()).check(docs), docs).collect()}
    assert own[None, "REPEATED_THE"] == (2, ["the the", "the the"]) and own["en", "REPEATED_THE"] == (2, ["the the", "The the"])


def test_order_of_answers_asks_for_no_suggestions(spark, tmp_path):
    rows = _ROWS + [(i, "old house now thing", "en", "s") for i in range(10, 35)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    import __spark_entry__ as entry

    assert "levenshtein" not in _plan(entry.queries()["answer_order"](spark, str(tmp_path)))
    assert len(_agrees(spark, tmp_path, "answer_order")) > 5


def test_nearest_agrees_with_all_pairs(monkeypatch):
    """In parts of a few words, a few keys and pairs at a time, with characters that only some words may be given."""
    import numpy as np
    import pyarrow as pa

    from proseworks.operators import nearest

    r = random.Random(5)
    make = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    known = list(dict.fromkeys(make("abcdéñ$A", r.randint(0, 7)) for _ in range(250)))
    asked = list(dict.fromkeys([make("abcdéB", r.randint(0, 8)) for _ in range(60)] + known[:20]))
    reach = {k: _edits(k, "abcdéñ$AB") for k in known}
    expected = []
    for w in asked:
        allowed = [k for k in known if k != w and all("a" <= c <= "z" or c in w or w[:1] == "B" and c == "A" for c in k)]
        one = _edits(w, "abcdéñ$AB")
        hits = [k for k in allowed if w in reach[k]] or [k for k in allowed if one & (reach[k] | {k})]
        expected.append(hits[:8])
    capital = np.array([w[:1] == "B" for w in asked])
    for parts, keys, pairs in (({1: 70, 2: 40}, 5000, 30), (nearest.PARTS, nearest.KEYS, nearest.PAIRS)):
        for name, value in (("PARTS", parts), ("KEYS", keys), ("PAIRS", pairs)):
            monkeypatch.setattr(nearest, name, value)
        own, word = nearest.Nearest(pa.array(known)).of(asked, capital, 8)
        assert [[known[k] for k in word[own == i]] for i in range(len(asked))] == expected


def test_suggestions_have_no_keys_of_short_words(spark):
    """Each word became a row for each string that two deletions leave of it, and all that share one were compared."""
    words = spark.createDataFrame([("abcdefgh",), ("abcdefghijklmnopqrstuv",)], "word string")
    found = spelling.suggestions(words, spark.createDataFrame([("abcdefgx", 1), ("abcdefghijklmnopqrstuw", 1)], "word string, freq int"))
    assert sorted(map(tuple, found.collect())) == [("abcdefgh", ["abcdefgx"]), ("abcdefghijklmnopqrstuv", ["abcdefghijklmnopqrstuw"])]
    assert _plan(found).count("mapinarrow") == 1
    pairs = spelling._pairs(words, spark.createDataFrame([("abcdefgx", 1)], "word string, freq int"))
    assert "length" in _plan(pairs) and pairs.where("suggestion = 'abcdefgx'").count() == 0


def test_words_are_looked_for_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "en"), (2, "", "en"), (3, None, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    from proseworks.queries import _words

    words = _words(spark, str(tmp_path))
    assert _plan(words).count("regexp_extract_all") == 1 and [r["word"] for r in words.collect()] == ["a", " ", "b"]


def test_words_are_asked_only_where_they_can_fit(monkeypatch):
    """Each new word of a batch was asked for readings, lower-cased, shown and tried with patterns that its length rules out."""
    from proseworks.operators import matching

    assert [c for c in map(chr, range(0x110000)) if len(c.lower()) != 1] == [batch_module.LONGER]
    lexicon = Lexicon({"to": [("to", "TO")], "running": [("run", "VBG")], "été": [("été", "N")]})
    words = [f"word{i}" for i in range(500)] + ["TO", "To", "runnin'", "ÉTÉ", "İs", "i̇s", "I", "K", "\u212a", "ΟΔΟΣ", "οδος", "οδοσ", "\n", "a\tb", "\x1c", "\xa0", "to", "word3"]
    asked = []
    monkeypatch.setattr(lexicon, "may_have", lambda w, f=lexicon.may_have: asked.append(w) or f(w))
    v = Vocabulary(lexicon)
    numbers = v.number(words)
    assert [v.words[n] for n in numbers] == words and len(set(v.words)) == len(v.words)
    assert v.length.tolist() == list(map(len, v.words)) and [v.words[n] for n in range(len(v.words)) if v.space[n]] == ["\n", "\xa0"]
    kinds = v.kind_table()
    assert not {w for w in asked if w.startswith("word")}
    assert [v.kinds[kinds[n]] for n in numbers] == [tuple(lexicon.readings(w)) for w in words]
    for low in ["", "to", "i̇s", "i", "k", "οδος", "οδοσ", "İs", "none"] + [w.lower() for w in words]:
        assert sorted(v.alike(low)) == [n for n, w in enumerate(v.words) if w.lower() == low]
    v.number(["tO", "İS"])
    assert [v.words[n] for n in v.alike("to")] == ["TO", "To", "to", "tO"] and [v.words[n] for n in v.alike("i̇s")] == ["i̇s", "İs", "İS"]
    tried = []

    class Seen:
        def __init__(self, text):
            self.own = matching.compiled(text, False)

        def fullmatch(self, w):
            tried.append(w)
            return self.own.fullmatch(w)

    monkeypatch.setattr(batch_module, "compiled", lambda text, sensitive: Seen(text))
    for text in ("to|is|the", "K|οδος|weiß", "t.*"):
        tried.clear()
        spec = TokenSpec(text=text, regexp=True)
        assert v.text_table(spec).tolist() == [matching.compiled(text, False).fullmatch(w) is not None for w in v.words]
        assert (len(tried) < 20) == (text != "t.*")
    assert v.shown_words() == [w.replace("\n", "\\n").replace("\t", "\\t") for w in v.words]


def test_only_sentences_with_signs_of_addresses_are_searched(monkeypatch):
    pack = builtin()
    plain = ["One two wwhat.\n"] * 50
    texts = ["".join(plain) + "See www.a.org now.\nMail a@b.org ☺\ufe0f.\nOr http://a.org/b.\n" + "".join(plain), "ww", "w. W"]
    searched = []

    class Signs:
        @staticmethod
        def search(s, own=batch_module.JOINED):
            searched.append(s)
            return own.search(s)

    monkeypatch.setattr(batch_module, "JOINED", Signs)
    batch = Batch(pack.segmenter(), Vocabulary(pack.lexicon()), texts)
    assert len(searched) == 4  # one more for the sign that only two texts together have
    want = [t for s in batch.raw for t in ["", *(t for t in tokenize(s, pack.lexicon().knows) if not t.isspace())]]
    assert [batch.vocabulary.words[w] for w in batch.word] == want
