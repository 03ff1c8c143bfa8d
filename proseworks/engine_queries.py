"""Queries that run the checker itself over whole tables, and SQL that reaches the same rows by another way.

The SQL cuts texts into tokens by one expression and looks at neighbours with window functions. Rules here are small packs
of their own, one for each feature; a pack without break rules takes each document as one sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseworks.functions import text as T
from proseworks.operators import analysis
from proseworks.plans import lines, reports
from proseworks.plans.engine import Engine
from proseworks.sources.pack import builtin, from_texts

#: Characters of words with both apostrophes.
WORD = f"{analysis.WORD}'’"
#: An e-mail address as one token, fixed value.
_MAIL = r"[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@(?:[a-zA-Z\-0-9]+\.)+[a-zA-Z]{2,}"
#: Signs of words right behind an address belong to a token that begins inside it, which is none: fixed value.
_SIGNED = f"^({_MAIL})[&%$][{WORD}]*$".replace("'", "''")
_TOKEN_SQL = f"{_MAIL}(?:[&%$][{WORD}]*)?|[{WORD}]+|[^{WORD}]".replace("'", "''")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _sql(marked: str = "text") -> str:
    """CTEs up to num (doc_id, lang, sent, k, word, off, spaced, m): solid tokens numbered from 1 in each sentence; m counts them."""
    return f"""cut AS (SELECT doc_id, lang, {marked} AS t FROM documents),
lists AS (SELECT doc_id, lang, regexp_extract_all(t, '{_TOKEN_SQL}') AS l FROM cut),
whole AS (SELECT doc_id, lang, unnest(l) AS token, unnest(range(len(l))) AS i FROM lists),
flat AS (SELECT *, CASE WHEN contains(token, '@') THEN regexp_replace(token, '{_SIGNED}', '\\1') ELSE token END AS word, CASE WHEN token = chr(1) THEN 0 ELSE length(token) END AS full_length FROM whole),
placed AS (SELECT *, CAST(sum(CASE WHEN word = chr(1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS sent FROM flat),
spaced AS (SELECT *, coalesce(lag(regexp_matches(word, '^\\s$')) OVER s, false) AS spaced, CAST(sum(full_length) OVER (PARTITION BY doc_id ORDER BY i) - sum(full_length) OVER s + sum(length(word)) OVER s - length(word) AS INTEGER) AS off
 FROM placed WHERE word <> chr(1) WINDOW s AS (PARTITION BY doc_id, sent ORDER BY i)),
num AS (SELECT doc_id, lang, sent, word, lower(word) AS low, off, spaced, row_number() OVER s AS k, count(*) OVER (PARTITION BY doc_id, sent) AS m, lead(lower(word)) OVER s AS n1, lead(lower(word), 2) OVER s AS n2, lead(lower(word), 3) OVER s AS n3,
 lag(lower(word)) OVER s AS p1, lead(word) OVER s AS w1, lead(off) OVER s AS o1, lead(word, 2) OVER s AS w2, lead(off, 2) OVER s AS o2, lead(word, 3) OVER s AS w3, lead(off, 3) OVER s AS o3, lead(spaced) OVER s AS s1, lead(spaced, 2) OVER s AS s2, lead(spaced, 3) OVER s AS s3
 FROM spaced WHERE NOT regexp_matches(word, '^\\s$') WINDOW s AS (PARTITION BY doc_id, sent ORDER BY i))"""


#: Marks where sentences of the built-in pack begin.
_BREAKS = r"""regexp_replace(regexp_replace(replace(regexp_replace(text, '([.!?]\s+)(\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1) || '+', chr(1), 'g'), '\b((?:Mr|Dr|etc)\.\s+)' || chr(1), '\1', 'g')"""
_ALTERNATE = "row_number() OVER (PARTITION BY doc_id, sent, k - g ORDER BY k) % 2 = 1"


def _grammar(*rules: str, forms: str = "", disambiguation: str = "") -> Engine:
    body = "".join(rules)
    texts = {"grammar": f'<rules><category id="CHECK">{body}</category></rules>'} if body else {}
    if disambiguation:
        texts["disambiguation"] = f"<rules>{disambiguation}</rules>"
    return Engine(from_texts(texts | {"forms": forms}))


def _rule(name: str, pattern: str, message: str = "x", suggestion: str = "", anti: str = "") -> str:
    anti = f"<antipattern>{anti}</antipattern>" if anti else ""
    return f'<rule id="{name}">{anti}<pattern>{pattern}</pattern><message>{message}</message><suggestion>{suggestion}</suggestion></rule>'


def _found(engine: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.check(_docs(spark, sf_dir)).select("doc_id", "offset", "length", "rule_id")


def engine_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the built-in break rules, with their offsets, as lines."""
    own = Engine(builtin()).sentences(_docs(spark, sf_dir))
    return lines.sentence_lines(own).join(own.select("doc_id", "sent_id", "offset"), ["doc_id", "sent_id"]).select("doc_id", "sent_id", "offset", F.md5("line").alias("line_md5"))


_SENTENCES_SQL = f"""WITH cut AS (SELECT doc_id, regexp_replace({_BREAKS}, chr(1) || '$', '') AS t FROM documents WHERE text <> ''), parts AS (SELECT doc_id, string_split(t, chr(1)) AS p FROM cut),
rows AS (SELECT doc_id, unnest(p) AS s, CAST(unnest(range(len(p))) AS INTEGER) AS sent_id FROM parts)
SELECT doc_id, sent_id, CAST(coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS "offset",
 md5('SENT' || length(s) || '|' || replace(replace(s, chr(10), '\\n'), chr(9), '\\t')) AS line_md5 FROM rows"""


def engine_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each sentence that are not white space, their places and how many follow a space."""
    own = Engine(builtin()).token_lists(_docs(spark, sf_dir))
    joined = F.array_join(F.zip_with("offsets", "words", lambda o, w: F.concat(o.cast("string"), F.lit(" "), w)), "\n")
    spaced = F.size(F.filter("after_space", lambda x: x)).cast("long")
    return own.select("doc_id", "sent_id", F.size("words").cast("long").alias("tokens"), spaced.alias("after_space"), F.md5(joined).alias("md5"), F.element_at("offsets", -1).alias("last"))


_TOKENS_SQL = f"""WITH {_sql(_BREAKS)} SELECT doc_id, sent AS sent_id, count(*) AS tokens, count(*) FILTER (spaced) AS after_space, md5(string_agg(off || ' ' || word, chr(10) ORDER BY off)) AS md5, max(off) AS last FROM num GROUP BY 1, 2"""


def grammar_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the built-in rules in all documents, rendered."""
    own = Engine(builtin()).check(_docs(spark, sf_dir))
    return own.select("doc_id", "sent_id", "offset", "length", "rule_id", "category_id", "message", F.array_join("replacements", "|").alias("replacements"))


_JOIN = "CASE WHEN {s} THEN ' ' ELSE '' END || {w}"
FINDINGS_SQL = f"""{_sql(_BREAKS)},
the_cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY k) AS g FROM num WHERE low = 'the' AND n1 = 'the'),
the_two AS (SELECT doc_id, lang, sent, off AS o, o1 + length(w1) - off AS n, 'REPEATED_THE' AS rule_id, 'GRAMMAR' AS category_id, 'Repeated word: “' || word || '”' AS message, word AS replacements FROM the_cand QUALIFY {_ALTERNATE}),
a_cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY k) AS g FROM num WHERE low = 'a' AND regexp_matches(w1, '^[aeioAEIO]')),
a_one AS (SELECT * FROM a_cand QUALIFY {_ALTERNATE}),
a_an AS (SELECT doc_id, lang, sent, off AS o, 1 AS n, 'A_AN' AS rule_id, 'GRAMMAR' AS category_id, 'Use “an” before a vowel.' AS message, CASE WHEN word = 'A' THEN 'An' ELSE 'an' END AS replacements FROM a_one
 WHERE NOT (n1 = 'one' OR starts_with(n1, 'uni')) AND NOT (n1 = 'a' AND coalesce(n2 = 'one' OR starts_with(n2, 'uni'), false))),
an_a AS (SELECT doc_id, lang, sent, off AS o, 2 AS n, 'A_AN' AS rule_id, 'GRAMMAR' AS category_id, 'Use “a”.' AS message, CASE WHEN regexp_matches(word, '^A') THEN 'A' ELSE 'a' END AS replacements FROM num WHERE low = 'an' AND regexp_matches(n1, '^[bcdfgklmnprstvz]')),
of_cand AS (SELECT *, CASE WHEN n1 IN ('the', 'a') AND n2 IN ('the', 'a') AND n3 = 'of' THEN 3 WHEN n1 IN ('the', 'a') AND n2 = 'of' THEN 2 WHEN n1 = 'of' THEN 1 END AS far FROM num WHERE low = 'of'),
of_chain AS (SELECT *, count(*) FILTER (coalesce(prev + prev_far <> k, true)) OVER (PARTITION BY doc_id, sent ORDER BY k) AS chain FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id, sent ORDER BY k) AS prev, lag(far) OVER (PARTITION BY doc_id, sent ORDER BY k) AS prev_far FROM of_cand WHERE far IS NOT NULL)),
of_first AS (SELECT * FROM of_chain QUALIFY row_number() OVER (PARTITION BY doc_id, sent, chain ORDER BY k) % 2 = 1),
of_of AS (SELECT doc_id, lang, sent, off AS o, CASE far WHEN 1 THEN o1 + length(w1) WHEN 2 THEN o2 + length(w2) ELSE o3 + length(w3) END - off AS n, 'OF_OF' AS rule_id, 'GRAMMAR' AS category_id, 'Repeated ' || word AS message,
 word || ' ' || CASE far WHEN 1 THEN '' WHEN 2 THEN w1 ELSE w1 || {_JOIN.format(s='s2', w='w2')} END AS replacements FROM of_first),
comma AS (SELECT doc_id, lang, sent, off AS o, 1 AS n, 'SPACE_COMMA' AS rule_id, 'TYPOGRAPHY' AS category_id, 'No space before a comma.' AS message, ',' AS replacements FROM num WHERE word = ',' AND spaced),
every AS (SELECT * FROM the_two UNION ALL SELECT * FROM a_an UNION ALL SELECT * FROM an_a UNION ALL SELECT * FROM of_of UNION ALL SELECT * FROM comma),
kept AS (SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM every x WHERE x.doc_id = e.doc_id AND x.sent = e.sent AND x.o <= e.o AND e.o + e.n <= x.o + x.n AND x.n > e.n))"""
_GRAMMAR_SQL = f"""WITH {FINDINGS_SQL} SELECT doc_id, sent AS sent_id, o AS "offset", CAST(n AS INTEGER) AS length, rule_id, category_id, message, replacements FROM kept"""


def scope_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each rule that fired in a language: hits, first message and first two texts, and what kind of rule it is."""
    docs, pack = _docs(spark, sf_dir), builtin()
    own = reports.scope(Engine(pack).check(docs), docs)
    named = reports.classified(own, reports.rules(spark, pack))
    return named.select("lang", "rule_id", "category_id", "hits", "message", F.array_join("samples", "|").alias("samples"), "tier")


_SCOPE_SQL = f"""WITH {FINDINGS_SQL}, r AS (SELECT k.*, substr(d.text, o + 1, n) AS sample, row_number() OVER (PARTITION BY k.lang, rule_id ORDER BY k.doc_id, o, n) AS place FROM kept k JOIN documents d USING (doc_id))
SELECT lang, rule_id, max(category_id) AS category_id, count(*) AS hits, max(message) FILTER (place = 1) AS message, string_agg(sample, '|' ORDER BY place) FILTER (place <= 2) AS samples, 'xml' AS tier FROM r GROUP BY 1, 2"""


def finding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proseworks.plans.engine import ordered

    return lines.finding_lines(ordered(Engine(builtin()).check(_docs(spark, sf_dir)))).select("doc_id", "line")


_FINDING_LINES_SQL = f"""WITH {FINDINGS_SQL} SELECT doc_id, rule_id || chr(9) || o || chr(9) || n || chr(9) || replacements AS line FROM kept"""

#: The packs of the pattern queries, one feature each.
_OPTIONAL = _rule("OPTIONAL", '<token>of</token><token min="0" max="2" regexp="yes">the|a|an</token><token>and</token>')
_SKIP = _rule("SKIP", '<token skip="2">the</token><token>of</token>')
_EXCEPT = _rule("NEIGHBOURS", '<token>the<exception scope="previous">of</exception><exception scope="next" regexp="yes">and|th.*</exception></token>') + _rule("CURRENT", '<token regexp="yes">th.*<exception regexp="yes">the|th.*n.*</exception></token>')
_GROUPS = _rule("BOTH", '<and><token regexp="yes">th.*</token><token regexp="yes">.*e</token></and>') + _rule("EITHER", "<or><token>of</token><token>to</token></or><token>the</token>")
_NEGATE = _rule("NOT_THE", '<token>of</token><token negate="yes" regexp="yes">the|a</token>') + _rule("EXACT", '<token case_sensitive="yes">The</token>') + _rule("TIGHT", '<token spacebefore="no" regexp="yes">[.,]</token>')
_PAIRS = _rule("PAIRS", '<token regexp="yes">[a-z]+</token><token regexp="yes">[a-z]+</token>')
_BACK = _rule("BACK", '<token>of</token><marker><token regexp="yes">the|and|to</token></marker><token/>', "<suggestion>\\2</suggestion> after \\1", '<match no="3" case_conversion="startupper"/> <match no="2" case_conversion="allupper"/>\\1')
_ANTI = _rule("ANTI", "<token>of</token><token>the</token>", anti='<token>the</token><token regexp="yes">.*(e|n)</token>')
_FORMS = "the\tthe\tDT\nof\tof\tIN\nto\tto\tTO\nto\tto\tIN\nand\tand\tCC\nin\tin\tIN\nin\tin\tRP\nis\tbe\tVBZ\nare\tbe\tVBP"
_TAGS = (
    _rule("IN_DT", '<token postag="IN"/><token postag="DT"/>') + _rule("BE", '<token inflected="yes">be</token>') + _rule("TAGS", '<token postag="V.*|CC" postag_regexp="yes"/><token postag="UNKNOWN"/>')
    + _rule("NO_TAG", '<token regexp="yes">to|in|the</token><token postag="DT" negate_pos="yes">in</token>')
)


def _pattern(rules: str, forms: str = ""):
    return lambda spark, sf_dir: _found(_grammar(rules, forms=forms), spark, sf_dir)


def _rows(select: str) -> str:
    return f"WITH {_sql()} {select}"


_END1, _END2, _END3 = "o1 + length(w1) - off", "o2 + length(w2) - off", "o3 + length(w3) - off"
_HIT = 'SELECT doc_id, off AS "offset", CAST({n} AS INTEGER) AS length, \'{rule}\' AS rule_id FROM {table} WHERE {where}'
_hit = lambda rule, n, where, table="num": _HIT.format(rule=rule, n=n, where=where, table=table)
_ART = "('the', 'a', 'an')"
#: Forms found by the word itself or, unless it is lower or mixed case, by its lower case; capitals also by the capitalised form, which none has.
_FORM = "(word = low OR NOT regexp_matches(word, '\\p{Ll}') OR regexp_matches(word, '^\\p{Lu}([^\\p{L}]|\\p{Ll})*$'))"


def _kept(select: str) -> str:
    """The rows of ``select`` (doc_id, offset, length, rule_id) that lie inside no larger one."""
    return f"every AS ({select}) SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM every x WHERE x.doc_id = e.doc_id AND x.\"offset\" <= e.\"offset\" AND e.\"offset\" + e.length <= x.\"offset\" + x.length AND x.length > e.length)"


def nonoverlap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _found(_grammar(_PAIRS), spark, sf_dir)
    return own.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum("offset").cast("long").alias("offsets"), F.sum("length").cast("long").alias("lengths"))


def template_backref(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _grammar(_BACK).check(_docs(spark, sf_dir))
    return own.select("doc_id", "offset", "length", "message", F.array_join("replacements", "|").alias("replacements"))


_BACK_SQL = f"""WITH {_sql()}, c AS (SELECT *, upper(substr(w2, 1, 1)) || substr(w2, 2) || ' ' || upper(w1) || word AS r, lag(k) OVER (PARTITION BY doc_id, sent ORDER BY k) AS prev FROM num WHERE low = 'of' AND n1 IN ('the', 'and', 'to') AND w2 IS NOT NULL),
chained AS (SELECT *, count(*) FILTER (coalesce(prev + 2 <> k, true)) OVER (PARTITION BY doc_id, sent ORDER BY k) AS chain FROM c), apart AS (SELECT * FROM chained QUALIFY row_number() OVER (PARTITION BY doc_id, sent, chain ORDER BY k) % 2 = 1)
SELECT doc_id, o1 AS "offset", CAST(length(w1) AS INTEGER) AS length, '“' || w1 || '” after ' || word AS message, w1 || '|' || r AS replacements FROM apart"""

#: One rule for each action; readings are those of ``_FORMS``.
_ACTS = {
    "replace": '<rule id="R"><pattern><token>of</token><marker><token>the</token></marker></pattern><disambig><wd lemma="them" pos="X"/></disambig></rule>',
    "retag": '<rule id="R"><pattern><marker><token>to</token></marker><token>the</token></pattern><disambig postag="IN"/></rule>',
    "add": '<rule id="R"><pattern><marker><token>to</token></marker><token>the</token></pattern><disambig action="add"><wd pos="X"/></disambig></rule>',
    "remove": '<rule id="R"><pattern><token>of</token><marker><token>in</token></marker></pattern><disambig action="remove" postag="R.*"/></rule>',
    "filter": '<rule id="R"><pattern><marker><token>to</token></marker><token regexp="yes">th.*</token></pattern><disambig action="filter" postag="TO"/></rule>',
    "filterall": '<rule id="R"><antipattern><token>in</token><token>of</token></antipattern><pattern><marker><token postag="IN"/></marker><token regexp="yes">the|of</token></pattern><disambig action="filterall"/></rule>',
}


def _act(action: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _grammar(forms=_FORMS, disambiguation=_ACTS[action]).tally(_docs(spark, sf_dir)).where("text <> 'TOK||∅/SENT_START'")

    return query


def _act_sql(case: str) -> str:
    """How often each token has which readings; ``case`` says what a rule makes of them, else they are the lexicon's."""
    base = f"CASE WHEN NOT {_FORM} THEN NULL WHEN low = 'the' THEN 'the/DT' WHEN low = 'of' THEN 'of/IN' WHEN low = 'to' THEN 'to/TO#to/IN' WHEN low = 'and' THEN 'and/CC' WHEN low = 'in' THEN 'in/IN#in/RP' WHEN low = 'is' THEN 'be/VBZ' WHEN low = 'are' THEN 'be/VBP' END"
    return _rows(f"""SELECT 'TOK|' || word || '|' || CASE WHEN k = m THEN CASE WHEN r IS NULL THEN '∅/SENT_END' ELSE r || '#' || string_split(string_split(r, '#')[-1], '/')[1] || '/SENT_END' END ELSE coalesce(r, '∅/∅') END AS text, count(*) AS n
 FROM (SELECT word, k, m, CASE {case} ELSE base END AS r FROM (SELECT *, {base} AS base FROM num)) GROUP BY 1""")


#: Words with apostrophes, fixed values; the lexicon of the query knows the endings.
_SHORT = ("can't", "Isn't", "shouldn't", "cat's", "they'll", "we've", "I'd", "I'm", "you're", "o'clock", "'twas", "don't", "rock'n'roll", "cats'", "mustn't", "plain")
_ENDS = "\n".join(f"{w}\t{w}\tX" for w in ("n't", "'s", "'ll", "'ve", "'d", "'m", "'re", "'t"))


def contraction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame(list(enumerate(_SHORT)), "doc_id long, text string")
    own = _grammar(forms=_ENDS).tokens(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("offset", "word"))).alias("l"))
    return own.select("doc_id", F.array_join(F.transform("l", lambda x: x["word"]), " ").alias("parts"))


_SPLIT_SQL = f"""WITH words AS (SELECT unnest(range({len(_SHORT)})) AS doc_id, unnest([{', '.join("'" + w.replace("'", "''") + "'" for w in _SHORT)}]) AS w)
SELECT doc_id, CASE WHEN regexp_matches(lower(w), '^(is|should|do|ca|must)n''t$') THEN left(w, -3) || ' n''t' WHEN lower(w) = '''twas' THEN '''t was'
 WHEN regexp_matches(w, '.''(s|ll|ve|d|m|re)$') THEN regexp_extract(w, '^(.*)(''.*)$', 1) || ' ' || regexp_extract(w, '^(.*)(''.*)$', 2) ELSE trim(regexp_replace(replace(w, '''', ' '' '), ' +', ' ', 'g')) END AS parts FROM words"""


def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the built-in lexicon has each distinct word of the corpus, and its entries, as lines."""
    pack = builtin()
    words = Engine(pack).distinct_words(_docs(spark, sf_dir))
    forms = spark.createDataFrame([f for f in pack.forms if f not in set(pack.removed)], "form string, stem string, tag string")
    return lines.dictionary_lines(words, forms).select("line")


def _lookup_sql() -> str:
    pack = builtin()
    forms = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in f) + ")" for f in pack.forms if f not in set(pack.removed))
    return f"""WITH {_sql(_BREAKS)}, w AS (SELECT DISTINCT word FROM num), lex(form, stem, tag) AS (VALUES {forms})
SELECT word || chr(9) || CASE WHEN word IN (SELECT form FROM lex) THEN 'true' ELSE 'false' END AS line FROM w
UNION ALL SELECT word || chr(9) || coalesce(stem || chr(9) || tag, '<none>') AS line FROM w LEFT JOIN lex ON form = word"""


#: Ids of rules, fixed values that show each tier.
_IDS = ("A_AN", "MORFOLOGIK_RULE_EN_US", "GERMAN_SPELLER_RULE", "SPELLING_RULE", "EN_SIMPLE_REPLACE", "COMMA_WHITESPACE", "OF_OF")


def rule_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = spark.createDataFrame([(i,) for i in _IDS], "rule_id string")
    return reports.classified(fired, reports.rules(spark, builtin()))


_TIERS_SQL = f"""WITH f AS (SELECT unnest({list(_IDS)!r}) AS rule_id) SELECT rule_id, CASE WHEN rule_id IN ('A_AN', 'OF_OF') THEN 'xml' ELSE 'java' END AS kind,
 CASE WHEN rule_id IN ('A_AN', 'OF_OF') THEN 'xml' WHEN contains(rule_id, 'MORFOLOGIK_RULE') OR contains(rule_id, '_SPELLER_RULE') OR contains(rule_id, 'SPELLING_RULE') THEN 'spelling' WHEN contains(rule_id, 'SIMPLE_REPLACE') THEN 'data-replace' ELSE 'java' END AS tier FROM f"""


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.languages(spark)


def visible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as lines and lines as texts again."""
    docs = _docs(spark, sf_dir).select("doc_id", T.visible(F.col("text")).alias("line"))
    return docs.select("doc_id", F.md5("line").alias("line_md5"), F.length(lines.unescaped(F.col("line"))).cast("long").alias("n"))


def case_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case conversions of templates on every distinct token."""
    w = F.col("word")
    words = Engine(builtin()).distinct_words(_docs(spark, sf_dir))
    kinds = ("startlower", "startupper", "alllower", "allupper")
    return words.select("word", *[T.convert_case(k, w, w).alias(k) for k in kinds], T.convert_case("preserve", w, F.lit("oNe")).alias("preserve"), T.capitalize_like(w, F.lit("one")).alias("like"))


_CASES_SQL = f"""WITH {_sql(_BREAKS)}, w AS (SELECT DISTINCT word FROM num)
SELECT word, lower(substr(word, 1, 1)) || substr(word, 2) AS startlower, upper(replace(substr(word, 1, 1), 'ß', 'SS')) || substr(word, 2) AS startupper, lower(word) AS alllower, upper(replace(word, 'ß', 'SS')) AS allupper,
 CASE WHEN regexp_matches(word, '\\p{{L}}') AND NOT regexp_matches(word, '[^\\P{{L}}\\p{{Lu}}]') THEN 'ONE' WHEN regexp_matches(word, '^\\p{{Lu}}') THEN 'ONe' ELSE 'oNe' END AS preserve,
 CASE WHEN regexp_matches(word, '^\\p{{Lu}}') THEN 'One' ELSE 'one' END AS like FROM w"""


def collapsed_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.collapse_spaces(F.col("text"))).alias("md5"))


QUERIES = {
    "engine_sentences": engine_sentences, "engine_tokens": engine_tokens, "grammar_check": grammar_check, "scope_report": scope_report, "finding_lines": finding_lines,
    "pattern_optional": _pattern(_OPTIONAL), "pattern_skip": _pattern(_SKIP), "pattern_exception_prev_next": _pattern(_EXCEPT), "pattern_group_and_or": _pattern(_GROUPS), "pattern_negate_case": _pattern(_NEGATE),
    "pattern_antipattern": _pattern(_ANTI), "pattern_tags": _pattern(_TAGS, _FORMS), "nonoverlap_scan": nonoverlap_scan, "template_backref": template_backref,
    **{f"disambig_{a}": _act(a) for a in _ACTS}, "contraction_split": contraction_split, "dictionary_lookup": dictionary_lookup, "rule_tiers": rule_tiers, "languages": languages, "visible_lines": visible_lines,
    "case_conversions": case_conversions, "collapsed_spaces": collapsed_spaces,
}

_PAIR_SQL = f"""WITH {_sql()}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY k) AS g FROM num WHERE regexp_matches(word, '^[a-zA-Z]+$') AND regexp_matches(w1, '^[a-zA-Z]+$')), t AS (SELECT * FROM c QUALIFY {_ALTERNATE})
SELECT doc_id, count(*) AS pairs, CAST(sum(off) AS BIGINT) AS offsets, CAST(sum({_END1}) AS BIGINT) AS lengths FROM t GROUP BY doc_id"""
_OFS = f"ofs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY k) AS g FROM num WHERE low = 'of' AND n1 IS NOT NULL AND n1 NOT IN ('the', 'a')), ofs1 AS (SELECT * FROM ofs QUALIFY {_ALTERNATE})"
_KNOWN = "('the', 'of', 'to', 'and', 'in', 'is', 'are')"
_NEXT_FORM = _FORM.replace("word", "w1").replace("low", "n1")
#: Sentence ends have a tag of their own beside an unknown word's none, so the last token of a document is not unknown.
_TAGS_SQL = f"""WITH {_sql()}, bes AS (SELECT *, {_NEXT_FORM} AND n1 IN {_KNOWN} AS next_known FROM num),
ins AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY k) AS g FROM num WHERE low IN ('to', 'in', 'the') AND n1 = 'in'), ins1 AS (SELECT * FROM ins QUALIFY {_ALTERNATE}),
{_kept(' UNION ALL '.join((
    _hit('IN_DT', _END1, f"{_FORM} AND low IN ('of', 'to', 'in') AND n1 = 'the' AND {_NEXT_FORM}"), _hit('BE', 'length(word)', f"low IN ('is', 'are') AND {_FORM} OR low = 'be'"),
    _hit('TAGS', _END1, f"{_FORM} AND low IN ('and', 'is', 'are') AND w1 IS NOT NULL AND NOT next_known AND k + 1 < m", 'bes'),
    _hit('NO_TAG', _END1, "true", "ins1"))))}"""

ORACLE = {
    "engine_sentences": _SENTENCES_SQL, "engine_tokens": _TOKENS_SQL, "grammar_check": _GRAMMAR_SQL, "scope_report": _SCOPE_SQL, "finding_lines": _FINDING_LINES_SQL,
    "pattern_optional": _rows(" UNION ALL ".join((_hit("OPTIONAL", _END1, "low = 'of' AND n1 = 'and'"), _hit("OPTIONAL", _END2, f"low = 'of' AND n1 IN {_ART} AND n2 = 'and'"), _hit("OPTIONAL", _END3, f"low = 'of' AND n1 IN {_ART} AND n2 IN {_ART} AND n3 = 'and'")))),
    "pattern_skip": _rows(f"""SELECT doc_id, min(off) AS "offset", CAST(max(e) - min(off) AS INTEGER) AS length, 'SKIP' AS rule_id FROM (SELECT doc_id, off, CASE WHEN n1 = 'of' THEN o1 + 2 WHEN n2 = 'of' THEN o2 + 2 WHEN n3 = 'of' THEN o3 + 2 END AS e FROM num WHERE low = 'the') WHERE e IS NOT NULL GROUP BY doc_id, e"""),
    "pattern_exception_prev_next": _rows(_hit("NEIGHBOURS", 3, "low = 'the' AND coalesce(p1, '') <> 'of' AND NOT coalesce(n1 = 'and' OR starts_with(n1, 'th'), false)") + " UNION ALL " + _hit("CURRENT", "length(word)", "starts_with(low, 'th') AND low <> 'the' AND NOT contains(substr(low, 3), 'n')")),
    "pattern_group_and_or": f"WITH {_sql()}, " + _kept(_hit("BOTH", "length(word)", "starts_with(low, 'th') AND ends_with(low, 'e')") + " UNION ALL " + _hit("EITHER", _END1, "low IN ('of', 'to') AND n1 = 'the'")),
    "pattern_negate_case": f"WITH {_sql()}, {_OFS}, " + _kept(" UNION ALL ".join((_hit("NOT_THE", _END1, "true", "ofs1"), _hit("EXACT", 3, "word = 'The'"), _hit("TIGHT", 1, "word IN ('.', ',') AND NOT spaced")))),
    "pattern_antipattern": _rows(_hit("ANTI", _END1, "low = 'of' AND n1 = 'the' AND NOT coalesce(regexp_matches(n2, '(e|n)$'), false)")),
    "pattern_tags": _TAGS_SQL, "nonoverlap_scan": _PAIR_SQL, "template_backref": _BACK_SQL,
    "disambig_replace": _act_sql("WHEN low = 'the' AND p1 = 'of' THEN 'them/X'"),
    "disambig_retag": _act_sql("WHEN low = 'to' AND n1 = 'the' THEN CASE WHEN base IS NULL THEN '∅/IN' ELSE 'to/IN' END"),
    "disambig_add": _act_sql("WHEN low = 'to' AND n1 = 'the' THEN CASE WHEN base IS NULL THEN '' ELSE base || '#' END || word || '/X'"),
    "disambig_remove": _act_sql("WHEN low = 'in' AND p1 = 'of' AND base IS NOT NULL THEN 'in/IN'"),
    "disambig_filter": _act_sql("WHEN low = 'to' AND starts_with(n1, 'th') AND base IS NOT NULL THEN 'to/TO'"),
    "disambig_filterall": _act_sql("WHEN low = 'in' AND n1 = 'the' AND base IS NOT NULL THEN 'in/IN' WHEN low = 'to' AND n1 IN ('the', 'of') AND base IS NOT NULL THEN 'to/IN'"),
    "contraction_split": _SPLIT_SQL, "dictionary_lookup": _lookup_sql(), "rule_tiers": _TIERS_SQL,
    "languages": "SELECT * FROM (VALUES ('English', 'en', 'en'), ('English (US)', 'en', 'en-US')) t(name, code, \"longCode\")",
    "case_conversions": _CASES_SQL,
    "collapsed_spaces": r"SELECT doc_id, md5(regexp_replace(text, '[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS md5 FROM documents",
    "visible_lines": "SELECT doc_id, md5(replace(replace(text, chr(10), '\\n'), chr(9), '\\t')) AS line_md5, CAST(length(text) AS BIGINT) AS n FROM documents",
}
