"""Text functions as Column expressions: case shapes, spaces, context windows, issue types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense, fixed values (the regex engines' own classes differ).
SPACE = r"[\t-\r\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Code points shown on either side of a match.
REACH = 20
#: Issue types of categories, fixed values; others are "uncategorized".
ISSUE_TYPES = {"TYPOS": "misspelling", "GRAMMAR": "grammar", "TYPOGRAPHY": "typographical", "PUNCTUATION": "typographical"}


def is_space(c: Column) -> Column:
    return c.rlike(rf"\A{SPACE}+\z")


def is_all_upper(c: Column) -> Column:
    """No lower-case letter; true for words without letters."""
    return ~c.rlike(r"\p{Ll}")


def is_capitalized(c: Column) -> Column:
    """An upper-case letter, then no letter that is not lower-case."""
    return c.rlike(r"\A\p{Lu}(?:[^\p{L}]|\p{Ll})*\z")


def has_upper(c: Column) -> Column:
    """Some letter is not lower-case."""
    return c.rlike(r"[\p{L}&&[^\p{Ll}]]")


def is_mixed_case(c: Column) -> Column:
    return ~is_all_upper(c) & ~is_capitalized(c) & has_upper(c)


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def preserve_case(shape: Column, c: Column) -> Column:
    """``c`` in capitals where ``shape`` has only capital letters, with a capital where it begins with one."""
    letters = F.regexp_replace(shape, r"[^\p{L}]", "")
    return F.when(letters.rlike(r"\A\p{Lu}+\z"), F.upper(c)).when(shape.rlike(r"\A\p{Lu}"), upper_first(c)).otherwise(c)


def convert_case(kind: str | None, shape: Column, c: Column) -> Column:
    """One of the case conversions of templates: startlower, startupper, alllower, allupper, preserve."""
    return {
        "startlower": lower_first(c), "startupper": upper_first(c), "alllower": F.lower(c), "allupper": F.upper(c), "preserve": preserve_case(shape, c),
    }.get(kind or "", c)


def capitalize_like(shape: Column, c: Column) -> Column:
    """``c`` begins with a capital if ``shape`` does."""
    return F.when(shape.rlike(r"\A\p{Lu}") & c.rlike(r"\A\p{Ll}"), upper_first(c)).otherwise(c)


def collapse_spaces(c: Column) -> Column:
    """Each run of white space becomes one space; nothing is trimmed."""
    return F.regexp_replace(c, f"{SPACE}+", " ")


def visible(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def context(text: Column, offset: Column, length: Column) -> Column:
    """struct(text, offset, length): the match with ``REACH`` code points on each side, and where it begins there."""
    start = F.greatest(offset - REACH, F.lit(0))
    end = F.least(offset + length + REACH, F.length(text))
    left, right = F.when(start > 0, "...").otherwise(""), F.when(end < F.length(text), "...").otherwise("")
    return F.struct(
        F.concat(left, F.substring(text, start + 1, end - start), right).alias("text"), (offset - start + F.length(left)).cast("int").alias("offset"), length.cast("int").alias("length")
    )


def issue_type(category: Column) -> Column:
    pairs = [F.lit(x) for kv in ISSUE_TYPES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), F.lit("uncategorized"))


def cross_product(parts: list[Column]) -> Column:
    """All concatenations of one element of each array, the first array varying slowest."""
    def step(done: Column, part: Column) -> Column:
        return F.flatten(F.transform(done, lambda a: F.transform(part, lambda b: F.concat(a, b))))

    out = F.array(F.lit(""))
    for part in parts:
        out = step(out, part)
    return out


def suffix_decode(word: Column, code: Column) -> Column:
    """Stem from a form and its code: drop as many bytes as the first letter says (A is none), append the rest."""
    cut = F.octet_length(word) - (F.ascii(code) - 65)
    stem = F.concat(F.substring(word.cast("binary"), F.lit(1), F.greatest(cut, F.lit(0))), F.substring(code.cast("binary"), F.lit(2), F.octet_length(code)))
    return stem.cast("string")


def is_link_like(c: Column) -> Column:
    """URLs, e-mail addresses and handles, which are not spell-checked."""
    low = F.lower(c)
    return c.contains("@") | c.startswith("#") | c.startswith("$") | low.contains("://") | low.startswith("www.") | low.startswith("ftp.") | low.startswith("mailto:")


def is_spell_candidate(c: Column) -> Column:
    return c.rlike(r"\p{L}") & ~is_link_like(c)
