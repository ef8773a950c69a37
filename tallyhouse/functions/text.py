"""Column expressions over free text. All of them run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters of the Unicode standard.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPLIT_PATTERN = r"[\s\x0B\x{85}\p{Z}]+"


# Longer word lists become a constant array that a lambda runs over: spelled out
# they make generated methods too large for the JVM to compile.
MAX_CHAIN = 12


def constants(words: list[str]) -> Column:
    """An array of constant strings (without tabs), folded by the optimizer."""
    return F.split(F.lit("\t".join(words)), "\t") if words else F.array().cast("array<string>")


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words occurs as a substring.

    Substring searches stop at the first hit and are faster on long texts than
    a regular expression of alternatives.
    """
    if len(words) > MAX_CHAIN:
        return F.exists(F.array(text), lambda t: F.exists(constants(words), lambda w: t.contains(w)))
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def hits(text: Column, words: list[str]) -> Column:
    """The words that occur as substrings, in list order.

    The outer lambda binds the text, so that it is computed once per row and
    not once per word.
    """
    found = F.transform(F.array(text), lambda t: F.filter(constants(words), lambda w: t.contains(w)))
    return F.get(found, F.lit(0))


def count_hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur as substrings."""
    return F.size(hits(text, words))


def first_rule(text: Column, rules: list[list[str]]) -> Column:
    """Index of the first rule one of whose words occurs; the number of rules if none."""
    chain = None
    for i, words in enumerate(rules):
        test = contains_any(text, words)
        chain = F.when(test, i) if chain is None else chain.when(test, i)
    return chain.otherwise(len(rules))


def pick(index: Column, values: list) -> Column:
    """The value a rule index stands for."""
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def strip(text: Column) -> Column:
    """Without white space at either end; most texts have none and are passed on."""
    outer = [F.substring(text, 1, 1), F.substring(text, -1, 1)]
    padded = reduce(lambda a, b: a | b, [c.isin(list(WHITE_SPACE)) for c in outer])
    return F.when(padded, F.btrim(text, F.lit(WHITE_SPACE))).otherwise(text)


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, SPLIT_PATTERN), lambda w: w != "")


def keywords(text: Column, stop_words: list[str], punctuation: str, min_bytes: int) -> Column:
    """Lower-case words without outer punctuation, stop words and short words."""
    bare = F.transform(words(F.lower(text)), lambda w: F.btrim(w, F.lit(punctuation)))
    return F.filter(bare, lambda w: (F.octet_length(w) >= min_bytes) & ~w.isin(stop_words))


def folded(text: Column) -> Column:
    """A text in which letters that match regardless of case are the same."""
    return F.lower(F.upper(text))


def find_all(text: Column, pattern: str) -> Column:
    """All matches of a pattern regardless of case, whatever its groups."""
    return F.regexp_extract_all(text, F.lit("(?iu)" + pattern), F.lit(0))


def sanitise(text: Column) -> Column:
    """Without control characters, then without outer white space."""
    return strip(F.regexp_replace(text, r"[\x00-\x1f\x7f-\x{9f}]", ""))


def fingerprint(prefix: str, *parts: Column) -> Column:
    """A cache key: the prefix and 16 hex digits of the hash of all parts."""
    digest = F.sha2(F.concat(F.lit(prefix), *parts), 256)
    return F.concat(F.lit(prefix + ":"), F.substring(digest, 1, 16))


def outer_braces(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; NULL when there is no such part."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    found = (start > 0) & (F.instr(text, "}") > 0) & (start < end)
    return F.when(found, F.substring(text, start, end - start + 1))


def title_case(name: Column) -> Column:
    """First letter of every word in upper case, the others unchanged."""
    parts = F.transform(
        F.split(name, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    )
    return F.array_join(parts, " ")


def singular(name: Column) -> Column:
    """Without one trailing s."""
    return F.regexp_replace(name, r"s\z", "")
