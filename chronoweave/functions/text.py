"""Name similarity and text functions as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """White-space separated words; none for blank text."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, letter case aside; 1 for two empty texts."""
    return lower_similarity(F.lower(a), F.lower(b))


def lower_similarity(a: Column, b: Column) -> Column:
    """``edit_similarity`` of two texts in lower case."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def soundex(word: Column) -> Column:
    """Phonetic code of four characters in which vowels do not part equal codes (unlike the built-in one)."""
    upper = F.upper(F.trim(word))
    digits = F.translate(F.regexp_replace(upper, "[^A-Z]", ""), "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    codes = F.regexp_replace(F.regexp_replace(digits, "[^1-6]", ""), r"(.)\1+", "$1")
    first = F.substring(upper, 1, 1)
    rest = F.when(first.rlike("[BFPVCGJKQSXZDTLMNR]"), F.substring(codes, 2, 10_000)).otherwise(codes)
    return F.when(upper == "", F.lit("")).otherwise(F.rpad(F.concat(first, rest), 4, "0"))


def phonetic_codes(name: Column) -> Column:
    """The codes of the words of more than one letter."""
    return F.transform(F.filter(words(name), lambda w: F.length(w) > 1), soundex)


def shared_codes(a: Column, b: Column) -> Column:
    """Share of the pairs of codes that are equal; 0 without pairs."""
    same = F.aggregate(a, F.lit(0), lambda n, x: n + F.size(F.filter(b, lambda y: x == y)))
    pairs = F.size(a) * F.size(b)
    return F.when(pairs > 0, same / pairs).otherwise(F.lit(0.0))


def phonetic_match(a: Column, b: Column) -> Column:
    """Share of the word pairs (words of more than one letter) with equal codes; 0 without pairs."""
    return shared_codes(phonetic_codes(a), phonetic_codes(b))


def types_compatible(a: Column, b: Column) -> Column:
    """Persons, organisations and locations exclude one another."""
    return (a == b) | ~(a.isin("person", "organization", "location") & b.isin("person", "organization", "location"))


@lru_cache(maxsize=1)
def _accented() -> tuple[str, str]:
    """Lower-case letters whose canonical form is a letter with marks, and those letters."""
    pairs = []
    for code in range(0x80, min(sys.maxunicode, 0x2000)):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != char and char == char.lower() and unicodedata.category(char) == "Ll":
            pairs.append((char, plain))
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents."""
    accented, plain = _accented()
    return F.regexp_replace(F.translate(F.lower(text), accented, plain), r"\p{M}+", "")


def tokens(text: Column) -> Column:
    """Letters-and-digits tokens of the folded text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters and 5 for formatting, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int") + 5)


# Phrases that make a question wide, a counting one, or take it back.
WIDE = ("how many", "how much", "list all", "list every", "all the", "everything", "total number", "did i participate", "did i attend", "did i visit")
SIMPLE = ("what did", "when did", "what was", "did i", "have i")
COUNTING = ("how many", "total number", "list all", "list every")
NOT_COUNTING = (
    "how many days", "how many hours", "how many minutes", "how many weeks", "how many months", "how many years", "how long", "how much",
    "how many pages", "how many times", "how many stars", "how many titles", "how many engineers", "how many films", "how many episodes", "how many chapters",
    "do i need", "do i have to", "did i spend", "have i read", "have i watched", "have i written", "currently", "so far", "in total",
)


def has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(text), p))


def is_wide_question(text: Column) -> Column:
    return has_any(text, WIDE)


def is_simple_recall(text: Column) -> Column:
    return has_any(text, SIMPLE)


def is_counting_question(text: Column) -> Column:
    return has_any(text, COUNTING) & ~has_any(text, NOT_COUNTING)


def contained_share(reference: Column, text: Column) -> Column:
    """Share of the reference's words of more than 3 letters that the text contains; null without such words."""
    long = F.filter(words(F.lower(reference)), lambda w: F.length(w) > 3)
    return F.when(F.size(long) > 0, F.size(F.filter(long, lambda w: F.contains(F.lower(text), w))) / F.size(long))
