"""Text: normal forms, similarity and phonetic keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(text: Column) -> Column:
    """Trimmed and lower-cased."""
    return F.lower(F.trim(text))


def label(text: Column) -> Column:
    """Trimmed, lower-cased, spaces as underscores."""
    return F.replace(tidy(text), F.lit(" "), F.lit("_"))


def alphanumeric(text: Column) -> Column:
    """Upper-cased letters and digits alone."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def upper_words(text: Column) -> Column:
    """Upper-cased, white space collapsed."""
    return F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))


def trigrams(text: Column) -> Column:
    """The set of character trigrams of ##text##."""
    padded = F.concat(F.lit("##"), text, F.lit("##"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard of the words of two texts, '#' taken out."""
    cut = lambda t: F.array_distinct(F.array_remove(F.split(F.replace(t, F.lit("#"), F.lit("")), " "), ""))
    return jaccard(cut(a), cut(b))


def sorted_chars(text: Column) -> Column:
    return F.array_join(F.array_sort(F.array_remove(F.split(text, ""), "")), "")


def phonetic(text: Column, length: int = 4) -> Column:
    """The first letter and the consonants after it without repeats in a row, cut at `length`."""
    up = F.regexp_replace(F.upper(text), "[^A-Z]", "")
    rest = F.regexp_replace(F.substring(up, 2, 1 << 20), "[AEIOU]", "")
    return F.substring(F.regexp_replace(F.concat(F.substring(up, 1, 1), rest), r"(.)\1+", "$1"), 1, length)


def swapped_once(a: Column, b: Column) -> Column:
    """The texts differ by exactly one swap of neighbouring characters."""
    differs = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    i = F.element_at(differs, 1)
    crossed = (F.substring(a, i, F.lit(1)) == F.substring(b, i + 1, F.lit(1))) & (F.substring(a, i + 1, F.lit(1)) == F.substring(b, i, F.lit(1)))
    return F.when((F.length(a) == F.length(b)) & (F.size(differs) == 2), (F.element_at(differs, -1) == i + 1) & crossed).otherwise(False)


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def shown(name: Column) -> Column:
    """A column's name for display: underscores as spaces, a capital in front."""
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 20))
