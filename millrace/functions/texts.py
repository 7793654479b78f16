"""Full-text and trigram search as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the English dictionary drops.
STOP = "a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so than that the their them then there these they this to was we were what when which who will with you your".split()
DICTIONARIES = ("simple", "english")


def _stem(w: Column) -> Column:
    """Plural and verb endings off; a light stemmer, not the full English one."""
    s = F.regexp_replace(w, "(?<=..)(?:sses)$", "ss")
    s = F.regexp_replace(s, "(?<=...)ies$", "i")
    s = F.regexp_replace(s, "(?<=[^s].)s$|(?<=[^su])s$", "")
    return F.regexp_replace(s, "(?<=[aeiouy][^aeiou])(?:ing|ed|ly)$", "")


def vector(c: Column, dictionary: str = "english") -> Column:
    """Normalised tokens in text order."""
    if dictionary not in DICTIONARIES:
        raise ValueError(f"unknown dictionary {dictionary}")
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    if dictionary == "simple":
        return words
    return F.transform(F.filter(words, lambda w: ~w.isin(STOP)), _stem)


def matches(tokens: Column, query: str, dictionary: str = "english") -> Column:
    """A query of words with ``&``, ``|``, ``!`` and parentheses against a vector."""
    parts = re.findall(r"[&|!()]|[^\s&|!()]+", query)
    at = 0

    def word(w: str) -> Column:
        if dictionary == "english" and w.lower() in STOP:
            return F.lit(True)
        term = F.lower(F.lit(w))
        return F.array_contains(tokens, _stem(term) if dictionary == "english" else term)

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(parts) and parts[at] == "|":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out = single()
        while at < len(parts) and parts[at] not in "|)":
            if parts[at] == "&":
                at += 1
            out = out & single()
        return out

    def single() -> Column:
        nonlocal at
        p = parts[at]
        at += 1
        if p == "!":
            return ~single()
        if p == "(":
            out = either()
            at += 1
            return out
        return word(p)

    return either() if parts else F.lit(False)


def _same(w: Column):
    return lambda t: t == w


def rank(tokens: Column, words: list[str], dictionary: str = "english") -> Column:
    """Share of the query's words found, damped by text length; an approximation of ``ts_rank``."""
    terms = [(_stem(F.lower(F.lit(w))) if dictionary == "english" else F.lower(F.lit(w))) for w in words]
    hits = sum((F.size(F.filter(tokens, _same(w))) for w in terms), F.lit(0))
    return F.when(F.size(tokens) > 0, hits / (1 + F.log(F.size(tokens) + 1.0))).otherwise(F.lit(0.0))


def rank_cover(tokens: Column, words: list[str], dictionary: str = "english") -> Column:
    """``rank`` scaled by how close together the words' first places are; approximates ``ts_rank_cd``."""
    terms = [(_stem(F.lower(F.lit(w))) if dictionary == "english" else F.lower(F.lit(w))) for w in words]
    places = F.array(*[F.array_position(tokens, w) for w in terms])
    span = F.array_max(places) - F.array_min(places) + 1
    return F.when(F.array_min(places) > 0, F.lit(float(len(words))) / span).otherwise(F.lit(0.0))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word, with two blanks in front and one behind."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams, 0 to 1."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def similar(a: Column, b: Column, threshold: float = 0.3) -> Column:
    return similarity(a, b) >= threshold
