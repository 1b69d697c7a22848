"""Tokens, token sets and similarities as Column expressions. Words are runs of letters, digits and underscores of any script."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A whole word of two characters or more that isn't a number.
WORD = r"(?<![\p{L}\p{N}_])(?![0-9]++(?![\p{L}\p{N}_]))[\p{L}\p{N}_]{2,}+"


def spaced_identifiers(text: Column) -> Column:
    """camelCase, ACRONYMWord and snake_case as separate words."""
    out = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    out = F.regexp_replace(out, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.replace(out, F.lit("_"), F.lit(" "))


def tokens(text: Column) -> Column:
    """Lower-cased words of two characters or more, numbers left out, with repetitions."""
    return F.regexp_extract_all(F.lower(spaced_identifiers(text)), F.lit(WORD), F.lit(0))


#: Where spaced_identifiers puts a blank, and runs of two letters and digits or more.
_HUMPS, _ACRONYMS, _RUNS = re.compile("(?<=[a-z])(?=[A-Z])"), re.compile("(?<=[A-Z])(?=[A-Z][a-z])"), re.compile(r"[^\W_]{2,}")


def python_tokens(value: str) -> list[str]:
    """tokens() of a string, in Python workers."""
    runs = _RUNS.findall(_ACRONYMS.sub(" ", _HUMPS.sub(" ", value)).lower())
    return [t for t in runs if not (t.isascii() and t.isdigit())]


def white_tokens(text: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of each word, padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def word_set(text: Column, least: int = 3) -> Column:
    """Distinct ASCII words of at least so many letters and digits, punctuation taken as blank."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " +"), lambda w: F.length(w) >= least))


def sanitized_query(query: str, most: int = 500) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[!^~@()\[\]{}\"]", " ", query)).strip()[:most]


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def term_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms are parts of the text."""
    low = F.lower(text)
    return sum((F.when(low.contains(t.lower()), 1).otherwise(0) for t in terms), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


# Words and phrases that say nothing.
ARTICLES = ["a", "an", "the"]
FILLERS = ["just", "simply", "basically", "essentially", "very", "quite", "rather", "somewhat", "actually", "really", "certainly", "definitely", "probably", "literally", "practically"]
HEDGES = ["it is important to note that", "it should be noted that", "it is possible that", "may want to consider", "could potentially", "might want to", "you might consider", "please note that", "keep in mind that", "you may want to(?! consider(?!\\w))"]
#: Code between back ticks, addresses, and paths.
PROTECTED = r"`[^`\n]+`|(?:https?|ftp)://(?:`[^`\n]+`|\S)+|(?<!\S)(?:\.{1,2}/|/|~/)\S+"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def stripped_line(line: Column) -> Column:
    """Without articles, fillers and hedges; code, addresses and paths stay. Of a run of blanks its last one is left."""
    idle = "|".join([*HEDGES, *ARTICLES, *FILLERS])
    out = F.regexp_replace(line, rf"({PROTECTED})|(?<![\p{{L}}\p{{N}}_])(?i:{idle})(?![\p{{L}}\p{{N}}_])", "$1")
    return trimmed(F.regexp_replace(out, rf"({PROTECTED})|[ \t]+(?=[ \t])", "$1"))
