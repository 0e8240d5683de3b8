"""Readable quality rules for one document, each a projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import normalize

#: Words and phrases of the rules.
BLOCKED_KEYWORDS = ("casino", "casinos", "betting", "sportsbook", "poker", "slots", "blackjack", "roulette", "jackpot", "gambling")
PARKED_PHRASES = (
    "domain has expired",
    "this domain has expired",
    "under suspension",
    "renew this domain name",
    "permanently removed from your account",
    "buy this domain",
    "parked free courtesy of",
)
NAVIGATION_PHRASES = (
    "privacy policy",
    "terms of service",
    "all rights reserved",
    "skip to content",
    "shopping cart",
    "sign in",
    "create account",
    "contact us",
    "log in",
    "register",
)
#: Only so many leading characters of a text are searched for blocked keywords: the rule's own definition.
KEYWORD_CHARS = 2000


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def gopher(words: Column, lines: Column) -> Column:
    """Struct of four rules on words and lines, and ``keep``; ratios are compared as whole numbers."""

    def rules(w: Column, rows: Column) -> Column:
        n = F.size(w)
        chars = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
        dotted = F.size(F.filter(rows, lambda x: x.endswith("...")))
        letters = F.size(F.filter(w, lambda x: x.rlike(r"\p{L}")))
        count = (n >= 50) & (n <= 100000)
        mean = (n > 0) & (chars >= 3 * n) & (chars <= 10 * n)
        ellipsis_ = (F.size(rows) > 0) & (10 * dotted <= 3 * F.size(rows))
        alpha = (n > 0) & (5 * letters >= 4 * n)
        return F.struct(count.alias("word_count_ok"), mean.alias("mean_length_ok"), ellipsis_.alias("ellipsis_ok"), alpha.alias("alpha_ok"), (count & mean & ellipsis_ & alpha).alias("keep"))

    filled = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return bind(words, lambda w: bind(filled, lambda rows: rules(w, rows)))


def boilerplate(lines: Column, normalized: Column) -> Column:
    """Struct of lines, distinct lines, words, distinct words, navigation phrases, and ``keep``."""
    filled = F.filter(F.transform(lines, lambda x: F.lower(normalize(x))), lambda x: x != "")

    def rules(rows: Column, lower: Column, w: Column) -> Column:
        hits = sum((F.regexp_count(lower, F.lit(p)) for p in NAVIGATION_PHRASES), F.lit(0))
        n, words = F.size(rows), F.size(w)
        distinct, kinds = F.size(F.array_distinct(rows)), F.size(F.array_distinct(w))
        repeated = (n >= 5) & (5 * distinct < 4 * n)
        menu = (words >= 80) & (100 * hits > 3 * words)
        poor = (words >= 200) & (4 * kinds < words)
        return F.struct(
            n.alias("lines"), distinct.alias("distinct_lines"), words.alias("words"), kinds.alias("distinct_words"), hits.alias("nav_hits"), (~repeated & (words > 0) & ~menu & ~poor).alias("keep")
        )

    split = lambda lower: F.filter(F.split(lower, " "), lambda x: x != "")
    return bind(filled, lambda rows: bind(F.lower(normalized), lambda lower: bind(split(lower), lambda w: rules(rows, lower, w))))


def keyword_hits(uri: Column, text: Column) -> Column:
    """How many of the blocked keywords occur, as substrings, in the address and the start of the text."""
    seen = F.lower(F.concat(F.coalesce(uri, F.lit("")), F.lit(" "), F.substring(text, 1, KEYWORD_CHARS)))
    return bind(seen, lambda s: sum((F.contains(s, F.lit(k)).cast("int") for k in BLOCKED_KEYWORDS), F.lit(0)))


def is_parked(text: Column) -> Column:

    def any_of(lower: Column) -> Column:
        out = F.lit(False)
        for phrase in PARKED_PHRASES:
            out = out | F.contains(lower, F.lit(phrase))
        return out

    return bind(F.lower(text), any_of)
