"""Text expressions: white space, words, digests, n-grams and two ways of tokenising."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalize(text: Column) -> Column:
    """One line: Unicode white space collapsed to single spaces, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """White-space separated words of a text; none for a blank one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines of a text, without their terminators."""
    return F.split(F.coalesce(text, F.lit("")), r"\R")


def digest(text: Column) -> Column:
    """SHA-1 of the UTF-8 bytes, in hex."""
    return F.sha1(text.cast("binary"))


def strip_marks(text: str) -> str:
    """Compatibility decomposition without combining marks; only the different characters of a text are looked up, as few are marks."""
    out = unicodedata.normalize("NFKD", text)
    marks = [ord(c) for c in set(out) if unicodedata.combining(c)]
    if len(marks) > MARKS_APART:
        return out.translate(dict.fromkeys(marks))
    for mark in marks:
        out = out.replace(chr(mark), "")
    return out


#: With more different marks than these, a text is gone through once for all of them.
MARKS_APART = 16


@F.pandas_udf(returnType=StringType())
def _strip_marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(strip_marks)


def _plain(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def folded(text: Column) -> Column:
    """Compatibility decomposition without combining marks, lower case.

    Only texts with characters outside ASCII need Python; the others never leave the JVM's
    result, though Spark evaluates the function on its (then empty) argument for every row.
    """
    text = F.coalesce(text, F.lit(""))
    plain = _plain(text)
    return F.lower(F.when(plain, text).otherwise(_strip_marks(F.when(plain, F.lit("")).otherwise(text))))


def canonical(text: Column) -> Column:
    """:func:`folded`, white space collapsed."""
    return normalize(folded(text))


def tokens(text: Column) -> Column:
    """Runs of word characters of a canonical text, or of a folded one; in ASCII both patterns are the same, and the first is faster."""
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(_plain(text), found(r"\w+")).otherwise(found(r"(?U)\w+"))


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams joined by spaces; fewer than n words are one n-gram, no words none."""
    size = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    short = F.when(size > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(size >= n, F.array_distinct(grams)).otherwise(short)


def ngram_hashes(hashes: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the n-grams of :func:`ngrams`, from the words' own :func:`word_hashes`; no string of several words is built."""
    return F.array_distinct(placed_hashes(hashes, n))


def placed_hashes(hashes: Column, n: int) -> Column:
    """The same for every place, repeated ones included."""
    size = F.size(hashes)
    grams = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(n))))
    short = F.when(size > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.when(size >= n, grams).otherwise(short)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


#: The published conventions of Penn Treebank tokenisation, in order: pattern, replacement.
TREEBANK = (
    (r'^"', r"`` "),
    (r'([ (\[{<])"', r"\1 `` "),
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([:,])$", r" \1 "),
    (r"(\.\.+)", r" \1 "),
    (r"([;@#$%&?!])", r" \1 "),
    (r"([^.])(\.)([\])}>\"']*)\s*$", r"\1 \2 \3 "),
    (r"([\]\[(){}<>])", r" \1 "),
    (r"(--)", r" \1 "),
    (r'"', r" '' "),
    (r"([^' ])('[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE) ", r"\1 \2 "),
    (r"([^' ])(n't|N'T) ", r"\1 \2 "),
    (r"([^' ])' ", r"\1 ' "),
)


def treebank(text: Column) -> Column:
    """Treebank-style words: punctuation apart, contractions split, only a final period detached."""
    out = F.trim(F.coalesce(text, F.lit("")))
    for k, (pattern, replacement) in enumerate(TREEBANK):
        if k == 10:
            out = F.concat(F.lit(" "), out, F.lit(" "))
        out = F.regexp_replace(out, pattern, replacement.replace("\\", "$"))
    return words(out)


def treebank_sql(text: str) -> str:
    """The same chain in DuckDB."""
    out = f"trim(coalesce({text}, ''), ' ')"
    for k, (pattern, replacement) in enumerate(TREEBANK):
        if k == 10:
            out = f"' ' || {out} || ' '"
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{replacement.replace("'", "''")}', 'g')"
    return f"list_filter(regexp_split_to_array({out}, '\\s+'), lambda w: w <> '')"
