"""Masking of e-mail addresses, phone numbers and IPv4 addresses, with counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A border of a word of ASCII characters; Java's own ``\b`` takes letters of other scripts and accents for parts of the word.
_BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


@dataclass(frozen=True)
class Mask:
    """What is masked; ``core`` is the pattern between its borders, ``edge`` what may not adjoin it."""

    name: str
    core: str
    mark: str
    digits_around: bool

    @property
    def pattern(self) -> str:
        return rf"(?U)(?<!\d){self.core}(?!\d)" if self.digits_around else _BORDER + self.core + _BORDER

    @property
    def ascii_core(self) -> str:
        """For SQL: the same but for digits of other scripts."""
        return self.core.replace(r"\d", "[0-9]")


#: Patterns and marks, in the order in which they are applied.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MASKS = (
    Mask("emails", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "|||EMAIL_ADDRESS|||", False),
    Mask("phones", r"(?:\(\d{3}\)|\d{3})[ -]?\d{3}[ -]?\d{4}", "|||PHONE_NUMBER|||", True),
    Mask("ips", rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}", "|||IP_ADDRESS|||", True),
)


def mask(text: Column, what: Mask) -> tuple[Column, Column]:
    """The masked text and how many were masked; marks that were there before don't count."""
    return F.regexp_replace(text, what.pattern, what.mark.replace("$", r"\$")), F.regexp_count(text, F.lit(what.pattern))


def mask_all(df: DataFrame, text: str = "text", out: str = "masked") -> DataFrame:
    """Mask e-mails, then phones, then addresses, each in the result of the one before; add the counts."""
    df = df.withColumn(out, F.coalesce(F.col(text), F.lit("")))
    for what in MASKS:
        masked, n = mask(F.col(out), what)
        df = df.withColumn(what.name, n.cast("long")).withColumn(out, masked)
    return df


def mask_all_sql(source: str, text: str = "text", keep: str = "doc_id") -> str:
    """DuckDB SQL: its patterns can't look around, so neighbours are matched and put back."""
    last, ctes = source, []
    column = f"coalesce({text}, '')"
    done = ""
    for what in MASKS:
        core = what.ascii_core
        if what.digits_around:
            find, put, count = f"(^|[^0-9])({core})([^0-9]|$)", f"\\1{what.mark}\\3", f"(?:^|[^0-9])(?:{core})(?:[^0-9]|$)"
        else:
            find, put, count = f"\\b{core}\\b", what.mark, f"\\b{core}\\b"
        name = f"masked_{what.name}"
        ctes.append(f"{name} AS (SELECT {keep}, regexp_replace({column}, '{find}', '{put}', 'g') AS masked, len(regexp_extract_all({column}, '{count}'))::BIGINT AS {what.name}{done} FROM {last})")
        last, column, done = name, "masked", done + f", {what.name}"
    return ",\n".join(ctes)
