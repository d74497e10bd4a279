"""Text keys and token arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Column expressions are inlined wherever they are used, and inside a
    higher-order function they run once per element; binding a costly one to a
    lambda variable keeps it to one evaluation.
    """
    return F.get(F.transform(F.array(value), body), 0)


def squeeze(text: Column) -> Column:
    """Collapse runs of white space and trim."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}\ufeff]+", " "))


def tokens(text: Column, keep: str = "a-z0-9") -> Column:
    """Lower-case tokens of the kept character class, in order."""
    parts = F.split(F.lower(text), f"[^{keep}]+")
    return F.filter(parts, lambda t: t != "")


def _numeric(run: Column) -> Column:
    digits = F.ltrim(run, F.lit("0"))
    return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)


def natural_key(name: Column) -> Column:
    """Sort key under which digit runs compare as numbers, ignoring case.

    Each run of digits is preceded by its length without leading zeros, so
    ``img2`` sorts before ``img10``, however long the runs are.
    """
    runs = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.when(r.rlike("^[0-9]+$"), _numeric(r)).otherwise(r)), ""
    )


def contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def count_matches(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur in the text."""
    total = F.lit(0)
    for p in patterns:
        total = total + text.rlike(p).cast("int")
    return total


def compact_reasons(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold; a NULL condition counts as not holding."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in pairs]))
