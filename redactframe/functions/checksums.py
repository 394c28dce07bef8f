"""Checksum predicates as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactframe import rules
from redactframe.functions.text import digits, let


def luhn_valid(text: Column) -> Column:
    """13 to 19 digits after dropping everything else, and the mod-10 sum is right."""
    return let(
        digits(text),
        lambda d: F.length(d).between(13, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False)),
    )


def _table(rows: list[list[int]]) -> Column:
    return F.array(*[F.array(*[F.lit(v) for v in row]) for row in rows])


def verhoeff_valid(text: Column) -> Column:
    """Exactly 12 digits whose dihedral-group checksum folds to zero."""
    mul, perm = _table(rules.VERHOEFF_D), _table(rules.VERHOEFF_P)

    def check(d: Column) -> Column:
        def step(state, i):
            digit = F.substring(d, F.lit(12) - i, F.lit(1)).cast("int")
            return F.get(F.get(mul, state), F.get(F.get(perm, i % 8), digit))

        folded = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), step)
        return F.when(F.length(d) == 12, folded == 0).otherwise(F.lit(False))

    return let(digits(text), check)
