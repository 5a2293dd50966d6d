"""Scalar functions of result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, step: float | int) -> Column:
    """Nearest multiple of ``step``, halves away from zero."""
    return F.floor(F.abs(value) / step + 0.5) * step * F.signum(value)


def classify(name: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the last rule (pattern, label) that matches."""
    out = F.lit(default)
    for pattern, label in rules:
        out = F.when(name.rlike(pattern), label).otherwise(out)
    return out


def base_name(path: Column) -> Column:
    """The last component of a path, without tabs."""
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), "\t", "")


def after_midnight(start: Column, end: Column) -> Column:
    """Seconds from start to end, both seconds of a day; an earlier end is on the next day."""
    return F.when(end < start, end + 86_400 - start).otherwise(end - start)


def bit_set(flags: Column, i: Column) -> Column:
    return flags.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int")))


def bit_get(flags: Column, i: Column) -> Column:
    return F.call_function("shiftright", flags, i.cast("int")).bitwiseAND(F.lit(1)) == 1


def bits_merged(a: Column, b: Column) -> Column:
    """The union of two bit vectors, arrays of words of one length; a null vector is empty."""
    return F.coalesce(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)), a, b)


def bits_equal(a: Column, b: Column) -> Column:
    """Whether two bit vectors hold the same bits, whatever zero words follow."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).bitwiseXOR(F.coalesce(y, F.lit(0)))), lambda x: x == 0)


def bits_count(a: Column) -> Column:
    """How many bits of a vector are set."""
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda n, x: n + F.bit_count(x).cast("bigint"))
