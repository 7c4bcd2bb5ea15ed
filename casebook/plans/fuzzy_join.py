"""Equality joins that stand for similarity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _places(code: Column, last: Column) -> Column:
    """1 to ``last``; nothing where that is less than 1 (a sequence would count down)."""
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def edit_keys(code: Column, left: bool) -> Column:
    """Keys such that a left and a right code share one exactly where they are equal or one edit apart: the code itself; the
    code without the character at a place, with the place (one letter for another); the code with two neighbours in
    alphabetical order, with their place (a swap); and a code against another without one character (a letter more or less).
    Unequal codes share at most one, so a join needs no further test. Codes of one key differ in one character, so a key's
    rows are as many as the alphabet's letters at most."""
    n = F.char_length(code)
    at = lambda i, k=1: F.substring(code, i, F.lit(k))
    before, after = (lambda i: F.substring(code, F.lit(1), i - 1)), (lambda i: F.substring(code, i, n))
    cut = lambda i: F.concat(before(i), after(i + 1))
    pair = lambda i: F.concat(F.least(at(i), at(i + 1)), F.greatest(at(i), at(i + 1)))
    shorter, longer = ("a", "b") if left else ("b", "a")
    return F.concat(
        F.array(F.concat(F.lit("="), code), F.concat(F.lit(shorter), code)),
        F.transform(_places(code, n), lambda i: F.concat(F.lit("s"), i, F.lit(":"), cut(i))),
        F.transform(_places(code, n - 1), lambda i: F.concat(F.lit("t"), i, F.lit(":"), before(i), pair(i), after(i + 2))),
        F.array_distinct(F.transform(_places(code, n), lambda i: F.concat(F.lit(longer), cut(i)))),
    )


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether the optimal string alignment distance is at most one: an edit, or a swap of neighbours. The swap is tried
    only where lengths are equal and plain distance is two."""
    swap = F.exists(
        _places(a, F.char_length(a) - 1),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.char_length(a))) == b,
    )
    return F.when(F.levenshtein(a, b, 1) >= 0, True).when((F.char_length(a) == F.char_length(b)) & (F.levenshtein(a, b, 2) == 2), swap).otherwise(False)


def fuzzy_join(left: DataFrame, right: DataFrame, left_code: str, right_code: str) -> DataFrame:
    """Pairs of (left_code, right_code) at distance at most one, by an equi-join of their edit keys. A code has some three
    keys a character, which Spark's estimate of a side's size leaves out: a broadcast chosen by it would send the driver
    all keys of a large table, so both sides are shuffled and sorted whatever their size."""
    a = left.select(left_code).distinct().select(left_code, F.explode(edit_keys(F.col(left_code), True)).alias("_v"))
    b = right.select(right_code).distinct().select(right_code, F.explode(edit_keys(F.col(right_code), False)).alias("_v"))
    equal = F.col(left_code) == F.col(right_code)
    pairs = a.join(b.hint("merge"), "_v").where(~equal | F.col("_v").startswith("="))
    return pairs.select(left_code, right_code, F.when(equal, 0).otherwise(1).alias("distance"))
