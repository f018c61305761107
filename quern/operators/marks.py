"""Marks of sets that add up: equal sets have equal marks, whatever their order and wherever their rows lie.

A mark is a few sums modulo a prime of hashes of the members.  Partial sums
merge before they are shuffled, so a set of any size costs a row of fixed
size; members stay in rows of their own.  Two different multisets agree by
chance once in some 10**37 comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
LANES = 4
#: Members that a list shows; a set within it is shown whole.
MANY = 1000


def lanes(*of: str) -> list[Column]:
    """A hash of the columns for each sum: below ``PRIME``, so that it can be multiplied and added up 2**31 times."""
    return [F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(PRIME)) for seed in range(LANES)]


def sums(*of: str, times: Column | None = None) -> Column:
    """An aggregate: the mark of a group's members, or of their hashes ``times`` a number below ``PRIME``."""
    each = lanes(*of) if times is None else [F.pmod(h * times.cast("long"), F.lit(PRIME)) for h in lanes(*of)]
    return F.array(*[F.pmod(F.sum(h), F.lit(PRIME)) for h in each])


def moved(mark: Column, by: Column, weights: Column) -> Column:
    """``mark`` less ``by`` times ``weights``, lane by lane: positions told from a start of one's own."""
    return F.zip_with(mark, weights, lambda m, w: F.pmod(m - F.pmod(by.cast("long") * w, F.lit(PRIME)), F.lit(PRIME)))


def listed(members: DataFrame, by: list[str], order: list[str], name: str = "members") -> DataFrame:
    """``by`` and the first ``MANY`` members in order; ranks are limited before they are shuffled."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = members.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= MANY)
    return first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_k", *order))).alias("_m")).select(*by, F.transform("_m", lambda x: F.struct(*[x[c].alias(c) for c in order])).alias(name))
