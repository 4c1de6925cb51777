"""Band joins: values within ranges, as an equi-join of buckets; and what they give a key, counted without the pairs."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of each join; a range is copied to the buckets that it reaches into.
BUCKETS = 200
#: Cells of equal width that `fold` cuts each bucket into. A power of two.
CELLS = 64
SEEN = "_band"


def _doubles(numbers: list[float]) -> Column:
    """An array of them, as one text: a literal each would be a call each."""
    return F.expr(f"array({', '.join(f'{x!r}D' for x in numbers)})")


def _bucket(value: Column, cuts: list[float]) -> Column:
    """The number of cuts that `value` reaches, by halving: as many steps as the number of cuts has binary digits."""
    if not cuts:
        return F.lit(0)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    at = _doubles(cuts)
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(value >= F.get(at, n + step - 1), n + step).otherwise(n))


def _cell(value: Column, cuts: list[float]) -> Column:
    """Like the bucket, finer: buckets between two cuts have `CELLS` cells. A larger value never has a smaller cell."""
    if not cuts:
        return F.lit(0).cast("long")
    at, n = _doubles(cuts), _bucket(value, cuts)
    low, high = F.get(at, n - 1), F.get(at, n)
    part = F.least(F.floor((value - low) / (high - low) * CELLS), F.lit(CELLS - 1))  # rounding keeps order
    return n.cast("long") * CELLS + F.coalesce(part, F.lit(0))


def _cuts(values: DataFrame, value: Column, ranges: DataFrame, low: Column, high: Column, buckets: int) -> list[float]:
    """Quantiles of the values and of the ranges' ends."""
    share = _doubles([i / buckets for i in range(1, buckets)])
    quantiles = lambda df, *c: df.select(F.explode(F.array(*map(_number, c))).alias("v")).agg(F.percentile_approx("v", share, F.lit(10 * buckets))).first()[0] or []
    return sorted({x for x in [*quantiles(values, value), *quantiles(ranges, low, high)] if math.isfinite(x)})


def _number(c: Column) -> Column:
    return c.cast("double")


def band_join(values: DataFrame, value: Column, ranges: DataFrame, low: Column, high: Column, buckets: int = BUCKETS) -> DataFrame:
    """Rows of `values` beside those of `ranges` with low <= value <= high; a null on either side meets nothing.

    Quantiles of the values and of the ranges' ends cut the line into buckets (at most twice `buckets` and one cut are
    collected). A value lies in one bucket, a range in all that it reaches into, and rows of a bucket are compared. Ends
    that many rows share give no further cuts, so what is alike lands in one bucket, which adaptive execution can
    split on the side of the values. Values compare as doubles for the buckets only; the bounds are held as they are.
    """
    number, cuts = _number, _cuts(values, value, ranges, low, high, buckets)
    # A double's rounding keeps order, so a value within a range lies in one of the range's buckets.
    left = values.where(value.isNotNull()).withColumn(SEEN, _bucket(number(value), cuts))
    reach = F.sequence(_bucket(number(low), cuts), _bucket(number(high), cuts))
    right = ranges.where(low <= high).withColumn(f"{SEEN}_of", F.explode(reach))
    met = left.join(right, (F.col(SEEN) == F.col(f"{SEEN}_of")) & (value >= low) & (value <= high))
    return met.drop(SEEN, f"{SEEN}_of")


def _nodes(first: Column, end: Column, levels: int) -> Column:
    """The fewest nodes (level, node) that hold the cells from `first` on before `end`: a node has 2 ** level cells."""
    found = []
    for i in range(levels):
        width = F.lit(1 << i)
        a, b = F.floor((first + width - 1) / width).cast("long"), F.floor(end / width).cast("long")
        node = lambda n, i=i: F.struct(F.lit(i).alias("level"), n.alias("node"))
        found += [F.when((a < b) & (a % 2 == 1), node(a)), F.when((a < b) & (b % 2 == 1), node(b - 1))]
    return F.array_compact(F.array(*found))


def fold(
    parents: DataFrame, key: str, children: DataFrame, value: Column, low: Column, high: Column, *, of_children: bool, shared: list[str], place: str,
    met: Callable[[DataFrame], DataFrame] = lambda df: df, name: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = BUCKETS,
) -> DataFrame:
    """(key, n, place): how many `children` the band joins to each key of `parents`, and the smallest `place` (bigint) of them.

    `value` is the children's where `of_children` holds, or else the ranges are. `met` drops pairs by a further condition; it
    may use the parents' columns and the children's `shared` ones, under the names that `name` gives back to them.

    Pairs aren't made: children alike in `shared` are counted by cell, and by nodes of 2, 4, 8 ... cells. A range holds
    whole nodes, twice as many at most as there are levels, and is compared with values one by one in its first
    and last cell only.
    """
    bounds = {"_value": value} if of_children else {"_low": low, "_high": high}
    cuts = _cuts(children, value, parents, low, high, buckets) if of_children else _cuts(parents, value, children, low, high, buckets)
    levels = max(1, ((len(cuts) + 1) * CELLS - 1).bit_length())
    alike = children.select(*(c.alias(n) for n, c in bounds.items()), *shared, place)
    alike = alike.groupBy(*bounds, *shared).agg(F.count("*").alias("_n"), F.min(place).alias("_place"))
    own = parents.withColumns({"_value": value} if not of_children else {"_low": low, "_high": high})
    values, ranges = (alike, own) if of_children else (own, alike)
    values = values.where(F.col("_value").isNotNull()).withColumn(SEEN, _cell(_number(F.col("_value")), cuts))
    ranges = ranges.where("_low <= _high").withColumns({f"{SEEN}_a": _cell(_number(F.col("_low")), cuts), f"{SEEN}_b": _cell(_number(F.col("_high")), cuts)})
    up = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.shiftright(SEEN, i).alias("node")) for i in range(levels)))).alias("_at")
    down = F.explode(_nodes(F.col(f"{SEEN}_a") + 1, F.col(f"{SEEN}_b"), levels)).alias("_at")
    ends = F.explode(F.array_distinct(F.array(f"{SEEN}_a", f"{SEEN}_b"))).alias("_at")

    def split(df: DataFrame, at: Column, of: DataFrame) -> DataFrame:
        return df.select(*of.columns, at)

    def counted(of_parents: DataFrame, of_alike: DataFrame, within: Column | None) -> DataFrame:
        right = name(of_alike.withColumnRenamed("_at", "_of"))
        both = of_parents.join(right, (F.col("_at") == F.col("_of")) & within if within is not None else F.col("_at") == F.col("_of"))
        return met(both).select(F.col(key), "_n", "_place")

    within = (F.col("_value") >= F.col("_low")) & (F.col("_value") <= F.col("_high"))
    of_values, of_ranges = split(values, up, values), split(ranges, down, ranges)
    by_node = (of_values if of_children else of_ranges).groupBy("_at", *shared).agg(F.sum("_n").alias("_n"), F.min("_place").alias("_place"))
    whole = counted(of_ranges if of_children else of_values, by_node, None)
    at_ends = [split(ranges, ends, ranges), split(values, F.col(SEEN).alias("_at"), values)]
    single = counted(*(at_ends if of_children else reversed(at_ends)), within)
    return reduce(lambda a, b: a.unionByName(b), (whole, single)).groupBy(key).agg(F.sum("_n").alias("n"), F.min("_place").alias(place))
