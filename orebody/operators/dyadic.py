"""Summaries over address ranges from cells of a hierarchy (A3, A4, X9), and the joins that its cells allow.

A cell of level k has 8^k addresses. Any range consists of few cells, at most 14 of a level, and a point lies in one cell of each level, so that
of the cells that a range consists of exactly one holds a point inside it, and none a point outside: a join on cells gives the points inside
and no others, however long the ranges are.

A range's objects are those that start in it and those that start before it and reach its first address. The first are summed up beforehand by
the cells that hold their starts, the second by the cells that their addresses after the first consist of; either way an object
counts once in what a range collects, so that counts and sums are exact, as well as least and greatest values. Ranges meet cells, never objects.

Addresses are signed 64-bit numbers from -2^62 to 2^62.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.operators.store import by_sorting, cut

STEP = 3
LEVELS = 21
_CELLS = "array<struct<level:int,cell:bigint>>"


def _shift(c: Column, level: Column) -> Column:
    return F.call_function("shiftright", c, level * STEP)


def cover(start: Column, end: Column) -> Column:
    """The cells that an inclusive range consists of, largest first inside it; none if it is empty."""
    start, end = start.cast("bigint"), end.cast("bigint")

    def bounds(level: Column) -> tuple[Column, Column]:
        """Of the cells that lie in the range: the first, and the last + 1."""
        low, high = _shift(start, level), _shift(end, level)
        first = low + (F.call_function("shiftleft", low, level * STEP) != start).cast("bigint")
        return first, high + (_shift(end + 1, level) != high).cast("bigint")

    def span(level: Column, first: Column, last: Column) -> Column:
        return F.when(first < last, F.transform(F.sequence(first, last - 1), lambda c: F.struct(level.cast("int").alias("level"), c.alias("cell")))).otherwise(F.array().cast(_CELLS))

    def own(level: Column) -> Column:
        first, last = bounds(level)
        up, down = bounds(level + 1)
        apart = (level < LEVELS - 1) & (up <= down)  # the cells between belong to larger ones
        left = span(level, first, F.when(apart, up * (1 << STEP)).otherwise(last))
        return F.concat(left, F.when(apart, span(level, down * (1 << STEP), last)).otherwise(F.array().cast(_CELLS)))

    # no cell larger than the range lies in it; one level more than the logarithm says, against its rounding
    length = end.cast("double") - start.cast("double") + 1
    highest = F.least(F.floor(F.log2(length) / STEP).cast("int") + 1, F.lit(LEVELS - 1))
    return F.when(length >= 1, F.flatten(F.transform(F.sequence(F.lit(0), highest), own))).otherwise(F.array().cast(_CELLS))


def cells_at(point: Column, highest: int = LEVELS - 1) -> Column:
    """The cells that hold a point, one of each level."""
    return F.transform(F.sequence(F.lit(0), F.lit(highest)), lambda k: F.struct(k.cast("int").alias("level"), _shift(point.cast("bigint"), k).alias("cell")))


def contained(points: DataFrame, ranges: DataFrame, point: str, start: Column, end: Column, few: bool = False) -> DataFrame:
    """All pairs of a point's row and the row of a range that holds it, each once; columns of both sides. few: the ranges may be broadcast."""
    a = points.withColumn("_c", F.explode(cells_at(F.col(point))))
    b = ranges.withColumn("_c", F.explode(cover(start, end)))
    return a.join(F.broadcast(b) if few else by_sorting(b), "_c").drop("_c")


class RangeSummaries:
    """Summaries of objects, ready to be asked for any ranges and points.

    update: aggregates over objects' rows, by name; unite: for each the aggregate that makes one result of several, over the column of its name
    (X9: any property that can be updated by a row and united with another).
    """

    def __init__(self, objects: DataFrame, start: str, end: str, update: list[Column], unite: list[Column]) -> None:
        self.unite = unite
        real = objects.filter(F.col(start) <= F.col(end))
        base = cut(real.groupBy(F.lit(0).alias("level"), F.col(start).cast("bigint").alias("cell")).agg(*update))
        levels, top = [base], 0
        for upto in (7, LEVELS - 1):  # many levels at once; those above the seventh come from two millionths of the cells at most
            rows = base.withColumn("_by", F.explode(F.sequence(F.lit(1), F.lit(upto - top))))
            higher = cut(rows.groupBy((F.col("level") + F.col("_by")).alias("level"), _shift(F.col("cell"), F.col("_by")).alias("cell")).agg(*unite))
            levels.append(higher)
            base, top = higher.filter(F.col("level") == upto), upto
        self.starts = reduce(DataFrame.unionByName, levels)
        reaching = real.withColumn("_c", F.explode(cover(F.col(start) + 1, F.col(end))))
        self.reaching = cut(reaching.groupBy(F.col("_c.level").alias("level"), F.col("_c.cell").alias("cell")).agg(*update))
        self.highest = self.reaching.agg(F.max("level")).first()[0] or 0  # the levels that objects' lengths need

    def of_ranges(self, ranges: DataFrame, key: str, low: str, high: str) -> DataFrame:
        """A3: the summary of the objects that share an address with each range, by `key`; ranges without objects have no row. Swapped bounds are
        put right."""
        first, last = F.least(low, high), F.greatest(low, high)
        inside = ranges.select(key, F.explode(cover(first, last)).alias("_c")).select(key, "_c.*").join(by_sorting(self.starts), ["level", "cell"])
        before = ranges.select(key, F.explode(cells_at(first, self.highest)).alias("_c")).select(key, "_c.*").join(by_sorting(self.reaching), ["level", "cell"])
        return inside.unionByName(before).groupBy(key).agg(*self.unite)

    def at_points(self, points: DataFrame, key: str, point: str) -> DataFrame:
        """A4: the summary of the objects that hold each point."""
        return self.of_ranges(points.withColumn("_at", F.col(point)), key, point, "_at")
