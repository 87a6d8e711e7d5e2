"""Ordered scans over keys of any size: running values, runs and neighbours.

Rows are sorted into contiguous ranges of their whole order, so that a key with most rows lies in many of them; each range is scanned by
itself, and what it ends with is carried to the ranges after it. Only a key that began in an earlier range needs that, of which a range
has one at most: what is carried has at most a row for each range, and is broadcast.

Rows that are equal in every ordering column share a range; callers group equal rows first, or order by a hash of the row last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.operators.store import cut

PART = "_part"


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """`df`, written once in contiguous ranges of `order`, whose numbers are `_part`."""
    return cut(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_k_{k}"]) for k in keys], a[PART] == b[f"_k_{PART}"])


def _with_carry(line: DataFrame, tops: DataFrame, keys: list[str], carry: Column, out: str) -> DataFrame:
    """`line` with what `carry` (over the ranges of a key in `tops`) says of its range; null in the range where its key begins."""
    above = tops.withColumn("_far", carry).filter("_far is not null").select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, PART)], F.col("_far").alias(out))
    return line.join(F.broadcast(above), _same(line, above, keys), "left").drop(*[f"_k_{k}" for k in (*keys, PART)])


def _before(keys: list[str]) -> object:
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def running(line: DataFrame, keys: list[str], order: list[str], value: str, out: str, how: str = "max", own: bool = False) -> DataFrame:
    """A ranged table with the greatest (`how` max) or last value that isn't null among the rows of the key before each row, or up to it (`own`)."""
    near = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    if how == "max":
        tops = line.groupBy(PART, *keys).agg(F.max(value).alias("_top"))
        found, carry = F.max(value).over(near), F.max("_top").over(_before(keys))
        both = lambda a, b: F.greatest(a, b)
    else:
        place = F.struct(*order)
        tops = line.groupBy(PART, *keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("_top"))
        found, carry = F.last(value, ignorenulls=True).over(near), F.last("_top", ignorenulls=True).over(_before(keys))
        both = lambda a, b: F.coalesce(a, b)
    scanned = line.withColumn("_near", found)
    return _with_carry(scanned, tops, keys, carry, "_carried").withColumn(out, both(F.col("_near"), F.col("_carried"))).drop("_near", "_carried")


def segments(line: DataFrame, keys: list[str], order: list[str], head: Column, first: str, parts: list[Column], unite: list[Column]) -> DataFrame:
    """Runs of rows of a ranged table: keys, `first` and what `unite` says of the partial results of `parts`.

    head: where a row begins a run, a value that grows along the key; else null. Ranges are summed up by themselves; the row that goes on with
    a run of an earlier range takes that run's head.
    """
    w = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut(line.withColumn("_head", head).withColumn(first, F.max("_head").over(w)).groupBy(PART, *keys, first).agg(*parts))
    tops = local.groupBy(PART, *keys).agg(F.max(first).alias("_top"))
    whole = _with_carry(local, tops, keys, F.max("_top").over(_before(keys)), "_carried").withColumn(first, F.coalesce(first, "_carried")).drop("_carried")
    return whole.groupBy(*keys, first).agg(*unite)


def neighbours(df: DataFrame, keys: list[str], order: str, before: str | None = None, after: str | None = None) -> DataFrame:
    """`df` with the values of `order` right before and after each row of its key (ties in any order)."""
    line = ranged(df.withColumn("_tie", F.xxhash64(*df.columns)), [*keys, order, "_tie"])
    w = Window.partitionBy(PART, *keys).orderBy(order, "_tie")
    tops = line.groupBy(PART, *keys).agg(F.max(order).alias("_top"), F.min(order).alias("_bottom"))
    out = line
    if before:
        out = out.withColumn("_near", F.lag(order).over(w))
        out = _with_carry(out, tops, keys, F.max("_top").over(_before(keys)), "_carried").withColumn(before, F.coalesce("_near", "_carried")).drop("_near", "_carried")
    if after:
        later = Window.partitionBy(*keys).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_near", F.lead(order).over(w))
        out = _with_carry(out, tops, keys, F.min("_bottom").over(later), "_carried").withColumn(after, F.coalesce("_near", "_carried")).drop("_near", "_carried")
    return out.drop(PART, "_tie")
