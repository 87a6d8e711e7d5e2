"""Interval operators: stabbing, overlap, as-of containment, relations, merging and summaries.

Intervals are inclusive at both ends. Joins are equi-joins on buckets: an interval is laid on the coarsest grid that it needs and on
every coarser one, pairs meet on the coarser of their two grids and only in the bucket in which the later one starts, so that
no pair comes twice and no interval is copied more than a few times. Intervals too long for any grid are laid on the cells of `dyadic` that
they consist of, in which exactly those points lie that they contain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.operators import dyadic
from orebody.operators.scans import neighbours, ranged, running, segments
from orebody.operators.store import by_sorting

LEVELS = 4
RATIO = 64
SPAN = 8
FEW = 1000  # rows of a side that are broadcast, each as some hundred cells at most
FAN = 4096  # neighbours that one task carries a value over


def _own_level(start: Column, end: Column, width: int) -> Column:
    """The finest grid on which an interval covers few cells."""
    length = end - start + 1
    return reduce(lambda acc, k: F.when(length <= width * RATIO**k * SPAN, F.lit(k)).otherwise(acc), range(LEVELS - 1, -1, -1), F.lit(LEVELS))


def _laid(df: DataFrame, start: Column, end: Column, width: int, met: set[int]) -> DataFrame:
    """Rows by (level, bucket), with the interval's own level: laid on its own grid and on the coarser ones in `met`."""

    def cells_of(k: int) -> Column:
        w = width * RATIO**k
        cells = F.transform(F.sequence(F.floor(start / w), F.floor(end / w)), lambda b: F.struct(F.lit(k).alias("level"), b.alias("bucket")))
        here = (F.col("_own") == k) | (F.lit(k in met) & (F.col("_own") < k))
        return F.when(here, cells).otherwise(F.array().cast("array<struct<level:int,bucket:bigint>>"))

    laid = df.withColumn("_cell", F.explode(F.concat(*map(cells_of, range(LEVELS)))))
    return laid.withColumn("_level", F.col("_cell.level")).withColumn("_bucket", F.col("_cell.bucket")).drop("_cell")


def _on_grids(left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_start: str, right_end: str, width: int, in_left: set[int], in_right: set[int], few: tuple[bool, bool]) -> DataFrame:
    """Pairs of intervals that fit a grid, both with `_own`; `few`: the sides that are small enough to be broadcast."""
    names = [c for c in (*left.columns, *right.columns) if c != "_own"]
    a = _laid(left, F.col(left_start), F.col(left_end), width, in_right).withColumnRenamed("_own", "_own_a")
    b = _laid(right, F.col(right_start), F.col(right_end), width, in_left).withColumnRenamed("_own", "_own_b")
    a, b = (F.broadcast(a), b) if few[0] else (a, F.broadcast(b) if few[1] else by_sorting(b))
    level_width = F.lit(width).cast("double") * F.pow(F.lit(RATIO), F.col("_level"))
    home = F.floor(F.greatest(left_start, right_start) / level_width)
    meet = (F.col(left_start) <= F.col(right_end)) & (F.col(right_start) <= F.col(left_end))
    return a.join(b, ["_level", "_bucket"]).filter((F.greatest("_own_a", "_own_b") == F.col("_level")) & (F.col("_bucket") == home) & meet).select(*names)


def _with_long(long: DataFrame, other: DataFrame, long_start: str, long_end: str, other_start: str, other_end: str, width: int, in_other: set[int], few: bool) -> DataFrame:
    """Pairs of the long intervals with the other side: those that begin in them, and those in which they begin and that began before, which
    their first points find on the grids of that side. few: the long ones may be broadcast."""
    names = [*long.columns, *[c for c in other.columns if c != "_own"]]
    out = dyadic.contained(other.drop("_own"), long, other_start, F.col(long_start), F.col(long_end), few).select(*names)
    points = long.withColumns({"_own": F.lit(0), "_at": F.col(long_start)})
    out = out.unionByName(_on_grids(points, other.filter(F.col("_own") < LEVELS), long_start, "_at", other_start, other_end, width, {0}, in_other, (few, False)).filter(F.col(other_start) < F.col(long_start)).select(*names))
    if LEVELS in in_other:
        out = out.unionByName(dyadic.contained(long, other.filter(F.col("_own") == LEVELS).drop("_own"), long_start, F.col(other_start) + 1, F.col(other_end)).select(*names))
    return out


def overlap_join(left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_start: str, right_end: str, width: int, known: set[int] | None = None) -> DataFrame:
    """All pairs that share a point. Columns of both sides; their names must differ. `width`: about twice a usual length.

    Which grids are needed at all, and by how many, is asked of both sides while the plan is made, five rows each, unless a set that holds all of
    them is `known` (see `grids`).
    """
    left = left.filter(F.col(left_start) <= F.col(left_end)).withColumn("_own", _own_level(F.col(left_start), F.col(left_end), width))
    right = right.filter(F.col(right_start) <= F.col(right_end)).withColumn("_own", _own_level(F.col(right_start), F.col(right_end), width))
    counts = lambda d: dict.fromkeys(known, FEW + 1) if known is not None else dict(map(tuple, d.groupBy("_own").count().collect()))  # noqa: E731  five rows at most
    in_left, in_right = counts(left), counts(right)
    names = [*[c for c in left.columns if c != "_own"], *[c for c in right.columns if c != "_own"]]
    few = lambda n: sum(n.get(k, 0) for k in range(LEVELS)) <= FEW
    near = F.col("_own") < LEVELS
    pairs = _on_grids(left.filter(near), right.filter(near), left_start, left_end, right_start, right_end, width, set(in_left), set(in_right), (few(in_left), few(in_right)))
    if LEVELS in in_left:
        pairs = pairs.unionByName(_with_long(left.filter(~near).drop("_own"), right, left_start, left_end, right_start, right_end, width, set(in_right), in_left[LEVELS] <= FEW).select(*names))
    if LEVELS in in_right:
        pairs = pairs.unionByName(_with_long(right.filter(~near).drop("_own"), left.filter(near), right_start, right_end, left_start, left_end, width, set(in_left) - {LEVELS}, in_right[LEVELS] <= FEW).select(*names))
    return pairs


def grids(sizes: DataFrame, size: str, width: int) -> set[int]:
    """The grids that intervals of these sizes, or of size 1, need in `overlap_join`."""
    own = sizes.select(_own_level(F.lit(1), F.col(size), width).alias("k")).distinct()
    return {0} | {r[0] for r in own.filter("k is not null").collect()}  # five rows at most


def carried(df: DataFrame, place: str, value: str, out: str, levels: int = 3) -> DataFrame:
    """`df` (one row a place) with the last value that isn't null at any place before. Windows hold FAN neighbouring places; the last values
    of these are carried on in the same way, so that only one row for FAN^levels places is ordered in one task."""
    inside = lambda *by: Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    if not levels:
        return df.withColumn(out, F.last(value, ignorenulls=True).over(inside(F.lit(0))))
    lot, near, far = f"_lot{levels}", f"_near{levels}", f"_far{levels}"
    lots = df.withColumn(lot, F.floor(F.col(place) / FAN)).withColumn(near, F.last(value, ignorenulls=True).over(inside(lot)))
    tops = lots.groupBy(lot).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(place))).alias(value)).withColumnRenamed(lot, place)
    above = carried(tops, place, value, far, levels - 1).select(F.col(place).alias(lot), far)
    return lots.join(above, lot, "left").withColumn(out, F.coalesce(near, far)).drop(lot, near, far)


def stab(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: int) -> DataFrame:
    """The intervals that contain each point."""
    return overlap_join(points.withColumn("_p", F.col(point)), intervals, point, "_p", start, end, width).drop("_p")


def in_range(intervals: DataFrame, start: str, end: str, low: int, high: int) -> DataFrame:
    """J9 for one constant range; swapped bounds are put right."""
    low, high = min(low, high), max(low, high)
    return intervals.filter((F.col(start) <= high) & (F.col(end) >= low))


def as_of(probes: DataFrame, objects: DataFrame, probe: str, start: str, size: str, keep: list[str], bucket: int | None = None, both: str = "inner") -> DataFrame:
    """The object with the greatest start not after the probe, if it contains it (size <= 0: only its very start).

    One ordered line of probes and objects, scanned in ranges of equal size however the addresses lie (`bucket`, which once set them, has no
    effect). Among objects with one start the one with the greatest `keep` values counts. `both`: inner, or left to keep probes that nothing contains.
    """
    rank = F.struct(F.col(start).alias("_s"), F.col(size).alias("_z"), *[F.col(c) for c in keep])
    objs = objects.groupBy(start).agg(F.max(rank).alias("_o")).select(F.col(start).cast("bigint").alias("_at"), "_o", F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_tie"))
    marked = probes.withColumns({"_at": F.col(probe).cast("bigint"), "_o": F.lit(None).cast(objs.schema["_o"].dataType), "_kind": F.lit(1), "_tie": F.xxhash64(*probes.columns)})
    line = ranged(marked.unionByName(objs, allowMissingColumns=True), ["_at", "_kind", "_tie"])
    found = running(line, [], ["_at", "_kind", "_tie"], "_o", "_f", how="last", own=True).filter("_kind = 1")
    inside = F.col("_f").isNotNull() & (F.when(F.col("_f._z") <= 0, F.col(probe) == F.col("_f._s")).otherwise(F.col(probe) < F.col("_f._s") + F.col("_f._z")))
    out = found.withColumn("_f", F.when(inside, F.col("_f")))
    if both == "inner":
        out = out.filter(F.col("_f").isNotNull())
    return out.select(*probes.columns, F.col("_f._s").alias(start), F.col("_f._z").alias(size), *[F.col(f"_f.{c}").alias(c) for c in keep])


def relation(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """None, equal, first_embeds (a holds b), second_embeds, overlap, by the ends alone; `type_relation` tells cover from equal."""
    return (
        F.when((a_start > b_end) | (b_start > a_end), "none").when((a_start == b_start) & (a_end == b_end), "equal")
        .when((a_start <= b_start) & (a_end >= b_end), "first_embeds").when((b_start <= a_start) & (b_end >= a_end), "second_embeds").otherwise("overlap")
    )


def type_relation(by_ends: Column, same_type: Column, first_holds: Column, second_holds: Column) -> Column:
    """J13 with types: of intervals that lie within one another, what their types say; cover where neither type holds the other there."""
    within = by_ends.isin("equal", "first_embeds", "second_embeds")
    return F.when(~within, by_ends).when((by_ends == "equal") & same_type, "equal").when((by_ends != "second_embeds") & first_holds, "first_embeds").when((by_ends != "first_embeds") & second_holds, "second_embeds").otherwise("cover")


def merge(df: DataFrame, keys: list[str], start: str, end: str, touching: int = 1, block: int | None = None) -> DataFrame:
    """Maximal runs of intervals that overlap or lie within `touching` of each other: keys, start, end, n.

    The greatest end so far is carried along each key over ranges of equal size, so that one key with many intervals is shared out (`block`, which
    once cut them at fixed places, has no effect).
    """
    line = ranged(df.groupBy(*keys, start, end).agg(F.count("*").alias("n")), [*keys, start, end])
    reached = running(line, keys, [start, end], end, "_reach")
    head = F.when(F.col("_reach").isNull() | (F.col("_start") > F.col("_reach") + touching), F.col("_start"))
    sums = [F.max(end).alias(end), F.sum("n").alias("n")]
    return segments(reached.withColumnRenamed(start, "_start"), keys, ["_start", end], head, start, sums, sums).select(*keys, start, end, "n")


def gaps(df: DataFrame, start: str, end: str, low: int = -(1 << 61), high: int = 1 << 61) -> DataFrame:
    """What merged intervals leave of [low, high]: start, end."""
    ends = merge(df.filter(F.col(start) <= F.col(end)), [], start, end).select(F.col(start).alias("_s"), F.col(end).alias("_e"))
    edges = ends.unionByName(ends.sparkSession.range(1).select(F.lit(low - 1).alias("_s"), F.lit(low - 1).alias("_e")))
    line = neighbours(edges, [], "_s", after="_next")
    out = line.select((F.col("_e") + 1).alias(start), (F.coalesce("_next", F.lit(high + 1)) - 1).alias(end))
    return out.filter(F.col(start) <= F.col(end))


def subtract(df: DataFrame, start: str, end: str, without: DataFrame, without_start: str, without_end: str, width: int) -> DataFrame:
    """V7: what excluded ranges leave of each interval: its row once for each part left, with the part's ends; a swallowed interval has none.

    The excluded ranges, as far as they lie between the first and the last address of the intervals, become the gaps between them, with which an ordinary
    overlap join cuts the intervals into their parts."""
    low, high = df.filter(F.col(start) <= F.col(end)).agg(F.min(start), F.max(end)).first()
    if low is None:
        return df.limit(0)
    cuts = without.select(F.col(without_start).cast("bigint").alias("_gs"), F.col(without_end).cast("bigint").alias("_ge"))
    cuts = cuts.filter((F.col("_gs") <= F.col("_ge")) & (F.col("_ge") >= low) & (F.col("_gs") <= high)).withColumn("_gs", F.greatest("_gs", F.lit(low)))
    met = overlap_join(df, gaps(cuts, "_gs", "_ge", low, high), start, end, "_gs", "_ge", width)
    return met.withColumns({start: F.greatest(F.col(start), F.col("_gs")), end: F.least(F.col(end), F.col("_ge"))}).select(*df.columns)


def summary(prob: str, kind: str, valid: str | None = None, counted: Column | None = None) -> list[Column]:
    """A1: a mergeable summary. `counted`: rows whose probability counts (functions don't)."""
    p = F.col(prob) if counted is None else F.when(counted, F.col(prob))
    out = [F.count("*").alias("n"), F.min(p).alias("min_prob"), F.max(p).alias("max_prob"), F.bit_or(kind).alias("kinds")]
    return out + ([F.bit_or(valid).alias("validities")] if valid else [])


def merged_summary() -> list[Column]:
    """The summary of a union from the summaries of its parts."""
    return [F.sum("n").alias("n"), F.min("min_prob").alias("min_prob"), F.max("max_prob").alias("max_prob"), F.bit_or("kinds").alias("kinds")]


def bin_cells(df: DataFrame, start: str, end: str, low: int, high: int, cells: int) -> DataFrame:
    """Each interval once for every equal cell of [low, high] that it touches, as `cell`; the last cell takes the rest."""
    width = max(1, (high - low + 1) // cells)
    at = lambda c: F.least(F.floor((c - low) / width), F.lit(cells - 1))
    inside = df.filter((F.col(end) >= low) & (F.col(start) <= high))
    return inside.withColumn("cell", F.explode(F.sequence(at(F.greatest(F.col(start), F.lit(low))), at(F.least(F.col(end), F.lit(high))))))


def embeds_at(layout: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (outer, inner, offset) in which the outer type holds the inner one there. layout: type_id, offset, inner_type,
    stride, count - an array's elements stand at offset + i * stride for i below count."""
    hit = pairs.join(layout, (pairs["outer_type"] == layout["type_id"]) & (pairs["inner"] == layout["inner_type"]))
    d = pairs["at"] - layout["offset"]
    ok = F.when(layout["stride"] > 0, (d >= 0) & (d % layout["stride"] == 0) & (d / layout["stride"] < layout["count"])).otherwise(d == 0)
    return hit.filter(ok).select(*[pairs[c] for c in pairs.columns]).distinct()
