"""Differences: object fields, byte runs, page hashes, consecutive vectors, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.operators.intervals import carried, merge
from orebody.operators.scans import ranged, running, segments
from orebody.operators.store import by_sorting, cut

CHUNK = 16
FEW = 20_000  # rows, counted, that are broadcast
SHARED = 4  # roots to a pair from which on pairs are compared by themselves


def object_diff(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The paths at which two objects differ (null equals null): keys, paths; equal objects are left out."""
    r = right.select(*keys, *[F.col(f).alias(f"_r_{i}") for i, f in enumerate(fields)])
    joined = left.select(*keys, *[F.col(f).alias(f"_l_{i}") for i, f in enumerate(fields)]).join(r, keys)
    paths = F.array_compact(F.array(*[F.when(~F.col(f"_l_{i}").eqNullSafe(F.col(f"_r_{i}")), f) for i, f in enumerate(fields)]))
    return joined.select(*keys, paths.alias("paths")).filter(F.size("paths") > 0)


def recursive_diff(pairs: DataFrame, left_values: DataFrame, right_values: DataFrame, left_links: DataFrame, right_links: DataFrame) -> DataFrame:
    """P16, recursive: root, path: the dotted paths at which two object graphs differ. pairs: root, a, b; values: object, field, value; links:
    object, field, target (one row for an object's field).

    A frontier of pairs of objects: fields that only one side has or whose values differ (null equals null) are reported, links that both have lead to the
    next pairs, links that only one has are reported. Each pair counts once for a root, at its least number of steps and there at its least
    path, so that circles end. Where many roots have come to the same pairs, each of these is compared once, and what it says goes to its roots."""
    front = cut(pairs.select("root", "a", "b", F.lit("").alias("path")).groupBy("root", "a", "b").agg(F.min("path").alias("path")))
    seen, out = [], []
    dotted = F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), "field")
    near = lambda df: F.broadcast(df) if df.count() <= FEW else by_sorting(df)

    def shared(rows: DataFrame) -> DataFrame | None:
        """The pairs in `rows`, if many rows have the same."""
        n, kinds = rows.agg(F.count("*"), F.approx_count_distinct(F.struct("a", "b"))).first()
        return cut(rows.select("a", "b").distinct()) if n > SHARED * kinds else None

    def sides(rows: DataFrame, left: DataFrame, right: DataFrame, value: str) -> DataFrame:
        one = rows.join(left.select(F.col("object").alias("a"), "field", F.col(value).alias("_l"), F.lit(True).alias("_has_l")), "a").select(*rows.columns, "field", "_l", "_has_l")
        two = rows.join(right.select(F.col("object").alias("b"), "field", F.col(value).alias("_r"), F.lit(True).alias("_has_r")), "b").select(*rows.columns, "field", "_r", "_has_r")
        return one.join(two, [*rows.columns, "field"], "full")

    lone = F.col("_has_l").isNull() | F.col("_has_r").isNull()
    met = shared(front)
    while not front.isEmpty():
        seen.append(front.select("root", "a", "b"))
        both = front.select("root", "path", "a", "b")
        values, links = sides(both if met is None else met, left_values, right_values, "value"), cut(sides(both if met is None else met, left_links, right_links, "target"))
        values, lost = values.filter(lone | ~F.col("_l").eqNullSafe(F.col("_r"))), links.filter(lone | (F.col("_l").isNull() != F.col("_r").isNull()))
        links = links.filter("_l is not null and _r is not null")
        if met is not None:
            values, links = both.join(near(cut(values.select("a", "b", "field").unionByName(lost.select("a", "b", "field")))), ["a", "b"]), both.join(near(links), ["a", "b"])
        else:
            out.append(lost.select("root", dotted.alias("path")))
        out.append(cut(values.select("root", dotted.alias("path"))))
        on = cut(links.select("root", F.col("_l").alias("a"), F.col("_r").alias("b"), dotted.alias("path")).groupBy("root", "a", "b").agg(F.min("path").alias("path")))
        met, before = shared(on), reduce(DataFrame.unionByName, seen)
        if met is not None:
            before = cut(before.join(near(met), ["a", "b"], "left_semi").select("root", "a", "b"))  # the others can't come back here
        front = on if met is not None and before.isEmpty() else cut(on.join(by_sorting(before), ["root", "a", "b"], "left_anti"))
    return reduce(DataFrame.unionByName, out).distinct() if out else pairs.select("root", F.lit("").alias("path")).limit(0)


def objects_equal(left_leaves: DataFrame, right_leaves: DataFrame, deep: bool = False) -> DataFrame:
    """Object, equal - by leaf values (object, path, value, depth); nested structures only if `deep`."""
    pick = lambda d: d if deep else d.filter("depth <= 1")
    a, b = pick(left_leaves).select("object", "path", F.col("value").alias("_a")), pick(right_leaves).select("object", "path", F.col("value").alias("_b"))
    return a.join(b, ["object", "path"], "full").groupBy("object").agg(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))).alias("equal"))


def runs_of(df: DataFrame, group: list[str], place: str, step: int = 1, length: str = "run") -> DataFrame:
    """Islands of consecutive places: group, start, length in places. The place before is carried over ranges of a group's rows."""
    line = ranged(df.select(*group, place).distinct(), [*group, place])
    before = running(line, group, [place], place, "_before")
    head = F.when(F.col("_before").isNull() | (F.col(place) - F.col("_before") != step), F.col(place))
    return segments(before, group, [place], head, "start", [F.count("*").alias(length)], [F.sum(length).alias(length)])


def page_chunks(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pages cut into chunks: frame, place (from 0), bytes; a last chunk may be shorter."""
    n = F.ceil(F.length("data") / chunk).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring("data", i * chunk + 1, F.lit(chunk)))
    return pages.select("frame", F.posexplode(cut).alias("place", "bytes"))


def byte_runs(before: DataFrame, after: DataFrame, page: int = 4096, chunk: int = CHUNK, compat: bool = False) -> DataFrame:
    """V4: runs of chunks that changed between two images of pages(frame, data): start address and length in bytes.

    Any differing byte counts; compat=True looks at a chunk's last byte only and skips short chunks, as older tools do.
    Equal pages are dropped before any chunk is made."""
    both = before.select("frame", F.col("data").alias("_a")).join(after.select("frame", "data"), "frame").filter(F.col("_a") != F.col("data"))
    n = F.ceil(F.greatest(F.length("_a"), F.length("data")) / chunk).cast("int")
    piece = lambda c, i: F.substring(c, i * chunk + 1, F.lit(chunk))
    differs = (lambda i: F.substring("_a", (i + 1) * chunk, F.lit(1)) != F.substring("data", (i + 1) * chunk, F.lit(1))) if compat else (lambda i: piece("_a", i) != piece("data", i))
    places = F.filter(F.sequence(F.lit(0), n - 1), differs)
    rows = both.select("frame", F.explode(places).alias("_i")).withColumn("_n", F.row_number().over(Window.partitionBy("frame").orderBy("_i")))  # a page's chunks
    local = rows.groupBy("frame", (F.col("_i") - F.col("_n")).alias("_g")).agg(F.min("_i").alias("_s"), F.max("_i").alias("_e"))
    per = page // chunk
    inside = local.select((F.col("frame") * per + F.col("_s")).alias("start"), (F.col("frame") * per + F.col("_e")).alias("end"))
    edge = (F.col("start") % per == 0) | (F.col("end") % per == per - 1)  # only runs at a page's edge can go on in its neighbour
    return _joined(inside.filter(edge)).unionByName(inside.filter(~edge)).select((F.col("start") * chunk).alias("start"), ((F.col("end") - F.col("start") + 1) * chunk).alias("length"))


def _joined(runs: DataFrame) -> DataFrame:
    """Join runs that touch."""
    return merge(runs, [], "start", "end").drop("n")


def run_summary(runs: DataFrame, by: list[str], length: str) -> DataFrame:
    """A2: least and greatest length and count."""
    return runs.groupBy(*by).agg(F.min(length).alias("min_run"), F.max(length).alias("max_run"), F.count("*").alias("n_runs"))


def hash_changed(current: DataFrame, expected: DataFrame, key: str, data: str | Column) -> DataFrame:
    """V7: key, verdict (same, changed, new, gone) by SHA-1 of the content; one row a key."""
    digest = F.sha1(F.col(data) if isinstance(data, str) else data)
    a, b = current.select(key, digest.alias("_a")), expected.select(key, digest.alias("_b"))
    verdict = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, verdict.alias("verdict"))


def consecutive_cosine(df: DataFrame, order: str, vector: str, block: int = 4096) -> DataFrame:
    """Each row with the one before: dot product, cosine (-1 if a length is 0) and both lengths.

    The row before is the greatest smaller id: found inside id blocks, and for a block's first row carried from the block before."""
    rows = df.select(F.col(order).alias("_o"), F.col(vector).alias("_v")).withColumn("_b", F.floor(F.col("_o") / block))
    inside = Window.partitionBy("_b").orderBy("_o")
    last = rows.groupBy("_b").agg(F.max_by("_v", "_o").alias("_lv"))
    before = carried(last, "_b", "_lv", "_carry").select("_b", "_carry")
    paired = rows.withColumn("_p", F.lag("_v").over(inside)).withColumn("_first", F.row_number().over(inside) == 1).join(before, "_b")
    paired = paired.withColumn("_p", F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_p"))).filter("_p is not null")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    out = paired.select(F.col("_o").alias(order), dot("_p", "_v").alias("dot"), F.sqrt(dot("_p", "_p")).alias("len_prev"), F.sqrt(dot("_v", "_v")).alias("len_cur"))
    return out.withColumn("cosine", F.when((F.col("len_prev") == 0) | (F.col("len_cur") == 0), F.lit(-1.0)).otherwise(F.col("dot") / (F.col("len_prev") * F.col("len_cur"))))


def snapshot_join(previous: DataFrame, current: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of both snapshots by key with what they held; only those that changed (null equals null)."""
    p = previous.select(*key, F.col(value).alias("before"))
    return current.select(*key, F.col(value).alias("after")).join(p, key).filter(~F.col("before").eqNullSafe(F.col("after")))
