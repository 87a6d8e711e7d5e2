"""Counting operators: shares, histograms, top-k, multiplicities, coverage, ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_counts(df: DataFrame, by: list[str | Column], size: str | Column) -> DataFrame:
    """Rows and bytes of each class, and the share of all rows. The share's window is over one row a class."""
    counted = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(size).cast("bigint").alias("total_size"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def probability_histogram(df: DataFrame, prob: str, by: list[str], buckets: int = 10) -> DataFrame:
    """A dense histogram with the top bucket clamped; every bucket stands, also empty ones."""
    counted = df.filter(F.col(prob).isNotNull()).groupBy(*by, F.least(F.floor(F.col(prob) * buckets), F.lit(buckets - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    keys = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    axis = keys.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    if not by:
        return axis.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    same = [axis[c].eqNullSafe(counted[c]) for c in by] + [axis["bucket"] == counted["bucket"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return axis.join(counted, on, "left").select(*[axis[c] for c in by], axis["bucket"], F.coalesce(counted["n"], F.lit(0)).alias("n"))


def verdict_bounds(df: DataFrame, prob: str, valid: Column) -> DataFrame:
    """The least probability of a valid and the greatest of an invalid row."""
    return df.agg(F.min(F.when(valid, F.col(prob))).alias("min_valid"), F.max(F.when(~valid, F.col(prob))).alias("max_invalid"))


def top_share(df: DataFrame, by: str, size: str, k: int = 20) -> DataFrame:
    """The k most frequent values, their share of all rows and the mean size; ties by value."""
    counted = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(size).alias("mean_size"))
    top = counted.orderBy(F.desc("n"), F.asc(by)).limit(k)
    total = df.agg(F.count("*").alias("_total"))  # one row; a window would bring every value to one task
    return top.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total").orderBy(F.desc("n"), F.asc(by))


def coverage(wanted: DataFrame, found: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Of each group's wanted keys, how many are found. Keys of both sides count once."""
    hit = found.select(*keys).distinct().withColumn("_hit", F.lit(1))
    joined = wanted.select(group, *[k for k in keys if k != group]).distinct().join(hit, keys, "left")
    return joined.groupBy(group).agg(F.count("*").alias("total"), F.count("_hit").alias("found")).withColumn("ratio", F.col("found") / F.col("total"))


def multiplicity(df: DataFrame, value: str | Column, key: str, k: int | None = 10) -> DataFrame:
    """Values that occur more than once, by a digest of the value: n and the least key. k: a report's length."""
    hashed = df.select(F.md5(F.col(value) if isinstance(value, str) else value).alias("digest"), F.col(key).alias("_k"))
    counted = hashed.groupBy("digest").agg(F.count("*").alias("n"), F.min("_k").alias("first_key")).filter("n > 1")
    return counted.orderBy(F.desc("n"), "digest").limit(k) if k else counted


def postponed(df: DataFrame, ref: str, target: DataFrame, target_key: str, waiter: str, k: int = 20, sample: int = 5) -> DataFrame:
    """References to what doesn't exist: missing key, how many wait, the first waiters; the k most waited for.

    Waiters are looked at for the k chosen keys only, first in 64 parts of each key, of which each passes on `sample`."""
    waiting = df.filter(F.col(ref).isNotNull()).join(target.select(F.col(target_key).alias(ref)).distinct(), ref, "left_anti")
    most = waiting.groupBy(ref).agg(F.count("*").alias("n")).orderBy(F.desc("n"), ref).limit(k)
    theirs = waiting.join(F.broadcast(most.select(ref)), ref).select(ref, waiter, F.pmod(F.xxhash64(waiter), F.lit(64)).alias("_s")).filter(F.col(waiter).isNotNull()).distinct()  # k rows
    few = theirs.withColumn("_r", F.row_number().over(Window.partitionBy(ref, "_s").orderBy(waiter))).filter(F.col("_r") <= sample)
    first = few.groupBy(ref).agg(F.slice(F.array_sort(F.collect_list(waiter)), 1, sample).alias("waiters"))  # 64 * sample a key
    return most.join(first, ref, "left").select(ref, "n", F.coalesce("waiters", F.array().cast(first.schema["waiters"].dataType)).alias("waiters"))


def ambiguous_names(df: DataFrame, name: str, size: str) -> DataFrame:
    """Names with more than one non-zero size, with the sizes in numeric order."""
    sizes = df.filter(F.col(size) != 0).select(name, size).distinct()
    many = sizes.groupBy(name).agg(F.count("*").alias("n_sizes"), F.array_sort(F.collect_list(size)).alias("_s"))
    return many.filter("n_sizes > 1").select(name, "n_sizes", F.array_join(F.transform("_s", lambda x: x.cast("string")), ",").alias("sizes"))


def catalog_size(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def alternatives_summary(alts: DataFrame, owner: list[str], type_id: str, type_hash: str, at_least: int = 1) -> DataFrame:
    """Members with at least so many alternative types; different ones by id and by hash."""
    return alts.groupBy(*owner).agg(F.count("*").alias("n"), F.countDistinct(type_id).alias("by_id"), F.countDistinct(type_hash).alias("by_hash")).filter(F.col("n") >= at_least)


def change_vectors(df: DataFrame, snapshot: str, kind: str, axis: list, changed: Column) -> DataFrame:
    """Per snapshot, how many changed rows of each kind, over a fixed axis; 0 where none."""
    return df.groupBy(snapshot).agg(*[F.sum(F.when((F.col(kind) == a) & changed, 1).otherwise(0)).cast("bigint").alias(f"{kind}_{a}") for a in axis])


def child_validity(children: DataFrame, parent: str, union_of: str, tested: Column, invalid: Column, user: Column, allowance: float = 0.2) -> DataFrame:
    """Share of invalid children; of a union's members only the best counts; user-land ones beyond the allowance are invalid."""
    per = children.groupBy(parent, union_of).agg(F.sum(tested.cast("int")).alias("_t"), F.sum(invalid.cast("int")).alias("_i"), F.sum(user.cast("int")).alias("_u"))
    best = F.when(F.col(union_of).isNotNull(), F.struct(F.lit(1).cast("bigint").alias("t"), F.least(F.lit(1.0), F.col("_i") / F.greatest("_t", F.lit(1))).alias("i"), F.col("_u").alias("u")))
    rows = per.select(parent, F.coalesce(best, F.struct(F.col("_t").alias("t"), F.col("_i").cast("double").alias("i"), F.col("_u").alias("u"))).alias("x"))
    out = rows.groupBy(parent).agg(F.sum("x.t").alias("tested"), F.sum("x.i").alias("invalid"), F.sum("x.u").alias("user"))
    extra = F.when(F.col("user") > F.col("tested") * allowance, F.col("user")).otherwise(0)
    return out.select(parent, "tested", "invalid", ((F.col("invalid") + extra) / F.greatest("tested", F.lit(1))).alias("ratio"))
