"""Validation and detection: allocation logs, cache types, verdicts, pages, code pointers, members' safety."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.operators.intervals import as_of, stab


def object_validity(objects: DataFrame, log: DataFrame, address: str, size: str, type_id: str, bucket: int, embeds: Column | None = None) -> DataFrame:
    """V1: each object against the allocation that contains it. log: slot, slot_size, slot_type (null: cache of unknown type).

    not_found: no allocation holds the address; invalid: it reaches past the slot's end; no_slab_type: the slot has no type;
    valid: same type at the slot's start; embedded: another place or type that `embeds` allows; conflict: the rest."""
    probed = as_of(objects, log, address, "slot", "slot_size", ["slot_type"], bucket, both="left")
    inner = embeds if embeds is not None else F.col(size) < F.col("slot_size")
    verdict = (
        F.when(F.col("slot").isNull(), "not_found").when(F.col(address) + F.col(size) > F.col("slot") + F.col("slot_size"), "invalid").when(F.col("slot_type").isNull(), "no_slab_type")
        .when((F.col(address) == F.col("slot")) & (F.col(type_id) == F.col("slot_type")), "valid").when(inner, "embedded").otherwise("conflict")
    )
    return probed.withColumn("validity", verdict)


def allocation_verdict(objects: DataFrame, log: DataFrame, globals_: DataFrame, casts: DataFrame, address: str, size: str, type_id: str, bucket: int, well_formed: Column | None = None, embeds: Column | None = None) -> DataFrame:
    """V1 with all its verdicts. log: slot, slot_size, slot_type; globals_: address, type of global variables; casts: slot_type and the
    type as which its objects may be seen.

    invalid: not well formed; unknown: no log at all; without an allocation at the address: no_slab_type (the log holds no cache of the
    type), valid_global (a variable of the type stands there) or not_found; maybe: the cache's type isn't known; at the slot's start
    valid (same type) or valid_cast; elsewhere embedded (`embeds`, or else by size) or conflict."""
    probed = as_of(objects, log, address, "slot", "slot_size", ["slot_type"], bucket, both="left")
    slab_types = log.select(F.col("slot_type").alias(type_id)).filter(F.col(type_id).isNotNull()).distinct().withColumn("_slab", F.lit(True))
    known = globals_.select(F.col("address").alias(address), F.col("type").alias(type_id)).distinct().withColumn("_global", F.lit(True))
    seen_as = casts.select("slot_type", F.col("type").alias(type_id)).distinct().withColumn("_cast", F.lit(True))
    told = probed.join(slab_types, type_id, "left").join(known, [address, type_id], "left").join(seen_as, ["slot_type", type_id], "left")
    start = F.col(address) == F.col("slot")
    inner = embeds if embeds is not None else F.col(address) + F.col(size) <= F.col("slot") + F.col("slot_size")
    verdict = F.when(~(F.lit(True) if well_formed is None else well_formed), "invalid")
    if log.isEmpty():
        verdict = verdict.otherwise("unknown")
    else:
        verdict = (
            verdict.when(F.col("slot").isNull() & F.col("_slab").isNull(), "no_slab_type").when(F.col("slot").isNull() & F.col("_global").isNotNull(), "valid_global").when(F.col("slot").isNull(), "not_found")
            .when(F.col("slot_type").isNull(), "maybe").when(start & (F.col(type_id) == F.col("slot_type")), "valid").when(start & F.col("_cast").isNotNull(), "valid_cast").when(inner, "embedded").otherwise("conflict")
        )
    return told.select(*objects.columns, "slot", "slot_type", verdict.alias("verdict"))


def cache_types(caches: DataFrame, types: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """V2: cache -> type: an alias, else the name without _cache or a final s, exact before prefix; sizes must agree; of prefixes the
    name of nearest length wins. caches: cache, object_size; types: name, size, type_id."""
    base = F.regexp_replace(F.col("cache"), r"(_cachep?|s)$", "")
    table = F.create_map(*[x for k, v in (aliases or {}).items() for x in (F.lit(k), F.lit(v))]) if aliases else None
    wanted = F.coalesce(table[F.col("cache")], base) if table is not None else base
    named = caches.withColumn("_w", wanted)
    # every name once for each of its beginnings: names meet the caches that ask for such a beginning and size, and no others
    starts = F.transform(F.sequence(F.lit(0), F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n))
    t = types.select(F.col("name").alias("_n"), F.col("size").alias("_s"), F.col("type_id").alias("_t"), F.explode(starts).alias("_b"))
    asked = named.select(F.col("_w").alias("_b"), F.col("object_size").alias("_s")).distinct()
    pair = named.join(t.join(asked, ["_b", "_s"], "left_semi"), (F.col("_s") == F.col("object_size")) & (F.col("_b") == F.col("_w")))
    best = F.min(F.struct((F.col("_n") != F.col("_w")).alias("inexact"), F.abs(F.length("_n") - F.length("_w")).alias("far"), F.col("_n").alias("type_name"), F.col("_t").alias("type_id")))
    return pair.groupBy("cache").agg(best.alias("b")).select("cache", "b.type_name", "b.type_id")


def verdict(slab: Column, magic_ok: Column, has_magic: Column, is_global: Column) -> Column:
    """V3: the joint verdict of the allocation log, magic numbers and globals."""
    return (
        F.when(slab.isin("invalid", "conflict"), "invalid").when(has_magic & ~magic_ok, "invalid").when(slab.isin("valid", "embedded"), "valid")
        .when(is_global, "valid_global").when(has_magic & magic_ok, "maybe").otherwise("unknown")
    )


def executable_pages(page_table: DataFrame) -> DataFrame:
    """V5: present, executable, supervisor pages."""
    return page_table.filter(F.col("present") & ~F.col("nx") & F.col("supervisor"))


def attribute(points: DataFrame, point: str, key: str, ranges: list[tuple[str, DataFrame]], width: int, rest: str = "hidden") -> DataFrame:
    """The first class of `ranges` (name, table of start and end) that contains each point, else `rest`."""
    hits = None
    for i, (name, table) in enumerate(ranges):
        own = stab(points.select(key, point), table.select("start", "end"), point, "start", "end", width).select(key).distinct().withColumn("_c", F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")))
        hits = own if hits is None else hits.unionByName(own)
    best = hits.groupBy(key).agg(F.min("_c").alias("_c"))
    return points.join(best, key, "left").withColumn("page_class", F.coalesce("_c.name", F.lit(rest))).drop("_c")


def page_flags(entry: Column, pae: bool = True) -> dict[str, Column]:
    """Present, writeable, user and no-execute bits of a page-table entry."""
    bit = lambda i: F.call_function("shiftrightunsigned", entry, F.lit(i)).bitwiseAND(F.lit(1)) == 1
    return {"present": bit(0), "writeable": bit(1), "user": bit(2), "large": bit(7), "nx": bit(63) if pae else F.lit(False)}


def pointer_triage(pointer: Column, user: Column, default: Column, valid: Column, nx: Column, direct: Column, function: Column, module: Column, in_union: Column) -> Column:
    """V9: the first that holds: user_land, default, invalid, nx, direct_map, function, module; else suspicious, apart for unions."""
    tests = [(user, "user_land"), (default, "default"), (~valid, "invalid"), (nx, "nx"), (direct, "direct_map"), (function, "function"), (module, "module")]
    last = F.when(in_union, "suspicious_union").otherwise("suspicious")
    return F.when(pointer.isNull(), "invalid").otherwise(reduce(lambda acc, t: F.when(F.coalesce(t[0], F.lit(False)), t[1]).otherwise(acc), reversed(tests), last))


def code_targets(functions: DataFrame, system_map: DataFrame) -> DataFrame:
    """The addresses that code pointers may hold: starts of functions and text symbols."""
    return functions.select(F.col("pc_low").alias("target")).union(system_map.filter(F.col("type").isin("t", "T")).select("address")).distinct()


def unknown_targets(calls: DataFrame, target: str, known: DataFrame, known_key: str) -> DataFrame:
    """Calls whose target isn't known."""
    return calls.join(known.select(F.col(known_key).alias(target)).distinct(), target, "left_anti")


def version_matches(image: str, catalog: str) -> bool:
    """Whether an image's kernel version is the catalog's."""
    return image.strip() == catalog.strip()


def translate_linear(address: Column, regions: list[tuple[int, int, int]]) -> Column:
    """Physical address of directly mapped regions (low, high, base): address - low + base; null outside."""
    out = F.lit(None).cast("bigint")
    for low, high, base in regions:
        out = F.when(address.between(low, high), address - low + base).otherwise(out)
    return out


def translate(rows: DataFrame, address: str, entries: DataFrame, root: int, levels: int = 4, entry_bytes: int = 8, index_bits: int = 9, page_bits: int = 12) -> DataFrame:
    """Physical addresses by walking page tables: one join a level. entries: at (physical address of an entry), entry.
    The root's table, which all rows ask, has 2^index_bits entries at most and is broadcast; below it a busy entry is one row that a skewed join
    meets in parts. Adds physical (null if not present) and page_size; large pages end the walk early."""
    mask = (1 << 52) - (1 << page_bits)
    cur = rows.withColumn("_base", F.lit(root).cast("bigint")).withColumn("physical", F.lit(None).cast("bigint")).withColumn("page_size", F.lit(None).cast("bigint"))
    table = entries.select(F.col("at").alias("_at"), F.col("entry").alias("_e"))
    for level in range(levels - 1, -1, -1):
        shift = page_bits + level * index_bits
        index = F.call_function("shiftrightunsigned", F.col(address), F.lit(shift)).bitwiseAND(F.lit((1 << index_bits) - 1))
        top = level == levels - 1
        own = F.broadcast(table.filter(F.col("_at").between(root, root + (entry_bytes << index_bits) - 1)).dropDuplicates(["_at"])) if top else table
        cur = cur.withColumn("_at", F.col("_base") + index * entry_bytes).join(own, "_at", "left").drop("_at")
        present = F.coalesce(F.col("_e").bitwiseAND(F.lit(1)) == 1, F.lit(False))
        large = F.lit(True) if level == 0 else (F.col("_e").bitwiseAND(F.lit(0x80)) != 0) & F.lit(level < levels - 1)
        frame = F.col("_e").bitwiseAND(F.lit(mask & ~((1 << shift) - 1)))
        hit = F.col("_base").isNotNull() & present & large
        cur = (
            cur.withColumn("physical", F.when(hit, frame + F.col(address).bitwiseAND(F.lit((1 << shift) - 1))).otherwise(F.col("physical")))
            .withColumn("page_size", F.when(hit, F.lit(1 << shift)).otherwise(F.col("page_size")))
            .withColumn("_base", F.when(F.col("_base").isNotNull() & present & ~large, F.col("_e").bitwiseAND(F.lit(mask)))).drop("_e")
        )
    return cur.drop("_base")


def verify_instance(slab: DataFrame, magic: DataFrame, probability: DataFrame, key: str) -> DataFrame:
    """What the checks say of each instance, side by side."""
    return slab.join(magic, key, "left").join(probability, key, "left")


def highest_probability(objects: DataFrame, key: str, start: str, end: str, prob: str, width: int) -> DataFrame:
    """SNK3: of overlapping objects those that no overlapping object beats (higher probability, then lower key)."""
    from orebody.operators.intervals import overlap_join

    other = objects.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(prob).alias("_p"))
    pairs = overlap_join(objects.select(key, start, end, prob), other, start, end, "_s", "_e", width)
    beaten = pairs.filter((F.col("_p") > F.col(prob)) | ((F.col("_p") == F.col(prob)) & (F.col("_k") < F.col(key)))).select(key).distinct()
    return objects.join(beaten, key, "left_anti")
