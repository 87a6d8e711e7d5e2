"""Instances: by type, against files, new among known ones, their members by kind, lists, and arithmetic on addresses (F14, F24, J4, J15,
J18, G3, P14, X3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.operators.intervals import overlap_join, relation


def of_type(rows: DataFrame, wanted: DataFrame, equivalent: DataFrame | None = None, type_id: str = "type_id") -> DataFrame:
    """J4 (variables), J18 (instances): rows whose type is one of `wanted` (type_id) or equivalent to one. equivalent: type_id, canon_id."""
    ids = wanted.select(F.col(wanted.columns[0]).alias("_t")).distinct()
    if equivalent is not None:
        canon = equivalent.join(ids, equivalent["type_id"] == F.col("_t"), "left_semi").select("canon_id").distinct()
        ids = ids.unionByName(equivalent.join(canon, "canon_id", "left_semi").select(F.col("type_id").alias("_t"))).distinct()
    return rows.join(ids, F.col(type_id) == F.col("_t"), "left_semi")


def matching(instances: DataFrame, variables: DataFrame, test: Column, file_test: Column, instance_id: str = "id", variable_id: str = "var_id") -> DataFrame:
    """instances that pass `test` and, where they have an id above 0 and its variable is known, `file_test` on the variable's columns."""
    found = instances.filter(test).join(variables.withColumn("_known", F.lit(True)), (F.col(instance_id) > 0) & (F.col(instance_id) == F.col(variable_id)), "left")
    return found.filter(F.col("_known").isNull() | file_test).select(*[instances[c] for c in instances.columns])


def new_nodes(candidates: DataFrame, known: DataFrame, key: str, width: int) -> DataFrame:
    """Candidates that no known node covers. Both have start, end, type and is_function; a known node covers a candidate of its own
    type if their ends are equal or it embeds it; a candidate function is covered by any function that it overlaps."""
    c = candidates.select(key, F.col("start").alias("_cs"), F.col("end").alias("_ce"), F.col("type").alias("_ct"), F.col("is_function").alias("_cf"))
    k = known.select(F.col("start").alias("_ks"), F.col("end").alias("_ke"), F.col("type").alias("_kt"), F.col("is_function").alias("_kf"))
    met = overlap_join(c, k, "_cs", "_ce", "_ks", "_ke", width)
    covered = (relation(F.col("_ks"), F.col("_ke"), F.col("_cs"), F.col("_ce")).isin("equal", "first_embeds") & (F.col("_ct") == F.col("_kt"))) | (F.col("_cf") & F.col("_kf"))
    return candidates.join(met.filter(covered).select(key).distinct(), key, "left_anti")


def members_by_kind(nodes: DataFrame, members: DataFrame, pointers: DataFrame, rule_results: DataFrame | None = None) -> DataFrame:
    """Node, member, place, child_address, child_type, child_kind: what each node's members lead to. nodes: node, type_id, address;
    members: type_id, member, offset, kind, ref_type, size, length; pointers: address, value (what memory holds there); rule_results:
    node, member, child_address, child_type, which take the place of the member's own children.

    Struct: the member itself; Array: each element; Pointer and FuncPointer: what stands at the value, unless it is 0 or not mapped."""
    held = nodes.join(members, "type_id").withColumn("at", F.col("address") + F.col("offset"))
    inline = held.filter("kind = 'Struct'").select("node", "member", F.lit(0).alias("place"), F.col("at").alias("child_address"), "ref_type", F.lit("object").alias("child_kind"))
    each = held.filter("kind = 'Array' and length > 0").select("node", "member", "at", "size", "ref_type", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("place"))
    each = each.select("node", "member", "place", (F.col("at") + F.col("place") * F.col("size")).alias("child_address"), "ref_type", F.lit("object").alias("child_kind"))
    aimed = held.filter(F.col("kind").isin("Pointer", "FuncPointer")).join(pointers.select(F.col("address").alias("at"), "value"), "at").filter("value <> 0")
    aimed = aimed.select("node", "member", F.lit(0).alias("place"), F.col("value").alias("child_address"), "ref_type", F.when(F.col("kind") == "FuncPointer", "function").otherwise("object").alias("child_kind"))
    out = inline.unionByName(each).unionByName(aimed).withColumnRenamed("ref_type", "child_type")
    if rule_results is None:
        return out
    own = rule_results.select("node", "member").distinct()
    ruled = rule_results.select("node", "member", F.lit(0).alias("place"), "child_address", "child_type", F.lit("object").alias("child_kind"))
    return out.join(own, ["node", "member"], "left_anti").unionByName(ruled)


def list_elements(df: DataFrame, items: str, out: str = "item") -> DataFrame:
    """A list-valued instance as one row an element, in order, with the one after it (null at the end)."""
    rest = [c for c in df.columns if c != items]
    return df.select(*rest, items, F.posexplode(items).alias("place", out)).select(*rest, "place", out, F.try_element_at(F.col(items), F.col("place") + 2).alias("list_next"))


def shown(symbols: DataFrame, members: DataFrame, rules: DataFrame, wanted: Column, key: str = "type_id") -> DataFrame:
    """the wanted symbols with their members by offset (structs name, offset) and the names of the rules that fit them. members: key,
    name, offset; rules: rule, pattern (a regular expression for the whole of the symbol's name)."""
    own = symbols.filter(wanted)
    parts = members.join(own.select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("offset", "name"))).alias("members"))  # one type's members
    fits = own.select(key, "name").join(F.broadcast(rules), F.expr("name rlike concat('^(?:', pattern, ')$')")).groupBy(key).agg(F.array_sort(F.collect_set("rule")).alias("rules"))  # rules are a written list
    return own.join(parts, key, "left").join(fits, key, "left")


# --- X3: what instances answer, as columns


def moved(address: Column, by: Column | int) -> Column:
    """The address plus a distance, wrapped at 64 bits."""
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda c: F.call_function("shiftrightunsigned", c, F.lit(32))
    d = F.lit(by).cast("bigint") if isinstance(by, int) else by.cast("bigint")
    sum_low = low(address) + low(d)
    return F.call_function("shiftleft", low(high(address) + high(d) + high(sum_low)), F.lit(32)).bitwiseOR(low(sum_low))


def high_word(address: Column) -> Column:
    return F.call_function("shiftrightunsigned", address, F.lit(32))


def low_word(address: Column) -> Column:
    return address.bitwiseAND(F.lit(0xFFFFFFFF))


def element(address: Column, size: Column, index: Column) -> Column:
    """The address of an array's element."""
    return moved(address, size * index)


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1, as unsigned numbers."""
    x, y = a.bitwiseXOR(F.lit(-(1 << 63))), b.bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def is_valid(address: Column, type_id: Column) -> Column:
    """An instance is valid with a type and an address that isn't 0."""
    return type_id.isNotNull() & address.isNotNull() & (address != 0)
