"""Filters over catalog tables (F6-F33): kinds, sizes, ids, names, member chains, files, systems and versions, addresses.

Filters are written as `key:value` or `key value`; any unambiguous prefix of a key will do (type ids need five letters), and all
conditions of a filter must hold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.functions.patterns import NamePattern, compile_pattern, matches

#: One bit per kind of type, in catalog order (fixed values).
KINDS = {
    "Int8": 1 << 0, "UInt8": 1 << 1, "Bool8": 1 << 2, "Int16": 1 << 3, "UInt16": 1 << 4, "Bool16": 1 << 5, "Int32": 1 << 6, "UInt32": 1 << 7,
    "Bool32": 1 << 8, "Int64": 1 << 9, "UInt64": 1 << 10, "Bool64": 1 << 11, "Float": 1 << 12, "Double": 1 << 13, "Pointer": 1 << 14, "Array": 1 << 15,
    "Enum": 1 << 16, "Struct": 1 << 17, "Union": 1 << 18, "Const": 1 << 19, "Volatile": 1 << 20, "Typedef": 1 << 21, "FuncPointer": 1 << 22, "Function": 1 << 23,
    "Void": 1 << 24, "VaList": 1 << 25,
}
LEXICAL = KINDS["Const"] | KINDS["Volatile"] | KINDS["Typedef"]
POINTING = KINDS["Pointer"] | KINDS["Array"]
STRUCTURED = KINDS["Struct"] | KINDS["Union"]
SIGNED = KINDS["Int8"] | KINDS["Int16"] | KINDS["Int32"] | KINDS["Int64"]
UNSIGNED = KINDS["UInt8"] | KINDS["UInt16"] | KINDS["UInt32"] | KINDS["UInt64"]
BOOLEAN = KINDS["Bool8"] | KINDS["Bool16"] | KINDS["Bool32"] | KINDS["Bool64"]
INTEGER = SIGNED | UNSIGNED | BOOLEAN
FLOATING = KINDS["Float"] | KINDS["Double"]

TYPE_KEYS = ("typename", "datatype", "typeid", "size")
VARIABLE_KEYS = ("variablename", "filename", *TYPE_KEYS)


class FilterError(ValueError):
    """A filter that can't be read."""


def kind_mask(text: str) -> int:
    """The union of all kinds that a comma list of patterns matches; never case-sensitive."""
    mask = 0
    for part in text.split(","):
        p = compile_pattern(part)
        found = 0
        for name, bit in KINDS.items():
            value = name if p.kind != "literal" else name.lower()
            if p.kind == "literal":
                hit = value == p.text.lower()
            elif p.kind == "wildcard":
                hit = re.fullmatch(p.text, value, re.I | re.S)
            else:
                hit = p.kind == "any" or re.search(p.text, value, re.I)
            found |= bit if hit else 0
        if not found:
            raise FilterError(f"no kind of type matches {part.strip()!r}")
        mask |= found
    return mask


def expand_key(prefix: str, keys: tuple[str, ...]) -> str:
    """The key that a prefix stands for."""
    prefix = prefix.lower()
    if prefix in keys:
        return prefix
    found = [k for k in keys if k.startswith(prefix) and not (k == "typeid" and len(prefix) < 5)]
    if len(found) != 1:
        raise FilterError(f"{'ambiguous' if found else 'unknown'} filter key {prefix!r}")
    return found[0]


@dataclass
class TypeFilter:
    """Conditions on a type; unset ones hold."""

    name: NamePattern | None = None
    kinds: int | None = None
    size: int | None = None
    type_id: int | None = None
    variable: NamePattern | None = None
    file: NamePattern | None = None
    members: list[MemberFilter] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str, keys: tuple[str, ...] = VARIABLE_KEYS) -> TypeFilter:
        """Conditions are parted by white space; values with white space go in quotes."""
        out = cls()
        words = re.findall(r"""[^\s"']+:(?:"[^"]*"|'[^']*'|[^\s]+)|"[^"]*"|'[^']*'|\S+""", text.strip())
        i = 0
        while i < len(words):
            m = re.match(r"([A-Za-z]+):(.+)$", words[i], re.S)
            if m:
                key, value = m[1], m[2]
            elif i + 1 < len(words):
                key, value = words[i], words[i + 1]
                i += 1
            else:
                raise FilterError(f"{words[i]!r} has no value")
            out.set(expand_key(key, keys), value.strip("\"'"))
            i += 1
        return out

    def set(self, key: str, value: str) -> None:
        if key == "typename":
            self.name = compile_pattern(value)
        elif key == "datatype":
            self.kinds = kind_mask(value)
        elif key == "size":
            self.size = int(value, 16) if value.lower().startswith("0x") else int(value)
        elif key == "typeid":
            self.type_id = int(value, 16)
        elif key == "variablename":
            self.variable = compile_pattern(value)
        elif key == "filename":
            self.file = compile_pattern(value)

    def condition(self, chain: str | None = None, kind: str = "kind", size: str = "size", name: str = "name", type_id: str = "type_id") -> Column:
        """The predicate on a row of types. `chain`: a column of structs (kind, name, type_id) of the type and what its
        lexical wrappers lead to; without it only the type itself is looked at. The cheap tests stand first; size is the outer type's."""
        out = F.lit(True)
        see = (lambda test: F.exists(chain, lambda t: test(t["kind"], t["name"], t["type_id"]))) if chain else (lambda test: test(F.col(kind), F.col(name), F.col(type_id)))
        if self.size is not None:
            out &= F.col(size) == self.size
        if self.kinds is not None:
            mask = self.kinds
            out &= see(lambda k, n, i: k.bitwiseAND(F.lit(mask)) != 0)
        if self.type_id is not None:
            wanted = self.type_id
            out &= see(lambda k, n, i: i == wanted)
        if self.name is not None:
            p = self.name
            out &= see(lambda k, n, i: matches(n, p))
        return out


@dataclass
class MemberFilter:
    """A member's name and the conditions on its type."""

    name: NamePattern | None = None
    type: TypeFilter | None = None


def filter_types(types: DataFrame, text: str | TypeFilter, chain: str | None = None) -> DataFrame:
    """F6-F9 over a table of types."""
    f = TypeFilter.parse(text) if isinstance(text, str) else text
    return types.filter(f.condition(chain))


def filter_variables(variables: DataFrame, types: DataFrame, text: str | TypeFilter, chain: str | None = None) -> DataFrame:
    """the variable's name and own file, and its type."""
    f = TypeFilter.parse(text) if isinstance(text, str) else text
    own = variables.filter(matches(F.col("var_name"), f.variable) & matches(F.col("orig_file"), f.file))
    kept = types.filter(f.condition(chain)).select("type_id")
    return own.join(kept, "type_id", "left_semi")


def filter_member_chain(types: DataFrame, members: DataFrame, target: DataFrame, filters: list[MemberFilter]) -> DataFrame:
    """structs in which filter 1 matches a member, filter 2 a member of what that leads to, and so on.

    members: struct_id, name, ref_type_id; target: type_id, struct_id - what a type leads to through wrappers, pointers and arrays.
    """
    def hits(f: MemberFilter) -> DataFrame:
        own = members.filter(matches(F.col("name"), f.name))
        if f.type is not None:
            own = own.join(types.filter(f.type.condition()).select(F.col("type_id").alias("ref_type_id")), "ref_type_id", "left_semi")
        return own

    reached = None  # structs from which the rest of the chain can be walked
    for f in reversed(filters):
        own = hits(f)
        if reached is not None:
            leads = target.join(reached, "struct_id", "left_semi").select(F.col("type_id").alias("ref_type_id")).distinct()
            own = own.join(leads, "ref_type_id", "left_semi")
        reached = own.select("struct_id").distinct()
    return types if reached is None else types.join(reached.withColumnRenamed("struct_id", "type_id"), "type_id", "left_semi")


#: System and architecture bits (fixed values).
OS_BITS = {"linux": 1, "windows": 2}
ARCH_BITS = {"x86": 1, "x86_pae": 2, "x86_64": 4}


def version_key(version: Column) -> Column:
    """A sortable form of versions with numeric parts, parted by '-', ',' and '.': numbers by value, and a longer version after
    its own prefix. Parts that are no number sort as text, after all numbers."""
    parts = F.filter(F.split(version, r"[-,.]"), lambda p: F.lit(True))
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.struct(F.lit(0).alias("t"), p.try_cast("decimal(38,0)").alias("n"), F.lit("").alias("s"))).otherwise(F.struct(F.lit(1).alias("t"), F.lit(0).cast("decimal(38,0)").alias("n"), p.alias("s"))))


def compare_versions(a: Column, b: Column) -> Column:
    """F16: -1, 0 or 1. Part by part: as numbers if both are numbers, else as text; on a tie the longer one wins."""
    pa, pb = F.split(a, r"[-,.]"), F.split(b, r"[-,.]")
    number = lambda p: p.try_cast("decimal(38,0)")

    def one(x: Column, y: Column) -> Column:
        both = x.rlike("^[0-9]+$") & y.rlike("^[0-9]+$")
        return (
            F.when(x.isNull() | y.isNull(), F.lit(0))
            .when(both, F.when(number(x) < number(y), -1).when(number(x) > number(y), 1).otherwise(0))
            .otherwise(F.when(x < y, -1).when(x > y, 1).otherwise(0))
        )

    first = F.aggregate(F.zip_with(pa, pb, one), F.lit(0), lambda acc, x: F.when(acc != 0, acc).otherwise(x))
    return F.when(first != 0, first).otherwise(F.signum(F.size(pa) - F.size(pb)).cast("int"))


def os_filter(os: Column, arch: Column, version: Column, want_os: int = 0, want_arch: int = 0, min_version: str | None = None, max_version: str | None = None) -> Column:
    """a side that isn't set always passes."""
    out = F.lit(True)
    if want_os:
        out &= (os == 0) | (os.bitwiseAND(F.lit(want_os)) != 0)
    if want_arch:
        out &= (arch == 0) | (arch.bitwiseAND(F.lit(want_arch)) != 0)
    unset = version.isNull() | (version == "")
    if min_version:
        out &= unset | (compare_versions(version, F.lit(min_version)) >= 0)
    if max_version:
        out &= unset | (compare_versions(version, F.lit(max_version)) <= 0)
    return out


def script_list(df: DataFrame, name: str, text: str | None) -> DataFrame:
    """a plain identifier by equality, anything else as a wildcard; both case-sensitive."""
    if not text:
        return df
    if re.fullmatch(r"\w+", text):
        return df.filter(F.col(name) == text)
    return df.filter(F.col(name).rlike(f"(?s)^(?:{glob_to_regex_cached(text)})$"))


def glob_to_regex_cached(text: str) -> str:
    from orebody.functions.patterns import glob_to_regex

    return glob_to_regex(text)


def any_column_like(df: DataFrame, glob: str | None, columns: list[str | Column], order: str) -> DataFrame:
    """rows in which any of the columns matches the wildcard, in order of an unsigned address."""
    if glob:
        test = F.lit(False)
        for c in columns:
            test = test | matches(F.col(c) if isinstance(c, str) else c, compile_pattern(glob if re.search(r"[*?\[]", glob) else f"*{glob}*"))
        df = df.filter(test)
    return df.orderBy(unsigned_key(F.col(order)))


def unsigned_key(address: Column) -> Column:
    """A long that sorts as the unsigned number with the same bits."""
    return address.bitwiseXOR(F.lit(-(1 << 63)))


def unique_lookup(df: DataFrame, name: str, value: str) -> DataFrame:
    """name -> value, or -1 where a name has several values."""
    return df.groupBy(name).agg(F.countDistinct(value).alias("_n"), F.min(value).alias("_v")).select(name, F.when(F.col("_n") == 1, F.col("_v")).otherwise(F.lit(-1)).alias(value))


def ambiguous_lookup(df: DataFrame, name: str, wanted: str) -> DataFrame:
    """All rows of a name; raises in the plan if there are several."""
    from pyspark.sql import Window

    w = Window.partitionBy(name)
    found = df.filter(F.col(name) == wanted).withColumn("_n", F.count("*").over(w))
    return found.withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit(f"ambiguous type: {wanted}"))).filter(F.col("_ok").isNull()).drop("_n", "_ok")


def is_default_value(address: Column, poison: tuple[int, ...] = (0x00100100, 0x00200200), errors: int = 4095) -> Column:
    """0, -1, an error code or a poison value."""
    return (address == 0) | address.between(-errors, -1) | address.isin(*poison)


def is_valid_address(address: Column, bits: int = 64, regions: list[tuple[int, int]] | None = None) -> Column:
    """canonical for the architecture, and in one of the regions if any are given (signed bounds, inclusive)."""
    canonical = (address >= -(1 << 47)) & (address < (1 << 47)) if bits == 64 else address.between(0, (1 << 32) - 1)
    if not regions:
        return canonical
    inside = F.lit(False)
    for low, high in regions:
        inside = inside | address.between(low, high)
    return canonical & inside


def valid_function_pointers(df: DataFrame, pointer: str, pages: DataFrame, out: str = "callable", page: int = 4096) -> DataFrame:
    """whether a function pointer's target is in a page that is present and executable; a pointer that is null or a default value isn't
    callable. pages: frame, present, nx."""
    shift = page.bit_length() - 1
    code = pages.filter(F.col("present") & ~F.col("nx")).select(F.col("frame").alias("_frame")).distinct().withColumn("_code", F.lit(True))
    asked = df.withColumn("_frame", F.when(~is_default_value(F.col(pointer)), F.call_function("shiftrightunsigned", F.col(pointer), F.lit(shift))))
    # pointers without a target would be one hot key: only the others are joined
    aimed = asked.filter("_frame is not null").join(code, "_frame", "left").withColumn(out, F.coalesce("_code", F.lit(False))).drop("_frame", "_code")
    return aimed.unionByName(asked.filter("_frame is null").drop("_frame").withColumn(out, F.lit(False)))


def is_user_land(address: Column, bits: int = 64, low: int = 0x1000, high: int | None = None) -> Column:
    """between the user bounds of the architecture; the bounds are configuration."""
    return address.between(low, high if high is not None else ((1 << 47) - 1 if bits == 64 else 0xBFFFFFFF))


def is_valid_instance(address: Column, structured: Column, accessible: Column, align: int = 4) -> Column:
    """not null, a valid address, aligned if structured, and readable."""
    return (address != 0) & is_valid_address(address) & (~structured | (address % align == 0)) & accessible


def learn_constants(values: DataFrame, member: str, number: str, is_constant: str, is_string: str) -> DataFrame:
    """F32: the constants that a member was assigned; a string beside numbers or anything not constant spoils it."""
    agg = values.groupBy(member).agg(
        F.array_sort(F.collect_set(number)).alias("constants"), F.bool_or(~F.col(is_constant)).alias("_bad"),
        F.bool_or(is_string).alias("strings"), F.bool_or(F.col(number).isNotNull()).alias("_ints"),
    )
    return agg.select(member, "constants", "strings", (~F.col("_bad") & ~(F.col("strings") & F.col("_ints"))).alias("usable"))


def magic_valid(leaves: DataFrame, instance: str, union_of: str, value: str, constants: str) -> DataFrame:
    """each constrained member holds 0 or one of its constants; in a union one member is enough."""
    ok = (F.size(constants) == 0) | (F.col(value) == 0) | F.array_contains(F.col(constants), F.col(value))
    per_union = leaves.groupBy(instance, union_of).agg(F.when(F.col(union_of).isNull(), F.bool_and(ok)).otherwise(F.bool_or(ok)).alias("_ok"))
    return per_union.groupBy(instance).agg(F.bool_and("_ok").alias("valid"))
