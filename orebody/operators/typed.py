"""Instances as rows: types, members and memory as tables (X3), reads of typed requests (P12), variables that use a type by members.

An instance is a row with type_id and address, and columns of its own beside them. What one answers about itself, its members, what it points
at or its value is a join with the catalog's tables or the image's pages, for all rows at once. A third of the rows may have one type: joins with the
catalog are dealt over SALTS tasks a type. Nothing here looks at rows on the driver; loops run over the steps of the longest path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.functions.filters import KINDS, LEXICAL
from orebody.operators.graph import SALTS, closure
from orebody.operators.instances import moved
from orebody.operators.store import by_sorting, cut, discard
from orebody.plans.pathql import _READ, integer, read_bytes, real, text_value

REALS = {"Float": 4, "Double": 8}
STRUCTURED = ("Struct", "Union")
LINE = 16  # bytes on a line of a raw read
FEW = 20_000  # types of a catalog, counted, whose names are broadcast
HOT = 100_000  # users of a type from which on its joins are dealt over SALTS tasks


def _from_hex(c: Column) -> Column:
    """A long from hexadecimal digits, with or without 0x; 64-bit ones as the long with their bits."""
    digits = F.lpad(F.regexp_replace(F.lower(c), "^0x", ""), 16, "0")
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("bigint")
    return F.call_function("shiftleft", half(1), F.lit(32)).bitwiseOR(half(9))


class TypeTables:
    """A catalog as tables.

    types: type_id, kind (as in `pathql`), name, size, ref_type, length; members: type_id, idx, name, offset, ref_type; candidates: type_id, idx, no
    (from 1), ref_type: other types that a member may have. A member without a name whose type is a struct or union lends its members to
    the type that holds it, as in C. Types that name each other in a circle of typedefs are an error.

    shapes: type_id, name, and bare_id, kind, size, ref_type, length of the type behind const, volatile and typedefs, and pointees, the types
    behind a pointer one after another. fields: bare_id, idx, name, offset, ref_type, n_candidates, only_candidate, and the pointees of the type that
    a member is followed with; inner ones keep the idx of the anonymous member."""

    def __init__(self, types: DataFrame, members: DataFrame, candidates: DataFrame | None = None) -> None:
        bit = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v)])
        ends = closure(types.select("type_id", F.coalesce(bit[F.col("kind")], F.lit(0)).alias("kind"), F.col("ref_type").alias("ref_type_id")), LEXICAL)
        bare = types.select(F.col("type_id").alias("end_id"), "kind", F.col("name").alias("bare_name"), "size", "ref_type", "length")
        self.types, self.members = types, members
        shapes = cut(types.select("type_id", "name").join(ends.select("type_id", "end_id"), "type_id").join(bare, "end_id").withColumnRenamed("end_id", "bare_id"))
        self.shapes = cut(shapes.join(self._pointees(shapes), "type_id", "left").withColumn("pointees", F.coalesce("pointees", F.array().cast("array<bigint>"))))
        none = members.select("type_id", "idx", F.lit(0).alias("no"), "ref_type").filter("false")
        self.candidates = none if candidates is None else candidates.select("type_id", "idx", "no", "ref_type")
        tally = self.candidates.groupBy("type_id", "idx").agg(F.count("*").alias("n_candidates"), F.min("ref_type").alias("_only"))
        own = members.select("type_id", "idx", "name", "offset", "ref_type").join(tally, ["type_id", "idx"], "left")
        own = own.select(F.col("type_id").alias("bare_id"), "idx", F.coalesce("name", F.lit("")).alias("name"), "offset", "ref_type", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.when(F.col("n_candidates") == 1, F.col("_only")).alias("only_candidate"))
        self.direct = cut(own)
        self.fields = self._lent()

    def _pointees(self, shapes: DataFrame) -> DataFrame:
        """type_id, pointees: for each pointer the types behind it, one after another, up to the first that is no pointer, or void."""
        step = shapes.filter("kind = 'Pointer' and ref_type is not null").select("type_id", "ref_type")
        levels = [cut(step.select("type_id", F.col("ref_type").alias("to")))]
        onward, most = step.select(F.col("type_id").alias("to"), F.col("ref_type").alias("_next")), levels[0].count()
        while not levels[-1].isEmpty():
            if len(levels) > most:  # a way longer than there are pointers
                raise ValueError("pointers to pointers run in a circle")
            levels.append(cut(levels[-1].join(onward, "to").select("type_id", F.col("_next").alias("to"))))
        ways = reduce(DataFrame.unionByName, [df.withColumn("n", F.lit(n)) for n, df in enumerate(levels)])
        return ways.groupBy("type_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "to"))), lambda x: x["to"]).alias("pointees"))  # one type's stars

    def _lent(self) -> DataFrame:
        """Members by name, those of anonymous structs and unions at all depths among them; of two with one name the outer one."""
        inner = self.shapes.filter(F.col("kind").isin(*STRUCTURED)).select(F.col("type_id").alias("ref_type"), F.col("bare_id").alias("_in"))
        bodies = self.direct.select(F.col("bare_id").alias("_in"), "name", F.col("offset").alias("_o"), F.col("ref_type").alias("_r"), "n_candidates", "only_candidate")
        levels = [self.direct.withColumn("_d", F.lit(0))]
        most = self.direct.filter("name = ''").select("bare_id").distinct().count()
        for d in range(1, most + 2):  # one more than a way without a repeated type can have
            held = levels[-1].filter("name = ''").select("bare_id", "idx", "offset", "ref_type").join(inner, "ref_type")
            nxt = cut(held.join(bodies, "_in").select("bare_id", "idx", "name", (F.col("offset") + F.col("_o")).alias("offset"), F.col("_r").alias("ref_type"), "n_candidates", "only_candidate", F.lit(d).alias("_d")))
            if nxt.isEmpty():
                break
            levels.append(nxt)
        else:
            raise ValueError("types hold each other in a circle")
        named = reduce(DataFrame.unionByName, levels).filter("name <> ''")
        rest = ("idx", "offset", "ref_type", "n_candidates", "only_candidate")
        named = named.groupBy("bare_id", "name").agg(F.min(F.struct("_d", *rest)).alias("m")).select("bare_id", "name", *[F.col(f"m.{c}").alias(c) for c in rest])
        behind = self.shapes.select(F.col("type_id").alias("_type"), "pointees")
        return cut(named.withColumn("_type", F.coalesce("only_candidate", "ref_type")).join(behind, "_type", "left").drop("_type"))

    def release(self) -> None:
        """Delete the tables made here, when nothing reads them any more."""
        discard(self.shapes, self.direct, self.fields)


def _looked_up(rows: DataFrame, table: DataFrame, keys: dict[str, str]) -> DataFrame:
    """rows with the columns of a catalog's table, null where there is none. keys: column of rows -> column of the table. A hot key's rows are dealt
    over SALTS tasks, to each of which the table's rows go."""
    t = table.select([F.col(c).alias(f"_t_{c}") for c in table.columns]).withColumn("_t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("address"), F.lit(SALTS)).cast("int"))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_t_{v}") for k, v in keys.items()], F.col("_salt") == F.col("_t_salt"))
    return dealt.join(t, on, "left").drop("_salt", "_t_salt")


class Instances:
    """Rows with type_id and address; `full_name` names the way to each. Columns that begin with `_` are the operators' own.

    An instance without a type (an unknown type, a member that isn't there, a null pointer) keeps its row with null type_id and address, and
    all that follows from it is null. Repeated rows stay repeated; empty tables give empty tables."""

    def __init__(self, rows: DataFrame, tables: TypeTables, pages: DataFrame | None = None, page: int = 4096) -> None:
        rows = rows if "full_name" in rows.columns else rows.withColumn("full_name", F.lit(""))
        self.rows, self.tables, self.pages, self.page = rows, tables, pages, page

    def _with(self, rows: DataFrame) -> Instances:
        return Instances(rows, self.tables, self.pages, self.page)

    def _shaped(self) -> DataFrame:
        return _looked_up(self.rows, self.tables.shapes, {"type_id": "type_id"})

    def _settled(self, rows: DataFrame, type_id: Column, address: Column, name: Column, more: list[str] | None = None) -> Instances:
        kept = [F.col(c) for c in [*self.rows.columns, *(more or [])] if c not in ("type_id", "address", "full_name")]
        known = type_id.isNotNull() & address.isNotNull()
        return self._with(rows.select(*kept, F.when(known, type_id).alias("type_id"), F.when(known, address).alias("address"), name.alias("full_name")))

    # --- what an instance says of itself

    def described(self) -> DataFrame:
        """The rows with type_name, kind, size, array_length (-1 for others), member_count, is_number, is_integer, is_real, is_valid, is_null, name and
        parent_name (the last component of the full name, and what stands before it)."""
        count = self.tables.direct.groupBy("bare_id").agg(F.count("*").alias("member_count"))
        shaped = self._shaped().withColumn("bare", F.col("_t_bare_id"))
        told = {"type_name": F.col("_t_name"), "kind": F.col("_t_kind"), "size": F.col("_t_size")}
        told["array_length"] = F.when(F.col("_t_kind") == "Array", F.coalesce("_t_length", F.lit(-1))).when(F.col("_t_kind").isNotNull(), -1).cast("bigint")
        whole = F.col("_t_kind").rlike("^U?Int(8|16|32|64)$")
        told |= {"is_integer": F.coalesce(whole, F.lit(False)), "is_real": F.coalesce(F.col("_t_kind").isin(*REALS), F.lit(False))}
        rows = shaped.select(*[F.col(c) for c in self.rows.columns], F.col("bare").alias("_bare"), *[v.alias(k) for k, v in told.items()])
        rows = _looked_up(rows, count, {"_bare": "bare_id"}).withColumn("member_count", F.coalesce("_t_member_count", F.lit(0)))
        last = F.regexp_extract("full_name", r"([^.]*)$", 1)
        return rows.withColumns({
            "is_number": F.col("is_integer") | F.col("is_real"), "is_valid": F.col("type_name").isNotNull(), "is_null": F.coalesce(F.col("address") == 0, F.lit(True)),
            "name": last, "parent_name": F.regexp_replace(F.regexp_replace("full_name", r"[^.]*$", ""), r"\.$", ""),
        }).drop("_bare", "_t_bare_id", "_t_member_count")

    def member_names(self) -> DataFrame:
        """The rows with `member_names`, in order; an empty array without members. The array is one type's members, not the rows'."""
        names = self.tables.direct.groupBy("bare_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda m: m["name"]).alias("names"))
        rows = self._shaped().select(*self.rows.columns, F.col("_t_bare_id").alias("_bare"))
        return _looked_up(rows, names, {"_bare": "bare_id"}).withColumn("member_names", F.coalesce("_t_names", F.array().cast("array<string>"))).drop("_bare", "_t_bare_id", "_t_names")

    # --- instances from instances

    def element(self, index: Column | int) -> Instances:
        """Arrays: the element at an index, which isn't held against the length; pointers: what lies that many elements behind the target."""
        i = F.lit(index) if isinstance(index, int) else index
        rows = self._shaped().withColumn("_i", i.cast("bigint")).withColumn("_e", F.when(F.col("_t_kind").isin("Array", "Pointer"), F.col("_t_ref_type"))).withColumnRenamed("_t_kind", "_k").drop(*[f"_t_{c}" for c in self.tables.shapes.columns if c != "kind"])
        rows = self._pointed(rows.withColumn("_go", F.col("_k") == "Pointer"))
        rows = _looked_up(rows, self.tables.shapes.select("type_id", "size"), {"_e": "type_id"})
        return self._settled(rows, F.col("_t_type_id"), moved(F.col("_at"), F.col("_t_size") * F.col("_i")), F.concat("full_name", F.lit("["), F.col("_i").cast("string"), F.lit("]")))

    def _pointed(self, rows: DataFrame) -> DataFrame:
        """rows with `_at`: where `_go` holds what the pointer at `address` holds (null for 0 or without a page), else the address."""
        if self.pages is None:
            raise ValueError("to follow pointers, pages are needed")
        stay = rows.filter(~F.coalesce("_go", F.lit(False))).withColumn("_at", F.col("address"))
        go = read_bytes(rows.filter("_go"), "address", 8, self.pages, "_b", self.page).withColumn("_at", F.nullif(integer(F.col("_b"), 8, False), F.lit(0).cast("bigint"))).drop("_b")
        return stay.unionByName(go)

    def dereferenced(self, levels: int | None = None) -> Instances:
        """Pointers followed, at most `levels` times; all others as they are. Pointers to no type (void) stay pointers."""
        rows = self._shaped().select(*self.rows.columns, F.col("_t_pointees").alias("_to"))
        return self._followed(rows, levels)

    def _followed(self, rows: DataFrame, levels: int | None = None) -> Instances:
        """rows with `_to`, the types behind their pointers one after another: written, then one read of memory a level, for the rows that have it."""
        rows = cut(rows)
        most = rows.agg(F.max(F.size("_to"))).first()[0] or 0
        for level in range(most if levels is None else min(most, levels)):
            rows = rows if level == 0 else cut(rows)
            go = (F.size("_to") > level) & F.col("address").isNotNull()
            rows = self._pointed(rows.withColumn("_go", F.coalesce(go, F.lit(False))))
            kind = F.when(F.col("_go"), F.col("_to")[level]).otherwise(F.col("type_id"))
            rows = rows.withColumns({"type_id": F.when(F.col("_at").isNotNull(), kind), "address": F.col("_at")}).drop("_go", "_at")
        return self._with(rows.select(*self.rows.columns))

    def member(self, name: str | Column, declared: bool = False, candidate: int | Column | None = None) -> Instances:
        """The member of a name, also out of anonymous members. With its only candidate type, if it has just one, and pointers followed; `declared`: with
        its declared type and no pointer followed; `candidate`: with its candidate of that number (from 1)."""
        wanted = F.lit(name) if isinstance(name, str) else name
        rows = self._shaped().select(*self.rows.columns, F.col("_t_bare_id").alias("_bare"), wanted.alias("_name"), (F.lit(None) if candidate is None else F.lit(candidate)).cast("int").alias("_no"))
        rows = _looked_up(rows, self.tables.fields, {"_bare": "bare_id", "_name": "name"})
        path = F.when(F.col("full_name") == "", F.col("_name")).otherwise(F.concat("full_name", F.lit("."), F.col("_name")))
        if candidate is not None:
            rows = rows.select(*self.rows.columns, "_bare", "_name", F.col("_t_idx").alias("_idx"), F.col("_t_offset").alias("_offset"), "_no")
            rows = _looked_up(rows, self.tables.candidates, {"_bare": "type_id", "_idx": "idx", "_no": "no"})
            return self._settled(rows, F.col("_t_ref_type"), moved(F.col("address"), F.col("_offset")), path)
        kind = F.col("_t_ref_type") if declared else F.coalesce("_t_only_candidate", "_t_ref_type")
        out = self._settled(rows.withColumn("_to", F.col("_t_pointees")), kind, moved(F.col("address"), F.col("_t_offset")), path, ["_to"])
        return self._with(out.rows.drop("_to")) if declared else self._followed(out.rows)

    def all_members(self, declared: bool = False) -> Instances:
        """One row for each direct member, with its `idx`; anonymous ones have no name. Types follow as in `member`, pointers aren't followed."""
        rows = self._shaped().select(*[c for c in self.rows.columns if c != "idx"], F.col("_t_bare_id").alias("_bare"))
        rows = _looked_up(rows, self.tables.direct, {"_bare": "bare_id"}).filter("_t_idx is not null").withColumn("idx", F.col("_t_idx"))
        kind = F.col("_t_ref_type") if declared else F.coalesce("_t_only_candidate", "_t_ref_type")
        path = F.when(F.col("full_name") == "", F.col("_t_name")).otherwise(F.concat("full_name", F.lit("."), F.col("_t_name")))
        return self._with(self.rows.withColumn("idx", F.lit(0)))._settled(rows, kind, moved(F.col("address"), F.col("_t_offset")), path)

    def of_member(self, name: str | Column) -> DataFrame:
        """The rows with member_exists, member_offset (-1 if there is none), member_type (declared; 0 if there is none) and n_candidates."""
        wanted = F.lit(name) if isinstance(name, str) else name
        rows = self._shaped().select(*self.rows.columns, F.col("_t_bare_id").alias("_bare"), wanted.alias("_name"))
        rows = _looked_up(rows, self.tables.fields, {"_bare": "bare_id", "_name": "name"})
        return rows.select(*self.rows.columns, F.col("_t_name").isNotNull().alias("member_exists"), F.coalesce("_t_offset", F.lit(-1)).alias("member_offset"), F.coalesce("_t_ref_type", F.lit(0)).alias("member_type"), F.coalesce("_t_n_candidates", F.lit(0)).alias("n_candidates"))

    def retyped(self, to: int | str) -> Instances:
        """Every row with the type of an id or of a name; a name that no type or several types have is an error. Addresses stay."""
        same = self.tables.types.filter(F.col("type_id" if isinstance(to, int) else "name") == to).select("type_id").limit(2).collect()
        if len(same) != 1:
            raise ValueError(f"{'ambiguous' if same else 'unknown'} type: {to}")
        return self._with(self.rows.withColumn("type_id", F.lit(same[0][0]).cast("bigint")))

    # --- values

    def values(self) -> DataFrame:
        """The rows with type_name, accessible, and the value as `integer` (also of pointers; 64-bit ones with their bits), `real` or `text` (arrays of
        single bytes of a page at most, up to the first NUL; 256 bytes without a length); structs and other arrays have none, and are
        accessible if their first byte is."""
        if self.pages is None:
            raise ValueError("to read values, pages are needed")
        rows = self._shaped().select(*self.rows.columns, F.col("_t_name").alias("type_name"), F.col("_t_kind").alias("_kind"), F.col("_t_length").alias("_length"), F.col("_t_ref_type").alias("_ref"))
        rows = _looked_up(rows, self.tables.shapes.select("type_id", "size"), {"_ref": "type_id"})
        text = (F.col("_kind") == "Array") & (F.col("_t_size") == 1)
        sizes = F.create_map(*[F.lit(x) for k, s in ({k: v[0] for k, v in _READ.items()} | REALS).items() for x in (k, s)])
        size = F.when(text, F.when(F.col("_length") > 0, F.col("_length")).otherwise(256)).otherwise(F.coalesce(sizes[F.col("_kind")], F.lit(1))).cast("int")
        rows = rows.withColumn("_text", text).withColumn("_size", size).drop("_t_type_id", "_t_size", "_ref", "_length")
        read = read_bytes(rows, "address", F.col("_size"), self.pages, "_b", self.page)
        whole = F.coalesce(*[F.when(F.col("_kind").isin(*[k for k, v in _READ.items() if v == (n, s)]), integer(F.col("_b"), n, s)) for n, s in sorted(set(_READ.values()))])
        reals = F.coalesce(*[F.when(F.col("_kind") == k, real(F.col("_b"), n)) for k, n in REALS.items()])
        got = F.col("_b").isNotNull()
        return read.select(*self.rows.columns, "type_name", got.alias("accessible"), F.when(got, whole).alias("integer"), F.when(got, reals).alias("real"), F.when(got & F.col("_text"), text_value(F.col("_b"))).alias("text"))


def as_integer(value: Column, bits: int, signed: bool) -> Column:
    """A long cut to its lowest 8, 16 or 32 bits, as a signed or unsigned number; with 64 as it is."""
    if bits == 64:
        return value
    low = value.bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low) if signed else low


# --- P12


def parsed_requests(requests: DataFrame, spec: str = "spec") -> DataFrame:
    """`type(.member)* [length] @ address` as _type, _path (an array), _length and _address (hexadecimal, with or without 0x); all null for another
    text. The length is decimal."""
    halves = F.split(F.col(spec), "@")
    left, at = F.trim(halves[0]), F.lower(F.trim(halves[1]))
    words = F.split(left, r"\s+")
    good = (F.size(halves) == 2) & at.rlike("^(0x)?[0-9a-f]{1,16}$") & left.rlike(r"^[A-Za-z0-9_]+(\.[A-Za-z_][A-Za-z0-9_]*)*(\s+[0-9]{1,9})?$")
    parts = F.split(words[0], r"\.")
    return requests.withColumns({"_type": F.when(good, parts[0]), "_path": F.when(good, F.slice(parts, 2, 1000)), "_length": F.when(good & (F.size(words) > 1), F.try_element_at(words, F.lit(2))).cast("int"), "_address": F.when(good, _from_hex(at))})


def typed_reads(requests: DataFrame, key: str, tables: TypeTables, pages: DataFrame, page: int = 4096, spec: str = "spec") -> DataFrame:
    """What each request of a table reads: key, line (from 0), type_name, address, integer, real, text, error.

    A request is `type(.member)* [length] @ address`. char, int and long read 1, 4 and 8 signed bytes; raw and hex read `length` bytes, one row for 16
    bytes with them in hexadecimal as `text`, so that a long read is no long row; any other name, or else a hexadecimal id, is a type of the catalog,
    from which members are followed as by `Instances.member`. Errors are texts: malformed, no length, unknown type, ambiguous type, no
    member or not mapped (one of the path's members isn't there, or a pointer leads nowhere), cannot read. A null request is malformed; a length
    of 0 reads no rows. key names rows: repeated ones give repeated results."""
    asked = cut(parsed_requests(requests.select(key, F.col(spec).alias("spec"))))
    result = lambda df, **given: df.select(key, *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("line", "int"), ("type_name", "string"), ("address", "bigint"), ("integer", "bigint"), ("real", "double"), ("text", "string"), ("error", "string"))])
    zero = F.lit(0)
    bad = result(asked.filter("_type is null"), line=zero, error=F.lit("malformed"))
    # bytes: a request's lines are spread as rows before anything is read
    raw = asked.filter("_type in ('raw', 'hex')")
    nameless = result(raw.filter("_length is null"), line=zero, type_name=F.col("_type"), address=F.col("_address"), error=F.lit("no length"))
    lines = raw.filter("_length > 0").withColumn("_line", F.explode(F.sequence(zero, F.floor((F.col("_length") - 1) / LINE).cast("int"))))
    lines = lines.withColumn("_at", moved(F.col("_address"), F.col("_line") * LINE)).withColumn("_n", F.least(F.lit(LINE), F.col("_length") - F.col("_line") * LINE))
    got = read_bytes(lines, "_at", F.col("_n"), pages, "_b", page)
    pairs = F.trim(F.regexp_replace(F.lower(F.hex("_b")), "(..)", "$1 "))
    raw_rows = result(got, line=F.col("_line"), type_name=F.col("_type"), address=F.col("_at"), text=pairs, error=F.when(F.col("_b").isNull(), "cannot read"))
    # plain numbers
    plain = {"char": 1, "int": 4, "long": 8}
    basic = asked.filter(F.col("_type").isin(*plain)).withColumn("_n", F.create_map(*[F.lit(x) for kv in plain.items() for x in kv])[F.col("_type")])
    basic = read_bytes(basic, "_address", F.col("_n"), pages, "_b", page)
    number = F.coalesce(*[F.when(F.col("_type") == k, integer(F.col("_b"), n, True)) for k, n in plain.items()])
    basic_rows = result(basic, line=zero, type_name=F.col("_type"), address=F.col("_address"), integer=F.when(F.col("_b").isNotNull(), number), error=F.when(F.col("_b").isNull(), "cannot read"))
    # types of the catalog, by name, else by id
    typed = asked.filter(~F.col("_type").isin("raw", "hex", *plain))
    names = tables.types.groupBy(F.col("name").alias("_type")).agg(F.count("*").alias("_same"), F.min("type_id").alias("_id"))
    ids = tables.types.select(F.col("type_id").alias("_hex_id"), F.col("type_id").alias("_by_id"))
    hexed = F.when(F.col("_type").rlike("^(0[xX])?[0-9a-fA-F]{1,16}$"), _from_hex(F.col("_type")))
    if tables.types.limit(FEW + 1).count() <= FEW:  # requests name few types: a join that shuffles them has as many tasks as there are names
        names, ids = F.broadcast(names), F.broadcast(ids)
    found = typed.join(names, "_type", "left").withColumn("_hex_id", F.when(F.col("_same").isNull(), hexed)).join(ids, "_hex_id", "left")
    wrong = F.when(F.col("_same") > 1, "ambiguous type").when(F.col("_same").isNull() & F.col("_by_id").isNull(), "unknown type")
    found = cut(found.withColumn("_error", wrong).withColumn("type_id", F.coalesce("_id", "_by_id")))
    lost = result(found.filter("_error is not null"), line=zero, address=F.col("_address"), error=F.col("_error"))
    now = Instances(found.filter("_error is null").select(key, "_path", F.col("_address").alias("address"), "type_id"), tables, pages, page)
    longest = now.rows.agg(F.max(F.size("_path"))).first()[0] or 0
    done = []
    for step in range(longest):
        done.append(now.rows.filter(F.size("_path") == step))
        now = now._with(now.rows.filter(F.size("_path") > step)).member(F.try_element_at(F.col("_path"), F.lit(step + 1)))
    ends = now._with(reduce(DataFrame.unionByName, [d.select(*now.rows.columns) for d in done], now.rows)).values()
    error = F.when(F.col("type_id").isNull(), "no member or not mapped").when(~F.col("accessible"), "cannot read")
    typed_rows = result(ends, line=zero, type_name=F.col("type_name"), address=F.col("address"), integer=F.col("integer"), real=F.col("real"), text=F.col("text"), error=error)
    return reduce(DataFrame.unionByName, [bad, nameless, raw_rows, basic_rows, lost, typed_rows])


# --- J5


def variables_using(wanted: DataFrame, types: DataFrame, members: DataFrame, variables: DataFrame, most: int = 30, depth: int = 5) -> DataFrame:
    """Wanted, var_id, path, hops: variables whose type leads to a wanted type over members.

    wanted: type_id; types: type_id, kind, ref_type; members: type_id, name, ref_type; variables: var_id, type_id. From a wanted type all types that
    refer to it (pointers, arrays, typedefs, ...) are found, and theirs; a variable of one of these counts. Structs and unions with a member of such a
    type are the next hop, and the types that refer to them go on; a struct's own variables don't count, but those of its typedefs do. A wanted type
    goes on to the next hop only while it has fewer than `most` variables, and to `depth` hops; each hop is found whole. A way doesn't
    come back to a type on it. Members without a name add nothing to the path. Repeated wanted types count once."""
    refs = types.filter(~F.col("kind").isin(*STRUCTURED)).select(F.col("ref_type").alias("type"), F.col("type_id").alias("_user")).filter("type is not null")
    holds = members.select(F.col("ref_type").alias("type"), F.col("type_id").alias("_user"), F.coalesce("name", F.lit("")).alias("_name")).filter("type is not null")
    holds = cut(holds)  # read in each hop
    own = variables.select("var_id", F.col("type_id").alias("type"))
    between = cut(refs.select(F.col("_user").alias("type")).join(by_sorting(refs.select("type")), "type", "left_semi").distinct())  # such as pointers that pointers point to
    inner = between.count()
    users = refs.select("type").unionByName(holds.select("type")).unionByName(own.select("type"))
    hot = cut(users.groupBy("type").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT).select("type", F.lit(True).alias("_hot")))  # a type in HOT users at most
    part = lambda df, by: df.join(hot, "type", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    of = lambda df: df.join(hot, "type", "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")  # noqa: E731  the ways to a hot type go to all parts of its users
    refs, holds, own = part(refs, "_user"), part(holds, "_user"), part(own, "var_id")
    front = wanted.select(F.col(wanted.columns[0]).alias("wanted")).distinct().withColumns({"type": F.col("wanted"), "path": F.array().cast("array<string>"), "seen": F.array("wanted")})
    front, found = cut(front), []
    for hop in range(depth + 1):
        level, ways = [], [front]
        step = front
        while True:  # users that aren't structs, and theirs: a user is found also where it can't be gone on from
            users = cut(of(step).join(refs, ["type", "_salt"]).select("wanted", F.col("_user").alias("type"), "path", "seen"))
            if users.isEmpty():
                break
            level.append(users)
            step = users.filter(~F.array_contains("seen", F.col("type"))).withColumn("seen", F.concat("seen", F.array("type")))
            ways.append(step)
            if not inner:
                break
            if inner <= FEW:
                step = step.join(F.broadcast(between), "type", "left_semi").select(step.columns)
        if level:
            hits = of(reduce(DataFrame.unionByName, level)).join(own, ["type", "_salt"])
            found.append(cut(hits.select("wanted", "var_id", F.array_join("path", ".").alias("path"), F.lit(hop).alias("hops"))))
        if hop == depth:
            break
        all_ways = reduce(DataFrame.unionByName, ways)
        if found:
            full = reduce(DataFrame.unionByName, found).groupBy("wanted").agg(F.count("*").alias("n")).filter(F.col("n") >= most)
            all_ways = all_ways.join(full, "wanted", "left_anti")
        up = of(all_ways).join(holds, ["type", "_salt"]).filter(~F.array_contains("seen", F.col("_user")))
        path = F.when(F.col("_name") == "", F.col("path")).otherwise(F.concat(F.array("_name"), "path"))
        front = cut(up.select("wanted", F.col("_user").alias("type"), path.alias("path"), F.concat("seen", F.array("_user")).alias("seen")))
        if front.isEmpty():
            break
    discard(holds, hot, between)
    if not found:
        return wanted.limit(0).select(F.col(wanted.columns[0]).alias("wanted")).crossJoin(variables.limit(0).select("var_id")).withColumns({"path": F.lit(""), "hops": F.lit(0)})
    return reduce(DataFrame.unionByName, found)
