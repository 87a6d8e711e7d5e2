"""Path queries (P1-P18, G13, X2-X5): dotted paths over typed objects, compiled to DataFrame plans.

    path := component ('.' component)*
    component := ['(' TYPE ['-' (MEMBER | NUMBER)] ')'] SYMBOL ['<' n '>'] ('[' i ']')*

The text is parsed and bound to the catalog on the driver. Offsets are folded into one addition; each dereference is one join with
the bytes or, for tables linked by keys, with the target table. Nothing is interpreted row by row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

class QueryError(ValueError):
    """A path that can't be read or bound."""


@dataclass(frozen=True)
class Component:
    symbol: str
    cast: str | None = None
    container: str | None = None
    candidate: int | None = None
    indexes: tuple[int, ...] = ()


class _Reader:
    """Reads one component's text from left to right."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def take(self, mark: str) -> bool:
        found = self.peek() == mark
        self.at += found
        return found

    def word(self) -> str:
        self.peek()
        start = self.at
        while self.at < len(self.text) and self.text[self.at].isascii() and (self.text[self.at].isalnum() or self.text[self.at] == "_"):
            self.at += 1
        if start == self.at:
            self.fail("a name")
        return self.text[start : self.at]

    def number(self) -> int:
        word = self.word()
        return int(word) if word.isdigit() else self.fail("a number")

    def close(self, mark: str) -> None:
        if not self.take(mark):
            self.fail(mark)

    def fail(self, wanted: str):  # noqa: ANN201
        raise QueryError(f"{wanted} expected at place {self.at} of path component {self.text!r}")


def _component(text: str) -> Component:
    r = _Reader(text)
    cast = container = candidate = None
    if r.take("("):
        cast = r.word()
        if r.take("-"):
            container = r.word()
        r.close(")")
    symbol = r.word()
    if r.take("<"):
        candidate = r.number()
        r.close(">")
    indexes = []
    while r.take("["):
        indexes.append(r.number())
        r.close("]")
    if r.peek():
        r.fail("the end")
    return Component(symbol, cast, container, candidate, tuple(indexes))


def parse_path(text: str) -> list[Component]:
    """The components of a path; an empty path has none."""
    return [_component(part) for part in text.split(".")] if text.strip() else []


# --- catalogs held on the driver: types are few (one row per struct of a program), data are not


@dataclass
class Member:
    name: str
    offset: int
    type_id: int
    bit_size: int = -1
    bit_offset: int = -1
    alternatives: list[tuple[int, Column | None]] = field(default_factory=list)


@dataclass
class Type:
    type_id: int
    kind: str
    name: str
    size: int
    ref: int | None = None
    length: int | None = None
    members: list[Member] = field(default_factory=list)


WRAPPERS = ("Const", "Volatile", "Typedef")
_READ = {"Int8": (1, True), "UInt8": (1, False), "Bool8": (1, False), "Int16": (2, True), "UInt16": (2, False), "Bool16": (2, False), "Int32": (4, True), "UInt32": (4, False), "Bool32": (4, False), "Enum": (4, True), "Int64": (8, True), "UInt64": (8, False), "Bool64": (8, False), "Pointer": (8, False), "FuncPointer": (8, False)}


class Catalog:
    """Types by id and name."""

    def __init__(self, types: list[Type]) -> None:
        self.types = {t.type_id: t for t in types}

    def by_name(self, name: str) -> Type:
        found = [t for t in self.types.values() if t.name == name]
        if not found and re.fullmatch(r"(0x)?[0-9a-fA-F]+", name) and int(name, 16) in self.types:
            return self.types[int(name, 16)]
        if len(found) != 1:
            raise QueryError(f"{'ambiguous type' if found else 'unknown type'}: {name}")
        return found[0]

    def bare(self, type_id: int) -> Type:
        """Through const, volatile and typedef."""
        t = self.types[type_id]
        for _ in range(64):
            if t.kind not in WRAPPERS or t.ref is None:
                return t
            t = self.types[t.ref]
        raise QueryError("typedefs run in a circle")

    def member(self, t: Type, name: str) -> tuple[int, Member]:
        """Offset and member by name, also inside anonymous structs and unions."""
        for m in t.members:
            if m.name == name:
                return m.offset, m
        for m in t.members:
            inner = self.bare(m.type_id)
            if not m.name and inner.members:
                try:
                    off, found = self.member(inner, name)
                    return m.offset + off, found
                except QueryError:
                    continue
        raise QueryError(f"{t.name} has no member {name}")

    def offset(self, t: Type, path: str) -> int:
        """P10: offset of a dotted member path; -1 if there is none."""
        total = 0
        for name in path.split("."):
            try:
                off, m = self.member(t, name)
            except QueryError:
                return -1
            total, t = total + off, self.bare(m.type_id)
        return total

    def at_offset(self, t: Type, offset: int, exact: bool = False) -> str | None:
        """The path of the innermost member at an offset."""
        best = None
        for m in t.members:
            inner = self.bare(m.type_id)
            if m.offset == offset or (not exact and m.offset <= offset < m.offset + max(1, inner.size)):
                deeper = self.at_offset(inner, offset - m.offset, exact) if inner.members else None
                best = m.name if not deeper else f"{m.name}.{deeper}" if m.name else deeper
                break
        return best

    def flattened(self, t: Type, prefix: tuple[str, ...] = (), base: int = 0) -> list[tuple[str, int, Type, Member]]:
        """Every leaf: path, offset, type, member; anonymous members add nothing to a path."""
        out = []
        for m in t.members:
            inner = self.bare(m.type_id)
            path = (*prefix, m.name) if m.name else prefix
            if inner.members:
                out += self.flattened(inner, path, base + m.offset)
            else:
                out.append((".".join(path), base + m.offset, inner, m))
        return out


def read_bytes(rows: DataFrame, address: str, size: int, pages: DataFrame, out: str, page: int = 4096) -> DataFrame:
    """`size` (a page at most) bytes at each row's address from pages(frame, data); null where a page is missing.

    Rows that stay in a page join it once and take their bytes from it there; only those that cross into the next one join that as well."""
    shift = page.bit_length() - 1
    inside = F.pmod(F.col(address), F.lit(page)).cast("int")
    p0, p1 = pages.select(F.col("frame").alias("_f0"), F.col("data").alias("_d0")), pages.select(F.col("frame").alias("_f1"), F.col("data").alias("_d1"))
    placed = rows.withColumn("_f0", F.call_function("shiftrightunsigned", F.col(address), F.lit(shift)))
    whole = lambda c: F.when(F.length(c) == size, c)
    within = placed.filter((inside + size <= page) | F.col(address).isNull()).join(p0, "_f0", "left")
    within = within.withColumn(out, F.substring("_d0", inside + 1, F.lit(size))).withColumn(out, whole(F.col(out))).drop("_f0", "_d0")
    crossing = placed.filter(inside + size > page).join(p0, "_f0", "left").withColumn("_b0", F.substring("_d0", inside + 1, F.lit(size))).drop("_d0")
    crossing = crossing.withColumn("_f1", F.col("_f0") + 1).join(p1, "_f1", "left")
    both = F.concat("_b0", F.substring("_d1", F.lit(1), size - (page - inside)))
    return within.unionByName(crossing.withColumn(out, whole(both)).drop("_f0", "_f1", "_b0", "_d1"))


def integer(data: Column, size: int, signed: bool) -> Column:
    """A little-endian integer; 64-bit ones as the long with their bits."""
    digits = F.array_join(F.reverse(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.hex(F.substring(data, i, F.lit(1))))), "")
    half = lambda a, n: F.conv(F.substring(digits, a, n), 16, 10).cast("bigint")
    if size < 8:
        v = half(1, 2 * size)
        return F.when(v >= 1 << (8 * size - 1), v - (1 << (8 * size))).otherwise(v) if signed else v
    high = half(1, 8)
    return F.call_function("shiftleft", high, F.lit(32)).bitwiseOR(half(9, 8))


def real(data: Column, size: int) -> Column:
    """An IEEE number from its little-endian bytes, by its parts."""
    bits = integer(data, size, False)
    e_bits, m_bits, bias = (8, 23, 127) if size == 4 else (11, 52, 1023)
    sign = F.when(F.call_function("shiftrightunsigned", bits, F.lit(e_bits + m_bits)).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    e = F.call_function("shiftrightunsigned", bits, F.lit(m_bits)).bitwiseAND(F.lit((1 << e_bits) - 1))
    m = bits.bitwiseAND(F.lit((1 << m_bits) - 1)).cast("double") / float(1 << m_bits)
    special = (1 << e_bits) - 1
    value = F.when(e == special, F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).when(e == 0, m * F.pow(F.lit(2.0), F.lit(1 - bias))).otherwise((1 + m) * F.pow(F.lit(2.0), e - bias))
    return sign * value


def text_value(data: Column) -> Column:
    """Bytes up to the first NUL, unprintable ones as dots."""
    codes = F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))
    end = F.array_position(codes, 0)
    kept = F.slice(codes, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(codes)).cast("int"))
    return F.when(F.length(data) == 0, "").otherwise(F.array_join(F.transform(kept, lambda c: F.when(c.between(32, 126), F.char(c)).otherwise(".")), ""))


@dataclass
class Bound:
    """What a path has been bound to so far: a plan with an address column, and the type there."""

    rows: DataFrame
    type: Type
    address: Column
    name: list[str]


class Engine:
    """Path queries over a catalog, named roots and an image: variables name -> (address, type_id)."""

    def __init__(self, catalog: Catalog, variables: dict[str, tuple[int, int]], pages: DataFrame, dump: int = 0) -> None:
        self.catalog, self.variables, self.pages, self.dump = catalog, variables, pages, dump

    def roots(self) -> DataFrame:
        """All named roots."""
        rows = [(n, a, self.catalog.types[t].name) for n, (a, t) in sorted(self.variables.items())]
        return self.pages.sparkSession.createDataFrame(rows, "name string, address bigint, type string")

    def instance(self, path: str, rules: dict[tuple[str, str], int] | None = None, alternatives: bool = True) -> DataFrame:
        """One row: name, type, address. rules: (type, member) -> type id, tried before alternatives."""
        b = self._bind(path, rules or {}, alternatives)
        return b.rows.select(F.lit(".".join(b.name)).alias("name"), F.lit(b.type.name).alias("type"), b.address.alias("address"))

    def value(self, path: str, **how) -> DataFrame:  # noqa: ANN003
        """The instance with its value as text, integer or real."""
        b = self._bind(path, how.get("rules") or {}, how.get("alternatives", True))
        return self.read(b).select(F.lit(".".join(b.name)).alias("name"), F.lit(b.type.name).alias("type"), b.address.alias("address"), "value")

    def read(self, b: Bound) -> DataFrame:
        t = self.catalog.bare(b.type.type_id)
        rows = b.rows.withColumn("_addr", b.address)
        if t.kind == "Array" and t.ref is not None and self.catalog.bare(t.ref).size == 1:
            n = t.length if t.length and t.length > 0 else 256
            return read_bytes(rows, "_addr", n, self.pages, "_b").withColumn("value", text_value(F.col("_b")))
        if t.kind in ("Float", "Double"):
            return read_bytes(rows, "_addr", t.size, self.pages, "_b").withColumn("value", real(F.col("_b"), t.size))
        if t.kind not in _READ:
            return rows.withColumn("value", F.lit(None).cast("bigint"))
        size, signed = _READ[t.kind]
        return read_bytes(rows, "_addr", size, self.pages, "_b").withColumn("value", integer(F.col("_b"), size, signed))

    def _pointer(self, b: Bound) -> Bound:
        """Follow one pointer."""
        t = self.catalog.bare(b.type.type_id)
        rows = read_bytes(b.rows.withColumn("_addr", b.address), "_addr", 8, self.pages, "_b").select(integer(F.col("_b"), 8, False).alias("_a")).filter("_a is not null and _a <> 0")
        if t.ref is None:
            raise QueryError(f"{'.'.join(b.name)} points to nothing known")
        return Bound(rows, self.catalog.types[t.ref], F.col("_a"), b.name)

    def _bind(self, path: str, rules: dict[tuple[str, str], int], alternatives: bool) -> Bound:
        parts = parse_path(path)
        if not parts:
            raise QueryError("an empty path names no instance")
        b: Bound | None = None
        for p in parts:
            if b is None:
                if p.symbol not in self.variables:
                    raise QueryError(f"unknown variable {p.symbol}")
                address, type_id = self.variables[p.symbol]
                b = Bound(self.pages.sparkSession.range(1).select(), self.catalog.types[type_id], F.lit(address).cast("bigint"), [p.symbol])
            else:
                while self.catalog.bare(b.type.type_id).kind == "Pointer":
                    b = self._pointer(b)
                t = self.catalog.bare(b.type.type_id)
                if not t.members:
                    raise QueryError(f"{'.'.join(b.name)} is no struct")
                off, m = self.catalog.member(t, p.symbol)
                type_id = m.type_id
                if (t.name, p.symbol) in rules and p.candidate != 0:
                    type_id = rules[t.name, p.symbol]
                elif alternatives and p.candidate != 0 and m.alternatives:
                    if p.candidate is not None:
                        if p.candidate > len(m.alternatives):
                            raise QueryError(f"{p.symbol} has no candidate {p.candidate}")
                        type_id = m.alternatives[p.candidate - 1][0]
                    elif len(m.alternatives) == 1:  # several: ambiguous, so the declared type stays
                        type_id = m.alternatives[0][0]
                b = Bound(b.rows, self.catalog.types[type_id], b.address + off, [*b.name, p.symbol])
            if p.cast:
                t = self.catalog.by_name(p.cast)
                if self.catalog.bare(b.type.type_id).kind == "Pointer":
                    b = self._pointer(b)
                back = 0
                if p.container:
                    back = int(p.container) if p.container.isdigit() else self.catalog.offset(t, p.container)
                    if back < 0:
                        raise QueryError(f"{t.name} has no member {p.container}")
                b = Bound(b.rows, t, b.address - back, b.name)
            for i in p.indexes:
                t = self.catalog.bare(b.type.type_id)
                if t.kind == "Pointer":
                    b = self._pointer(b)
                    b = Bound(b.rows, b.type, b.address + i * b.type.size, [*b.name[:-1], f"{b.name[-1]}[{i}]"])
                elif t.kind == "Array" and t.ref is not None:
                    if t.length is not None and t.length >= 0 and i >= t.length:
                        raise QueryError(f"index {i} is out of bounds")
                    e = self.catalog.types[t.ref]
                    b = Bound(b.rows, e, b.address + i * self.catalog.bare(e.type_id).size, [*b.name[:-1], f"{b.name[-1]}[{i}]"])
                else:
                    raise QueryError(f"{'.'.join(b.name)} is no array")
        return b

    def members(self, path: str) -> DataFrame:
        """The leaves below an instance with their values: path, offset, type, value (integers; null for others)."""
        b = self._bind(path, {}, True)
        t = self.catalog.bare(b.type.type_id)
        rows = [(p, off, leaf.name, *_READ.get(leaf.kind, (0, False)), m.bit_size, m.bit_offset) for p, off, leaf, m in self.catalog.flattened(t)]
        layout = self.pages.sparkSession.createDataFrame(rows, "path string, offset bigint, type string, size int, signed boolean, bit_size int, bit_offset int")
        data = read_bytes(b.rows.withColumn("_addr", b.address), "_addr", t.size, self.pages, "_b").select("_b")
        piece = lambda n, s: F.when((F.col("size") == n) & (F.col("signed") == s), integer(F.substring("_b", F.col("offset").cast("int") + 1, F.lit(n)), n, s))
        return layout.crossJoin(F.broadcast(data)).select("path", "offset", "type", F.coalesce(*[piece(n, s) for n in (1, 2, 4, 8) for s in (True, False)]).alias("value"))


# --- tables linked by keys: a foreign key is a pointer


@dataclass
class Edge:
    """A member that points: from table and column to table and key column."""

    table: str
    name: str
    column: str
    target: str
    key: str


class KeyPaths:
    """Paths over tables linked by keys: `lineitem.order.customer.nation.n_name`."""

    def __init__(self, tables: dict[str, DataFrame], edges: list[Edge]) -> None:
        self.tables, self.edges = tables, {(e.table, e.name): e for e in edges}

    def query(self, path: str, keep: list[str] | None = None, distinct_roots: bool = False) -> DataFrame:
        """The root's `keep` columns with what the path leads to as `value`. Each dereference is one equi-join of the columns that
        are needed; Catalyst broadcasts small targets where their size is known to allow it."""
        parts = parse_path(path)
        if not parts or parts[0].symbol not in self.tables:
            raise QueryError(f"unknown root in {path!r}")
        table = parts[0].symbol
        rows = self.tables[table]
        keep = keep or []
        cur = rows.select(*[F.col(c) for c in keep], *[F.col(c).alias(f"_c_{c}") for c in rows.columns])
        column: str | None = None
        for p in parts[1:]:
            if column is not None:
                raise QueryError(f"{column} is no pointer")
            e = self.edges.get((table, p.symbol))
            if e:
                target = self.tables[e.target].select([F.col(c).alias(f"_t_{c}") for c in self.tables[e.target].columns])
                cur = cur.join(target, F.col(f"_c_{e.column}") == F.col(f"_t_{e.key}")).select(*keep, *[F.col(f"_t_{c}").alias(f"_c_{c}") for c in self.tables[e.target].columns])
                table = e.target
            elif p.symbol in self.tables[table].columns:
                value = F.col(f"_c_{p.symbol}")
                for i in p.indexes:
                    value = F.element_at(value, i + 1)
                cur, column = cur.select(*keep, value.alias("value")), p.symbol
            else:
                raise QueryError(f"{table} has no member {p.symbol}")
        return cur if column is not None else cur.select(*keep, *[F.col(f"_c_{c}").alias(c) for c in self.tables[table].columns if c not in keep])


class PathBuilder:
    """Attribute access that spells a path: PathBuilder(engine, 'init').tasks.next -> engine.value('init.tasks.next')."""

    def __init__(self, engine: Engine, path: str) -> None:
        self._engine, self._path = engine, path

    def __getattr__(self, name: str) -> PathBuilder:
        if name.startswith("_"):
            raise AttributeError(name)
        return PathBuilder(self._engine, f"{self._path}.{name}")

    def __getitem__(self, i: int) -> PathBuilder:
        return PathBuilder(self._engine, f"{self._path}[{i}]")

    def frame(self) -> DataFrame:
        return self._engine.value(self._path)
