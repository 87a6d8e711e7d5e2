"""A small C expression compiler (E1-E14, E18): text -> tree -> Spark column, with C's integer types.

Unsigned 64-bit values are held as longs with the same bits. Arithmetic wraps, also in ANSI mode: every operation is done in decimals
and brought back into its type's range. Comparisons of unsigned values compare unsigned.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """Text that is no expression, or an operation that its types forbid."""


#: Integer types: bits and sign, in promotion order.
RANKS = {"i32": (32, True), "u32": (32, False), "i64": (64, True), "u64": (64, False)}
SMALL = {"i8": (8, True), "u8": (8, False), "i16": (16, True), "u16": (16, False)}
FLOATS = ("f32", "f64")
SIZES = {"char": ("i8", 1), "short": ("i16", 2), "int": ("i32", 4), "long": ("i64", 8), "float": ("f32", 4), "double": ("f64", 8)}

_TOKEN = re.compile(
    r"""\s*(?:(?P<float>(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?[fFlL]?|\d+[eE][+-]?\d+[fFlL]?)|(?P<int>0[xX][0-9a-fA-F]+|\d+)(?P<suffix>[uUlL]*)
    |(?P<char>'(?:\\.|[^'\\])')|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(?P<op>\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^~!<>()?:,]))""",
    re.X,
)
_LEVELS = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">="], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]
_ESCAPES = {"n": 10, "t": 9, "r": 13, "0": 0, "\\": 92, "'": 39, '"': 34, "a": 7, "b": 8, "f": 12, "v": 11}


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = field(default=())
    value: object = None
    type: str = ""


def parse(text: str) -> Node:
    """The tree of an expression."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"can't read {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return tokens[pos]["op"] if pos < len(tokens) else None

    def need(op: str) -> None:
        nonlocal pos
        if peek() != op:
            raise ExpressionError(f"{op!r} is missing in {text!r}")
        pos += 1

    def primary() -> Node:
        nonlocal pos
        if pos >= len(tokens):
            raise ExpressionError(f"{text!r} ends too early")
        m = tokens[pos]
        pos += 1
        if m["op"] == "(":
            inner = conditional()
            need(")")
            return inner
        if m["op"] in ("-", "+", "~", "!", "*", "++", "--"):
            return Node(m["op"] + "u", (primary(),))
        if m["float"]:
            return Node("const", value=float(m["float"].rstrip("fFlL")), type="f32" if m["float"][-1] in "fF" else "f64")
        if m["int"]:
            digits, suffix = m["int"], m["suffix"].lower()
            base = 16 if digits[:2].lower() == "0x" else 8 if digits[0] == "0" and len(digits) > 1 else 10
            v = int(digits, base)
            options = ["i32", "u32", "i64", "u64"] if base != 10 else ["i32", "i64", "u64"]
            if "u" in suffix:
                options = ["u32", "u64"]
            if "l" in suffix:
                options = [t for t in options if t.endswith("64")]
            for t in options:
                bits, signed = RANKS[t]
                if v < 1 << (bits - signed):
                    return Node("const", value=v, type=t)
            raise ExpressionError(f"{digits} is too large")
        if m["char"]:
            body = m["char"][1:-1]
            return Node("const", value=_ESCAPES.get(body[1], ord(body[1])) if body[0] == "\\" else ord(body), type="i32")
        if m["name"]:
            if m["name"] in ("offsetof", "__builtin_offsetof") and peek() == "(":
                pos += 1
                words = []
                while pos < len(tokens) and tokens[pos]["name"]:
                    words.append(tokens[pos]["name"])
                    pos += 1
                need(",")
                path = tokens[pos]["name"] if pos < len(tokens) else None
                if not words or not path:
                    raise ExpressionError(f"offsetof needs a type and a member in {text!r}")
                pos += 1
                need(")")
                return Node("offsetof", value=(words[-1], path))
            if m["name"] == "__builtin_types_compatible_p" and peek() == "(":
                pos += 1
                first = type_name()
                need(",")
                second = type_name()
                need(")")
                return Node("const", value=int(first.op == second.op == "type" and first.type == second.type), type="i32")
            if m["name"] == "__builtin_object_size" and peek() == "(":
                pos += 1
                conditional()
                need(",")
                which = conditional()
                need(")")
                return Node("const", value=0 if which.value in (2, 3) else (1 << 64) - 1, type="u64")  # of objects that aren't known
            if m["name"] in ("sizeof", "__alignof__", "__builtin_constant_p", "__builtin_expect", "__builtin_choose_expr") and peek() == "(":
                pos += 1
                args = [type_name() if m["name"] in ("sizeof", "__alignof__") else conditional()]
                while peek() == ",":
                    pos += 1
                    args.append(conditional())
                need(")")
                return Node(m["name"], tuple(args))
            out = Node("var", value=m["name"])
            while peek() in ("++", "--"):  # the value is the one before
                pos += 1
            return out
        raise ExpressionError(f"{m['op']!r} is out of place in {text!r}")

    def type_name() -> Node:
        nonlocal pos
        m = tokens[pos]
        if m["name"] in SIZES or m["name"] == "unsigned":
            words = []
            while pos < len(tokens) and tokens[pos]["name"]:
                words.append(tokens[pos]["name"])
                pos += 1
            stars = 0
            while peek() == "*":
                pos += 1
                stars += 1
            base = [w for w in words if w != "unsigned"] or ["int"]
            return Node("type", value=8 if stars else SIZES[base[-1]][1], type=("u" if "unsigned" in words else "") + base[-1] + "*" * stars)
        return conditional()

    def binary(level: int) -> Node:
        nonlocal pos
        if level == len(_LEVELS):
            return primary()
        left = binary(level + 1)
        while peek() in _LEVELS[level]:
            op = peek()
            pos += 1
            left = Node(op, (left, binary(level + 1)))
        return left

    def conditional() -> Node:
        nonlocal pos
        test = binary(0)
        if peek() == "?":
            pos += 1
            a = conditional()
            need(":")
            return Node("?:", (test, a, conditional()))
        return test

    out = conditional()
    if pos != len(tokens):
        raise ExpressionError(f"{tokens[pos][0]!r} is left over in {text!r}")
    return out


def promoted(t: str) -> str:
    return "i32" if t in SMALL else t


def common_type(a: str, b: str) -> str:
    """E5: double, float, then the wider rank, unsigned before signed."""
    a, b = promoted(a), promoted(b)
    for t in ("f64", "f32", "u64", "i64", "u32", "i32"):
        if t in (a, b):
            return t
    raise ExpressionError(f"no common type of {a} and {b}")


def _bits(t: str) -> tuple[int, bool]:
    return (RANKS | SMALL)[t]


def _dec(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def wrap(c: Column, t: str) -> Column:
    """Bring a decimal or long into an integer type's range; 64-bit unsigned as the long with its bits."""
    bits, signed = _bits(t)
    if bits == 64:
        d = F.pmod(c.cast("decimal(38,0)"), _dec(1 << 64))
        return F.when(d >= _dec(1 << 63), d - _dec(1 << 64)).otherwise(d).cast("bigint")
    low = F.pmod(c.cast("decimal(38,0)"), F.lit(1 << bits).cast("decimal(38,0)")).cast("bigint")
    return F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low) if signed else low


def number(c: Column, t: str) -> Column:
    """The mathematical value of a held integer, as a decimal."""
    d = c.cast("decimal(38,0)")
    return F.when(c < 0, d + _dec(1 << 64)).otherwise(d) if t == "u64" else d


def convert(c: Column, have: str, want: str) -> Column:
    if have == want:
        return c
    if want in FLOATS:
        return (c if have in FLOATS else number(c, have)).cast("double" if want == "f64" else "float")
    return wrap(F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)), want) if have in FLOATS else wrap(number(c, have), want)


def enumerators(values: dict[str, int]) -> dict[str, tuple[Column, str]]:
    """An enum's names as variables: int where all fit, else the first wider type."""
    wide = "i32" if all(-(1 << 31) <= v < 1 << 31 for v in values.values()) else "i64"
    return {k: (F.lit(v).cast("bigint"), wide) for k, v in values.items()}


def guarded(candidates: list[tuple[Node | str, Node | str]], variables: dict[str, tuple[Column, str]]) -> tuple[Column, str]:
    """The first candidate (guard, expression) whose guard isn't 0, brought to the candidates' common type; null if none is."""
    made = [(compile_expr(g, variables)[0], *compile_expr(e, variables)) for g, e in candidates]
    t = reduce(common_type, [m[2] for m in made])
    out = F.lit(None)
    for test, c, have in reversed(made):
        out = F.when(test != 0, convert(c, have, t)).otherwise(out)
    return out, t


def compile_expr(tree: Node | str, variables: dict[str, tuple[Column, str]], offsets: Callable[[str, str], int] | None = None, memory: Callable[[Column, str], tuple[Column, str]] | None = None) -> tuple[Column, str]:
    """The column and its type. variables: name -> (column, type); names may be dotted paths (E10: members of what a path query has read).
    offsets(type, path) gives a member's offset (a catalog's `offset`), memory(address, type) what a pointer leads to."""
    n = parse(tree) if isinstance(tree, str) else tree
    inner = lambda x: compile_expr(x, variables, offsets, memory)
    if n.op == "offsetof":
        found = -1 if offsets is None else offsets(*n.value)
        if found < 0:
            raise ExpressionError(f"no offset of {n.value[1]} in {n.value[0]}")
        return F.lit(found).cast("bigint"), "u64"
    if n.op == "*u":
        if memory is None:
            raise ExpressionError("a dereference needs memory")
        return memory(*inner(n.args[0]))
    if n.op in ("++u", "--u"):
        return inner(Node("+" if n.op == "++u" else "-", (n.args[0], Node("const", value=1, type="i32"))))
    if n.op == "const":
        v = n.value
        return (F.lit(v), n.type) if n.type in FLOATS else (F.lit(v - (1 << 64) if v >= 1 << 63 else v).cast("bigint"), n.type)
    if n.op == "var":
        if n.value not in variables:
            raise ExpressionError(f"unknown name {n.value}")
        return variables[n.value]
    if n.op in ("sizeof", "__alignof__"):
        a = n.args[0]
        size = a.value if a.op == "type" else {"f32": 4, "f64": 8}.get(t := inner(a)[1]) or _bits(t)[0] // 8
        return F.lit(size).cast("bigint"), "u64"
    if n.op == "__builtin_constant_p":
        return F.lit(int(_constant(n.args[0]))).cast("bigint"), "i32"
    if n.op == "__builtin_expect":
        c, t = inner(n.args[0])
        return convert(c, t, "i64"), "i64"
    if n.op in ("?:", "__builtin_choose_expr"):
        (c, ct), (a, at), (b, bt) = map(inner, n.args)
        if n.op != "?:":
            raise_if = _constant(n.args[0])
            if not raise_if:
                raise ExpressionError("choose_expr needs a constant")
        t = common_type(at, bt)
        return F.when(c != 0, convert(a, at, t)).otherwise(convert(b, bt, t)), t
    if n.op.endswith("u"):
        c, t = inner(n.args[0])
        if n.op == "!u":
            return F.when(c == 0, 1).otherwise(0).cast("bigint"), "i32"
        p = promoted(t)
        c = convert(c, t, p)
        if n.op == "~u":
            if p in FLOATS:
                raise ExpressionError("~ of a float")
            return wrap(F.bitwise_not(c), p), p
        return (c if n.op == "+u" else -c if p in FLOATS else wrap(-number(c, p), p)), p
    (a, at), (b, bt) = map(inner, n.args)
    if n.op in ("&&", "||"):
        both = ((a != 0) & (b != 0)) if n.op == "&&" else ((a != 0) | (b != 0))
        return F.when(both, 1).otherwise(0).cast("bigint"), "u8"
    if n.op in ("<<", ">>"):
        t = promoted(at)
        if t in FLOATS or bt in FLOATS:
            raise ExpressionError("shift of a float")
        c, by = convert(a, at, t), b.cast("int")
        if n.op == "<<":
            return wrap(F.call_function("shiftleft", c, by), t), t
        return (F.call_function("shiftright", c, by) if _bits(t)[1] else F.call_function("shiftrightunsigned", c, by)), t
    t = common_type(at, bt)
    x, y = convert(a, at, t), convert(b, bt, t)
    if n.op in ("==", "!=", "<", ">", "<=", ">="):
        if t == "u64" and n.op not in ("==", "!="):
            x, y = x.bitwiseXOR(F.lit(-(1 << 63))), y.bitwiseXOR(F.lit(-(1 << 63)))
        test = {"==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[n.op]
        return F.when(test, 1).otherwise(0).cast("bigint"), "u8"
    if n.op in ("&", "|", "^"):
        if t in FLOATS:
            raise ExpressionError(f"{n.op} of a float")
        return {"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[n.op](y), t
    if t in FLOATS:
        if n.op == "%":
            raise ExpressionError("% of a float")
        return {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[n.op].cast("double" if t == "f64" else "float"), t
    p, q = number(x, t), number(y, t)
    if n.op == "*":
        return _multiply(x, y, t), t
    if n.op in ("+", "-"):
        return wrap(p + q if n.op == "+" else p - q, t), t
    zero = q == 0
    safe = F.when(zero, F.lit(1)).otherwise(q).cast("decimal(20,0)")
    quotient = (F.abs(p).cast("decimal(20,0)") - F.pmod(F.abs(p).cast("decimal(20,0)"), F.abs(safe))) / F.abs(safe)
    quotient = F.round(quotient, 0).cast("decimal(38,0)") * F.when((p < 0) != (q < 0), -1).otherwise(1)
    return (F.when(~zero, wrap(quotient if n.op == "/" else p - quotient.cast("decimal(20,0)") * safe, t)), t)


def _multiply(x: Column, y: Column, t: str) -> Column:
    """A wrapped product: by halves, as the whole has up to 128 bits."""
    bits, _ = _bits(t)
    if bits < 64:
        return wrap(x.cast("decimal(38,0)").cast("decimal(18,0)") * y.cast("decimal(38,0)").cast("decimal(18,0)"), t)
    d = lambda c: c.cast("decimal(20,0)")
    low = lambda c: d(c.bitwiseAND(F.lit(0xFFFFFFFF)))
    high = lambda c: d(F.call_function("shiftrightunsigned", c, F.lit(32)))
    middle = F.pmod((high(x) * low(y)).cast("decimal(38,0)") + (low(x) * high(y)).cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(38,0)"))
    return wrap((low(x) * low(y)).cast("decimal(38,0)") + middle * F.lit(1 << 32).cast("decimal(38,0)"), t)


def _constant(n: Node) -> bool:
    return n.op == "const" or (n.op not in ("var",) and all(_constant(a) for a in n.args if isinstance(a, Node)))


def alternatives(tree: Node | str) -> list[Node]:
    """One tree for each way through conditionals that no constant decides."""
    n = parse(tree) if isinstance(tree, str) else tree
    if n.op == "?:":
        return [x for branch in n.args[1:] for x in alternatives(branch)]
    if not n.args:
        return [n]
    ways: list[tuple] = [()]
    for a in n.args:
        ways = [w + (x,) for w in ways for x in alternatives(a)]
    return [Node(n.op, w, n.value, n.type) for w in ways]


def bit_field(value: Column, width: int, bit_offset: int, bit_size: int) -> Column:
    """The bits of a field in a `width`-bit word, counted from the top; size 0 gives 0, below 0 the whole word."""
    if bit_size == 0:
        return F.lit(0).cast("bigint")
    if bit_size < 0:
        return value
    return F.call_function("shiftright", value, F.lit(width - bit_offset - bit_size)).bitwiseAND(F.lit((1 << bit_size) - 1))


def flags_text(value: Column, flags: dict[int, str], sep: str = " | ") -> Column:
    """The names of the bits that are set, in the given order."""
    return F.concat_ws(sep, F.array_compact(F.array(*[F.when(value.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in flags.items()])))


def ipv4_text(value: Column, little: bool = False) -> Column:
    """Dotted form of a 32-bit address in either byte order."""
    parts = [F.call_function("shiftright", value, F.lit(s)).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *(reversed(parts) if little else parts))


def hex_add(a: Column, b: Column) -> Column:
    """The sum of two hexadecimal strings of up to 30 digits, without leading zeros."""
    value = lambda c: F.conv(F.substring(F.lpad(c, 30, "0"), 1, 15), 16, 10).cast("decimal(38,0)") * F.lit(1 << 60).cast("decimal(20,0)") + F.conv(F.substring(F.lpad(c, 30, "0"), 16, 15), 16, 10).cast("decimal(38,0)")
    total = value(a) + value(b)
    high = F.floor(total / F.lit(1 << 60).cast("decimal(38,0)")).cast("bigint")
    low = F.pmod(total, F.lit(1 << 60).cast("decimal(38,0)")).cast("bigint")
    return F.coalesce(F.nullif(F.ltrim(F.concat(F.hex(high), F.lpad(F.hex(low), 15, "0")), F.lit("0")), F.lit("")), F.lit("0"))
