"""Patterns, filters, expressions, intervals, paths, rules, sources against plain Python."""

import ctypes
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from orebody.functions import expr, filters, patterns
from orebody.operators import diff, graph, intervals, rules, stats, validate
from orebody.plans import pathql
from orebody.sources import memory, text
from orebody.streaming import trace


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_pattern_kinds():
    assert patterns.compile_pattern(" task_struct ").kind == "literal"
    assert patterns.compile_pattern("/^a.*b$/").kind == "regex"
    assert not patterns.compile_pattern("/x/").ignore_case and patterns.compile_pattern("!x!i").ignore_case
    assert patterns.compile_pattern("list_*").kind == "wildcard"
    assert patterns.compile_pattern("").kind == "any"
    with pytest.raises(re.error):
        patterns.compile_pattern("/(/")


def test_pattern_matching(spark):
    df = spark.createDataFrame([("task_struct",), ("Task_Struct",), ("a.b",), ("axb",), (None,)], "n string")
    hit = lambda p, **k: [r[0] for r in df.filter(patterns.matches(F.col("n"), patterns.compile_pattern(p, **k))).collect()]
    assert hit("TASK_STRUCT") == ["task_struct", "Task_Struct"]
    assert hit("TASK_STRUCT", ignore_case=False) == []
    assert hit("task*") == ["task_struct", "Task_Struct"]
    assert hit("?[.]b") == ["a.b"]
    assert hit("/_S/") == ["Task_Struct"]
    assert len(hit("/_s/i")) == 2


def test_kind_masks_and_keys():
    assert filters.kind_mask("int*") == sum(filters.KINDS[k] for k in ("Int8", "Int16", "Int32", "Int64"))
    assert filters.kind_mask("STRUCT, union") == filters.STRUCTURED
    assert filters.kind_mask("/^bool/") == filters.BOOLEAN
    with pytest.raises(filters.FilterError):
        filters.kind_mask("nothing")
    f = filters.TypeFilter.parse("datat:struct size 0x10 typename:'a b' typei:1f")
    assert (f.kinds, f.size, f.name.text, f.type_id) == (filters.KINDS["Struct"], 16, "a b", 31)
    for bad in ("zzz:1", "size"):
        with pytest.raises(filters.FilterError):
            filters.TypeFilter.parse(bad)


@pytest.mark.parametrize(("a", "b", "want"), [("2.6.31", "2.6.31", 0), ("2.6.31", "2.6.32", -1), ("2.6.31-a", "2.6.31", 1), ("02.06.031", "2.6.31", 0), ("2.10", "2.9", 1), ("2.6.a", "2.6.b", -1), ("3", "2.6.31", 1)])
def test_versions(spark, a, b, want):
    assert spark.range(1).select(filters.compare_versions(F.lit(a), F.lit(b))).first()[0] == want


def _c(op, x, y, t):
    bits, signed = (expr.RANKS | expr.SMALL)[t]
    ct = {(32, True): ctypes.c_int32, (32, False): ctypes.c_uint32, (64, True): ctypes.c_int64, (64, False): ctypes.c_uint64}[bits, signed]
    x, y = ct(x).value, ct(y).value
    if op in "/%" and y == 0:
        return None
    if op in "+-*":
        v = {"+": x + y, "-": x - y, "*": x * y}[op]
    elif op == "/":
        v = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
    elif op == "%":
        v = x - y * (abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1))
    else:
        return int({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y, "==": x == y, "!=": x != y}[op])
    return ct(v).value


def test_expressions_like_c(spark):
    rng = random.Random(5)
    edge = [0, 1, -1, 7, 2**31 - 1, -(2**31), 2**32 - 1, 2**63 - 1, -(2**63), 12345678901]
    rows = [(rng.choice(edge), rng.choice([e for e in edge if e])) for _ in range(60)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    for t in expr.RANKS:
        env = {n: (expr.wrap(F.col(n), t), t) for n in "ab"}
        ops = ["+", "-", "*", "/", "%", "<", ">=", "=="]
        got = df.select("a", "b", *[expr.compile_expr(f"a {o} b", env)[0].alias(f"r{i}") for i, o in enumerate(ops)]).collect()
        for r in got:
            for i, o in enumerate(ops):
                want = _c(o, r.a, r.b, t)
                if t == "u64" and o in "+-*/%" and want is not None:
                    want = ctypes.c_int64(want).value
                assert r[f"r{i}"] == want, (t, o, r.a, r.b, r[f"r{i}"], want)


def test_expression_forms(spark):
    one = lambda s: spark.range(1).select(expr.compile_expr(s, {})[0]).first()[0]
    assert one("1 + 2 * 3 << 2") == 28
    assert one("0x10 | 010") == 24
    assert one("'a' + 1") == 98
    assert one("5 > 3 ? 2 : 9") == 2
    assert one("sizeof(long) + sizeof(char*)") == 16
    assert one("-7 / 2") == -3 and one("-7 % 2") == -1
    assert one("!0 && ~0") == 1
    assert one("1.5 * 2") == 3.0
    assert one("__builtin_constant_p(3)") == 1
    assert len(expr.alternatives("a ? b : (c ? 1 : 2)")) == 3
    for bad in ("1 +", "(1", "1.5 % 2", "1.0 << 2", "$", "x"):
        with pytest.raises(expr.ExpressionError):
            expr.compile_expr(bad, {})
    bits = spark.range(1).select(expr.bit_field(F.lit(0b10110100).cast("bigint"), 8, 2, 3), expr.hex_add(F.lit("ffffffffffffffff"), F.lit("1"))).first()
    assert bits[0] == 0b110 and bits[1] == "10000000000000000"


def test_overlap_against_brute_force(spark):
    rng = random.Random(11)
    mk = lambda n, top: [(i, s := rng.randrange(top), s + rng.choice([0, 5, 50, 500, 5000, 60_000, 900_000])) for i in range(n)]
    for width in (16, 256):
        a, b = mk(120, 1_000_000), mk(150, 1_000_000)
        left, right = spark.createDataFrame(a, "i long, s long, e long"), spark.createDataFrame(b, "j long, p long, q long")
        want = sorted((i, j) for i, s, e in a for j, p, q in b if s <= q and p <= e)
        assert values(intervals.overlap_join(left, right, "s", "e", "p", "q", width), "i", "j") == want


def test_as_of_against_brute_force(spark):
    rng = random.Random(3)
    objs = [(rng.randrange(20_000), rng.choice([0, -1, 4, 64, 700]), f"t{i}") for i in range(300)]
    objs = list({o[0]: o for o in objs}.values())
    probes = [(i, rng.randrange(-50, 21_000)) for i in range(400)] + [(1000 + i, o[0]) for i, o in enumerate(objs[:50])]
    got = values(intervals.as_of(spark.createDataFrame(probes, "i long, p long"), spark.createDataFrame(objs, "s long, z long, t string"), "p", "s", "z", ["t"], 512), "i", "t")
    want = []
    for i, p in probes:
        best = max((o for o in objs if o[0] <= p), default=None)
        if best and (p < best[0] + best[1] if best[1] > 0 else p == best[0]):
            want.append((i, best[2]))
    assert got == sorted(want)


def test_merge_and_runs(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(3), s := rng.randrange(3000), s + rng.randrange(60)) for _ in range(200)]
    got = values(intervals.merge(spark.createDataFrame(rows, "k int, s long, e long"), ["k"], "s", "e", block=500), "k", "s", "e")
    want = []
    for k in range(3):
        run = None
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if run and s <= run[1] + 1:
                run[1] = max(run[1], e)
            else:
                run and want.append((k, *run))
                run = [s, e]
        want.append((k, *run))
    assert got == sorted(want)


def test_byte_runs(spark):
    a, b = bytearray(4096 * 3), bytearray(4096 * 3)
    for at in (0, 1, 17, 4090, 4096, 9000):
        b[at] = 1
    page = lambda d: spark.createDataFrame([(i, bytes(d[i * 4096 : i * 4096 + 4096])) for i in range(3)], "frame long, data binary")
    assert values(diff.byte_runs(page(a), page(b)), "start", "length") == [(0, 32), (4080, 32), (8992, 16)]
    assert values(diff.byte_runs(page(a), page(b), compat=True), "start", "length") == []
    assert diff.byte_runs(page(a), page(a)).count() == 0


IMAGE_BASE = 0x1000


@pytest.fixture(scope="module")
def engine(spark):
    t = pathql.Type
    m = pathql.Member
    types = [
        t(1, "Int32", "int", 4), t(2, "Int8", "char", 1), t(3, "Pointer", "node*", 8, 5), t(4, "Array", "char[8]", 8, 2, 8),
        t(5, "Struct", "node", 40, members=[m("id", 0, 1), m("name", 8, 4), m("link", 16, 9), m("", 32, 8)]),
        t(6, "Typedef", "node_t", 40, 5), t(7, "Double", "double", 8), t(8, "Union", "", 8, members=[m("d", 0, 7), m("raw", 0, 10)]),
        t(9, "Struct", "head", 16, members=[m("next", 0, 3), m("prev", 8, 3, alternatives=[(11, None)])]), t(10, "Int64", "long", 8), t(11, "Pointer", "head*", 8, 9),
        t(12, "Array", "node[2]", 80, 5, 2),
    ]
    image = bytearray(4096 * 3)
    def put(at, i, name, nxt, prev, d):
        struct.pack_into("<i4x8sQQd", image, at - IMAGE_BASE, i, name, nxt, prev, d)

    put(0x1000, 7, b"first\0\0\0", 0x1FF0, 0x1038, 1.5)
    put(0x1FF0, -2, b"a\x01b\0zzzz", 0x1000, 0, -0.25)  # crosses a page
    put(0x1028, 9, b"arr\0\0\0\0\0", 0, 0, 8.0)
    pages = spark.createDataFrame([(i + 1, bytes(image[i * 4096 : i * 4096 + 4096])) for i in range(3)], "frame long, data binary")
    return pathql.Engine(pathql.Catalog(types), {"root": (0x1000, 6), "arr": (0x1000, 12), "ptr": (0x1010, 3)}, pages)


def test_paths(engine):
    val = lambda p, **k: engine.value(p, **k).first()["value"]
    assert val("root.id") == 7
    assert val("root.link.next.id") == -2
    assert val("root.link.next.name") == "a.b"
    assert val("root.link.next.link.next.name") == "first"
    assert val("root.d") == 1.5 and val("root.link.next.d") == -0.25
    assert val("arr[1].id") == 9
    assert engine.instance("(node-link)root.link").first()["address"] == 0x1000
    assert engine.instance("(head)ptr").first()["address"] == 0x1FF0
    assert engine.instance("root.link.prev").first()["type"] == "head*"  # the only alternative
    assert engine.instance("root.link.prev<0>").first()["type"] == "node*"
    assert engine.instance("root.link.prev", rules={("head", "prev"): 10}).first()["type"] == "long"
    assert engine.catalog.offset(engine.catalog.by_name("node"), "link.prev") == 24
    assert engine.catalog.at_offset(engine.catalog.by_name("node"), 26) == "link.prev"
    assert {r.path: r.value for r in engine.members("root").collect()}["id"] == 7
    assert engine.roots().count() == 3
    assert pathql.PathBuilder(engine, "root").link.next.id.frame().first()["value"] == -2
    for bad in ("nothing", "root.zzz", "root.id.x", "arr[2]", "root..id", "root[", "(nope)root", ""):
        with pytest.raises(pathql.QueryError):
            engine.instance(bad)


def test_translation(spark):
    entries = {0x1000: 0x2001, 0x2000 + 8: 0x3001, 0x3000 + 16: 0x4001, 0x4000 + 24: 0x9001, 0x3000 + 24: 0x40000081}
    table = spark.createDataFrame(list(entries.items()), "at long, entry long")
    va = (1 << 30) | (2 << 21) | (3 << 12) | 0x123
    large = (1 << 30) | (3 << 21) | 0x12345
    got = validate.translate(spark.createDataFrame([(va,), (large,), (5 << 30,)], "a long"), "a", table, 0x1000).collect()
    assert {r.a: (r.physical, r.page_size) for r in got} == {va: (0x9123, 4096), large: (0x40012345, 1 << 21), 5 << 30: (None, None)}


def test_rules_and_xml(spark, tmp_path):
    (tmp_path / "b.xml").write_text("<typeknowledge version='1'><rules><rule priority='3'><name>two</name><filter><typename>x*</typename></filter><action type='expression'><expression>src</expression></action></rule></rules></typeknowledge>")
    (tmp_path / "a.xml").write_text(
        "<typeknowledge version='1' os='linux'><include>b.xml</include><include>b.xml</include><rules priority='7'><!-- c --><rule><name>one</name><filter><datatype>struct</datatype>"
        "<members><member match='any'/><member>next</member></members></filter><action type='function' file='f.js'>go</action></rule></rules></typeknowledge>"
    )
    got = rules.read_rules(str(tmp_path / "a.xml"))
    assert [(r["name"], r["priority"]) for r in got] == [("two", 3), ("one", 7)] and got[1]["os"] == {"os": "linux"} and got[1]["members"][1]["name"] == "next"
    assert rules.to_filter(got[1]["filter"]).kinds == filters.KINDS["Struct"]
    n = rules.write_rules([{"name": "r", "type_name": "a", "member": "m", "target_type": "t", "expression": "src"}, {"name": "s", "type_name": "a", "member": "k", "target_type": "t", "expression": ""}], str(tmp_path / "o.xml"))
    assert n == 1 and rules.read_rules(str(tmp_path / "o.xml"))[0]["name"] == "r"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, n string")
    rs = [rules.Rule("p", F.col("n") == "a", "x", 1), rules.Rule("q", F.lit(True), "y", 1)]
    out = {r.id: (r.rule_name, r.ambiguous) for r in rules.decide(rules.match(df, rs, ["id"]), ["id"]).collect()}
    assert out == {1: ("p", True), 2: ("q", False)}
    box = rules.RuleSet(rs)
    box.set_enabled(["p"], False)
    assert [r.enabled for r in box.listing(spark).orderBy("rule_no").collect()] == [False, True]


def test_text_sources(spark, tmp_path):
    (tmp_path / "m").write_text("ffffffff80000000 T start\nnonsense\n0000000000001000 d data sym\n  10 t x\n")
    assert values(text.system_map(spark, str(tmp_path / "m")), "name", "address") == [("data sym", 0x1000), ("start", 0xFFFFFFFF80000000 - (1 << 64)), ("x", 16)]
    (tmp_path / "log").write_text("# c\nkmalloc 0x10\nbad\na b c\ncache 0xffff\n")
    assert values(text.allocation_log(spark, str(tmp_path / "log"), 0x11, 1 << 40), "cache", "address") == [("cache", 0xFFFF)]
    (tmp_path / "cfg").write_text("CONFIG_A=y\n# CONFIG_B is not set\nCONFIG_C=\"x\"\n")
    assert text.kernel_config(spark, str(tmp_path / "cfg")).count() == 2
    (tmp_path / "d").write_text(" <1><2a>: Abbrev Number: 1 (DW_TAG_base_type)\n    <2b>   DW_AT_name : int\n    <2c>   DW_AT_byte_size : 4\n <1><3a>: Abbrev Number: 2 (DW_TAG_variable)\n    <3b>   DW_AT_name : v\n")
    got = {r.record_id: (r.tag, r.attrs) for r in text.debug_records(text.numbered_lines(spark, str(tmp_path / "d"))).collect()}
    assert got == {0x2A: ("base_type", {"name": "int", "byte_size": "4"}), 0x3A: ("variable", {"name": "v"})}
    (tmp_path / "h.h").write_text("asmlinkage long sys_read(unsigned int fd,\n  char *buf);\n")
    assert text.syscall_signatures(spark, str(tmp_path / "h.h")).first()["args"] == ["unsigned int fd", "char *buf"]


def test_trace_stream_equals_batch(spark, tmp_path):
    lines = ["TRACE a alloc 0x10 inuse=1", "TRACE a free 0x10 inuse=0", "TRACE a alloc 0x20 inuse=1", "TRACE b free 0x30 inuse=0", "x"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.txt").write_text("\n".join(lines))
    batch = trace.live_objects(spark.read.text(str(tmp_path / "in")).withColumnRenamed("value", "line"))
    want = [("a", 16, "freed"), ("a", 32, "live"), ("b", 48, "anomaly")]
    assert values(batch, "cache", "address", "state") == want
    stream = trace.run_to_table(trace.live_objects(trace.stream_lines(spark, str(tmp_path / "in"))), "live_t", "complete")
    assert values(stream, "cache", "address", "state") == want


def test_image_and_dumps(spark, tmp_path):
    data = bytes(range(256)) * 32
    (tmp_path / "img").write_bytes(data)
    d = memory.Dumps(spark)
    assert d.load(str(tmp_path / "img")) == 0 == d.load(str(tmp_path / "img"))
    pages = d.pages(0).drop("dump_id")
    assert pages.count() == 2
    first = memory.hex_dump(pages).orderBy("address").first()
    assert first.hex.startswith("00 01 02") and first.ascii == "." * 16
    assert d.unload(0) == 0 and d.list() == {}
    (tmp_path / "odd").write_bytes(b"x")
    with pytest.raises(ValueError):
        memory.read_image(spark, str(tmp_path / "odd"))
    rows = memory.decode_bulk(spark.createDataFrame([(struct.pack("<ihB", -5, 300, 255),), (b"",)], "d binary"), "d", {"a": (0, "<i4"), "b": (4, "<i2"), "c": (6, "u1")}).collect()
    assert (rows[0].a, rows[0].b, rows[0].c) == (-5, 300, 255) and rows[1].a is None
    memory.write_catalog({"t": spark.range(3)}, str(tmp_path / "cat"), 1)
    assert memory.read_catalog(spark, str(tmp_path / "cat"), ["t"])["t"].count() == 3
    v = memory.split_vector(spark.createDataFrame([([1, 2, 3],)], "v array<int>"), "v").first()
    assert (v.even, v.odd) == ([1, 3], [2])


def test_graph_loops(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (9, None)], "node long, next long")
    heads = spark.createDataFrame([(0, 1), (5, 9)], "head long, first long")
    assert values(graph.walk_list(heads, links), "head", "node", "place") == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (5, 9, 0)]
    p = graph.fixed_point(spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 1)], "id long, initial double, encounters int"), spark.createDataFrame([(1, 2)], "parent long, child long"), rounds=3)
    assert all(0 <= r.p <= 1 for r in p.collect())
    h = stats.probability_histogram(spark.createDataFrame([(1.0,), (0.05,), (None,)], "p double"), "p", [])
    assert values(h, "bucket", "n") == [(0, 1), *[(i, 0) for i in range(1, 9)], (9, 1)]


def test_radix_and_offsets(spark):
    roots = spark.createDataFrame([("a", 1, 2), ("b", 9, 0)], "tree string, node long, height int")
    slots = spark.createDataFrame([(1, 0, 2), (1, 3, 3), (2, 1, 100), (3, 2, 101)], "node long, slot long, child long")
    assert values(graph.radix_leaves(roots, slots, 6), "tree", "key", "item") == [("a", 1, 100), ("a", 3 * 64 + 2, 101), ("b", 0, 9)]
    types = spark.createDataFrame([(1, 40, 1), (2, 16, 1), (3, 16, 2), (4, 8, 1), (5, 4, 0)], "type_id long, size long, kind int")
    members = spark.createDataFrame([(1, 8, 2), (1, 24, 3), (3, 0, 2), (3, 0, 4), (2, 8, 4), (4, 0, 5)], "struct_id long, offset long, ref_type_id long")
    got = graph.containing_offset(members, types, spark.createDataFrame([(1, 28)], "root long, at long"), F.col("kind") > 0)
    assert values(got, "type_id", "rest", "depth") == [(1, 28, 0), (2, 4, 2), (3, 4, 1), (4, 4, 2)]


def test_session(spark, tmp_path):
    from orebody.session import Session

    (tmp_path / "img").write_bytes(struct.pack("<i", 42) + bytes(4092))
    types = spark.createDataFrame([(1, filters.KINDS["Int32"], "int", 4, "a.c"), (2, filters.KINDS["Function"], "main", 0, "a.c")], "type_id int, kind int, name string, size int, src_file string")
    s = Session(spark, pathql.Catalog([pathql.Type(1, "Int32", "int", 4)]), {"x": (0, 1)}, {"types": types})
    with pytest.raises(pathql.QueryError):
        s.query("x")
    s.memory.load(str(tmp_path / "img"))
    assert s.query("x").first()["value"] == 42 and s.query("").count() == 1
    assert [r.name for r in s.symbols.list_types("datatype:int*").collect()] == ["int"] and s.symbols.list_functions().count() == 1
    assert s.symbols.exists("types", "name", "main") and s.symbols.names("types", "name", "m*").count() == 1 and s.symbols.list_sources().first().n == 2
    column = rules.expression_target("src->next - 4", "src", {"next": (F.lit(100).cast("bigint"), "i64")})
    assert spark.range(1).select(column).first()[0] == 96


def test_long_intervals_and_carries(spark):
    """Intervals too long for any grid on either side, and carries over more places than a task holds."""
    rng = random.Random(5)
    make = lambda n, k: [(i, (a := rng.randrange(10**9)), a + (rng.randrange(5 * 10**8, 10**9) if i % k == 0 else rng.randrange(3000))) for i in range(n)]
    a, b = make(300, 20), make(250, 50)
    left, right = spark.createDataFrame(a, "i long, ls long, le long"), spark.createDataFrame(b, "j long, rs long, re long")
    got = [(r.i, r.j) for r in intervals.overlap_join(left, right, "ls", "le", "rs", "re", 16).collect()]
    assert sorted(got) == sorted((i, j) for i, s, e in a for j, s2, e2 in b if s <= e2 and s2 <= e)
    places = sorted(rng.sample(range(10**8), 400))
    values = [rng.choice([None, None, k]) for k in range(400)]
    got = {r.p: r.c for r in intervals.carried(spark.createDataFrame(list(zip(places, values, strict=True)), "p long, v long"), "p", "v", "c").collect()}
    last = None
    for p, v in zip(places, values, strict=True):
        assert got[p] == last
        last = v if v is not None else last


def test_joined_byte_runs_over_blocks(spark):
    runs = [(0, 4095), (4096, 8191), (8192, 8195), (9000, 12287), (12288, 12290), (20480, 20480)]
    got = sorted((r["start"], r["end"]) for r in diff._joined(spark.createDataFrame(runs, "start long, end long")).collect())
    assert got == [(0, 8195), (9000, 12290), (20480, 20480)]


def test_long_lists_and_deep_trees(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(1, n)] + [(n, 0), (1000, 1001), (1001, 1000)], "node long, next long")
    got = sorted((r.head, r.place, r.node) for r in graph.walk_list(spark.createDataFrame([(0, 1), (7, 1000)], "head long, first long"), links).collect())
    assert got == [(0, i - 1, i) for i in range(1, n + 1)] + [(7, 0, 1000), (7, 1, 1001)]
    deep = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(100)], "node string, parent string")
    above = {r.node: r.above for r in graph.ancestors(deep).collect()}
    assert above["99"] == [str(i) for i in range(98, -1, -1)] and above["0"] == []
    with pytest.raises(ValueError):
        graph.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"))


def test_fixed_point_ends(spark):
    nodes, edges = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 2)], "id long, initial double, encounters int"), spark.createDataFrame([(1, 2)], "parent long, child long")
    got = {r.id: r.p for r in graph.fixed_point(nodes, edges).collect()}
    a, b = 0.9, 0.75
    for _ in range(200):
        a, b = min(1.0, 0.9 * b), min(1.0, 0.5 * a * 1.5)
    assert abs(got[1] - a) < 1e-4 and abs(got[2] - b) < 1e-4


def test_expressions_with_memory_and_types():
    from orebody.functions import expr

    assert expr.parse("__builtin_types_compatible_p(unsigned long, unsigned long)").value == 1 and expr.parse("__builtin_types_compatible_p(int*, int)").value == 0
    assert expr.parse("__builtin_object_size(x, 2)").value == 0 and expr.parse("__builtin_object_size(x, 0)").value == (1 << 64) - 1
    with pytest.raises(expr.ExpressionError):
        expr.compile_expr("*p", {"p": (F.lit(1), "u64")})
    with pytest.raises(expr.ExpressionError):
        expr.compile_expr("offsetof(struct a, b)", {})


def test_dereference(spark):
    from orebody.functions import expr

    held = {8: 5, 16: 9}
    memory = lambda c, t: (F.create_map(*[F.lit(x).cast("bigint") for kv in held.items() for x in kv])[c], "i32")
    df = spark.createDataFrame([(8,), (16,)], "p long")
    names = {"p": (F.col("p"), "u64")}
    assert [r[0] for r in df.select(expr.compile_expr("*p + 1", names, memory=memory)[0]).collect()] == [6, 10]


def test_path_reader():
    from orebody.plans.pathql import Component, QueryError, parse_path

    assert parse_path(" (task - list) a <2> [1] [ 3 ] . b") == [Component("a", "task", "list", 2, (1, 3)), Component("b")]
    assert parse_path("  ") == []
    for bad in ("a..b", "(a b", "a[1", "a<x>", "a b", "a[-1]", "é"):
        with pytest.raises(QueryError):
            parse_path(bad)


def test_repeated_attributes(spark):
    from orebody.sources.text import debug_records

    lines = [" <1><2a>: Abbrev Number: 2 (DW_TAG_member)", "    <2b>   DW_AT_name : a", "    <2c>   DW_AT_name : b", "    <2d>   DW_AT_type : <0x10>"]
    got = debug_records(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")).collect()
    assert len(got) == 1 and got[0].attrs == {"name": "a", "type": "<0x10>"}
