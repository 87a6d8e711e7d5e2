"""Instances as rows, typed requests, variables by members: against a plain reading of the same image and graphs."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from orebody.operators import typed

PAGE = 64
TYPES = [
    (1, "Int32", "int", 4, None, None), (2, "Int8", "char", 1, None, None), (3, "Array", "char[8]", 8, 2, 8), (4, "Struct", "node", 40, None, None), (5, "Pointer", "node*", 8, 4, None),
    (6, "Typedef", "node_t", 40, 4, None), (7, "Pointer", "node**", 8, 5, None), (8, "Union", "", 8, None, None), (9, "Double", "double", 8, None, None), (10, "Array", "node*[3]", 24, 5, 3),
    (11, "Pointer", "void*", 8, None, None), (12, "Int64", "s64", 8, None, None), (13, "Const", "const node_t", 40, 6, None), (14, "Struct", "holder", 40, None, None), (15, "Struct", "twin", 4, None, None), (16, "Struct", "twin", 8, None, None),
]
MEMBERS = [
    (4, 0, "id", 0, 1), (4, 1, "", 8, 8), (4, 2, "name", 16, 3), (4, 3, "next", 24, 5), (4, 4, "priv", 32, 11), (8, 0, "a", 0, 1), (8, 1, "d", 0, 9),
    (14, 0, "slots", 0, 10), (14, 1, "pp", 24, 7), (14, 2, "any", 32, 12),
]
CANDIDATES = [(4, 4, 1, 5), (14, 2, 1, 5), (14, 2, 2, 1)]
HOLDER = 0x1000 + 8
NODES = [0x1000 + 56 + 40 * i for i in range(3)]  # they cross pages of 64 bytes


@pytest.fixture(scope="module")
def image(spark):
    size = 0x200
    memory = bytearray(size)

    def put(at, data):
        memory[at - 0x1000 : at - 0x1000 + len(data)] = data

    for i, at in enumerate(NODES):
        nxt = NODES[i + 1] if i < 2 else 0
        put(at, struct.pack("<iid8sQQ", i - 1, 0, i + 0.5, f"n{i}".encode(), nxt, NODES[0]))
    cell = 0x1180
    put(cell, struct.pack("<Q", NODES[2]))
    put(HOLDER, struct.pack("<QQQQq", NODES[2], 0, NODES[1], cell, -7))
    rows = [((0x1000 + i) // PAGE, bytearray(memory[i : i + PAGE])) for i in range(0, size, PAGE)]
    pages = spark.createDataFrame(rows, "frame bigint, data binary")
    types = spark.createDataFrame(TYPES, "type_id bigint, kind string, name string, size bigint, ref_type bigint, length bigint")
    members = spark.createDataFrame(MEMBERS, "type_id bigint, idx int, name string, offset bigint, ref_type bigint")
    candidates = spark.createDataFrame(CANDIDATES, "type_id bigint, idx int, no int, ref_type bigint")
    return typed.TypeTables(types, members, candidates), pages, memory


def nodes(spark, image, type_id=13):
    tables, pages, _ = image
    rows = spark.createDataFrame([(i, at, type_id, f"n{i}") for i, at in enumerate(NODES)], "k int, address bigint, type_id bigint, full_name string")
    return typed.Instances(rows, tables, pages, PAGE)


def by(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) for r in df.collect()}


def test_described(spark, image):
    tables, pages, _ = image
    rows = spark.createDataFrame([(0, 0x1000, 13, "a.b"), (1, 0, 10, "x"), (2, 0x1000, 9, ""), (3, 0x1000, 99, "u"), (4, None, 1, None)], "k int, address bigint, type_id bigint, full_name string")
    got = by(typed.Instances(rows, tables, pages, PAGE).described(), "k", "type_name", "kind", "size", "array_length", "member_count", "is_integer", "is_real", "is_number", "is_valid", "is_null", "name", "parent_name")
    assert got[0] == ("const node_t", "Struct", 40, -1, 5, False, False, False, True, False, "b", "a")
    assert got[1] == ("node*[3]", "Array", 24, 3, 0, False, False, False, True, True, "x", "")
    assert got[2][5:10] == (False, True, True, True, False)
    assert got[3][:5] == (None, None, None, None, 0) and got[3][8] is False
    assert got[4][0] == "int" and got[4][9] is True and got[4][10] is None


def test_members_and_values(spark, image):
    n = nodes(spark, image)
    assert by(n.member_names(), "k", "member_names")[1] == (["id", "", "name", "next", "priv"],)
    assert by(n.member("id").values(), "k", "integer") == {0: (-1,), 1: (0,), 2: (1,)}
    assert by(n.member("d").values(), "k", "real", "address")[2] == (2.5, NODES[2] + 8)  # out of the anonymous union
    assert sorted(by(n.member("name").values(), "k", "text").values()) == [("n0",), ("n1",), ("n2",)]
    nxt = n.member("next")
    assert by(nxt.rows, "k", "address", "type_id", "full_name") == {0: (NODES[1], 4, "n0.next"), 1: (NODES[2], 4, "n1.next"), 2: (None, None, "n2.next")}
    assert by(n.member("next", declared=True).rows, "k", "address", "type_id")[2] == (NODES[2] + 24, 5)
    assert by(n.member("priv").rows, "k", "address", "type_id")[1] == (NODES[0], 4)  # its only candidate, followed
    assert by(n.member("priv", declared=True).dereferenced().rows, "k", "type_id")[1] == (11,)  # void
    assert by(n.member("nothing").values(), "k", "type_name", "accessible")[0] == (None, False)
    every = n.all_members().rows.collect()
    assert len(every) == 15 and {(r["idx"], r["type_id"]) for r in every} == {(0, 1), (1, 8), (2, 3), (3, 5), (4, 5)}
    assert by(n.of_member("a"), "k", "member_exists", "member_offset", "member_type", "n_candidates")[0] == (True, 8, 1, 0)
    assert by(n.of_member("zz"), "k", "member_exists", "member_offset", "member_type", "n_candidates")[0] == (False, -1, 0, 0)
    assert by(n.of_member("priv"), "k", "n_candidates")[0] == (1,)


def test_elements_pointers_candidates_types(spark, image):
    tables, pages, _ = image
    rows = spark.createDataFrame([(0, HOLDER, 14)], "k int, address bigint, type_id bigint")
    h = typed.Instances(rows, tables, pages, PAGE)
    slots = h.member("slots")
    got = [slots.element(i).dereferenced().rows.first() for i in range(3)]
    assert [(r["address"], r["type_id"]) for r in got] == [(NODES[2], 4), (None, None), (NODES[1], 4)]
    assert got[0]["full_name"] == "slots[0]"
    pp = h.member("pp", declared=True)
    assert tuple(pp.dereferenced(1).rows.select("address", "type_id").first()) == (0x1180, 5)
    assert tuple(pp.dereferenced().rows.select("address", "type_id").first()) == (NODES[2], 4)
    assert tuple(pp.dereferenced(0).rows.select("address", "type_id").first()) == (HOLDER + 24, 7)
    assert tuple(pp.element(0).rows.select("address", "type_id").first()) == (0x1180, 5)
    assert tuple(h.member("any").rows.select("type_id").first()) == (12,)  # two candidates: the declared type
    assert [h.member("any", candidate=i).rows.first()["type_id"] for i in (1, 2, 3)] == [5, 1, None]
    assert h.member("any").retyped("int").values().first()["integer"] == -7
    assert h.retyped(6).described().first()["type_name"] == "node_t"
    for name in ("twin", "no such"):
        with pytest.raises(ValueError):
            h.retyped(name)
    v = F.lit(-7).cast("bigint")
    assert spark.range(1).select(typed.as_integer(v, 8, False), typed.as_integer(v, 16, True), typed.as_integer(v, 32, False), typed.as_integer(v, 64, True)).first()[:] == (249, -7, 4294967289, -7)


def test_circles_and_empty_tables(spark, image):
    tables, pages, _ = image
    types = spark.createDataFrame([(1, "Struct", "s", 8, None, None), (2, "Pointer", "p", 8, 2, None)], tables.types.schema)
    held = spark.createDataFrame([(1, 0, "", 0, 1)], tables.members.schema)
    with pytest.raises(ValueError):
        typed.TypeTables(types, held)
    again = spark.createDataFrame([(2, "Pointer", "p", 8, 2, None)], tables.types.schema)
    with pytest.raises(ValueError):
        typed.TypeTables(again, held.filter("false"))
    at = spark.createDataFrame([(0, 8, 2)], "k int, address bigint, type_id bigint")
    none = typed.Instances(at.filter("false"), tables, pages, PAGE)
    assert none.member("id").values().count() == 0 and none.described().count() == 0 and none.all_members().rows.count() == 0


def test_typed_reads(spark, image):
    tables, pages, memory = image
    a, b = NODES[0], NODES[1]
    asked = {
        "id": f"node.id @ 0x{a:x}", "deep": f" node_t.next.next.name@{a:x}", "lost": f"node.next.next.next.id @ 0x{a:x}", "byid": f"4.id @ {b:x}", "char": f"char @ 0x{a + 16:x}", "int": f"int @ 0x{a:x}",
        "long": f"long @ 0x{HOLDER + 32:x}", "raw": f"raw 40 @ 0x{a:x}", "hexes": f"hex 0 @ 0x{a:x}", "nolen": f"raw @ 0x{a:x}", "far": "int @ 0x9000", "farraw": "raw 3 @ 9000", "bad": "node.id 0x10", "bad2": "node..id @ 1",
        "twin": "twin @ 0x1000", "unknown": "nope.x @ 0x1000", "union": f"node.d @ 0x{b:x}", "nomember": f"node.qq @ 0x{b:x}", "struct": f"holder @ 0x{HOLDER:x}", "null": None,
    }
    rows = spark.createDataFrame(list(asked.items()), "k string, spec string").withColumn("address", F.lit("a clash"))
    got = {(r["k"], r["line"]): r for r in typed.typed_reads(rows, "k", tables, pages, PAGE).collect()}
    assert {k for k, _ in got} == set(asked) - {"hexes"}
    assert got["id", 0]["integer"] == -1 and got["id", 0]["type_name"] == "int"
    assert got["deep", 0]["text"] == "n2" and got["byid", 0]["integer"] == 0 and got["union", 0]["real"] == 1.5
    assert got["char", 0]["integer"] == ord("n") and got["int", 0]["integer"] == -1 and got["long", 0]["integer"] == -7
    whole = bytes(memory[a - 0x1000 : a - 0x1000 + 40])
    assert [bytes.fromhex(got["raw", i]["text"]) for i in range(3)] == [whole[:16], whole[16:32], whole[32:]] and got["raw", 2]["address"] == a + 32
    errors = {k: got[k, 0]["error"] for k in ("lost", "nolen", "far", "farraw", "bad", "bad2", "twin", "unknown", "nomember", "null", "struct")}
    assert errors == {"lost": "no member or not mapped", "nolen": "no length", "far": "cannot read", "farraw": "cannot read", "bad": "malformed", "bad2": "malformed", "twin": "ambiguous type", "unknown": "unknown type", "nomember": "no member or not mapped", "null": "malformed", "struct": None}
    assert typed.typed_reads(rows.filter("false"), "k", tables, pages, PAGE).count() == 0


def brute(wanted, types, members, variables, most, depth):
    """As the rule is worded: for each number of hops all ways, until there are enough."""
    refs = [(t, r) for t, k, r in types if k not in ("Struct", "Union")]
    out = []

    def go(used, names, left, seen, hits):
        if left < 0 or used in seen:
            return
        for t, r in refs:
            if r == used:
                if left == 0:
                    hits.append((t, names))
                go(t, names, left, [*seen, used], hits)
        for t, n, r in members:
            if r == used and left > 0:
                go(t, ([n] if n else []) + names, left - 1, [*seen, used], hits)

    for w in wanted:
        n = 0
        for hop in range(depth + 1):
            if n >= most:
                break
            hits = []
            go(w, [], hop, [], hits)
            new = [(w, v, ".".join(p), hop) for t, p in hits for v, vt in variables if vt == t]
            n, out = n + len(new), out + new
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variables_using(spark, seed, monkeypatch):
    monkeypatch.setattr(typed, "HOT", seed - 1)  # with 0 every type is hot
    r = random.Random(seed)
    kinds = ["Struct", "Pointer", "Typedef", "Array", "Union"]
    types = [(i, k, None if k in ("Struct", "Union") else r.randrange(14)) for i in range(14) for k in [r.choice(kinds)]]
    bodies = [t for t, k, _ in types if k in ("Struct", "Union")]
    members = [(r.choice(bodies), r.choice(["a", "b", "", "c"]), r.randrange(14)) for _ in range(9)] if bodies else []
    variables = [(100 + i, r.randrange(14)) for i in range(12)]
    wanted = [0, 3, 5, 5]
    got = typed.variables_using(
        spark.createDataFrame([(w,) for w in wanted], "type_id bigint"), spark.createDataFrame(types, "type_id bigint, kind string, ref_type bigint"),
        spark.createDataFrame(members, "type_id bigint, name string, ref_type bigint"), spark.createDataFrame(variables, "var_id bigint, type_id bigint"), 4, 3,
    )
    assert sorted(tuple(x) for x in got.select("wanted", "var_id", "path", "hops").collect()) == brute([0, 3, 5], types, members, variables, 4, 3)
