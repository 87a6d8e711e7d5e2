"""What grows with the input: results at the edges, and plans that send no such side through the driver."""

import random
import re

import pytest
from pyspark.sql import functions as F

from orebody.operators import dyadic, graph, intervals


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _intervals(spark, rows, names):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], f"{names[0]} long, {names[1]} long, {names[2]} long")


@pytest.mark.parametrize("few", [0, 1000])
def test_overlaps_of_long_and_short_intervals(spark, monkeypatch, few):
    monkeypatch.setattr(intervals, "FEW", few)
    r = random.Random(few)
    top = 64 * 64**3 * 30  # beyond the coarsest grid

    def some(n):
        out = []
        for _ in range(n):
            a = r.randrange(top)
            out.append((a, a + r.choice([0, 30, 5_000, 10**7, top // 2])))
        return [*out, (top // 3, top - 5), (top // 3, top // 3), (7, 3)]

    a, b = some(60), some(60)
    got = intervals.overlap_join(_intervals(spark, a, ("i", "s", "e")), _intervals(spark, b, ("j", "x", "y")), "s", "e", "x", "y", 64)
    want = sorted((i, j) for i, (s, e) in enumerate(a) for j, (x, y) in enumerate(b) if s <= e and x <= y and s <= y and x <= e)
    assert sorted((x["i"], x["j"]) for x in got.select("i", "j").collect()) == want
    if not few:
        assert "Broadcast" not in plan_of(got)


def test_subtract_clips_exclusions_and_broadcasts_no_intervals(spark):
    runs = spark.range(2000).selectExpr("id", "id * 50 + 1000 as s", "id * 50 + 1040 as e")
    without = spark.createDataFrame([(-5, 990), (900, 1010), (1100, 1105), (5, 1), (None, 1150), (50_000, 10**15), (10**16, 10**17)], "xs long, xe long")
    got = intervals.subtract(runs, "s", "e", without, "xs", "xe", 64)
    out = {p for x, y in [(-5, 990), (900, 1010), (1100, 1105), (50_000, 10**7)] for p in range(max(x, 0), min(y, 110_000) + 1)}
    want = []
    for k in range(2000):
        left = [p for p in range(k * 50 + 1000, k * 50 + 1041) if p not in out]
        heads = [p for p in left if p - 1 not in left]
        tails = [p for p in left if p + 1 not in left]
        want += [(k, p, q) for p, q in zip(heads, tails)]
    assert sorted(map(tuple, got.collect())) == want
    assert intervals.subtract(runs.limit(0), "s", "e", without, "xs", "xe", 64).count() == 0


def test_range_summaries_broadcast_no_cells(spark):
    made = dyadic.RangeSummaries(spark.range(3000).selectExpr("id * 64 as s", "id * 64 + 100 as e", "0.5D as prob", "1 as kind"), "s", "e", intervals.summary("prob", "kind"), intervals.merged_summary())
    got = made.of_ranges(spark.range(500).selectExpr("id as k", "id * 300 as lo", "id * 300 + 5000 as hi"), "k", "lo", "hi")
    assert "Broadcast" not in plan_of(got)
    assert [x["n"] for x in got.orderBy("k").collect()] == [sum(s * 64 <= k * 300 + 5000 and s * 64 + 100 >= k * 300 for s in range(3000)) for k in range(500)]


@pytest.fixture()
def plans(monkeypatch):
    """The plans of what `graph` writes."""
    seen, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (seen.append(plan_of(df)), real(df))[1])
    return seen


def test_jumps_broadcast_no_nodes(spark, plans):
    depths = graph.Jumps(spark.range(300).selectExpr("id as node", "case when id > 2 then id - 3 end as parent")).depths
    assert sorted(map(tuple, depths.collect())) == [(k, k // 3) for k in range(300)]
    assert len(plans) > 7 and not any("Broadcast" in p for p in plans)


def test_common_ancestors_broadcast_no_pairs(spark, plans):
    nodes = spark.range(200).selectExpr("cast(id as string) as node", "case when id > 2 then cast(id - 2 as string) end as parent")
    found = graph.lowest_common_ancestor(spark.range(200).selectExpr("id as a", "id * 7 % 200 as b"), graph.Jumps(nodes))
    above = lambda k: [k] if k <= 2 else [k, *above(k - 2)]
    want = [(k, k * 7 % 200, next((str(x) for x in above(k) if x in above(k * 7 % 200)), None)) for k in range(200)]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == want
    assert not any("Broadcast" in p for p in [*plans, plan_of(found)])


@pytest.mark.parametrize("few", [0, 7, 50_000])
def test_list_ranks_over_stations(spark, monkeypatch, few):
    from orebody.operators import trees

    monkeypatch.setattr(trees, "FEW", few)
    sizes, seen, real = [], [], trees.cut
    monkeypatch.setattr(trees, "cut", lambda df: (seen.append(plan_of(df)), sizes.append(out := real(df)), out)[2])
    rows = [(k, k + 1 if k % 100 != 99 and k < 299 else None, k % 3) for k in range(300)] + [(1000, 50, 5), (1001, 5000, 1), (1002, 1001, 1)]
    got = trees.list_ranks(spark.createDataFrame(rows, "item long, next long, weight long"))
    want = [(k, k // 100 * 100 + 99, sum(j % 3 for j in range(k, k // 100 * 100 + 100))) for k in range(300)]
    want.append((1000, 99, 5 + want[50][2]))
    assert sorted(map(tuple, got.select("item", "last", "rest").collect())) == want  # what leads to no item is left out
    if not few:
        assert not any("Broadcast" in p for p in seen)
    with pytest.raises(ValueError):
        trees.list_ranks(spark.createDataFrame([(k, (k + 1) % 40, 1) for k in range(40)], "item long, next long, weight long"))


def test_expand_broadcasts_no_front(spark, plans):
    edges = spark.range(400).selectExpr("id div 7 as src", "id as dst", "cast(id as string) as label").filter("dst > 0")
    seed = spark.sql("select 0L as node, array('0') as path, 1.0D as score")
    got = graph.expand(seed, edges, 3, factor=0.5)
    depth = lambda k: 0 if k == 0 else 1 + depth(k // 7)
    assert sorted((x["node"], x["depth"]) for x in got.collect()) == [(k, depth(k)) for k in range(400) if depth(k) <= 3]
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans)


def test_tree_dump_over_stations(spark, monkeypatch):
    from orebody.operators import trees
    from orebody.sources import memory

    monkeypatch.setattr(trees, "FEW", 0, raising=False)
    seen, real = [], trees.cut
    monkeypatch.setattr(trees, "cut", lambda df: (seen.append(plan_of(df)), real(df))[1])
    parents = spark.range(12).selectExpr("id as node", "case when id > 0 then (id - 1) div 2 end as parent")
    got = memory.tree_dump(parents, "node").orderBy("place").collect()
    below = lambda k, d: [(k, d), *(x for c in (2 * k + 1, 2 * k + 2) if c < 12 for x in below(c, d + 1))]
    assert [(x["node"], x["line"]) for x in got] == [(k, "  " * d + str(k)) for k, d in below(0, 0)]
    assert not any("Broadcast" in p for p in seen[1:])


def test_ranked_trees_join_nothing_to_their_ranks(spark):
    from orebody.operators import trees
    from orebody.sources import memory

    above = {1: None, 2: 1, 3: 2, 9: 3, 4: 1, 5: None, 6: 5, 7: 6, 8: None}
    parents = spark.createDataFrame([(k, p, f"n{k}") for k, p in above.items()], "node long, parent long, title string")
    want = [(1, 1, 0, 0), (2, 1, 1, 1), (3, 1, 2, 2), (9, 1, 3, 3), (4, 1, 4, 1), (5, 5, 0, 0), (6, 5, 1, 1), (7, 5, 2, 2), (8, 8, 0, 0)]
    lines = memory.tree_dump(parents, "node")
    assert [tuple(x) for x in lines.orderBy("root", "place").collect()] == [(*w, "  " * w[3] + str(w[0])) for w in want]
    assert "Join" not in plan_of(lines)
    titled = memory.tree_dump(parents, "title", 2)
    assert [tuple(x) for x in titled.orderBy("root", "place").collect()] == [(*w, "  " * w[3] + f"n{w[0]}") for w in want if w[3] < 2]
    assert "Broadcast" not in plan_of(titled)
    ordered = trees.in_order(spark.createDataFrame([(4, 2, 6), (2, None, 3), (3, None, None), (6, 5, 77), (5, None, None), (9, None, None)], "node long, left long, right long"))
    assert sorted(map(tuple, ordered.collect())) == [(2, 4, 0), (3, 4, 1), (4, 4, 2), (5, 4, 3), (6, 4, 4), (9, 9, 0)]
    assert "Join" not in plan_of(ordered)
    for ring in ([(1, 2), (2, 1), (3, None)], [(1, 1)]):
        with pytest.raises(ValueError):
            memory.tree_dump(spark.createDataFrame(ring, "node long, parent long"), "node")


def test_debug_records_are_read_once(spark):
    from orebody.sources import text

    lines = [
        (0, "    <0>   DW_AT_name : nobody's"), (1, " <1><10>: Abbrev Number: 2 (DW_TAG_structure_type)"), (1, "    <0>   DW_AT_name : first"), (2, "noise"), (3, "    <0>   DW_AT_name : second"), (3, "    <0>   DW_AT_byte_size : 8  "),
        (4, "    <0>   DW_AT_byte_size : 9"), (4, "    <0>   DW_AT_note : a\0b"), (4, " <2><11>: Abbrev Number: 3 (DW_TAG_member)"), (4, "    <0>   DW_AT_name :"), (4, "    <0>   DW_AT_name : late"),
        (5, " <x><12>: (DW_TAG_member)"), (5, " <2><13>: (DW_TAG_member)"), (5, "    <0>   DW_AT_a : 1"), (6, " <0><14>: (DW_TAG_compile_unit)"), (6, " <7><15>: (DW_TAG_member)"),
    ]
    made = text.debug_records(spark.createDataFrame([("f", s, i, x) for i, (s, x) in enumerate(lines)], "file string, split long, line_no long, line string"), split="split")
    got = sorted((r.record_id, r.parent_id, r.depth, r.tag, r.attrs) for r in made.collect())
    assert got == [
        (16, None, 1, "structure_type", {"name": "first", "byte_size": "8", "note": "a\0b"}), (17, 16, 2, "member", {"name": ""}), (19, 16, 2, "member", {"a": "1"}),
        (20, None, 0, "compile_unit", {}), (21, 20, 7, "member", {}),
    ]
    assert "FlatMapGroups" not in plan_of(made)  # Python's part is written, not worked out again by each that reads it


def test_rules_find_letters_around_a_wildcard(spark):
    from orebody.operators import rules

    said = [f"Customer#{k:09d}" for k in range(0, 3000, 7)] + ["xabİcx", "AB-C", "abc", "ab", "", None, "\U0001f600ab\U0001f600cd"]
    names = spark.createDataFrame(list(enumerate(said)), "i int, name string")
    patterns = ["customer#*12?3*", "customer#*12?3*", "*ab?c*", "a[b]-c", "*0?1", "ab??cd*", "*1?1?1*"]
    index = rules.RuleIndex(spark, patterns).tuned(names, "name")
    assert index.chosen[0] == index.chosen[1] == "1123"  # letters that few names have, not those of every name
    got = index.candidates(names, "name")
    tests = [re.compile(rules.compile_pattern(p).text, re.S | re.I | re.A) for p in patterns]
    assert sorted(map(tuple, got.select("i", "rule_no").collect())) == [(i, n) for i, x in enumerate(said) if x is not None for n, p in enumerate(tests) if p.fullmatch(x)]
    assert got.columns == ["i", "name", "rule_no"]


def test_engine_reads_members_only_where_a_rule_waits(spark):
    from orebody.operators import rules

    lengths = []

    def extend(df):
        lengths.append({len(r.path) for r in df.collect()})
        return df.select("type_name", "address", F.concat("path", F.array(F.lit("m"))).alias("path"), (F.col("at") + 1).alias("at"))

    def decided(*known):
        lengths.clear()
        got = rules.RuleEngine(list(known), extend).evaluate(spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "type_name string, address long"))
        return sorted((r.type_name, r.address, ".".join(r.path), r.rule_name, r.result, r.ambiguous, r.generation) for r in got.collect())

    rule = lambda name, kind, n, to, priority: rules.PathRule(name, kind, ["m"] * n, "same", to, priority)
    got = decided(rule("alone", "[ab]", 0, "c", 0), rule("next", "c", 0, "d", 0))
    assert got == [(kind, at, "", name, at, False, n) for kind, at, name, n in [("a", 10, "alone", 0), ("b", 20, "alone", 0), ("c", 10, "next", 1), ("c", 20, "next", 1)]]
    assert lengths == []  # no rule has members
    got = decided(rule("short", "a", 1, "long_name", 3), rule("equal", "?", 2, "long_name", 3), rule("more", "?", 3, "long_name", 4), rule("more_too", "a", 3, "other_name", 4))
    assert got == [("a", 10, "m", "short", 11, False, 0), ("a", 10, "m.m.m", "more", 13, True, 0), ("b", 20, "m.m", "equal", 22, False, 0), ("b", 20, "m.m.m", "more", 23, False, 0)]
    assert lengths == [{0}, {1}, {2}]


def test_requests_of_one_type_stay_in_their_tasks(spark, monkeypatch):
    from orebody.operators import typed

    seen, real = [], typed.cut
    monkeypatch.setattr(typed, "cut", lambda df: (seen.append((df.columns, plan_of(df))), real(df))[1])
    types = spark.createDataFrame([(1, "Int32", "number", 4, None, None)], "type_id bigint, kind string, name string, size bigint, ref_type bigint, length bigint")
    tables = typed.TypeTables(types, spark.createDataFrame([], "type_id bigint, idx int, name string, offset bigint, ref_type bigint"))
    pages = spark.createDataFrame([(0, bytearray(range(64)))], "frame bigint, data binary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = typed.typed_reads(spark.createDataFrame([(1, "number@4"), (2, "1@0"), (3, "none@0")], "k long, spec string"), "k", tables, pages, 64)
        assert sorted((r.k, r.integer, r.error) for r in got.collect()) == [(1, 0x07060504, None), (2, 0x03020100, None), (3, None, "unknown type")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = next(p for c, p in seen if "_hex_id" in c)
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("few", [0, 40, 20_000])
def test_lists_walked_over_stations(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few, raising=False)
    r = random.Random(few)
    after = {k: k + 1 if k % 1000 else None for k in range(1, 2001)}  # two long lists; below: lists that meet, run in circles, come to their head
    after |= {k: r.choice([r.randrange(3000, 3200), None, 3000 + (k - 2999) % 200]) for k in range(3000, 3200)} | {k: 4000 + (k - 3999) % 30 for k in range(4000, 4030)} | {5000: 5001, 5001: 5002, 5002: 5000, 6000: 6000, 7000: 99}
    heads = [(-1, 1), (-2, 1001), (4007, 4008), (-3, None), (-4, 9000), (-5, 7000), (-6, 3000), (-6, 3050), (6000, 6000), *((-k, k) for k in range(3000, 3200, 9))]
    want = {}
    for head, first in heads:
        node, place = first, 0
        while node is not None and want.get((head, node), place + 1) > place:
            want[head, node], node, place = place, after.get(node), place + 1
    stop = {h: p for (h, n), p in want.items() if h == n}
    want = sorted((h, n, p) for (h, n), p in want.items() if p < stop.get(h, p + 1))
    links = spark.createDataFrame(list(after.items()), "node long, next long")
    got = graph.walk_list(spark.createDataFrame(heads, "head long, first long"), links)
    assert sorted(map(tuple, got.select("head", "node", "place").collect())) == want


def test_a_long_list_is_written_a_few_times(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 50, raising=False)
    rows, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (out := real(df), rows.append(out.count()))[0])
    n = 4000
    got = graph.walk_list(spark.createDataFrame([(-1, 0)], "head long, first long"), spark.range(n).selectExpr("id as node", f"case when id + 1 < {n} then id + 1 end as next"))
    assert got.filter("node = place").count() == n
    assert sum(rows) < 8 * n


@pytest.mark.parametrize("few, deep", [(20_000, True), (0, True), (20_000, False)])
def test_variables_read_members_once(spark, monkeypatch, few, deep):
    from orebody.operators import typed

    monkeypatch.setattr(typed, "FEW", few)
    seen, real = [], typed.cut
    monkeypatch.setattr(typed, "cut", lambda df: (seen.append(plan_of(df)), real(df))[1])
    types = [(1, "Struct", None), (2, "Pointer", 1), *([(3, "Pointer", 2), (4, "Typedef", 3)] if deep else [])]
    types = spark.createDataFrame(types, "type_id long, kind string, ref_type long").unionByName(spark.range(7, 107).selectExpr("id * 10 + 1 as type_id", "'Pointer' as kind", "id * 10 as ref_type"))
    members = spark.range(7, 107).selectExpr("id * 10 as type_id", "concat('m', id) as name", f"id % {3 if deep else 1} + 2 as ref_type").distinct()
    variables = spark.range(1, 1100).selectExpr("id as var_id", "id as type_id")
    got = typed.variables_using(spark.createDataFrame([(1,)], "type_id long"), types, members, variables, 1000, 2)
    own = {2, 3, 4} if deep else {2}
    assert sorted(map(tuple, got.collect())) == sorted([(1, k, "", 0) for k in own] + [(1, k * 10 + 1, f"m{k}", 1) for k in range(7, 107)])
    assert sum("m, " in p for p in seen) == 1


@pytest.mark.parametrize("share, few", [(4, 20_000), (0, 0), (10**6, 20_000)])
def test_pairs_of_many_roots_are_compared_once(spark, monkeypatch, share, few):
    from orebody.operators import diff

    monkeypatch.setattr(diff, "SHARED", share, raising=False)
    monkeypatch.setattr(diff, "FEW", few, raising=False)
    rows, real = [], diff.cut
    monkeypatch.setattr(diff, "cut", lambda df: (out := real(df), rows.append(out.count()))[0])
    n = 300
    values = spark.createDataFrame([(0, "x", "1"), (1, "x", "2"), (2, "y", "1"), (3, "y", "1"), (3, "z", None), (5, "w", "1"), (6, "w", "2")], "object long, field string, value string")
    links = [(o, f"f{k:02d}", o + 2) for o in (0, 1) for k in range(20)] + [(2, "back", 0), (3, "back", 1), (2, "only", 5), (2, "to", 5), (3, "to", 6), (2, "nowhere", None), (3, "nowhere", None)]
    links = spark.createDataFrame(links, "object long, field string, target long")
    got = diff.recursive_diff(spark.range(n).selectExpr("id as root", "0L as a", "1L as b"), values, values, links, links)
    assert sorted(map(tuple, got.collect())) == sorted((k, p) for k in range(n) for p in ("x", "f00.z", "f00.only", "f00.to.w"))
    assert share > 4 or max(rows) <= 2 * n
