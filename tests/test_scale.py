"""Scans, cells, jumps, tours, the reverse map, differences and rules against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from orebody.operators import diff, dyadic, graph, instances, intervals, revmap, rules, scans, stats, trees, validate
from orebody.sources import memory, text


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture()
def narrow(spark):
    """Small ranges, so that keys lie in many of them."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def slow_merge(items, touching):
    out = []
    for k in {x[0] for x in items}:
        runs = []
        for _, s, e in sorted(x for x in items if x[0] == k):
            if runs and s <= runs[-1][1] + touching:
                runs[-1][1], runs[-1][2] = max(runs[-1][1], e), runs[-1][2] + 1
            else:
                runs.append([s, e, 1])
        out += [(k, *r) for r in runs]
    return sorted(out)


def test_merge_over_ranges(narrow):
    rng = random.Random(5)
    items = [(0, s := rng.randrange(40_000), s + rng.choice([0, 3, 30, 400])) for _ in range(900)] + [(rng.randrange(1, 5), s := rng.randrange(900), s + rng.randrange(5)) for _ in range(200)]
    items += [(0, 5, 60_000 if i == 0 else 9) for i in range(3)] + [(9, 1, 1)] * 40
    for part in (items, items[:900]):
        for touching in (0, 1, 25):
            df = narrow.createDataFrame(part, "k int, s long, e long")
            assert rows_of(intervals.merge(df, ["k"], "s", "e", touching), "k", "s", "e", "n") == slow_merge(part, touching)
    df = narrow.createDataFrame([(None, 1, 2), (None, 2, 5)], "k int, s long, e long")
    assert [tuple(r) for r in intervals.merge(df, ["k"], "s", "e").collect()] == [(None, 1, 5, 2)]
    assert intervals.merge(df.limit(0), ["k"], "s", "e").count() == 0


def test_many_separate_intervals_of_one_key_are_shared_out(narrow):
    df = narrow.range(100_000).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 3).alias("e"))
    line = scans.ranged(df, ["k", "s", "e"])
    sizes = [r[1] for r in line.groupBy("_part").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 40_000
    assert intervals.merge(df, ["k"], "s", "e").count() == 100_000


def test_runs_over_ranges(narrow):
    rng = random.Random(6)
    places = sorted({rng.randrange(3000) for _ in range(2500)})
    got = rows_of(diff.runs_of(narrow.createDataFrame([(1, p) for p in places] * 2, "g int, p long"), ["g"], "p"), "g", "start", "run")
    want = []
    for p in places:
        if want and want[-1][1] + want[-1][2] == p:
            want[-1][2] += 1
        else:
            want.append([1, p, 1])
    assert got == [tuple(x) for x in want]


def test_neighbours_over_ranges(narrow):
    got = {(r.g, r.o): (r.prev, r.next) for r in graph.neighbours_window(narrow.createDataFrame([(i % 2 if i < 900 else 5, i) for i in range(1000)], "g int, o long"), "g", "o").collect()}
    for g in (0, 1, 5):
        own = sorted(o for k, o in got if k == g)
        for a, b, c in zip([None, *own], own, [*own[1:], None]):
            assert got[g, b] == (a, c)


def test_as_of_over_ranges(narrow):
    rng = random.Random(8)
    objects = {rng.randrange(5000): rng.choice([0, 1, 5, 40]) for _ in range(300)}
    probes = [(i, 77 if i % 3 == 0 else rng.randrange(-5, 5200)) for i in range(600)]
    got = {r.i: r.s for r in intervals.as_of(narrow.createDataFrame(probes, "i long, p long"), narrow.createDataFrame(list(objects.items()), "s long, z long"), "p", "s", "z", [], both="left").collect()}
    for i, p in probes:
        s = max((x for x in objects if x <= p), default=None)
        inside = s is not None and (p == s if objects[s] <= 0 else p < s + objects[s])
        assert got[i] == (s if inside else None)


def test_cover_holds_every_point_once(spark):
    rng = random.Random(2)
    ranges = [(a := rng.randrange(-(10**6), 10**6), a + rng.randrange(-2, 10 ** rng.randrange(1, 7))) for _ in range(60)] + [(-(1 << 61), 1 << 61), (0, 0), (7, 8), (-9, 63)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "i int, a long, b long")
    cells = {r.i: [(c.level, c.cell) for c in r.c] for r in df.select("i", dyadic.cover(F.col("a"), F.col("b")).alias("c")).collect()}
    for i, (a, b) in enumerate(ranges):
        parts = sorted((c << (3 * k), ((c + 1) << (3 * k)) - 1) for k, c in cells[i])
        assert (not parts and b < a) or (parts[0][0] == a and parts[-1][1] == b and all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:])))
        assert max((len([1 for k, _ in cells[i] if k == level]) for level in range(20)), default=0) <= 14


def test_range_summaries(spark):
    rng = random.Random(3)
    objects = [(s := rng.randrange(20_000), s + rng.choice([0, 10, 3000, 9000]) if i % 50 else s - 1, rng.random() if i % 7 else None, 1 << rng.randrange(5), i) for i in range(500)] + [(100, 140, 0.5, 32, 1)] * 30
    schema = "s long, e long, p double, k int, w long"
    update = [*intervals.summary("p", "k"), F.sum("w").alias("w")]
    unite = [*intervals.merged_summary(), F.sum("w").alias("w")]
    made = dyadic.RangeSummaries(spark.createDataFrame(objects, schema), "s", "e", update, unite)
    asked = [(i, a := rng.randrange(-50, 21_000), a + rng.randrange(-40, 6000)) for i in range(120)] + [(998, 0, 10**9), (999, 120, 120)]
    got = {r.i: r for r in made.of_ranges(spark.createDataFrame(asked, "i long, a long, b long"), "i", "a", "b").collect()}
    for i, a, b in asked:
        a, b = min(a, b), max(a, b)
        met = [o for o in objects if o[0] <= o[1] and o[0] <= b and o[1] >= a]
        assert (i in got) == bool(met)
        if met:
            ps = [o[2] for o in met if o[2] is not None]
            kinds = 0
            for o in met:
                kinds |= o[3]
            assert (got[i].n, got[i].min_prob, got[i].max_prob, got[i].kinds, got[i].w) == (len(met), min(ps, default=None), max(ps, default=None), kinds, sum(o[4] for o in met))
    at = {r.i: r.n for r in made.at_points(spark.createDataFrame([(1, 100), (2, 141)], "i long, p long"), "i", "p").collect()}
    assert at[1] == sum(o[0] <= 100 <= o[1] for o in objects) and at.get(2, 0) == sum(o[0] <= 141 <= o[1] for o in objects)
    plan = made.of_ranges(spark.createDataFrame(asked, "i long, a long, b long"), "i", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_long_intervals_meet_what_they_hold(spark):
    rng = random.Random(4)
    a = [(i, s := rng.randrange(10**9), s + rng.choice([5, 10**4, 10**8, 5 * 10**8])) for i in range(60)]
    b = [(i, s := rng.randrange(10**9), s + rng.choice([0, 100, 3 * 10**8])) for i in range(60)]
    got = rows_of(intervals.overlap_join(spark.createDataFrame(a, "i long, s long, e long"), spark.createDataFrame(b, "j long, t long, f long"), "s", "e", "t", "f", 16), "i", "j")
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2])


def test_subtract_cuts_and_swallows(spark):
    rng = random.Random(7)
    runs = [(i, s := rng.randrange(500), s + rng.randrange(60)) for i in range(40)] + [(90, 1000, 1010), (91, 2000, 2005)]
    out = [(s := rng.randrange(500), s + rng.randrange(12)) for _ in range(25)] + [(990, 1020), (2002, 2002), (7, 3)]
    got = rows_of(intervals.subtract(spark.createDataFrame(runs, "i long, s long, e long"), "s", "e", spark.createDataFrame(out, "x long, y long"), "x", "y", 64), "i", "s", "e")
    gone = {p for x, y in out for p in range(x, y + 1)}
    want = []
    for i, s, e in runs:
        for _, part in itertools.groupby((p for p in range(s, e + 1) if p not in gone), key=lambda p, c=itertools.count(): p - next(c)):
            part = list(part)
            want.append((i, part[0], part[-1]))
    assert got == sorted(want)
    none = intervals.subtract(spark.createDataFrame(runs, "i long, s long, e long"), "s", "e", spark.createDataFrame([], "x long, y long"), "x", "y", 64)
    assert rows_of(none, "i", "s", "e") == sorted(runs)


def test_closure_of_a_circle_is_an_error(spark):
    types = spark.createDataFrame([(1, 4, 2), (2, 4, 1), (3, 4, 4), (4, 1, None)], "type_id long, kind int, ref_type_id long")
    with pytest.raises(ValueError):
        graph.closure(types, 4)
    ended = graph.closure(types.filter("type_id > 2").unionByName(types.limit(0)), 4)
    assert rows_of(ended, "type_id", "end_id", "depth") == [(3, 4, 1), (4, 4, 0)]


def test_jumps_and_ancestors_in_deep_trees(spark):
    rng = random.Random(9)
    n = 2000
    parent = {i: (i - 1 if i < 1500 else rng.randrange(i)) for i in range(1, n)} | {0: None, n: None, n + 1: n}
    df = spark.createDataFrame([(str(k), None if v is None else str(v)) for k, v in parent.items()], "node string, parent string")
    jumps = graph.Jumps(df)

    def line(k):
        out = [k]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out

    assert {r.node: r.depth for r in jumps.depths.collect()} == {str(k): len(line(k)) - 1 for k in parent}
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(150)] + [(5, 5), (0, 1999), (3, n + 1), (n, n + 1)]
    got = {(r.a, r.b): r.lca for r in graph.lowest_common_ancestor(spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string"), jumps).collect()}
    for a, b in pairs:
        above = set(line(b))
        want = next((str(x) for x in line(a) if x in above), None)
        assert got[str(a), str(b)] == want
    near = jumps.lines(spark.createDataFrame([("1400",)], "node string"), within=5)
    assert rows_of(near, "distance", "above") == [(d, str(1400 - d)) for d in range(1, 6)]
    assert sum(t.count() for t in jumps.levels) <= (n + 2) * 11
    with pytest.raises(ValueError):
        graph.Jumps(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "node string, parent string"))


def test_preorder_and_in_order(spark):
    rng = random.Random(11)
    parent = {0: None, 500: None} | {i: rng.choice([i - 1, rng.randrange(i), 0]) for i in range(1, 300)}
    got = {r.node: (r.root, r.place) for r in trees.preorder(spark.createDataFrame([(k, v) for k, v in parent.items()], "node long, parent long")).collect()}
    order = []

    def walk(k):
        stack = [k]
        while stack:
            x = stack.pop()
            order.append(x)
            stack += sorted((c for c, p in parent.items() if p == x), reverse=True)

    walk(0)
    assert got == {k: (0, i) for i, k in enumerate(order)} | {500: (500, 0)}
    left, right, keys = {}, {}, list(range(400))
    rng.shuffle(keys)
    for root, own in ((keys[0], keys), (1000, list(range(1000, 1200)))):  # a bushy one and a chain to the right
        for k in own[1:]:
            at = root
            while True:
                side = left if k < at else right
                if at not in side:
                    side[at] = k
                    break
                at = side[at]
    nodes = spark.createDataFrame([(k, left.get(k), right.get(k)) for k in [*keys, *range(1000, 1200)]] + [], "node long, left long, right long")
    got = {r.node: (r.root, r.place) for r in trees.in_order(nodes).collect()}
    assert got == {k: (keys[0], k) for k in keys} | {k: (1000, k - 1000) for k in range(1000, 1200)}
    assert trees.in_order(nodes.limit(0)).count() == 0


def test_hash_chains(spark):
    heads = spark.createDataFrame([(10, 100), (20, 200), (30, None)], "head long, first long")
    links = spark.createDataFrame([(100, 101, 10), (101, 102, 108), (102, None, 5), (200, None, 20)], "node long, next long, pprev long")
    got = rows_of(trees.hash_chains(heads, links, next_offset=8), "head", "place", "node", "linked")
    assert got == [(10, 0, 100, True), (10, 1, 101, True), (10, 2, 102, False), (20, 0, 200, True)]


def test_tree_lines_and_dumps(spark, tmp_path):
    parents = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", "c")], "node string, parent string")
    lines = [r.line for r in memory.tree_lines(graph.ancestors(parents), "node", 3).collect()]
    assert lines == ["a", "  b", "    c", "  d"]
    memory.dump_objects(spark.createDataFrame([(1, "x"), (2, None)], "a long, t string"), str(tmp_path / "o"), ["a", "t"])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "o")).collect()) == ["1\tx", "2"]


def test_fixed_point_works_out_less_each_round(spark):
    rng = random.Random(12)
    n = 120
    initial = {i: (rng.uniform(0.5, 1), rng.choice([1, 1, 2, 3])) for i in range(n)}
    edges = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(90)) if a < b} | {(0, i) for i in range(1, 40)})
    log: list[int] = []
    got = {r.id: r.p for r in graph.fixed_point(spark.createDataFrame([(i, *v) for i, v in initial.items()], "id long, initial double, encounters int"), spark.createDataFrame(edges, "parent long, child long"), rounds=6, log=log).collect()}
    f = {i: 1.5 * (e - 1) if e > 1 else 1.0 for i, (_, e) in initial.items()}
    p = {i: min(1.0, initial[i][0] * f[i]) for i in initial}
    for _ in range(6):
        kids = {i: [p[b] for a, b in edges if a == i] for i in p}
        ups = {i: [p[a] for a, b in edges if b == i] for i in p}
        p = {i: min(1.0, initial[i][0] * max(ups[i], default=1.0) * (sum(kids[i]) / len(kids[i]) if kids[i] else 1.0) * f[i]) for i in p}
    assert all(abs(got[i] - p[i]) < 1e-9 for i in p)
    assert log[0] == n


def test_fixed_point_looks_only_where_something_moves(spark):
    n = 400  # a long chain whose values are 1 but for a few at its end
    nodes = [(i, 1.0 if i < n - 3 else 0.9, 1) for i in range(n)]
    log: list[int] = []
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(1000, 2000 + i) for i in range(50)], "parent long, child long")
    more = [(1000, 1.0, 1)] + [(2000 + i, 1.0, 1) for i in range(50)]
    got = {r.id: r.p for r in graph.fixed_point(spark.createDataFrame(nodes + more, "id long, initial double, encounters int"), edges, rounds=5, log=log).collect()}
    p = {i: x for i, x, _ in nodes}
    for _ in range(5):
        p = {i: min(1.0, nodes[i][1] * p.get(i - 1, 1.0) * p.get(i + 1, 1.0)) for i in p}
    assert all(abs(got[i] - p[i]) < 1e-9 for i in p) and got[2007] == 1.0
    assert log[0] == n + 51 and max(log[1:]) < 20


# --- the reverse map


def slow_reverse_map(seeds, size, kids, ok, magic, least, gap):
    """One by one, the most probable first. kids: node -> children (node) or None."""
    import heapq

    def factor(node):
        p = 1 - 1e-5
        p = p * (1.0 if ok(node) else 0.01)
        aimed = kids(node)
        share = sum(ok(k) for k in aimed) / len(aimed) if aimed else 1.0
        p = p * (1.0 if magic(node) else 0.7)
        bad = 1.0 - share
        return p * (bad * 0.2 + (1 - bad))

    queue = [(-(p * factor(s) / (1 - 1e-5)), s) for s, p in seeds]
    heapq.heapify(queue)
    stored = {}
    while queue:
        p, node = heapq.heappop(queue)
        p = -p
        if p <= least:
            break
        if node in stored:
            continue
        a, t = node
        e = a + size(node) - 1
        hit = False
        for (b, u), q in stored.items():
            f = b + size((b, u)) - 1
            if q > p + gap and a <= f and b <= e:
                inside = (a <= b and f <= e) or (b <= a and e <= f)
                held = inside and t == u and (a, e) == (b, f)
                if not held:  # within one another, but no type holds the other; or across
                    hit = True
        if hit:
            continue
        stored[node] = p
        for k in kids(node):
            heapq.heappush(queue, (-(p * factor(k)), k))
    return stored


def test_reverse_map_equals_one_by_one(spark):
    rng = random.Random(2)
    n = 120
    kinds = {"A": 40, "B": 16}
    address = {i: 1000 + 36 * i for i in range(n)}
    aim = {(i, slot): address[rng.randrange(n)] if rng.random() < 0.7 else 0 for i in range(n) for slot in (0, 8)}
    at = {address[i]: i for i in range(n)}
    ok = lambda node: node[0] in at and at[node[0]] % 19 != 4
    magic = lambda node: node[0] in at and at[node[0]] % 4 != 1
    to = {("A", 0): "B", ("A", 8): "A", ("B", 0): "A"}

    def kids(node):
        i = at.get(node[0])
        return [] if i is None else [(aim[i, off], to[node[1], off]) for off in (0, 8) if (node[1], off) in to and aim[i, off]]

    members = spark.createDataFrame([(t, f"m{o}", o, "Pointer", r, 8, 1) for (t, o), r in to.items()], "type_id string, member string, offset long, kind string, ref_type string, size long, length int")
    pointers = spark.createDataFrame([(address[i] + o, v) for (i, o), v in aim.items()], "address long, value long")
    index = (F.col("address") - 1000) / 36
    here = (F.col("address") >= 1000) & ((F.col("address") - 1000) % 36 == 0) & (index < n)
    build = revmap.ReverseMap(
        spark.createDataFrame(list(kinds.items()), "type_id string, size long"), members, pointers, lambda d: d.withColumn("valid", here & (index % 19 != 4)), lambda d: d.withColumn("magic_ok", here & (index % 4 != 1)),
        layout=spark.createDataFrame([], "type_id string, offset long, inner_type string, stride long, count long"), least=0.6,
    )
    seeds = [((address[i], "A" if i % 2 else "B"), p) for i, p in ((0, 1.0), (7, 0.97), (30, 0.9), (31, 0.35), (61, 0.8), (90, 0.75), (105, 0.6))]
    got = {(r.address, r.type_id): r.prob for r in build.build(spark.createDataFrame([(a, t, p) for (a, t), p in seeds], "address long, type_id string, prob double")).collect()}
    want = slow_reverse_map(seeds, lambda x: kinds[x[1]], kids, ok, magic, 0.6, 0.1)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 8


def test_reverse_map_of_nothing(spark):
    empty = lambda s: spark.createDataFrame([], s)
    build = revmap.ReverseMap(empty("type_id string, size long"), empty("type_id string, member string, offset long, kind string, ref_type string, size long, length int"), empty("address long, value long"), lambda d: d.withColumn("valid", F.lit(True)))
    assert build.build(empty("address long, type_id string, prob double")).count() == 0
    assert rows_of(build.build(spark.createDataFrame([(8, "x", 1.0), (8, "x", 1.0)], "address long, type_id string, prob double")), "address", "end", "prob") == [(8, 8, 1.0)]
    log = spark.createDataFrame([(64, 32, "t"), (64, 32, "t")], "slot long, slot_size long, slot_type string")
    assert rows_of(revmap.slab_map(log), "address", "end", "prob") == [(64, 95, 1.0)]


# --- differences, caches, waiting references


def test_recursive_difference(spark):
    rng = random.Random(13)
    values, links = [{}, {}], [{}, {}]
    for side in (0, 1):
        for o in range(30):
            for f in "xyz":
                if rng.random() < 0.8:
                    values[side][o, f] = str(rng.randrange(2))
            for f in "pq":
                if rng.random() < 0.93:
                    links[side][o, f] = rng.randrange(3 * len(f) + 5)
    want, seen, front = set(), set(), [("", 0, 0)]
    while front:
        best = {}
        for path, a, b in front:
            if (a, b) not in seen:
                best[a, b] = min(path, best.get((a, b), path))
        seen |= set(best)
        front = []
        for (a, b), path in best.items():
            dot = lambda f: f"{path}.{f}" if path else f  # noqa: B023, E731
            for f in "xyz":
                if values[0].get((a, f)) != values[1].get((b, f)):
                    want.add(dot(f))
            for f in "pq":
                x, y = links[0].get((a, f)), links[1].get((b, f))
                if (x is None) != (y is None):
                    want.add(dot(f))
                elif x is not None:
                    front.append((dot(f), x, y))
    table = lambda d, t, v: spark.createDataFrame([(o, f, x) for (o, f), x in d.items()], f"object long, field string, {v} {t}")
    pairs = spark.createDataFrame([("r", 0, 0)], "root string, a long, b long")
    got = diff.recursive_diff(pairs, table(values[0], "string", "value"), table(values[1], "string", "value"), table(links[0], "long", "target"), table(links[1], "long", "target"))
    assert {r.path for r in got.collect()} == want and len(seen) > 5


def test_cache_types_meet_only_what_fits(spark):
    caches = spark.createDataFrame([("inode_cache", 16), ("file", 8), ("s", 4), ("dentrys", 9)], "cache string, object_size int")
    types = spark.createDataFrame([("inode_ext", 16, 1), ("inode", 16, 2), ("inode", 8, 3), ("filesystem", 8, 4), ("files", 8, 5), ("other", 4, 6)], "name string, size int, type_id long")
    assert rows_of(validate.cache_types(caches, types), "cache", "type_name", "type_id") == [("file", "files", 5), ("inode_cache", "inode", 2), ("s", "other", 6)]


def test_postponed_names_the_first_waiters(spark):
    df = spark.createDataFrame([(7, i) for i in range(500)] + [(7, 3), (8, 1), (9, 2), (None, 4), (8, None)], "ref long, w long")
    got = [(r.ref, r.n, r.waiters) for r in stats.postponed(df, "ref", spark.createDataFrame([(9,)], "k long"), "k", "w", 5, 3).orderBy("ref").collect()]
    assert got == [(7, 501, [0, 1, 2]), (8, 2, [1])]


def test_relations_of_types(spark):
    cases = [("none", False, False, False, "none"), ("equal", True, False, False, "equal"), ("equal", False, False, False, "cover"), ("equal", False, True, False, "first_embeds"), ("second_embeds", False, True, False, "cover"), ("first_embeds", False, True, False, "first_embeds"), ("second_embeds", False, False, True, "second_embeds"), ("overlap", True, True, True, "overlap")]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, r string, same boolean, f boolean, s boolean")
    got = {r.i: r.v for r in df.select("i", intervals.type_relation(F.col("r"), F.col("same"), F.col("f"), F.col("s")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[4] for c in cases]


def test_checks_side_by_side(spark):
    a = spark.createDataFrame([(1, "valid")], "k long, slab string")
    assert validate.verify_instance(a, spark.createDataFrame([(1, True)], "k long, m boolean"), spark.createDataFrame([], "k long, p double"), "k").first().asDict() == {"k": 1, "slab": "valid", "m": True, "p": None}
    assert validate.version_matches("2.6.32 ", "2.6.32") and not validate.version_matches("2.6.32", "2.6.33")
    cpus = spark.createDataFrame([(0, 100), (1, 200)], "cpu int, offset long")
    assert rows_of(graph.per_cpu(spark.createDataFrame([(5,)], "a long"), cpus, "a", every=False), "a") == [(105,)]
    assert instances.is_valid(F.lit(1), F.lit(None)) is not None


def test_lookup_of_a_name_that_must_be_unique(spark):
    from orebody.functions.filters import ambiguous_lookup

    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "name string, v long")
    assert [r.v for r in ambiguous_lookup(df, "name", "a").collect()] == [1] and ambiguous_lookup(df, "name", "c").count() == 0
    with pytest.raises(Exception, match="ambiguous type"):
        ambiguous_lookup(df, "name", "b").collect()


# --- rules


def test_rule_index_equals_every_rule_on_every_name(spark):
    from orebody.functions.patterns import compile_pattern, matches

    rng = random.Random(14)
    names = ["".join(rng.choice("abcDE_1") for _ in range(rng.randrange(0, 9))) for _ in range(300)] + [None, "abcabc", "task_struct", "Task_Struct", "list_head"]
    patterns = ["task_struct", "*_struct", "list*head", "abc*", "?bc*", "*[ab]cD*", "/^ab/", "/AB/i", None, "a*", "*abc", "[abc]*1", "ab[cd]", "*a*b*"] + [f"*{''.join(rng.choice('abcd') for _ in range(3))}*" for _ in range(60)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, name string")
    index = rules.RuleIndex(spark, patterns)
    said = F.array_compact(F.array(*[F.when(matches(F.col("name"), compile_pattern(p)), F.lit(i)) for i, p in enumerate(patterns)]))
    want = rows_of(df.select("i", F.explode(said).alias("rule_no")), "i", "rule_no")
    assert rows_of(index.candidates(df, "name"), "i", "rule_no") == want
    assert rows_of(index.tuned(df, "name").candidates(df, "name"), "i", "rule_no") == want
    with pytest.raises(ValueError):
        rules.RuleIndex(spark, ["x"] * (rules.MOST_RULES + 1))


def test_rules_wait_fire_and_follow(spark):
    @rules.action("same")
    def same(at):
        return at

    @rules.action("down")
    def down(at):
        return F.when(at % 100 != 0, at - 1)

    fields = {"list": {"next": 8, "prev": 16}, "task": {"list": 32}}
    inner = {("task", "list"): "list"}

    def extend(df):
        out = None
        for owner, members in fields.items():
            for m, offset in members.items():
                holds = (F.col("type_name") == owner) & (F.size("path") == 0) if owner == "task" else (F.size("path") == 1) & (F.element_at("path", -1) == "list") if owner == "list" else F.lit(False)
                one = df.filter(holds).withColumns({"path": F.concat("path", F.array(F.lit(m))), "at": F.col("at") + offset})
                out = one if out is None else out.unionByName(one)
        return out

    assert inner
    made = rules.RuleEngine(
        [
            rules.PathRule("next", "task", ["list", "next"], "same", "node", 1), rules.PathRule("both", "ta*", ["list", "*"], "same", "node", 0), rules.PathRule("node", "node", [], "down", "leaf"),
            rules.PathRule("off", "task", [], "same", "task", 9, enabled=False), rules.PathRule("again", "leaf", [], "same", "leaf"),
        ],
        extend,
    ).evaluate(spark.createDataFrame([("task", 1000), ("task", 1160), ("other", 5)], "type_name string, address long"))
    got = sorted((r.generation, r.type_name, r.address, ".".join(r.path), r.rule_name, r.result) for r in made.collect())
    assert got == [
        (0, "task", 1000, "list.next", "next", 1040), (0, "task", 1000, "list.prev", "both", 1048), (0, "task", 1160, "list.next", "next", 1200), (0, "task", 1160, "list.prev", "both", 1208),
        (1, "node", 1040, "", "node", 1039), (1, "node", 1048, "", "node", 1047), (1, "node", 1208, "", "node", 1207),
        (2, "leaf", 1039, "", "again", 1039), (2, "leaf", 1047, "", "again", 1047), (2, "leaf", 1207, "", "again", 1207),
    ]
    with pytest.raises(ValueError):
        rules.RuleEngine([rules.PathRule("x", "t", action="missing")], extend)


def test_parent_rules_win_unless_weaker(spark):
    rules.ACTIONS.setdefault("same", lambda at: at)
    step = lambda df: df.filter(F.size("path") < 2).withColumns({"path": F.concat("path", F.array(F.lit("m"))), "at": F.col("at") + 1})
    engine = lambda p: rules.RuleEngine([rules.PathRule("short", "t", ["m"], "same", "a", 3), rules.PathRule("long", "t", ["m", "m"], "same", "b", p)], step)
    one = spark.createDataFrame([("t", 10)], "type_name string, address long")
    assert [r.rule_name for r in engine(3).evaluate(one).collect()] == ["short"]
    assert sorted(r.rule_name for r in engine(4).evaluate(one).collect()) == ["long", "short"]


def test_results_are_put_on_members(spark):
    members = spark.createDataFrame([(7, 0, "head"), (7, 8, "next")], "struct_id long, offset long, name string")
    df = spark.createDataFrame([(1, 7, 100, 16, 108), (2, 7, 100, 16, 104), (3, 7, 100, 16, 999)], "i long, type_id long, base long, size long, result long")
    got = {r.i: r.member for r in rules.reanchor(df, "result", "base", "size", members).collect()}
    assert got == {1: "next", 2: None, 3: None}


# --- debug records over splits


LISTING = """x.o: file format
 <0><b>: Abbrev Number: 1 (DW_TAG_compile_unit)
    <c>   DW_AT_name        : a.c
 <1><10>: Abbrev Number: 2 (DW_TAG_base_type)
    <11>   DW_AT_byte_size   : 4
    <12>   DW_AT_name        : (indirect string, offset: 0x1f): int
 <1><20>: Abbrev Number: 3 (DW_TAG_structure_type)
    <21>   DW_AT_name        : list
    <22>   DW_AT_byte_size   : 16
 <2><28>: Abbrev Number: 4 (DW_TAG_member)
    <29>   DW_AT_name        : next
    <2a>   DW_AT_type        : <0x40>
    <2b>   DW_AT_data_member_location: 0
 <2><30>: Abbrev Number: 4 (DW_TAG_member)
    <31>   DW_AT_name        : count
    <32>   DW_AT_type        : <10>
    <33>   DW_AT_data_member_location: 2 byte block: 23 8 	(DW_OP_plus_uconst: 8)
 <1><40>: Abbrev Number: 5 (DW_TAG_pointer_type)
    <41>   DW_AT_byte_size   : 8
    <42>   DW_AT_type        : <0x20>
 <1><50>: Abbrev Number: 6 (DW_TAG_array_type)
    <51>   DW_AT_type        : <0x10>
 <2><54>: Abbrev Number: 7 (DW_TAG_subrange_type)
    <55>   DW_AT_upper_bound : 3
 <2><58>: Abbrev Number: 7 (DW_TAG_subrange_type)
    <59>   DW_AT_upper_bound : 1
 <1><60>: Abbrev Number: 8 (DW_TAG_enumeration_type)
    <61>   DW_AT_name        : color
 <2><64>: Abbrev Number: 9 (DW_TAG_enumerator)
    <65>   DW_AT_name        : RED
    <66>   DW_AT_const_value : -1
 <1><70>: Abbrev Number: 10 (DW_TAG_variable)
    <71>   DW_AT_name        : head
    <72>   DW_AT_type        : <0x20>
    <73>   DW_AT_location    : 9 byte block: 3 0 	(DW_OP_addr: ffffffff81000000)
 <1><80>: Abbrev Number: 11 (DW_TAG_subprogram)
    <81>   DW_AT_name        : main
    <82>   DW_AT_low_pc      : 0x400000
    <83>   DW_AT_high_pc     : 0x400010
 <2><88>: Abbrev Number: 12 (DW_TAG_lexical_block)
 <3><90>: Abbrev Number: 10 (DW_TAG_variable)
    <91>   DW_AT_name        : local
""".splitlines()


def test_debug_records_over_splits(spark):
    every = [(r.record_id, r.parent_id, r.depth, r.tag, tuple(sorted(r.attrs.items()))) for r in text.debug_records(spark.createDataFrame([("f", i, x) for i, x in enumerate(LISTING)], "file string, line_no long, line string")).orderBy("record_id").collect()]
    assert {i: p for i, p, *_ in every} == {0xB: None, 0x10: 0xB, 0x20: 0xB, 0x28: 0x20, 0x30: 0x20, 0x40: 0xB, 0x50: 0xB, 0x54: 0x50, 0x58: 0x50, 0x60: 0xB, 0x64: 0x60, 0x70: 0xB, 0x80: 0xB, 0x88: 0x80, 0x90: 0x88}
    for size in (1, 2, 3, 7, 20):
        cut = spark.createDataFrame([("f", i // size * 1000, i, x) for i, x in enumerate(LISTING)], "file string, split long, line_no long, line string")
        got = [(r.record_id, r.parent_id, r.depth, r.tag, tuple(sorted(r.attrs.items()))) for r in text.debug_records(cut, split="split").orderBy("record_id").collect()]
        assert got == every


def test_typed_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(LISTING))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        read = text.split_lines(spark, str(tmp_path / "a.txt"))
        assert read.select("split").distinct().count() > 3
        made = {k: v.collect() for k, v in text.typed_rows(text.debug_records(read, split="split")).items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.type_id, r.kind, r.name, r["size"], r.ref_type_id, r.length) for r in made["types"]) == [(0x10, "Base", "int", 4, None, None), (0x20, "Struct", "list", 16, None, None), (0x40, "Pointer", None, 8, 0x20, None), (0x50, "Array", None, None, 0x10, 8), (0x60, "Enum", "color", None, None, None)]
    assert sorted((r.struct_id, r.name, r.ref_type_id, r.offset) for r in made["members"]) == [(0x20, "count", 0x10, 8), (0x20, "next", 0x40, 0)]
    assert [(r.type_id, r.name, r.value) for r in made["enumerators"]] == [(0x60, "RED", -1)]
    assert [(r.name, r.type_id, r.address) for r in made["variables"]] == [("head", 0x20, 0xFFFFFFFF81000000 - (1 << 64))]
    assert [(r.name, r.pc_low, r.pc_high) for r in made["functions"]] == [("main", 0x400000, 0x400010)]


def test_reads_that_cross_pages(spark):
    from orebody.plans.pathql import read_bytes

    pages = spark.createDataFrame([(0, bytearray(range(256)) * 16), (1, bytearray([9] * 4096))], "frame long, data binary")
    df = spark.createDataFrame([(1, 0), (2, 4094), (3, 8190), (4, 20_000), (5, None), (6, 4092)], "i long, a long")
    got = {r.i: None if r.b is None else bytes(r.b) for r in read_bytes(df, "a", 4, pages, "b").collect()}
    assert got == {1: bytes([0, 1, 2, 3]), 2: bytes([254, 255, 9, 9]), 3: None, 4: None, 5: None, 6: bytes([252, 253, 254, 255])}
