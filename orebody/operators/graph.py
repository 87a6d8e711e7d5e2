"""Graph operators: reference closure, users, bounded expansion, ancestors, lists, probabilities.

Loops run on the driver, one Spark plan a round; what a round makes is written to the shared folder when lineage has grown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.operators.scans import neighbours
from orebody.operators.store import by_sorting, cut, discard

SALTS = 8
MOST_ROUNDS = 1000
FEW = 20_000  # links that are walked by doubling, and rows that are broadcast
SHARE = 4


def follow(rows: DataFrame, ref: str, types: DataFrame) -> DataFrame:
    """What a reference column points at, as columns ref_*."""
    target = types.select([F.col(c).alias(f"ref_{c}") for c in types.columns])
    return rows.join(target, F.col(ref) == F.col("ref_type_id"), "left")


def closure(types: DataFrame, mask: int, kind: str = "kind", ref: str = "ref_type_id") -> DataFrame:
    """For each type, where its chain of references ends when only kinds in `mask` are seen through: type_id, end_id, depth.

    Path doubling: each round doubles the length that chains have been followed. Types that name each other in a circle have no end: a chain
    longer than there are types raises an error."""
    step = types.select("type_id", F.when((F.col(kind).bitwiseAND(F.lit(mask)) != 0) & F.col(ref).isNotNull(), F.col(ref)).alias("to"))
    reach = cut(step.select("type_id", F.coalesce("to", "type_id").alias("end_id"), F.col("to").isNotNull().cast("bigint").alias("depth")))
    most = reach.count()
    while True:
        nxt = reach.filter("depth > 0").select(F.col("type_id").alias("end_id"), F.col("end_id").alias("_e"), F.col("depth").alias("_d"))
        grown = cut(reach.join(nxt, "end_id", "left").select("type_id", F.coalesce("_e", "end_id").alias("end_id"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_d").isNotNull().alias("_m")))
        discard(reach)
        moved, longest = grown.agg(F.bool_or("_m"), F.max("depth")).first()
        reach = grown
        if not moved:
            return reach.select("type_id", "end_id", F.col("depth").cast("int").alias("depth"))
        if longest > most:
            raise ValueError("types refer to each other in a circle")


def used_by(types: DataFrame, members: DataFrame, wanted: DataFrame, equivalent: DataFrame | None = None) -> DataFrame:
    """Ids of types that refer to one of `wanted` (type_id), directly or by a member; equal types count as one."""
    if equivalent is not None:
        same = equivalent.join(wanted, equivalent["canon_id"] == wanted["type_id"], "left_semi").select("type_id")
        wanted = wanted.unionByName(same).distinct()
    refs = types.select("type_id", "ref_type_id").unionByName(members.select(F.col("struct_id").alias("type_id"), "ref_type_id"))
    return refs.join(wanted.select(F.col("type_id").alias("ref_type_id")), "ref_type_id", "left_semi").select("type_id").distinct()


def expand(seed: DataFrame, edges: DataFrame, depth: int, score: str | None = None, factor: float = 1.0, least: float = 0.0) -> DataFrame:
    """Breadth-first from seed(node, path, score) along edges(src, dst, label): each node once, at its least depth, with the
    best score and then the least path. Scores fall by `factor` an edge; those not above `least` stop. Round-synchronous, so the
    result does not depend on the order of tasks."""
    fronts = [cut(seed.select("node", F.col("path"), F.col("score").cast("double").alias("score"), F.lit(0).alias("depth")))]
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")  # noqa: E731  a node's edges are dealt over SALTS tasks
    dealt = edges.withColumn("_salt", salt("dst"))
    for d in range(1, depth + 1):
        front = fronts[-1].withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = front.join(by_sorting(dealt), (front["node"] == dealt["src"]) & (front["_salt"] == dealt["_salt"])).select(F.col("dst").alias("node"), F.concat("path", F.array("label")).alias("path"), (F.col("score") * factor).alias("score")).filter(F.col("score") > least)
        best = out.groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("b")).select("node", F.col("b.path").alias("path"), (-F.col("b.s")).alias("score"))
        seen = reduce(DataFrame.unionByName, [f.select("node") for f in fronts])  # each front is written once
        front = cut(best.join(by_sorting(seen), "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        fronts.append(front)
    return reduce(DataFrame.unionByName, fronts)


def admit(child_prob: Column, other_prob: Column, relation: Column, gap: float = 0.1) -> Column:
    """What happens to a candidate that overlaps a stored object: keep_outer, replace, keep_old or keep_both."""
    return F.when(relation.isin("equal", "second_embeds"), "inside").when(relation == "first_embeds", "around").when(child_prob > other_prob + gap, "replace").when(other_prob > child_prob + gap, "keep_old").otherwise("keep_both")


#: Fixed values of the model: what an object's probability is multiplied by for an invalid address, invalid pointers, a wrong magic number.
BAD_ADDRESS, BAD_POINTERS, BAD_MAGIC = 0.01, 0.1, 0.7


def node_probability(parent: Column, valid_address: Column, valid_pointers: Column, magic_ok: Column, valid_share: Column) -> Column:
    """The parent's probability, a little less, times a factor for each failing test and the share of valid children."""
    p = F.coalesce(parent, F.lit(1.0)) * (1 - 1e-5)
    p = p * F.when(valid_address, 1.0).otherwise(BAD_ADDRESS) * F.when(valid_pointers, 1.0).otherwise(BAD_POINTERS) * F.when(magic_ok, 1.0).otherwise(BAD_MAGIC)
    bad = F.lit(1.0) - F.coalesce(valid_share, F.lit(1.0))
    return p * (bad * 0.2 + (1 - bad))


def fixed_point(nodes: DataFrame, edges: DataFrame, rounds: int | None = None, tolerance: float = 1e-6, log: list[int] | None = None) -> DataFrame:
    """p = min(1, initial * greatest parent's p * mean of children's p * encounters), until nothing moves by more than the tolerance,
    or for a given number of rounds; values that still swing after MOST_ROUNDS raise an error.

    nodes: id, initial, encounters; edges: parent, child. A node seen n > 1 times counts 1.5 * (n - 1) (fixed values of the model). While more than an
    eighth of the nodes moves, a round works out all of them; after that only nodes with a parent or child that moved, and what it finds is kept
    beside the last whole table until that in turn is an eighth of it. log: gets the number of nodes worked out in each round."""
    factor = F.when(F.col("encounters") > 1, 1.5 * (F.col("encounters") - 1)).otherwise(1.0)
    base = cut(nodes.select("id", "initial", factor.alias("f"), F.least(F.lit(1.0), F.col("initial") * factor).alias("p")))
    many = base.count()
    news: DataFrame | None = None  # id, q: newer values than the base's
    moved, n_moved, gone = None, many, 0.0

    def stepped(now: DataFrame, due: DataFrame, down: DataFrame, up: DataFrame) -> DataFrame:
        """The due nodes with their next value. Of an edge's two ends the one that is looked up has one row a key, so that a hub's edges may be
        dealt out, and what a hub gets is summed up in parts."""
        kids = down.join(now.select(F.col("id").alias("child"), F.col("p").alias("cp")), "child").groupBy(F.col("parent").alias("id")).agg(F.avg("cp").alias("kids"))
        ups = up.join(now.select(F.col("id").alias("parent"), F.col("p").alias("pp")), "parent").groupBy(F.col("child").alias("id")).agg(F.max("pp").alias("up"))
        value = F.least(F.lit(1.0), F.col("initial") * F.coalesce("up", F.lit(1.0)) * F.coalesce("kids", F.lit(1.0)) * F.col("f"))
        return cut(due.join(kids, "id", "left").join(ups, "id", "left").select("id", "initial", "f", value.alias("p"), F.abs(value - F.col("p")).alias("_d")))

    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        now = base if news is None else base.join(news, "id", "left").select("id", "initial", "f", F.coalesce("q", "p").alias("p"))
        if n_moved * 8 > many:
            fresh = stepped(now, now, edges, edges)
            discard(base, *([] if news is None else [news]))
            base, news = fresh, None
        else:
            changed = moved.select("id")
            near = edges.join(changed.withColumnRenamed("id", "parent"), "parent", "left_semi").select(F.col("child").alias("id"))
            near = cut(near.union(edges.join(changed.withColumnRenamed("id", "child"), "child", "left_semi").select("parent")).distinct())
            own = lambda side: edges.join(near.withColumnRenamed("id", side), side, "left_semi")  # noqa: B023, E731
            fresh = stepped(now, now.join(near, "id", "left_semi"), own("parent"), own("child"))
            latest = fresh.select("id", F.col("p").alias("q"))
            grown = cut(latest if news is None else news.join(latest, "id", "left_anti").unionByName(latest))
            discard(near, *([] if news is None else [news]))
            news = grown
        worked, gone, n_moved = fresh.agg(F.count("*"), F.coalesce(F.max("_d"), F.lit(0.0)), F.coalesce(F.sum((F.col("_d") != 0).cast("long")), F.lit(0))).first()
        moved = fresh.filter("_d <> 0")
        if log is not None:
            log.append(worked)
        if news is not None and news.count() * 8 > many:
            whole = cut(base.join(news, "id", "left").select("id", "initial", "f", F.coalesce("q", "p").alias("p"), F.lit(0.0).alias("_d")))
            discard(base, news)
            base, news = whole, None
        if gone <= tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"probabilities still moved by {gone} after {MOST_ROUNDS} rounds")
    return base.select("id", "p") if news is None else base.join(news, "id", "left").select("id", F.coalesce("q", "p").alias("p"))


def walk_list(heads: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes of linked lists in order: head, node, place. heads: head, first; links: node, next. Ends at null, at the head, or
    where a list runs into itself.

    A quarter of the nodes, by a hash, are stations, and so are the lists' first nodes and those that several nodes lead to. Any other node has one
    node before it, and finds the station before it by doubling, which takes few rounds as the stretches between stations are short. The lists of
    stations alone are walked in the same way, and every station seen brings its stretch. All levels together handle a few times the
    nodes and what comes back, however long the lists are. Each node counts at its first place."""
    steps = cut(links.filter("node is not null and next is not null").groupBy("node").agg(F.min("next").alias("next")).withColumn("by", F.lit(1).cast("bigint")))
    starts = cut(heads.select("head", F.col("first").alias("node")).filter("node is not null").distinct())
    seen = _walked(starts, steps, 0)
    stop = seen.filter("node = head").select("head", F.col("place").alias("_stop"))  # a list that comes to its head ends there
    return seen.join(stop, "head", "left").filter("_stop is null or place < _stop").drop("_stop")


def _walked(starts: DataFrame, steps: DataFrame, level: int) -> DataFrame:
    """head, node, place of what starts (head, node) lead to over steps (node, next, by: the places between them), which are used up."""
    most, reach = steps.count(), 1
    if most <= FEW:
        return _walked_by_doubling(starts, steps)
    drawn = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(SHARE)) == 0
    known = steps.select(F.col("next").alias("node"), F.col("node").alias("up"), "by").unionByName(starts.select("node").distinct(), allowMissingColumns=True)
    known = known.groupBy("node").agg(F.count("up").alias("_n"), F.count("*").alias("_rows"), F.min("up").alias("up"), F.min("by").alias("by"))
    forced = (F.col("_n") > 1) | (F.col("_rows") > F.col("_n"))
    station = forced | drawn("node")
    state = cut(known.select("node", F.when(station, F.col("node")).otherwise(F.col("up")).alias("up"), F.when(station, 0).otherwise(F.col("by")).alias("by"), (station | drawn("up")).alias("there"), forced.alias("_forced")))
    rows = state.drop("_forced")
    under_way, arrived, written = rows.filter("not there"), [rows.filter("there")], [state]
    while (n := under_way.count()) and reach <= 2 * most:  # what still goes on then runs in circles that no list leads to
        now = reduce(DataFrame.unionByName, [*arrived, under_way]).filter(~drawn("node"))
        ahead = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("by").alias("_by"), F.col("there").alias("_there"))
        met = F.broadcast(under_way).join(ahead, "up") if n <= FEW else under_way.join(by_sorting(ahead), "up")
        step = cut(met.select("node", F.col("_up").alias("up"), (F.col("by") + F.col("_by")).alias("by"), F.col("_there").alias("there")))
        written.append(step)
        arrived.append(step.filter("there"))
        under_way, reach = step.filter("not there"), 2 * reach
    stretches = reduce(DataFrame.unionByName, arrived).select("node", "up", "by")
    special = state.filter("_forced").select(F.col("node").alias("next"))
    special = F.broadcast(special) if special.count() <= FEW else by_sorting(special)
    into = steps.filter(drawn("next")).unionByName(steps.filter(~drawn("next")).join(special, "next", "left_semi").select(steps.columns))
    owners = stretches.select("node", F.col("up").alias("_at"), F.col("by").alias("_by"))
    between = cut(into.join(by_sorting(owners), "node").select(F.col("_at").alias("node"), "next", (F.col("by") + F.col("_by")).alias("by")))
    if between.count() * SHARE > most * (SHARE - 1):  # nearly every node is a station
        discard(between, *written)
        return _walked_by_doubling(starts, steps)
    top = _walked(starts, between, level + 1)
    out = cut(top.join(by_sorting(stretches.select(F.col("node").alias("_node"), F.col("up").alias("node"), "by")), "node").select("head", F.col("_node").alias("node"), (F.col("place") + F.col("by")).alias("place")))
    discard(top, steps, *written)
    return out


def _walked_by_doubling(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """After round i the steps lead 2^i nodes on, and every list's known part has that many nodes. A list that comes back to one of its nodes stops
    growing with new nodes."""
    few = steps.count() <= FEW
    look_up = F.broadcast if few else by_sorting
    jump = steps
    seen = cut(starts.withColumn("place", F.lit(0).cast("bigint")))
    known = seen.count()
    while True:
        grown = seen.join(look_up(jump), "node").select("head", F.col("next").alias("node"), (F.col("place") + F.col("by")).alias("place"))
        both = cut(seen.unionByName(grown).groupBy("head", "node").agg(F.min("place").alias("place")))
        if (more := both.count()) == known:  # nothing new within twice the length
            discard(jump, seen)
            return both
        ahead = jump.select(F.col("node").alias("next"), F.col("next").alias("_far"), F.col("by").alias("_by"))
        further = cut(jump.join(look_up(ahead), "next").select("node", F.col("_far").alias("next"), (F.col("by") + F.col("_by")).alias("by")))
        discard(jump, seen)
        jump, seen, known = further, both, more


def neighbours_ok(links: DataFrame) -> DataFrame:
    """Node, whether next's prev and prev's next are the node itself (absent neighbours pass). links: node, next, prev."""
    nxt = links.select(F.col("node").alias("next"), F.col("prev").alias("_np"))
    prv = links.select(F.col("node").alias("prev"), F.col("next").alias("_pn"))
    both = links.join(nxt, "next", "left").join(prv, "prev", "left")
    ok = (F.col("next").isNull() | F.coalesce(F.col("_np") == F.col("node"), F.lit(False))) & (F.col("prev").isNull() | F.coalesce(F.col("_pn") == F.col("node"), F.lit(False)))
    return both.select("node", ok.alias("ok"))


class Jumps:
    """The ancestors of a forest's nodes at the distances 1, 2, 4, ...: a table for each, and every node's depth (0 at a root). All together
    they hold n * log2(depth) rows at most, however deep the trees are. parents: node, parent; a circle raises an error."""

    def __init__(self, parents: DataFrame) -> None:
        state = cut(parents.select("node", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("bigint").alias("depth")))
        most, self.levels = state.count(), []
        while not (going := state.filter("up is not null")).isEmpty():
            if 1 << len(self.levels) > 2 * most:
                raise ValueError("the parents run in a circle")
            self.levels.append(cut(going.select("node", "up")))
            above = state.select(F.col("node").alias("up"), F.col("up").alias("_next"), F.col("depth").alias("_more"))
            # a parent that isn't a node itself is a root of its own
            step = going.join(by_sorting(above), "up", "left").select("node", F.col("_next").alias("up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"))
            grown = cut(state.filter("up is null").unionByName(step))
            discard(state)
            state = grown
        self.depths = state.select("node", "depth")

    def raised(self, rows: DataFrame, node: str, by: str) -> DataFrame:
        """Rows with `node` replaced by its ancestor `by` steps up (by: less than 2^levels); null above a root."""
        for k, table in enumerate(self.levels):
            up = table.select(F.col("node").alias(node), F.col("up").alias("_up"))
            bit = F.call_function("shiftright", F.col(by), F.lit(k)).bitwiseAND(F.lit(1)) == 1
            stay, go = rows.filter(~bit), rows.filter(bit)
            rows = cut(stay.unionByName(go.join(by_sorting(up), node, "left").withColumn(node, F.col("_up")).drop("_up")))
        return rows

    def lines(self, nodes: DataFrame | None = None, within: int | None = None) -> DataFrame:
        """SNK4, G12: node, above, distance (from 1): a row for each ancestor, to a distance of `within`. For chosen nodes, or all: what comes back
        has a row for each of them and ancestor, so that deep trees are better asked for few nodes or a bounded distance."""
        own = self.depths.select("node") if nodes is None else nodes.select("node")
        out = own.select("node", F.col("node").alias("above"), F.lit(0).cast("bigint").alias("distance"))
        for k in range(len(self.levels) - 1, -1, -1):
            up = self.levels[k].select(F.col("node").alias("above"), F.col("up").alias("_up"))
            further = out.join(by_sorting(up), "above").select("node", F.col("_up").alias("above"), (F.col("distance") + (1 << k)).alias("distance"))
            out = cut(out.unionByName(further if within is None else further.filter(F.col("distance") <= within)))
        return out.filter("distance > 0")


def ancestors(parents: DataFrame) -> DataFrame:
    """Each node with the array of its ancestors, nearest first. parents: node, parent; parents that run in a circle raise an error.

    An array holds a node's whole line; for deep trees ask `Jumps` for depths, ancestors at a distance, or lines as rows."""
    jumps = Jumps(parents)
    lines = jumps.lines().groupBy("node").agg(F.array_sort(F.collect_list(F.struct("distance", F.col("above").cast("string").alias("above")))).alias("l"))
    return parents.select("node").join(lines, "node", "left").select("node", F.coalesce(F.transform("l", lambda x: x["above"]), F.array().cast("array<string>")).alias("above"))


def lowest_common_ancestor(pairs: DataFrame, above: DataFrame | Jumps) -> DataFrame:
    """Pairs (a, b) with the nearest node above or equal to both; null if there is none. above: `Jumps`, or what `ancestors` returns.

    Binary lifting: the deeper node is raised to the other's depth, then both by ever smaller steps while they stay apart; log2(depth)
    joins over the pairs, and no line of ancestors is ever gathered."""
    if not isinstance(above, Jumps):
        above = Jumps(above.select(F.col("node").cast("string").alias("node"), F.try_element_at("above", F.lit(1)).alias("parent")))
    depth = lambda side: above.depths.select(F.col("node").alias(f"_{side}"), F.col("depth").alias(f"_d{side}"))
    rows = pairs.select("a", "b", F.col("a").cast("string").alias("_a"), F.col("b").cast("string").alias("_b")).join(by_sorting(depth("a")), "_a").join(by_sorting(depth("b")), "_b")
    rows = cut(rows.withColumns({"_ra": F.greatest(F.col("_da") - F.col("_db"), F.lit(0)), "_rb": F.greatest(F.col("_db") - F.col("_da"), F.lit(0))}).drop("_da", "_db"))
    for side in ("a", "b"):
        rows = above.raised(rows, f"_{side}", f"_r{side}")
    for k in range(len(above.levels) - 1, -1, -1):
        up = lambda side: above.levels[k].select(F.col("node").alias(f"_{side}"), F.col("up").alias(f"_u{side}"))  # noqa: B023, E731
        apart, met = rows.filter("_a <> _b"), rows.filter("_a = _b")
        tried = apart.join(by_sorting(up("a")), "_a", "left").join(by_sorting(up("b")), "_b", "left")
        move = F.coalesce(F.col("_ua") != F.col("_ub"), F.lit(False))
        rows = cut(met.unionByName(tried.withColumns({"_a": F.when(move, F.col("_ua")).otherwise(F.col("_a")), "_b": F.when(move, F.col("_ub")).otherwise(F.col("_b"))}).drop("_ua", "_ub")))
    if above.levels:
        parent = lambda side: above.levels[0].select(F.col("node").alias(f"_{side}"), F.col("up").alias(f"_u{side}"))
        rows = rows.join(by_sorting(parent("a")), "_a", "left").join(by_sorting(parent("b")), "_b", "left")
        lca = F.when(F.col("_a") == F.col("_b"), F.col("_a")).when(F.col("_ua") == F.col("_ub"), F.col("_ua"))
    else:
        lca = F.when(F.col("_a") == F.col("_b"), F.col("_a"))
    return rows.select("a", "b", lca.alias("lca"))


def per_cpu(instances: DataFrame, offsets: DataFrame, address: str, every: bool = True) -> DataFrame:
    """One instance for each CPU's offset, or the first CPU's only. The offsets are a table of a machine's CPUs."""
    base = offsets if every else offsets.orderBy("cpu").limit(1)
    return instances.crossJoin(F.broadcast(base)).withColumn(address, F.col(address) + F.col("offset"))


def specialise(objects: DataFrame, variables: DataFrame, pointer: str) -> DataFrame:
    """An object whose operations pointer is a known variable's address takes that variable's specialised type."""
    known = variables.select(F.col("address").alias(pointer), F.col("special_type").alias("_t"))
    return objects.join(known, pointer, "left").withColumn("type_id", F.coalesce("_t", "type_id")).drop("_t")


def rebase(variables: DataFrame, modules: DataFrame, sections: DataFrame) -> DataFrame:
    """Module variables at their sections' load addresses. Module names compare with _ for - and without .ko."""
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit("-"), F.lit("_")), r"\.ko$", "")
    v = variables.withColumn("_m", plain(F.regexp_extract("orig_file", r"[^/]*$", 0)))
    s = sections.join(modules.select("module"), "module", "left_semi").select(plain(F.col("module")).alias("_m"), "section", F.col("address").alias("_base"))
    return v.join(s, ["_m", "section"]).withColumn("address", F.col("address") + F.col("_base")).drop("_m", "_base")


def objects_by_page(objects: DataFrame, address: str, size: str, page: int = 4096) -> DataFrame:
    """An object once for each page that it touches, as `frame`."""
    shift = page.bit_length() - 1
    at = lambda c: F.call_function("shiftrightunsigned", c, F.lit(shift))
    return objects.withColumn("frame", F.explode(F.sequence(at(F.col(address)), at(F.col(address) + F.greatest(F.col(size), F.lit(1)) - 1))))


def best_first(df: DataFrame, key: str, k: int, largest: bool = True) -> DataFrame:
    """O2: the k first of a queue; rows with equal keys all count, their order is free."""
    return df.orderBy(F.desc(key) if largest else F.asc(key)).limit(k)


def watch(before: DataFrame, after: DataFrame, node: str, prob: str, interval: float) -> DataFrame:
    """Nodes whose probability moved by more than the interval."""
    b = before.select(node, F.col(prob).alias("_b"))
    return after.join(b, node).filter(F.abs(F.col(prob) - F.col("_b")) > interval).select(node, F.col("_b").alias("before"), F.col(prob).alias("after"))


def full_name(path: str) -> Column:
    """The dotted name of a path."""
    return F.concat_ws(".", F.col(path))


def neighbours_window(df: DataFrame, group: str, order: str) -> DataFrame:
    """The rows of a group as a list: next and prev by order."""
    return neighbours(df, [group], order, before="prev", after="next")


def radix_leaves(roots: DataFrame, slots: DataFrame, bits: int) -> DataFrame:
    """Leaves of radix trees or idr layers: tree, key, item. roots: tree, node, height (0: the node is the item);
    slots: node, slot, child. Each level keeps its own height, also for later siblings."""
    front = roots.select("tree", "node", F.col("height").cast("int").alias("height"), F.lit(0).cast("bigint").alias("key"))
    done = front.filter("height <= 0")
    while True:
        open_ = front.filter("height > 0")
        front = cut(open_.join(slots, "node").select("tree", F.col("child").alias("node"), (F.col("height") - 1).alias("height"), (F.call_function("shiftleft", F.col("key"), F.lit(bits)) + F.col("slot")).alias("key")))
        done = cut(done.unionByName(front.filter("height <= 0")))
        if front.filter("height > 0").isEmpty():
            return done.select("tree", "key", F.col("node").alias("item"))


def containing_offset(members: DataFrame, types: DataFrame, roots: DataFrame, structured: Column) -> DataFrame:
    """Every structured type that covers an offset of a root type, through nested structs and all branches of unions: root,
    type_id, rest (the offset inside it), depth. roots: root, at; members: struct_id, offset, ref_type_id; types: type_id, size, kind."""
    nested = types.filter(structured).select(F.col("type_id").alias("ref_type_id"), F.col("size").alias("_size"))
    inner = members.join(nested, "ref_type_id").select("struct_id", F.col("offset").alias("_off"), F.col("ref_type_id").alias("_to"), "_size")
    front = cut(roots.select("root", F.col("root").alias("type_id"), F.col("at").cast("bigint").alias("rest"), F.lit(0).alias("depth")))
    out = front
    most = types.count()
    for d in range(1, most + 2):  # types nest no deeper than there are types
        hit = front.join(inner, (F.col("type_id") == F.col("struct_id")) & (F.col("rest") >= F.col("_off")) & (F.col("rest") < F.col("_off") + F.col("_size")))
        front = cut(hit.select("root", F.col("_to").alias("type_id"), (F.col("rest") - F.col("_off")).cast("bigint").alias("rest"), F.lit(d).alias("depth")).distinct())
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise ValueError("types hold themselves")
