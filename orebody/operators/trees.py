"""Trees and chained tables in order, however deep (G6, G11, SNK4): tours of their nodes, ranked by doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.operators.graph import walk_list
from orebody.operators.scans import neighbours
from orebody.operators.store import by_sorting, cut, discard


FEW = 20_000  # items that are ranked by doubling, and rows that are broadcast
SHARE = 4


def list_ranks(items: DataFrame, *more: str) -> DataFrame:
    """Parallel list ranking: from item, next (null at a list's end) and weight: item, last (its list's end) and rest, the sum of weights from the
    item to the end. `more` names further weights, whose sums keep their names. A circle raises an error.

    A quarter of the items, by a hash, are stations. Every item is led on to the next station or the end, by doubling, which takes few
    rounds as the stretches between stations are short; then the stations alone, a list a quarter as long, are ranked in the same way. All
    levels together handle a few times the items, however long the lists are."""
    sums = [F.col(c).cast("bigint").alias("rest" if c == "weight" else c) for c in ("weight", *more)]
    return _ranked(cut(items.select("item", "next", *sums, F.when(F.col("next").isNull(), F.col("item")).alias("last"))), 0)


def _ranked(state: DataFrame, level: int) -> DataFrame:
    most, reach = state.count(), 1
    sums = [c for c in state.columns if c not in ("item", "next", "last")]
    found = lambda df, *kept: df.select(F.col("item").alias("next"), *kept, F.col("last").alias("_last"), *[F.col(c).alias(f"_{c}") for c in sums])
    added = [(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums]
    station = lambda c: (F.pmod(F.xxhash64(c, F.lit(level)), F.lit(SHARE)) == 0) if most > FEW else F.lit(False)
    going = F.col("next").isNotNull() & ~station("next")
    arrived, under_way, written = [state.filter(~going)], state.filter(going), [state]
    while n := under_way.count():
        if reach > 2 * most:
            raise ValueError("a list runs in a circle")
        now = reduce(DataFrame.unionByName, [*arrived, under_way]).filter(~station("item"))
        ahead = found(now.select("*", F.col("next").alias("_next")), "_next")
        met = F.broadcast(under_way).join(ahead, "next") if n <= FEW else under_way.join(by_sorting(ahead), "next")
        step = cut(met.select("item", F.col("_next").alias("next"), *added, F.col("_last").alias("last")))
        written.append(step)
        arrived.append(step.filter(~going))
        under_way, reach = step.filter(going), 2 * reach
    whole = reduce(DataFrame.unionByName, arrived)
    if most <= FEW:
        out = cut(whole.select("item", "last", *sums))
        discard(*written)
        return out
    top = _ranked(cut(whole.filter(station("item"))), level + 1)
    others = whole.filter(~station("item"))
    led = others.filter("next is not null").join(by_sorting(found(top)), "next").select("item", F.col("_last").alias("last"), *added)
    out = cut(top.unionByName(others.filter("next is null").select("item", "last", *sums)).unionByName(led))
    discard(top, *written)
    return out


_DOWN, _BETWEEN, _UP = 0, 1, 2


def _event(node: Column, kind: int) -> Column:
    return F.struct(node.alias("node"), F.lit(kind).alias("kind"))


def _numbered(events: DataFrame, counted: int, *more: str) -> DataFrame:
    """node, root and the place of each node's event of the counted kind in its tree's tour, from 0. events: item and next, here the event before it: a
    sum from an event back to its tour's start is its number, and the start is the root's, so that nothing has to be joined to the ranks. `more`: as in
    `list_ranks`."""
    ranks = list_ranks(events.withColumn("weight", (F.col("item.kind") == counted).cast("int")), *more)
    return ranks.filter(F.col("item.kind") == counted).select("item.node", F.col("last.node").alias("root"), (F.col("rest") - 1).alias("place"), *more)


def preorder(parents: DataFrame, place: str = "node") -> DataFrame:
    """node, root, place of each node in its tree's order: a node, then its children's trees by the column `place`; and depth (0 at a root). parents:
    node, parent (null at a root), place. Works on an Euler tour from its end, whose links need only each node's last child and previous sibling."""
    rows = parents.select("node", "parent", F.struct(F.col(place).alias("place"), F.col("node").alias("node")).alias("_o"))
    chained = cut(neighbours(rows, ["parent"], "_o", before="_prev"))
    final = chained.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.max("_o").alias("_final"))
    inner = F.col("parent").isNotNull()
    down = chained.select(_event(F.col("node"), _DOWN).alias("item"), F.when(inner & F.col("_prev").isNotNull(), _event(F.col("_prev.node"), _UP)).when(inner, _event(F.col("parent"), _DOWN)).alias("next"), F.lit(1).alias("depth"))
    up = chained.select("node").join(by_sorting(final), "node", "left").select(_event(F.col("node"), _UP).alias("item"), F.when(F.col("_final").isNotNull(), _event(F.col("_final.node"), _UP)).otherwise(_event(F.col("node"), _DOWN)).alias("next"), F.lit(-1).alias("depth"))
    return _numbered(down.unionByName(up), _DOWN, "depth").withColumn("depth", F.col("depth") - 1)


def in_order(nodes: DataFrame) -> DataFrame:
    """Node, root and place of the nodes of binary trees in the order of their keys: the left tree, the node, the right tree. nodes:
    node, left, right (null or absent: none). Red-black or any other kind, balanced or not."""
    real = nodes.select("node")
    here = lambda side: real.withColumnRenamed("node", side).withColumn(f"_has_{side}", F.lit(True))
    known = nodes.join(by_sorting(here("left")), "left", "left").join(by_sorting(here("right")), "right", "left").select("node", F.when(F.col("_has_left"), F.col("left")).alias("left"), F.when(F.col("_has_right"), F.col("right")).alias("right"))
    known = cut(known)
    above = known.filter("left is not null").select(F.col("left").alias("node"), F.col("node").alias("_of"), F.lit(_DOWN).alias("_to")).unionByName(known.filter("right is not null").select(F.col("right").alias("node"), F.col("node").alias("_of"), F.lit(_BETWEEN).alias("_to")))
    item = lambda kind: _event(F.col("node"), kind).alias("item")
    down = known.select("node").join(by_sorting(above), "node", "left").select(item(_DOWN), F.when(F.col("_of").isNotNull(), F.struct(F.col("_of").alias("node"), F.col("_to").alias("kind"))).alias("next"))
    between = known.select(item(_BETWEEN), F.when(F.col("left").isNotNull(), _event(F.col("left"), _UP)).otherwise(_event(F.col("node"), _DOWN)).alias("next"))
    up = known.select(item(_UP), F.when(F.col("right").isNotNull(), _event(F.col("right"), _UP)).otherwise(_event(F.col("node"), _BETWEEN)).alias("next"))
    return _numbered(down.unionByName(between).unionByName(up), _BETWEEN)


def hash_chains(heads: DataFrame, links: DataFrame, next_offset: int = 0) -> DataFrame:
    """The nodes of chained hash tables: head, node, place, linked. heads: head (the address of the first pointer), first; links: node,
    next, pprev. linked: whether pprev is the address of the pointer that leads to the node: the head's, or the next field of the node before."""
    walked = walk_list(heads, links.select("node", "next"))
    before = walked.select("head", (F.col("place") + 1).alias("place"), (F.col("node") + next_offset).alias("_from"))
    back = links.groupBy("node").agg(F.min("pprev").alias("pprev"))
    lead = F.when(F.col("place") == 0, F.col("head")).otherwise(F.col("_from"))
    return walked.join(by_sorting(before), ["head", "place"], "left").join(by_sorting(back), "node", "left").select("head", "node", "place", F.coalesce(F.col("pprev") == lead, F.lit(False)).alias("linked"))
