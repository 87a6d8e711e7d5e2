"""The reverse map: which object, of which type and how surely, stands at an address.

Starting from known variables, members and pointers lead to further objects, each less sure than the one it was found from. The most probable come
first: an object that lies across a much more probable one is dropped with all that only it leads to. Done in Spark by delta-stepping. Candidates are
dealt into buckets of probability, as wide as the gap by which an object must be surer to drop another, best bucket first. In a bucket the best
probability of each object is found in rounds, all objects of a round at once; since no two objects of a bucket can drop one another,
and those of better buckets are settled, the order inside a bucket doesn't matter, and the result is that of taking
the candidates one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.operators.graph import admit, node_probability
from orebody.operators.instances import members_by_kind
from orebody.operators.intervals import grids, overlap_join, relation, type_relation
from orebody.operators.store import cut, discard

GAP = 0.1
_LABEL = ("node", "address", "type_id", "prob", "parent")


def _id(address: Column, type_id: Column) -> Column:
    return F.concat_ws(":", address.cast("string"), type_id.cast("string"))


class ReverseMap:
    """What a build needs to know of the memory and the types.

    types: type_id, size, and magic_ok if known (a type without a row has size 1); members: as for `members_by_kind`; pointers: address, value; valid: from rows with a column `address` the same
    rows with a boolean `valid` (translated or in a valid region); magic: the same with `magic_ok` for rows with address and type_id; rules: node, member, child_address, child_type that replace members' own children, the node being `address:type`;
    layout: type_id, offset, inner_type, stride, count, what types hold; width: as for `overlap_join`.
    """

    def __init__(
        self, types: DataFrame, members: DataFrame, pointers: DataFrame, valid: Callable[[DataFrame], DataFrame], magic: Callable[[DataFrame], DataFrame] | None = None,
        rules: DataFrame | None = None, layout: DataFrame | None = None, gap: float = GAP, least: float = 0.05, width: int = 512,
    ) -> None:
        self.types, self.members, self.pointers, self.valid, self.magic, self.rules, self.layout = types, members, pointers, valid, magic, rules, layout
        self.gap, self.least, self.width = gap, least, width
        self.grids = grids(types, "size", width)

    def _described(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of new nodes (node, address, type_id): node, end and factor - what a parent's probability is multiplied by - and their children."""
        made = members_by_kind(nodes, self.members, self.pointers, self.rules).select("node", F.col("child_address").alias("address"), F.col("child_type").alias("type_id"), "child_kind")
        both = made.unionByName(nodes.select("node", "address", "type_id", F.lit("self").alias("child_kind")))
        held = cut(self.valid(both).withColumn("child", _id(F.col("address"), F.col("type_id"))))
        kids, own = held.filter("child_kind <> 'self'"), held.filter("child_kind = 'self'")
        aimed = kids.groupBy("node").agg(F.avg(F.col("valid").cast("double")).alias("share"), F.bool_and(F.col("valid") | (F.col("child_kind") != "function")).alias("pointers_ok"))
        own = own.join(self.types.select("type_id", "size"), "type_id", "left").join(aimed, "node", "left")
        own = self.magic(own) if self.magic else own.withColumn("magic_ok", F.lit(True))
        factor = node_probability(F.lit(1.0), F.col("valid"), F.coalesce("pointers_ok", F.lit(True)), F.col("magic_ok"), F.col("share"))
        facts = own.select("node", (F.col("address") + F.coalesce("size", F.lit(1)) - 1).alias("end"), factor.alias("factor"))
        return cut(facts), held

    def _admitted(self, front: DataFrame, settled: DataFrame | None) -> DataFrame:
        """The candidates that no settled object drops."""
        if settled is None:
            return front
        other = settled.select(F.col("node").alias("_node"), F.col("address").alias("_start"), F.col("end").alias("_end"), F.col("type_id").alias("_type"), F.col("prob").alias("_prob"))
        met = overlap_join(front.select("node", "address", "end", "type_id", "prob"), other, "address", "end", "_start", "_end", self.width, self.grids).filter(F.col("_prob") > F.col("prob") + self.gap)
        by_ends = relation(F.col("address"), F.col("end"), F.col("_start"), F.col("_end"))
        first = second = F.lit(False)
        if self.layout is not None:
            first_in = self._held(met, "type_id", "_type", F.col("_start") - F.col("address"), "_first")
            met = self._held(first_in, "_type", "type_id", F.col("address") - F.col("_start"), "_second")
            first, second = F.col("_first"), F.col("_second")
        said = type_relation(by_ends, F.col("type_id") == F.col("_type"), first, second)
        dropped = met.filter(admit(F.col("prob"), F.col("_prob"), said, self.gap) == "keep_old").select("node").distinct()
        return front.join(dropped, "node", "left_anti")

    def _held(self, pairs: DataFrame, outer: str, inner: str, at: Column, out: str) -> DataFrame:
        """Pairs with whether the outer type holds the inner one at a distance (an array's elements stand a stride apart)."""
        lay = self.layout.select(F.col("type_id").alias("_lo"), F.col("inner_type").alias("_li"), F.col("offset").alias("_lf"), F.col("stride").alias("_ls"), F.col("count").alias("_lc"))
        d = at - F.col("_lf")
        there = F.when(F.col("_ls") > 0, (d >= 0) & (d % F.col("_ls") == 0) & (F.floor(d / F.col("_ls")) < F.col("_lc"))).otherwise(d == 0)
        joined = pairs.join(lay, (F.col(outer) == F.col("_lo")) & (F.col(inner) == F.col("_li")), "left")
        return joined.groupBy(*pairs.columns).agg(F.coalesce(F.bool_or(there), F.lit(False)).alias(out))

    @staticmethod
    def _best(rows: DataFrame) -> DataFrame:
        """One row a node: the highest probability, then the least parent."""
        label = F.struct((-F.col("prob")).alias("_p"), "parent", "address", "type_id")
        return rows.groupBy("node").agg(F.min(label).alias("l")).select("node", "l.address", "l.type_id", (-F.col("l._p")).alias("prob"), "l.parent")

    def build(self, seeds: DataFrame) -> DataFrame:
        """G1: node, address, end, type_id, prob, parent of all objects above `least`. seeds: address, type_id, prob.

        A round writes three tables: what the objects met for the first time lead to, what is known of them, and the next candidates."""
        facts, edges, settled = _Layers(), _Layers(), _Layers()

        def learn(rows: DataFrame) -> None:
            fresh = rows.select("node", "address", "type_id")  # one row a node
            own, kids = self._described(fresh.join(facts.all().select("node"), "node", "left_anti") if facts else fresh)
            facts.add(own)
            edges.add(kids)

        start = cut(self._best(seeds.select(_id(F.col("address"), F.col("type_id")).alias("node"), F.col("address").cast("bigint").alias("address"), "type_id", F.col("prob").cast("double").alias("prob"), F.lit(None).cast("string").alias("parent"))))
        learn(start)
        # a seed's probability counts as its parent's does for others, without the little that each step takes
        roots = cut(start.join(facts.all(), "node").withColumn("prob", F.col("prob") * F.col("factor") / (1 - 1e-5)).select(*_LABEL, "end").filter(F.col("prob") > self.least))
        pending = roots
        while (top := pending.agg(F.max("prob")).first()[0]) is not None:
            low = max(1 - (int((1 - min(top, 1.0)) / self.gap) + 1) * self.gap, self.least)
            if low >= top:  # on a bucket's very edge
                low = max(low - self.gap, self.least)
            better = settled.all() if settled else None
            front, rest, rounds = pending.filter(F.col("prob") > low), [pending.filter(F.col("prob") <= low)], []
            while True:
                front = self._admitted(front, better)
                if rounds:
                    best = reduce(DataFrame.unionByName, rounds).groupBy("node").agg(F.max("prob").alias("_old"))
                    front = front.join(best, "node", "left").filter("_old is null or prob > _old").drop("_old")
                if rounds or better is not None:
                    front = cut(front)
                if front.isEmpty():
                    break
                rounds.append(front)
                led = front.select("node", F.col("prob").alias("_above")).join(edges.all().filter("child_kind <> 'self'"), "node").select(F.col("child").alias("node"), "address", "type_id", F.col("_above").alias("prob"), F.col("node").alias("parent"))
                if better is not None:
                    led = led.join(better.select("node"), "node", "left_anti")
                led = self._best(led)  # a node's probability is its best parent's times its own factor
                learn(led)
                found = cut(led.join(facts.all(), "node").withColumn("prob", F.col("prob") * F.col("factor")).filter(F.col("prob") > self.least).select(*_LABEL, "end"))
                rest.append(found.filter(F.col("prob") <= low))
                front = found.filter(F.col("prob") > low)
            if rounds:
                settled.add(cut(self._best(reduce(DataFrame.unionByName, rounds)).join(facts.all().select("node", "end"), "node").select("node", "address", "end", "type_id", "prob")))
            left = self._best(reduce(DataFrame.unionByName, rest)).join(facts.all().select("node", "end"), "node").select(*_LABEL, "end")
            pending = cut(left.join(settled.all().select("node"), "node", "left_anti") if settled else left)
        if not settled:
            return roots.select("node", "address", "end", "type_id", "prob", "parent")
        kept = settled.all()
        # of several parents that make a node as probable, the least; none for a seed that is as sure by itself
        ways = kept.select(F.col("node").alias("parent"), F.col("prob").alias("_above")).join(edges.all().filter("child_kind <> 'self'").withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"), "parent", "_above")
        ways = ways.join(kept.select("node", F.col("prob").alias("_own")), "node").join(facts.all().select("node", "factor"), "node").filter(F.col("_above") * F.col("factor") == F.col("_own"))
        ways = ways.select("node", "parent").join(roots.join(kept.select("node", "prob"), ["node", "prob"], "left_semi").select("node"), "node", "left_anti")
        return kept.join(ways.groupBy("node").agg(F.min("parent").alias("parent")), "node", "left").select("node", "address", "end", "type_id", "prob", "parent")


class _Layers:
    """A table that grows by parts, which are put together when there are several."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []
        self.old: list[DataFrame] = []

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > 4:
            whole = cut(self.all())
            discard(*self.old)  # what was put together last time; plans made since then may still read the parts of this time
            self.old, self.parts = self.parts, [whole]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def __bool__(self) -> bool:
        return bool(self.parts)


def slab_map(log: DataFrame) -> DataFrame:
    """The map made of an allocation log alone: every allocated object, sure, without traversal. log: slot, slot_size, slot_type."""
    return log.select(_id(F.col("slot"), F.col("slot_type")).alias("node"), F.col("slot").alias("address"), (F.col("slot") + F.greatest(F.col("slot_size"), F.lit(1)) - 1).alias("end"), F.col("slot_type").alias("type_id"), F.lit(1.0).alias("prob")).distinct()
