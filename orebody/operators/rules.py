"""Rules: activation, access paths, priority, ambiguity, deferral, actions, conflicts.

`match` is for a few rules of any condition. `RuleIndex` and `RuleEngine` are for many rules over type names: names find their rules by equality
or by three letters that a wildcard must contain, so that a row is never tested against each of a thousand rules.
"""

from __future__ import annotations

import os
import re
import string
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.functions.expr import compile_expr
from orebody.functions.filters import TypeFilter, expand_key
from orebody.functions.patterns import NamePattern, compile_pattern, matches
from orebody.operators.store import by_sorting, cut


@dataclass
class Rule:
    """A rule: where it applies, what it says, and how it ranks (higher priority first, then the order of listing)."""

    name: str
    condition: Column
    action: str
    priority: int = 0
    enabled: bool = True
    os: dict[str, str] = field(default_factory=dict)


def match(rows: DataFrame, rules: list[Rule], key: list[str], target: Callable[[Rule], Column] | None = None) -> DataFrame:
    """Every row with each enabled rule that fits: key, rule_no, rule_name, priority, action, target.

    Rules are a list on the driver; each becomes one predicate of one pass over the rows, without a join."""
    said = F.array_compact(F.array(*[
        F.when(r.condition, F.struct(F.lit(i).alias("rule_no"), F.lit(r.name).alias("rule_name"), F.lit(r.priority).alias("priority"), F.lit(r.action).alias("action"), (target(r) if target else F.lit(r.action)).cast("string").alias("target")))
        for i, r in enumerate(rules) if r.enabled
    ]))
    return rows.select(*key, F.explode(said).alias("_r")).select(*key, "_r.*")


def decide(matched: DataFrame, key: list[str]) -> DataFrame:
    """The winning rule of each row: the highest priority, then the first listed; ambiguous if another rule of that
    priority leads to a different target. Aggregates only: no window over a key's rules."""
    # each priority by itself, then the highest; targets differ where the least isn't the greatest
    one = matched.filter("priority is not null").groupBy(*key, "priority").agg(F.min(F.struct("rule_no", "rule_name", "target")).alias("first"), F.min("target").alias("_low"), F.max("target").alias("_high"))
    top = one.groupBy(*key).agg(F.max("priority").alias("priority"), F.max_by(F.struct("first", "_low", "_high"), "priority").alias("top"))
    return top.select(*key, F.col("top.first.rule_name").alias("rule_name"), "priority", F.col("top.first.target").alias("target"), F.coalesce(F.col("top._low") < F.col("top._high"), F.lit(False)).alias("ambiguous"))


def defer(matched: DataFrame, given: Column, needed: Column) -> DataFrame:
    """R2: rules that want longer paths than are given wait; equal lengths match."""
    return matched.withColumn("state", F.when(given < needed, "defer").when(given == needed, "match").otherwise("none"))


#: How alternatives of one member combine; the highest rank wins (ignore dominates).
CONFLICT_RANKS = {"none": 0, "replace": 1, "conflict": 2, "ignore": 3}


def conflicts(df: DataFrame, key: list[str], verdict: str) -> DataFrame:
    """The joint verdict of all rows of a key."""
    rank = F.coalesce(*[F.when(F.col(verdict) == v, F.lit(r)) for v, r in CONFLICT_RANKS.items()])
    names = F.array(*[F.lit(v) for v in CONFLICT_RANKS])
    return df.groupBy(*key).agg(F.max(rank).alias("_r")).select(*key, F.element_at(names, F.col("_r") + 1).alias("verdict"))


def reanchor(df: DataFrame, result: str, base: str, size: str, members: DataFrame) -> DataFrame:
    """A result inside its input is put on the member at that offset: adds member (null where none starts there)."""
    inside = F.when((F.col(result) >= F.col(base)) & (F.col(result) < F.col(base) + F.col(size)), F.col(result) - F.col(base))
    m = members.select(F.col("struct_id").alias("_struct"), F.col("offset").alias("_at"), F.col("name").alias("member"))
    return df.withColumn("_off", inside).join(m, (F.col("type_id") == F.col("_struct")) & (F.col("_off") == F.col("_at")), "left").drop("_off", "_at", "_struct")


class RuleSet:
    """Rules that can be switched, listed and counted."""

    def __init__(self, rules: list[Rule] | None = None) -> None:
        self.rules = list(rules or [])

    def set_enabled(self, names: list[str] | None, on: bool) -> None:
        for r in self.rules:
            if names is None or r.name in names:
                r.enabled = on

    def reset(self) -> None:
        self.set_enabled(None, True)

    def flush(self) -> None:
        self.rules.clear()

    def listing(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.name, r.priority, r.action, r.enabled) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "rule_no int, rule_name string, priority int, action string, enabled boolean")

    def usage(self, matched: DataFrame) -> DataFrame:
        return matched.groupBy("rule_name").agg(F.count("*").alias("n"))


def expression_target(text: str, source: str, columns: dict[str, tuple[Column, str]]) -> Column:
    """An expression action as a column: `src->next - 4` with columns {"next": ...}; members follow the source with -> or a dot."""
    flat = text.replace("->", ".")
    names = {f"{source}.{k}": v for k, v in columns.items()} | {k: v for k, v in columns.items() if k == source}
    return compile_expr(flat, names)[0]


#: Named user functions that rules may call.
ACTIONS: dict[str, Callable[..., Column]] = {}


def action(name: str) -> Callable:
    """Register a function from columns to a column as a rule action."""

    def register(f: Callable[..., Column]) -> Callable[..., Column]:
        ACTIONS[name] = f
        return f

    return register


FEW = 20_000  # rows of names and the rules that fit them that are broadcast, counted first
MOST_RULES = 100_000  # a written list; tables made of it are broadcast
SHAPES = ((1, 2), (1, 3), (2, 3))  # the places of the second and third letter behind the first


def _grams(glob: str) -> list[str]:
    """What a wildcard says of three letters: the number of a shape, then the letters that must stand in a name at its distances."""
    found = set()
    for stretch in glob.lower().split("*"):
        at = [x if len(x) == 1 and x != "?" else None for x in re.findall(r"\[.[^\]]*\]|.", stretch, re.S)]
        for k in range(len(at)):
            for n, (i, j) in enumerate(SHAPES):
                if k + j < len(at) and None not in (letters := (at[k], at[k + i], at[k + j])):
                    found.add(f"{n}{''.join(letters)}")
    return sorted(found)


class RuleIndex:
    """Which of many name patterns fit a row's name. Patterns: literals, wildcards, regular expressions or None (any), by their place in the list.

    The most selective way is taken for each: literals by an equi-join, wildcards by three of their letters at fixed distances (SHAPES, so that they may
    stand around a `?`), those that the fewest names contain (if `tuned`), and then the expression, once for all rules that share it; only patterns
    without such letters are tried on every row. Joins are with tables of the rules, which are broadcast: a list of more than MOST_RULES is refused.
    """

    def __init__(self, spark: SparkSession, patterns: list[str | None]) -> None:
        if len(patterns) > MOST_RULES:
            raise ValueError(f"{len(patterns)} rules; {MOST_RULES} are the most")
        self.spark = spark
        self.exact: list[tuple[int, str]] = []
        self.wild: list[tuple[int, list[str], str]] = []
        self.rest: list[tuple[int, NamePattern]] = []
        for i, text in enumerate(patterns):
            p = compile_pattern(text)
            grams = _grams(text.strip()) if p.kind == "wildcard" else []
            if p.kind == "literal":
                self.exact.append((i, p.text.lower()))
            elif grams and all(x.isascii() for x in grams):
                self.wild.append((i, grams, f"(?si)^(?:{p.text})$"))
            else:
                self.rest.append((i, p))
        self.chosen = {i: grams[0] for i, grams, _ in self.wild}

    @staticmethod
    def _spread(rows: DataFrame, name: str, grams: set[str]) -> DataFrame:
        """Rows once for each different three letters of their name in one of the shapes of `grams`, as `_gram`. Letters stay at their places: only A-Z
        are lowered, as the expressions do."""
        rows = rows.withColumn("_low", F.translate(F.col(name), string.ascii_uppercase, string.ascii_lowercase))
        low = F.col("_low")  # worked out once a row, not once a letter
        letter = lambda at: F.substring(low, at, F.lit(1))
        every = [
            F.when(F.length(low) > j, F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - j, F.lit(1))), lambda k: F.concat(F.lit(str(n)), letter(k), letter(k + i), letter(k + j)))).otherwise(F.array().cast("array<string>"))  # noqa: B023
            for n, (i, j) in enumerate(SHAPES) if any(g[0] == str(n) for g in grams)
        ]
        return rows.withColumn("_gram", F.explode(F.array_distinct(F.concat(*every)))).drop("_low")

    def tuned(self, rows: DataFrame, name: str) -> RuleIndex:
        """Choose for each wildcard the letters that the fewest of these names contain. One pass; a row for each three letters of the rules comes back."""
        known = {g for _, grams, _ in self.wild for g in grams}
        if known:
            table = F.broadcast(self.spark.createDataFrame([(g,) for g in sorted(known)], "_gram string"))
            n = {r[0]: r[1] for r in self._spread(rows.select(name), name, known).join(table, "_gram").groupBy("_gram").count().collect()}
            self.chosen = {i: min(grams, key=lambda g: (n.get(g, 0), g)) for i, grams, _ in self.wild}
        return self

    def candidates(self, rows: DataFrame, name: str) -> DataFrame:
        """`rows` with rule_no, once for each pattern that fits."""
        low = F.lower(F.col(name))
        out = []
        if self.exact:
            table = self.spark.createDataFrame(self.exact, "rule_no int, _text string")
            out.append(rows.join(F.broadcast(table), low == F.col("_text")).drop("_text"))
        if self.wild:
            same: dict[tuple[str, str], list[int]] = {}
            for i, _, regex in self.wild:
                same.setdefault((self.chosen[i], regex), []).append(i)
            table = self.spark.createDataFrame([(g, regex, nos) for (g, regex), nos in same.items()], "_gram string, _regex string, _nos array<int>")
            met = self._spread(rows, name, set(self.chosen.values())).join(F.broadcast(table), "_gram").filter(F.expr(f"`{name}` rlike _regex"))
            out.append(met.select(*rows.columns, F.explode("_nos").alias("rule_no")))
        if self.rest:
            said = F.array_compact(F.array(*[F.when(matches(F.col(name), p), F.lit(i)) for i, p in self.rest]))
            out.append(rows.withColumn("rule_no", F.explode(said)))
        if not out:
            return rows.withColumn("rule_no", F.lit(0)).limit(0)
        first = out[0].select(*rows.columns, "rule_no")
        for more in out[1:]:
            first = first.unionByName(more.select(*rows.columns, "rule_no"))
        return first


@dataclass
class PathRule:
    """A rule on a type and on the members that are read from it, one after another; `action` names one of ACTIONS, whose result, an address, is an
    instance of `target_type`."""

    name: str
    type_name: str | None
    members: list[str] = field(default_factory=list)
    action: str = ""
    target_type: str = ""
    priority: int = 0
    enabled: bool = True


class RuleEngine:
    """Rules evaluated until nothing more follows.

    A rule that wants more members than an instance has been asked for waits; `extend` then reads one member more of such instances, and the waiting
    rules are tried on what it returns. Where a rule's action yields an address, an instance of the rule's target type stands there, to which the
    rules apply anew. Each (type, address, members read) is looked at once, so that circles end.
    """

    def __init__(self, rules: list[PathRule], extend: Callable[[DataFrame], DataFrame]) -> None:
        """extend: from instances (type_name, address, path, at), whose paths are of one length in a call, rows with a member more: the same columns, `path`
        one longer and `at` where the member stands; further columns may serve the actions. It isn't called where no rule waits."""
        self.rules, self.extend = [r for r in rules if r.enabled], extend
        unknown = sorted({r.action for r in self.rules} - set(ACTIONS))
        if unknown:
            raise ValueError(f"unknown actions: {', '.join(unknown)}")

    def evaluate(self, instances: DataFrame) -> DataFrame:
        """instances: type_name, address. Returns type_name, address, path, rule_name, priority, target_type, result, ambiguous, generation: the
        deciding rule of each instance and path for which one matched; a rule on fewer members of the same instance wins over one on more
        if its priority isn't lower."""
        spark = instances.sparkSession
        index = RuleIndex(spark, [r.type_name for r in self.rules])
        table = F.broadcast(spark.createDataFrame(
            [(i, r.name, r.priority, [_whole(compile_pattern(m)) for m in r.members], r.action, r.target_type) for i, r in enumerate(self.rules)],
            "rule_no int, rule_name string, priority int, wants array<string>, action string, target_type string",
        ))
        fresh = cut(instances.select("type_name", F.col("address").cast("bigint").alias("address")).distinct())
        seen, decided, generation = [], [], 0
        while not fresh.isEmpty():
            seen.append(fresh)
            start = fresh.withColumns({"path": F.array().cast("array<string>"), "at": F.col("address")})
            # rules are looked up once for each different name
            fits = cut(index.candidates(fresh.select("type_name").distinct(), "type_name"))
            few = fits.limit(FEW + 1).count() <= FEW
            active = cut(start.join(F.broadcast(fits) if few else by_sorting(fits), "type_name"))
            rounds = []
            while not active.isEmpty():
                given, wanted = F.size("path"), F.size("wants")
                told = defer(active.join(table, "rule_no"), given, wanted)  # only a rule's number is written and moved
                hit = told.filter("state = 'match'")
                result = F.lit(None).cast("bigint")
                for name in sorted({r.action for r in self.rules}):
                    result = F.when(F.col("action") == name, ACTIONS[name](F.col("at")).cast("bigint")).otherwise(result)
                rounds.append(cut(hit.withColumn("result", result).filter("result is not null").select("type_name", "address", "path", "rule_no", "rule_name", "priority", "target_type", "result")))
                waiting = told.filter("state = 'defer'")
                if waiting.isEmpty():
                    break
                longer = self.extend(cut(waiting.select("type_name", "address", "path", "at").distinct())).withColumn("_before", F.slice("path", 1, F.size("path") - 1))
                again = waiting.select(F.col("type_name").alias("_t"), F.col("address").alias("_a"), F.col("path").alias("_p"), "rule_no")
                met = longer.join(again, (F.col("type_name") == F.col("_t")) & (F.col("address") == F.col("_a")) & (F.col("_before") == F.col("_p")))
                fitting = met.join(table.select("rule_no", "wants"), "rule_no").filter(F.expr("element_at(path, -1) rlike element_at(wants, size(path))"))
                active = cut(fitting.drop("_before", "_t", "_a", "_p", "wants"))
            matched = rounds[0] if rounds else None
            for more in rounds[1:]:
                matched = matched.unionByName(more)
            if matched is None:
                break
            own = cut(self._decided(matched, self.rules).withColumn("generation", F.lit(generation)))
            decided.append(own)
            known = seen[0].select("type_name", "address")
            for more in seen[1:]:
                known = known.unionByName(more.select("type_name", "address"))
            fresh = cut(own.select(F.col("target_type").alias("type_name"), F.col("result").alias("address")).distinct().join(known, ["type_name", "address"], "left_anti"))
            generation += 1
        if not decided:
            return self._decided(instances.select("type_name", F.col("address").cast("bigint").alias("address"), F.array().cast("array<string>").alias("path"), F.lit(0).alias("rule_no"), F.lit("").alias("rule_name"), F.lit(0).alias("priority"), F.lit("").alias("target_type"), F.lit(0).cast("bigint").alias("result"))).withColumn("generation", F.lit(0)).limit(0)
        out = decided[0]
        for more in decided[1:]:
            out = out.unionByName(more)
        return out

    @staticmethod
    def _decided(matched: DataFrame, rules: list[PathRule] | None = None) -> DataFrame:
        """The best rule of each instance and path, then those of shorter paths against those of longer ones: only rows that a rule of fewer members
        could beat are held against the paths that begin theirs."""
        target = F.concat_ws("@", "target_type", F.col("result").cast("string"))
        best = cut(decide(matched.withColumn("target", target), ["type_name", "address", "path"]))
        lengths = sorted({len(r.members) for r in rules or []})
        over = {n: max(r.priority for r in rules if len(r.members) < n) for n in lengths[1:]}  # the highest priority of rules of fewer members
        loose = reduce(lambda a, b: a | b, [(F.size("path") == n) & (F.col("priority") <= p) for n, p in over.items()], F.lit(False))
        begins = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n < F.size("path"))
        asked = best.filter(loose).select("type_name", "address", F.col("path").alias("_long"), F.col("priority").alias("_own"), F.explode(begins).alias("_n")).select("type_name", "address", "_long", "_own", F.slice("_long", 1, F.col("_n")).alias("path"))
        beaten = asked.join(best.select("type_name", "address", "path", "priority"), ["type_name", "address", "path"]).filter(F.col("priority") >= F.col("_own"))
        beaten = beaten.select("type_name", "address", F.col("_long").alias("path")).distinct()
        kept = best.filter(~loose).unionByName(best.filter(loose).join(beaten, ["type_name", "address", "path"], "left_anti")) if over else best
        parts = F.split("target", "@")
        return kept.select("type_name", "address", "path", "rule_name", "priority", parts[0].alias("target_type"), F.get(parts, F.lit(1)).cast("bigint").alias("result"), "ambiguous")


def _whole(p: NamePattern) -> str:
    """A pattern as one expression."""
    if p.kind == "any":
        return ""
    if p.kind == "literal":
        return "(?i)^" + re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", p.text) + "$"
    return f"(?si)^(?:{p.text})$" if p.kind == "wildcard" else f"(?i){p.text}" if p.ignore_case else p.text


def read_rules(path: str, seen: set[str] | None = None) -> list[dict]:
    """SRC10: rules from XML: filters, system, action, priority; includes are read once and looked for beside the file and
    in its include paths. Raises ValueError for unknown elements."""
    seen = set() if seen is None else seen
    real = os.path.realpath(path)
    if real in seen:
        return []
    seen.add(real)
    root = ET.parse(real).getroot()
    out: list[dict] = []
    folders = [os.path.dirname(real)]
    inherited = {k: v for k, v in root.attrib.items() if k in ("os", "architecture", "minversion", "maxversion")}
    for part in root:
        tag = part.tag if isinstance(part.tag, str) else ""  # comments have no name
        if tag == "ruleincludes":
            folders += [os.path.join(os.path.dirname(real), (c.text or "").strip()) for c in part if c.tag == "ruleinclude"]
        elif tag == "include":
            text = (part.text or "").strip()
            found = next((f for d in folders if os.path.exists(f := os.path.join(d, text))), None)
            if found is None:
                raise FileNotFoundError(text)
            out += read_rules(found, seen)
        elif tag == "rules":
            out += [_rule(r, int(part.get("priority", 0)), inherited) for r in part if isinstance(r.tag, str)]
        elif tag and tag != "scriptincludes":
            raise ValueError(f"unknown element <{tag}>")
    return out


def _rule(node: ET.Element, priority: int, system: dict[str, str]) -> dict:
    own = {k: v for k, v in node.attrib.items() if k in ("os", "architecture", "minversion", "maxversion")}
    rule: dict = {"name": "", "description": "", "priority": int(node.get("priority", priority)), "os": system | own, "filter": {}, "members": [], "action": None}
    for c in node:
        if not isinstance(c.tag, str):
            continue
        if c.tag in ("name", "description"):
            rule[c.tag] = " ".join((c.text or "").split())
        elif c.tag == "filter":
            for f in c:
                if f.tag == "members":
                    rule["members"] = [dict(m.attrib) | {"name": (m.text or "").strip() or None} for m in f if isinstance(m.tag, str)]
                elif isinstance(f.tag, str):
                    rule["filter"][f.tag] = (f.text or "").strip()
        elif c.tag == "action":
            rule["action"] = dict(c.attrib) | {"text": (c.text or "").strip(), "parts": {k.tag: (k.text or "").strip() for k in c if isinstance(k.tag, str)}}
        else:
            raise ValueError(f"unknown element <{c.tag}>")
    if rule["action"] is None:
        raise ValueError(f"rule {rule['name']!r} has no action")
    return rule


def to_filter(fields: dict[str, str]) -> TypeFilter:
    """The filter of a rule's fields."""
    out = TypeFilter()
    for k, v in fields.items():
        out.set(expand_key(k, ("typename", "datatype", "typeid", "size", "variablename", "filename")), v)
    return out


def write_rules(rows: list[dict], path: str) -> int:
    """SNK2: alternatives as rules: name, type_name, member, target_type, expression; rows without an expression become comments."""
    root = ET.Element("typeknowledge", version="1")
    box = ET.SubElement(root, "rules")
    n = 0
    for r in rows:
        if not r.get("expression"):
            box.append(ET.Comment(f" {r['type_name']}.{r['member']} can't be evaluated "))
            continue
        rule = ET.SubElement(box, "rule", priority=str(r.get("priority", 0)))
        ET.SubElement(rule, "name").text = r["name"]
        f = ET.SubElement(rule, "filter")
        ET.SubElement(f, "typename").text = r["type_name"]
        members = ET.SubElement(f, "members")
        ET.SubElement(members, "member").text = r["member"]
        a = ET.SubElement(rule, "action", type="expression")
        ET.SubElement(a, "targettype").text = r["target_type"]
        ET.SubElement(a, "expression").text = r["expression"]
        n += 1
    ET.indent(root)
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)
    return n


def ranked(matched: DataFrame, key: list[str]) -> DataFrame:
    """Every match with its rank, for reports."""
    w = Window.partitionBy(*key).orderBy(F.desc("priority"), "rule_no")
    return matched.withColumn("rank", F.row_number().over(w))
