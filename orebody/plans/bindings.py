"""The operators bound to relational tables: one query per operator or group of operators, with its SQL.

OBJ, the view of objects that many use, is the same expression in both engines: events as objects of 16 to 160 bytes at
64-byte steps, so that neighbours overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions import expr, filters, patterns
from orebody.operators import diff, dyadic, graph, instances, intervals, revmap, rules, stats, trees, typed, validate
from orebody.operators.store import cut
from orebody.plans.pathql import Edge, KeyPaths
from orebody.session import Symbols
from orebody.sources import memory
from orebody.sources import text as text_source
from orebody.sources.text import fold_trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WIDTH = 512
TYPE_BITS = {"click": 1, "view": 2, "purchase": 4, "signup": 8, "error": 16}
_CASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_BITS.items())
OBJ_SQL = f"""OBJ AS (SELECT event_id, event_id*64 AS addr, 16 + (event_id % 7)*24 AS size, event_id*64 + 16 + (event_id % 7)*24 - 1 AS end_, event_type AS kind,
  CASE event_type {_CASE} ELSE 0 END AS bits, user_id AS owner, least(value/300, 1.0) AS prob, ts FROM events)"""


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register


def obj(t: Callable[[str], DataFrame]) -> DataFrame:
    size = 16 + (F.col("event_id") % 7) * 24
    bits = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in TYPE_BITS.items()], F.lit(0))
    return t("events").select(
        "event_id", (F.col("event_id") * 64).alias("addr"), size.alias("size"), (F.col("event_id") * 64 + size - 1).alias("end_"), F.col("event_type").alias("kind"), bits.alias("bits"),
        F.col("user_id").alias("owner"), F.least(F.col("value") / 300, F.lit(1.0)).alias("prob"), "ts",
    )


def big(c: Column, name: str) -> Column:
    return c.cast("bigint").alias(name)


# --- filters and projections


@query("filter_literal", "SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_type) = 'standard'")
def _(t):
    return t("part").filter(patterns.matches(F.col("p_type"), "Standard")).select("p_partkey", "p_name", "p_type")


@query("filter_wildcard", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^.*r.d.*[gt]$')")
def _(t):
    return t("part").filter(patterns.matches(F.col("p_name"), "*R?D*[gt]")).select("p_partkey", "p_name")


@query("filter_regex", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '#1[0-4]$')")
def _(t):
    return t("part").filter(patterns.matches(F.col("p_brand"), "/#1[0-4]$/")).select("p_partkey", "p_brand")


@query("filter_regex_ignore_case", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)EXAMPLE\\.(com|net)/EN/')")
def _(t):
    return t("pages").filter(patterns.matches(F.col("url"), "!EXAMPLE\\.(com|net)/EN/!i")).select("page_id", "url")


@query("filter_any_name", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return t("nation").filter(patterns.matches(F.col("n_name"), "")).select("n_nationkey", "n_name")


@query("filter_kind_mask", f"WITH {OBJ_SQL} SELECT event_id, kind, bits FROM OBJ WHERE (bits & 5) <> 0")
def _(t):
    f = filters.TypeFilter(kinds=TYPE_BITS["click"] | TYPE_BITS["purchase"])
    return obj(t).filter(f.condition(kind="bits")).select("event_id", "kind", "bits")


@query("filter_type_options", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size = 16 AND regexp_matches(p_name, '(?i)^.*bolt$') AND p_partkey % 3 = 0")
def _(t):
    types = t("part").select("p_partkey", "p_name", "p_size", F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.lit(1).alias("kind"), (F.col("p_partkey") % 3).alias("type_id"))
    return filters.filter_types(types, "typen:*bolt size:0x10 typeid:0").select("p_partkey", "p_name", "p_size")


@query("filter_lexical_chain", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'asia' OR lower(n_name) = 'asia' OR lower(c_name) = 'asia'")
def _(t):
    link = lambda name, i: F.struct(F.lit(i).alias("kind"), F.col(name).alias("name"), F.lit(0).alias("type_id"))
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.withColumn("chain", F.array(link("c_name", 1), link("n_name", 2), link("r_name", 4)))
    return rows.filter(filters.TypeFilter.parse("typename:asia").condition("chain")).select("c_custkey")


@query(
    "filter_member_chain",
    """SELECT n_nationkey, n_name FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND lower(c.c_mktsegment) = 'building'
      AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND regexp_matches(o.o_orderpriority, '^1-')))""",
)
def _(t):
    types = t("nation").select("n_nationkey", "n_name", F.concat(F.lit("n"), F.col("n_nationkey")).alias("type_id"))
    own = t("customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("struct_id"), F.col("c_mktsegment").alias("name"), F.concat(F.lit("c"), F.col("c_custkey")).alias("ref_type_id"))
    inner = t("orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("struct_id"), F.col("o_orderpriority").alias("name"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("ref_type_id"))
    target = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("type_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("struct_id"))
    chain = [filters.MemberFilter(patterns.compile_pattern("Building")), filters.MemberFilter(patterns.compile_pattern("/^1-/"))]
    return filters.filter_member_chain(types, own.unionByName(inner), target, chain).select("n_nationkey", "n_name")


@query("filter_variables", "SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE regexp_matches(s_name, '(?i)^supplier#0000000[1-4].*$') AND regexp_matches(n_name, '(?i)^nation_1.*$')")
def _(t):
    variables = t("supplier").select("s_suppkey", "s_name", F.col("s_name").alias("var_name"), F.lit("a.c").alias("orig_file"), F.col("s_nationkey").alias("type_id"))
    types = t("nation").select(F.col("n_nationkey").alias("type_id"), F.col("n_name").alias("name"), F.lit(1).alias("kind"), F.lit(0).alias("size"))
    return filters.filter_variables(variables, types, "variablename:supplier#0000000[1-4]* typename:nation_1*").select("s_suppkey", "s_name")


@query("list_sorted_filtered", "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE regexp_matches(s_name, '(?i)^.*7.*$') OR regexp_matches(CAST(s_nationkey AS VARCHAR), '(?i)^.*7.*$')")
def _(t):
    rows = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    return filters.any_column_like(rows, "7", ["s_name", F.col("s_nationkey").cast("string")], "s_suppkey")


@query("script_list", "SELECT p_partkey, p_type FROM part WHERE p_type = 'PROMO' UNION ALL SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^S.*L.?$')")
def _(t):
    rows = t("part").select("p_partkey", "p_type")
    return filters.script_list(rows, "p_type", "PROMO").unionAll(filters.script_list(rows, "p_type", "S*L*").filter(~F.col("p_type").rlike("^S.*L..")))


@query(
    "version_compare",
    """WITH v AS (SELECT p_partkey, [p_size, p_partkey % 7] || CASE WHEN p_partkey % 3 = 0 THEN [p_partkey % 5] ELSE [] END AS a FROM part)
    SELECT p_partkey, CAST(CASE WHEN a[1] <> 16 THEN sign(a[1] - 16) WHEN a[2] <> 3 THEN sign(a[2] - 3) WHEN len(a) > 2 THEN 1 ELSE 0 END AS INTEGER) AS cmp,
      CAST(CASE WHEN a[1] <> 16 THEN sign(a[1] - 16) WHEN a[2] <> 3 THEN sign(a[2] - 3) WHEN len(a) > 2 THEN 1 ELSE 0 END AS INTEGER) >= 0 AS passes FROM v""",
)
def _(t):
    tail = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("."), F.col("p_partkey") % 5)).otherwise("")
    v = F.concat(F.col("p_size"), F.lit("-"), F.col("p_partkey") % 7, tail)
    return t("part").select("p_partkey", filters.compare_versions(v, F.lit("16-3")).alias("cmp"), filters.os_filter(F.lit(1), F.lit(4), v, want_os=1, min_version="16-3").alias("passes"))


@query(
    "enum_lookup_unique",
    "SELECT name, CAST(CASE WHEN count(DISTINCT v) = 1 THEN min(v) ELSE -1 END AS INTEGER) AS v FROM (SELECT n_name AS name, n_nationkey AS v FROM nation UNION ALL SELECT p_type, p_size FROM part) GROUP BY name",
)
def _(t):
    rows = t("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("v")).unionByName(t("part").select(F.col("p_type").alias("name"), F.col("p_size").alias("v")))
    return filters.unique_lookup(rows, "name", "v")


@query("distinct_names", "SELECT DISTINCT p_type FROM part")
def _(t):
    return Symbols({"parts": t("part")}).names("parts", "p_type")


@query("list_types_projection", "SELECT p_partkey, p_type, p_name, p_size, p_brand || ':' || CAST(p_partkey % 100 AS VARCHAR) AS source FROM part")
def _(t):
    types = t("part").withColumn("source", F.concat_ws(":", "p_brand", (F.col("p_partkey") % 100).cast("string")))
    return Symbols({"types": types}).list_types(order="p_partkey").select("p_partkey", "p_type", "p_name", "p_size", "source")


@query("show_nested", "SELECT n_nationkey, n_name, CAST(count(s_suppkey) AS BIGINT) AS n_members, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS members FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL")
def _(t):
    types = t("nation").select(F.col("n_nationkey").alias("type_id"), F.col("n_name").alias("name"))
    members = t("supplier").select(F.col("s_nationkey").alias("type_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("offset"))
    rows = instances.shown(types, members, types.sparkSession.createDataFrame([("none", "x")], "rule string, pattern string"), F.lit(True))
    found = F.coalesce("members", F.array().cast("array<struct<offset:bigint,name:string>>"))
    return rows.select(F.col("type_id").alias("n_nationkey"), F.col("name").alias("n_name"), big(F.size(found), "n_members"), F.array_join(F.transform(found, lambda x: x["name"]), ",").alias("members"))


@query("address_sanity", f"""WITH {OBJ_SQL} SELECT event_id, addr - 4096 = 0 OR (addr - 4096 BETWEEN -4095 AND -1) OR addr - 4096 IN (1048832, 2097664) AS is_default,
  addr - 4096 BETWEEN 65536 AND 262143 AS in_region, addr BETWEEN 4096 AND 140737488355327 AS user_land, addr <> 0 AND (kind <> 'click' OR addr % 4 = 0) AS usable FROM OBJ""")  # fmt: skip
def _(t):
    a = F.col("addr") - 4096
    return obj(t).select(
        "event_id", filters.is_default_value(a).alias("is_default"), filters.is_valid_address(a, regions=[(65536, 262143)]).alias("in_region"),
        filters.is_user_land(F.col("addr")).alias("user_land"), filters.is_valid_instance(F.col("addr"), F.col("kind") == "click", F.lit(True)).alias("usable"),
    )


@query(
    "learned_constants",
    """SELECT p_type, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS constants, NOT bool_or(p_partkey % 400 = 0) AS usable FROM part GROUP BY p_type""",
)
def _(t):
    rows = t("part").select("p_type", "p_size", (F.col("p_partkey") % 400 != 0).alias("c"), F.lit(False).alias("s"))
    learned = filters.learn_constants(rows, "p_type", "p_size", "c", "s")
    return learned.select("p_type", F.array_join(F.transform("constants", lambda x: x.cast("string")), ",").alias("constants"), "usable")


@query(
    "magic_valid",
    f"""WITH {OBJ_SQL}, per AS (SELECT owner, CASE WHEN kind IN ('click', 'view') THEN 'u' END AS u, CASE WHEN kind IN ('click', 'view') THEN bool_or(ok) ELSE bool_and(ok) END AS ok FROM (
      SELECT owner, kind, CASE WHEN kind IN ('click', 'view') THEN 'u' END AS u, (event_id % 50 = 0 OR event_id % 50 IN (1, 2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47) OR kind = 'error') AS ok FROM OBJ) GROUP BY owner, kind, u)
    SELECT owner, bool_and(ok2) AS valid FROM (SELECT owner, u, CASE WHEN u IS NULL THEN bool_and(ok) ELSE bool_or(ok) END AS ok2 FROM per GROUP BY owner, u) GROUP BY owner""",
)
def _(t):
    primes = [1, 2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47]
    rows = obj(t).select("owner", F.when(F.col("kind").isin("click", "view"), "u").alias("u"), (F.col("event_id") % 50).alias("v"), F.when(F.col("kind") == "error", F.array().cast("array<bigint>")).otherwise(F.array(*[F.lit(p).cast("bigint") for p in primes])).alias("k"))
    return filters.magic_valid(rows, "owner", "u", "v", "k")


# --- joins and lookups


@query("follow_reference", "SELECT c_custkey, n_name AS ref_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    return graph.follow(t("customer"), "c_nationkey", t("nation").select(F.col("n_nationkey").alias("type_id"), F.col("n_name").alias("name"))).select("c_custkey", "ref_name")


@query(
    "reference_closure",
    """WITH RECURSIVE typ AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 4 <> 3 THEN p_partkey - 1 END AS nxt FROM part), walk AS (
      SELECT id, id AS cur, 0 AS depth FROM typ UNION ALL SELECT w.id, y.nxt, w.depth + 1 FROM walk w JOIN typ y ON w.cur = y.id WHERE y.nxt IS NOT NULL)
    SELECT id AS type_id, arg_max(cur, depth) AS end_id, CAST(max(depth) AS INTEGER) AS depth FROM walk GROUP BY id""",
)
def _(t):
    k = F.col("p_partkey")
    types = t("part").select(k.alias("type_id"), F.when((k % 10 != 0) & (k % 4 != 3), filters.KINDS["Typedef"]).otherwise(filters.KINDS["Struct"]).alias("kind"), (k - 1).alias("ref_type_id"))
    return graph.closure(types, filters.LEXICAL)


@query("usedby_lookup", "SELECT DISTINCT o_orderkey AS type_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900)")
def _(t):
    wanted = t("customer").filter("c_acctbal < -900").select(F.col("c_custkey").alias("type_id"))
    refs = t("orders").select(F.col("o_orderkey").alias("type_id"), F.col("o_custkey").alias("ref_type_id"))
    none = t("lineitem").filter("false").select(F.col("l_orderkey").alias("struct_id"), F.col("l_partkey").alias("ref_type_id"))
    return graph.used_by(refs, none, wanted)


@query("equivalent_ids", "SELECT DISTINCT l_orderkey AS type_id FROM lineitem WHERE l_partkey IN (SELECT p.p_partkey FROM part p WHERE p.p_name IN (SELECT p_name FROM part WHERE p_partkey = 7))")
def _(t):
    part = t("part").select("p_name", "p_partkey")
    canon = part.groupBy("p_name").agg(F.min("p_partkey").alias("canon_id"))
    same = part.join(canon, "p_name").select(F.col("p_partkey").alias("type_id"), "canon_id")
    wanted = same.filter("type_id = 7").select(F.col("canon_id").alias("type_id"))
    refs = t("lineitem").select(F.col("l_orderkey").alias("type_id"), F.col("l_partkey").alias("ref_type_id"))
    return graph.used_by(refs.filter("false"), refs.withColumnRenamed("type_id", "struct_id"), wanted, same)


@query(
    "usedby_depth_k",
    """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
    w AS (SELECT 'r2' AS node, 0 AS depth, 'r2' AS path UNION ALL SELECT e.dst, w.depth + 1, w.path || '.' || e.dst FROM w JOIN e ON e.src = w.node WHERE w.depth < 3) SELECT node, depth, path FROM w""",
)
def _(t):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t("nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    e = e.unionByName(t("customer").select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"))).unionByName(t("orders").select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst")))
    seed = t("region").filter("r_regionkey = 2").select(key("r", "r_regionkey").alias("node"), F.array(key("r", "r_regionkey")).alias("path"), F.lit(1.0).alias("score"))
    out = graph.expand(seed, e.withColumn("label", F.col("dst")), 3)
    return out.select("node", "depth", graph.full_name("path").alias("path"))


def _ranges(t, step: int, length: int) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("rid"), (F.col("c_custkey") * step).alias("lo"), (F.col("c_custkey") * step + (F.col("c_custkey") % 5) * length).alias("hi"))


@query("stab_points", f"WITH {OBJ_SQL} SELECT c_custkey AS pid, event_id FROM customer JOIN OBJ ON c_custkey * 397 BETWEEN addr AND end_")
def _(t):
    p = t("customer").select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") * 397).alias("point"))
    return intervals.stab(p, obj(t).select("event_id", "addr", "end_"), "point", "addr", "end_", WIDTH).select("pid", "event_id")


@query("range_overlap", f"WITH {OBJ_SQL} SELECT c_custkey AS rid, event_id FROM customer JOIN OBJ ON addr <= c_custkey * 401 + (c_custkey % 5) * 90 AND end_ >= c_custkey * 401")
def _(t):
    return intervals.overlap_join(_ranges(t, 401, 90), obj(t).select("event_id", "addr", "end_"), "lo", "hi", "addr", "end_", WIDTH).select("rid", "event_id")


@query("range_overlap_long", f"WITH {OBJ_SQL} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id * (c_custkey + 1)) AS BIGINT) AS s FROM customer JOIN OBJ ON addr <= c_custkey * 401 + (c_custkey % 5) * 9000 AND end_ >= c_custkey * 401")
def _(t):
    pairs = intervals.overlap_join(_ranges(t, 401, 9000), obj(t).select("event_id", "addr", "end_"), "lo", "hi", "addr", "end_", WIDTH)
    return pairs.agg(F.count("*").alias("n"), big(F.sum(F.col("event_id") * (F.col("rid") + 1)), "s"))


@query("range_constant", f"WITH {OBJ_SQL} SELECT event_id FROM OBJ WHERE addr <= 20000 AND end_ >= 10000")
def _(t):
    return intervals.in_range(obj(t), "addr", "end_", 20000, 10000).select("event_id")


@query("self_overlap", f"WITH {OBJ_SQL} SELECT a.event_id AS id_a, b.event_id AS id_b FROM OBJ a JOIN OBJ b ON a.event_id < b.event_id AND a.addr <= b.end_ AND b.addr <= a.end_")
def _(t):
    a = obj(t).select(F.col("event_id").alias("id_a"), F.col("addr").alias("a_s"), F.col("end_").alias("a_e"))
    b = obj(t).select(F.col("event_id").alias("id_b"), F.col("addr").alias("b_s"), F.col("end_").alias("b_e"))
    return intervals.overlap_join(a, b, "a_s", "a_e", "b_s", "b_e", WIDTH).filter("id_a < id_b").select("id_a", "id_b")


_LOG_SQL = "alloc AS (SELECT event_id*64 AS slot, 32 + (event_id % 3)*64 AS slot_size, CASE WHEN event_id % 12 = 0 THEN NULL ELSE event_type END AS slot_type FROM events WHERE event_id % 4 = 0)"


def _log(t) -> DataFrame:
    return t("events").filter("event_id % 4 = 0").select((F.col("event_id") * 64).alias("slot"), (32 + (F.col("event_id") % 3) * 64).alias("slot_size"), F.when(F.col("event_id") % 12 != 0, F.col("event_type")).alias("slot_type"))


@query(
    "asof_containing",
    f"""WITH {_LOG_SQL}, probes AS (SELECT c_custkey AS pid, c_custkey * 411 + 7 AS probe FROM customer), best AS (SELECT pid, probe, max(slot) AS slot FROM probes JOIN alloc ON slot <= probe GROUP BY ALL)
    SELECT pid, slot, slot_size FROM best JOIN alloc USING (slot) WHERE probe < slot + slot_size""",
)
def _(t):
    p = t("customer").select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") * 411 + 7).alias("probe"))
    return intervals.as_of(p, _log(t), "probe", "slot", "slot_size", ["slot_type"], 8192).select("pid", "slot", "slot_size")


_REL = "CASE WHEN a.addr > b.end_ OR b.addr > a.end_ THEN 'none' WHEN a.addr = b.addr AND a.end_ = b.end_ THEN 'equal' WHEN a.addr <= b.addr AND a.end_ >= b.end_ THEN 'first_embeds' WHEN b.addr <= a.addr AND b.end_ >= a.end_ THEN 'second_embeds' ELSE 'overlap' END"


def _neighbour_pairs(t) -> DataFrame:
    a = obj(t)
    b = a.select((F.col("event_id") - 1).alias("event_id"), F.col("addr").alias("b_s"), F.col("end_").alias("b_e"), F.col("prob").alias("b_p"))
    return a.join(b, "event_id").withColumn("relation", intervals.relation(F.col("addr"), F.col("end_"), F.col("b_s"), F.col("b_e")))


@query("interval_relation", f"WITH {OBJ_SQL} SELECT a.event_id, {_REL} AS relation FROM OBJ a JOIN OBJ b ON b.event_id = a.event_id + 1")
def _(t):
    return _neighbour_pairs(t).select("event_id", "relation")


@query(
    "child_admission",
    f"""WITH {OBJ_SQL}, p AS (SELECT a.event_id, {_REL} AS relation, a.prob AS pa, b.prob AS pb FROM OBJ a JOIN OBJ b ON b.event_id = a.event_id + 1)
    SELECT event_id, CASE WHEN relation IN ('equal', 'second_embeds') THEN 'inside' WHEN relation = 'first_embeds' THEN 'around' WHEN pa > pb + 0.1 THEN 'replace' WHEN pb > pa + 0.1 THEN 'keep_old' ELSE 'keep_both' END AS verdict FROM p""",
)
def _(t):
    return _neighbour_pairs(t).select("event_id", graph.admit(F.col("prob"), F.col("b_p"), F.col("relation")).alias("verdict"))


@query(
    "merge_intervals",
    f"""WITH {OBJ_SQL}, b AS (SELECT owner, addr, end_ + (event_id % 9) * 500 AS e FROM OBJ), m AS (SELECT *, max(e) OVER (PARTITION BY owner ORDER BY addr, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR addr > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY addr, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT owner, min(addr) AS addr, max(e) AS e, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY owner, g""",
)
def _(t):
    rows = obj(t).select("owner", "addr", (F.col("end_") + (F.col("event_id") % 9) * 500).alias("e"))
    return intervals.merge(rows, ["owner"], "addr", "e", block=100_000)


@query(
    "reverse_pointers",
    "SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON l_partkey * 8 BETWEEN o_orderkey * 8 AND o_orderkey * 8 + 15 GROUP BY o_orderkey",
)
def _(t):
    edges = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("c")).select((F.col("l_partkey") * 8).alias("target"), "c")
    objs = t("orders").select("o_orderkey", (F.col("o_orderkey") * 8).alias("lo"), (F.col("o_orderkey") * 8 + 15).alias("hi"))
    return intervals.stab(edges, objs, "target", "lo", "hi", 64).groupBy("o_orderkey").agg(big(F.sum("c"), "n"))


@query("loaded_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 400000)")
def _(t):
    return t("customer").join(t("orders").filter("o_orderstatus = 'F' and o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("unknown_anti", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def _(t):
    return validate.unknown_targets(t("part"), "p_partkey", t("lineitem").filter("l_quantity > 49"), "l_partkey").select("p_partkey", "p_name")


@query("code_targets", "SELECT DISTINCT target FROM (SELECT s_suppkey * 8 AS target FROM supplier UNION ALL SELECT p_partkey * 4 FROM part WHERE p_type IN ('SMALL', 'LARGE'))")
def _(t):
    system = t("part").select((F.col("p_partkey") * 4).alias("address"), F.when(F.col("p_type") == "SMALL", "t").when(F.col("p_type") == "LARGE", "T").otherwise("d").alias("type"))
    return validate.code_targets(t("supplier").select((F.col("s_suppkey") * 8).alias("pc_low")), system)


@query(
    "embeds_at_offset",
    """WITH pairs AS (SELECT p_partkey AS pid, p_type AS outer_type, p_brand AS inner_, p_size AS pos FROM part)
    SELECT pid FROM pairs WHERE (outer_type = 'SMALL' AND inner_ = 'Brand#1' AND pos >= 4 AND (pos - 4) % 8 = 0 AND (pos - 4) / 8 < 5) OR (outer_type = 'LARGE' AND inner_ = 'Brand#2' AND pos = 16) OR (outer_type = 'PROMO' AND inner_ = 'Brand#3' AND pos % 2 = 0 AND pos / 2 < 20)""",
)
def _(t):
    pairs = t("part").select(F.col("p_partkey").alias("pid"), F.col("p_type").alias("outer_type"), F.col("p_brand").alias("inner"), F.col("p_size").alias("at"))
    layout = pairs.sparkSession.createDataFrame([("SMALL", 4, "Brand#1", 8, 5), ("LARGE", 16, "Brand#2", 0, 1), ("PROMO", 0, "Brand#3", 2, 20)], "type_id string, offset int, inner_type string, stride int, count int")
    return intervals.embeds_at(layout, pairs).select("pid")


# --- aggregates


@query(
    "interval_summary",
    f"""WITH {OBJ_SQL} SELECT c_custkey AS rid, CAST(count(*) AS BIGINT) AS n, min(prob) AS min_prob, max(prob) AS max_prob, CAST(bit_or(bits) AS INTEGER) AS kinds
    FROM customer JOIN OBJ ON addr <= c_custkey * 1024 + 1023 AND end_ >= c_custkey * 1024 GROUP BY c_custkey""",
)
def _(t):
    w = t("customer").select(F.col("c_custkey").alias("rid"), (F.col("c_custkey") * 1024).alias("lo"), (F.col("c_custkey") * 1024 + 1023).alias("hi"))
    return intervals.overlap_join(w, obj(t).select("addr", "end_", "prob", "bits"), "lo", "hi", "addr", "end_", 1024).groupBy("rid").agg(*intervals.summary("prob", "bits"))


@query(
    "bin_summary",
    f"""WITH {OBJ_SQL}, r AS (SELECT min(addr) AS lo, greatest(1, (max(end_) - min(addr) + 1) // 100) AS width FROM OBJ),
    c AS (SELECT prob, bits, unnest(range(least((addr - lo) // width, 99), least((end_ - lo) // width, 99) + 1)) AS cell FROM OBJ, r)
    SELECT cell, CAST(count(*) AS BIGINT) AS n, min(prob) AS min_prob, max(prob) AS max_prob, CAST(bit_or(bits) AS INTEGER) AS kinds FROM c GROUP BY cell""",
)
def _(t):
    o = obj(t)
    low, high = o.agg(F.min("addr"), F.max("end_")).first()
    low, high = (0, 0) if low is None else (low, high)
    return intervals.bin_cells(o, "addr", "end_", low, high, 100).groupBy("cell").agg(*intervals.summary("prob", "bits"))


@query("probability_histogram", f"""WITH {OBJ_SQL}, a AS (SELECT kind, b AS bucket FROM (SELECT DISTINCT kind FROM OBJ), range(10) r(b)), h AS (SELECT kind, CAST(least(floor(prob * 10), 9) AS BIGINT) AS bucket, count(*) AS n FROM OBJ WHERE prob IS NOT NULL GROUP BY 1, 2)
  SELECT kind, CAST(bucket AS INTEGER) AS bucket, CAST(coalesce(n, 0) AS BIGINT) AS n FROM a LEFT JOIN h USING (kind, bucket)""")  # fmt: skip
def _(t):
    return stats.probability_histogram(obj(t), "prob", ["kind"])


@query("verdict_bounds", f"WITH {OBJ_SQL} SELECT min(CASE WHEN kind <> 'error' THEN prob END) AS min_valid, max(CASE WHEN kind = 'error' THEN prob END) AS max_invalid FROM OBJ")
def _(t):
    return stats.verdict_bounds(obj(t), "prob", F.col("kind") != "error")


@query(
    "top_types_share",
    "SELECT l_partkey, CAST(n AS BIGINT) AS n, round(m, 6) AS mean_size, round(n / t, 9) AS share FROM (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS m, sum(count(*)) OVER () AS t FROM lineitem GROUP BY l_partkey) ORDER BY n DESC, l_partkey LIMIT 20",
)
def _(t):
    return stats.top_share(t("lineitem"), "l_partkey", "l_quantity").withColumn("mean_size", F.round("mean_size", 6)).withColumn("share", F.round("share", 9))


@query(
    "coverage",
    "SELECT p_type, CAST(count(*) AS BIGINT) AS total, CAST(count(h) AS BIGINT) AS found, round(count(h) / count(*), 9) AS ratio FROM (SELECT DISTINCT p_type, p_partkey FROM part) LEFT JOIN (SELECT DISTINCT l_partkey AS h FROM lineitem WHERE l_quantity > 49) ON p_partkey = h GROUP BY p_type",
)
def _(t):
    found = t("lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return stats.coverage(t("part"), found, ["p_partkey"], "p_type").withColumn("ratio", F.round("ratio", 9))


@query(
    "class_counts",
    f"""WITH {OBJ_SQL}, c AS (SELECT size, CASE WHEN prob IS NULL THEN 'unknown' WHEN prob >= 0.5 THEN 'valid' WHEN prob >= 0.1 THEN 'maybe' ELSE 'invalid' END AS class FROM OBJ)
    SELECT class, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS total_size, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM c GROUP BY class""",
)
def _(t):
    c = F.when(F.col("prob").isNull(), "unknown").when(F.col("prob") >= 0.5, "valid").when(F.col("prob") >= 0.1, "maybe").otherwise("invalid")
    return stats.class_counts(obj(t), [c.alias("class")], "size").withColumn("share", F.round("share", 9))


@query(
    "ambiguous_names",
    "SELECT p_name, CAST(count(*) AS BIGINT) AS n_sizes, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY p_size) AS sizes FROM (SELECT DISTINCT p_name, p_size FROM part WHERE p_size <> 0) GROUP BY p_name HAVING count(*) > 1",
)
def _(t):
    return stats.ambiguous_names(t("part"), "p_name", "p_size")


@query("hash_multiplicity", "SELECT md5(text) AS digest, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return stats.multiplicity(t("documents"), "text", "doc_id", None)


@query("hash_multiplicity_top", "SELECT md5(text) AS digest, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, digest LIMIT 10")
def _(t):
    return stats.multiplicity(t("documents"), "text", "doc_id")


@query(
    "postponed_references",
    """WITH w AS (SELECT l_partkey AS ref, l_orderkey AS waiter FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0)), f AS (SELECT ref, waiter, row_number() OVER (PARTITION BY ref ORDER BY waiter) AS k FROM (SELECT DISTINCT ref, waiter FROM w))
    SELECT ref, CAST((SELECT count(*) FROM w w2 WHERE w2.ref = f.ref) AS BIGINT) AS n, string_agg(CAST(waiter AS VARCHAR), ',' ORDER BY waiter) AS waiters FROM f WHERE k <= 5 GROUP BY ref ORDER BY n DESC, ref LIMIT 20""",
)
def _(t):
    rows = t("lineitem").select(F.col("l_partkey").alias("ref"), F.col("l_orderkey").alias("waiter"))
    out = stats.postponed(rows, "ref", t("part").filter("p_partkey % 10 <> 0"), "p_partkey", "waiter")
    return out.select("ref", big(F.col("n"), "n"), F.array_join(F.transform("waiters", lambda x: x.cast("string")), ",").alias("waiters"))


@query("catalog_size", " UNION ALL ".join(f"SELECT '{x}' AS table_name, CAST(count(*) AS BIGINT) AS n FROM {x}" for x in ("nation", "part", "supplier")))
def _(t):
    return stats.catalog_size({x: t(x) for x in ("nation", "part", "supplier")})


@query(
    "alternative_statistics",
    "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_partkey) AS BIGINT) AS by_id, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS by_hash FROM lineitem GROUP BY ALL HAVING count(*) >= 3",
)
def _(t):
    return stats.alternatives_summary(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", "l_returnflag", 3)


@query(
    "changed_type_vector",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, " + ", ".join(f"CAST(sum(CASE WHEN event_type = '{k}' AND value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS event_type_{k}" for k in TYPE_BITS) + " FROM events GROUP BY 1",
)
def _(t):
    return stats.change_vectors(t("events").withColumn("day", F.to_date("ts").cast("string")), "day", "event_type", list(TYPE_BITS), F.col("value") > 10)


@query(
    "child_validity_ratio",
    f"""WITH {OBJ_SQL}, c AS (SELECT owner, CASE WHEN kind = 'view' THEN 'u' END AS u, 1 AS t, CASE WHEN prob < 0.1 THEN 1 ELSE 0 END AS i, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS us FROM OBJ),
    p AS (SELECT owner, u, sum(t) AS t, sum(i) AS i, sum(us) AS us FROM c GROUP BY owner, u), q AS (SELECT owner, CASE WHEN u IS NULL THEN t ELSE 1 END AS t, CASE WHEN u IS NULL THEN i::DOUBLE ELSE least(1.0, i / greatest(t, 1)) END AS i, us FROM p),
    r AS (SELECT owner, sum(t) AS tested, sum(i) AS invalid, sum(us) AS us FROM q GROUP BY owner)
    SELECT owner, CAST(tested AS BIGINT) AS tested, round(invalid, 9) AS invalid, round((invalid + CASE WHEN us > tested * 0.2 THEN us ELSE 0 END) / greatest(tested, 1), 9) AS ratio FROM r""",
)
def _(t):
    rows = obj(t).withColumn("u", F.when(F.col("kind") == "view", "u"))
    out = stats.child_validity(rows, "owner", "u", F.lit(True), F.coalesce(F.col("prob") < 0.1, F.lit(False)), F.col("event_id") % 4 == 0)
    return out.select("owner", "tested", F.round("invalid", 9).alias("invalid"), F.round("ratio", 9).alias("ratio"))


# --- windows, diffs


@query(
    "cosine_consecutive",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS p FROM embeddings)
    SELECT vec_id, round(list_dot_product(p, v), 5) AS dot, round(sqrt(list_dot_product(p, p)), 5) AS len_prev, round(sqrt(list_dot_product(v, v)), 5) AS len_cur,
      round(CASE WHEN list_dot_product(p, p) = 0 OR list_dot_product(v, v) = 0 THEN -1.0 ELSE list_dot_product(p, v) / sqrt(list_dot_product(p, p)) / sqrt(list_dot_product(v, v)) END, 5) AS cosine FROM e WHERE p IS NOT NULL""",
)
def _(t):
    out = diff.consecutive_cosine(t("embeddings"), "vec_id", "embedding", 64)
    return out.select("vec_id", *[F.round(c, 5).alias(c) for c in ("dot", "len_prev", "len_cur", "cosine")])


@query(
    "diff_runs",
    """WITH d AS (SELECT DISTINCT user_id, event_id // 16 AS place FROM events WHERE value > 30), g AS (SELECT *, place - row_number() OVER (PARTITION BY user_id % 5 ORDER BY place) AS i FROM (SELECT DISTINCT user_id % 5 AS user_id, place FROM d))
    SELECT user_id AS grp, min(place) AS start, CAST(count(*) AS BIGINT) AS run FROM g GROUP BY user_id, i""",
)
def _(t):
    rows = t("events").filter("value > 30").select((F.col("user_id") % 5).alias("grp"), F.floor(F.col("event_id") / 16).alias("place"))
    return diff.runs_of(rows, ["grp"], "place")


@query(
    "diff_run_summary",
    """WITH d AS (SELECT DISTINCT user_id % 5 AS grp, event_id // 16 AS place FROM events WHERE value > 30), g AS (SELECT *, place - row_number() OVER (PARTITION BY grp ORDER BY place) AS i FROM d), r AS (SELECT grp, count(*) AS run FROM g GROUP BY grp, i)
    SELECT grp, CAST(min(run) AS BIGINT) AS min_run, CAST(max(run) AS BIGINT) AS max_run, CAST(count(*) AS BIGINT) AS n_runs FROM r GROUP BY grp""",
)
def _(t):
    rows = t("events").filter("value > 30").select((F.col("user_id") % 5).alias("grp"), F.floor(F.col("event_id") / 16).alias("place"))
    return diff.run_summary(diff.runs_of(rows, ["grp"], "place"), ["grp"], "run")


@query(
    "list_neighbours",
    """WITH l AS (SELECT conv_id * 1000 + turn AS node, lead(conv_id * 1000 + turn) OVER w AS next, lag(conv_id * 1000 + turn) OVER w AS prev FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    b AS (SELECT node, CASE WHEN node % 11 = 5 THEN node + 1 ELSE next END AS next, prev FROM l)
    SELECT a.node, (a.next IS NULL OR coalesce(n.prev = a.node, false)) AND (a.prev IS NULL OR coalesce(p.next = a.node, false)) AS ok FROM b a LEFT JOIN b n ON a.next = n.node LEFT JOIN b p ON a.prev = p.node""",
)
def _(t):
    rows = graph.neighbours_window(t("conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("node")), "conv_id", "node")
    broken = rows.select("node", F.when(F.col("node") % 11 == 5, F.col("node") + 1).otherwise(F.col("next")).alias("next"), "prev")
    return graph.neighbours_ok(broken)


@query("list_walk", "SELECT conv_id AS head, conv_id * 1000 + turn AS node, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations")
def _(t):
    rows = graph.neighbours_window(t("conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("node")), "conv_id", "node")
    heads = rows.groupBy((-F.col("conv_id") - 1).alias("head")).agg(F.min("node").alias("first"))
    return graph.walk_list(heads, rows.select("node", "next")).select((-F.col("head") - 1).alias("head"), "node", "place")


@query("union_lists", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT p_type FROM part")
def _(t):
    return t("nation").select(F.col("n_name").alias("name")).union(t("region").select("r_name")).union(t("part").select("p_type")).distinct()


@query("best_first", f"WITH {OBJ_SQL} SELECT event_id, prob FROM OBJ WHERE prob < 1 ORDER BY prob DESC, event_id LIMIT 50")
def _(t):
    queue = obj(t).filter("prob < 1").withColumn("key", F.struct("prob", (-F.col("event_id")).alias("later")))
    return graph.best_first(queue, "key", 50).select("event_id", "prob")


@query(
    "object_diff_paths",
    """SELECT c_custkey AS id, trim(CASE WHEN c_nationkey IS DISTINCT FROM s_nationkey THEN 'nationkey ' ELSE '' END || CASE WHEN c_acctbal IS DISTINCT FROM s_acctbal THEN 'acctbal ' ELSE '' END || CASE WHEN c_custkey % 3 IS DISTINCT FROM s_suppkey % 2 THEN 'group' ELSE '' END) AS paths
    FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey IS DISTINCT FROM s_nationkey OR c_acctbal IS DISTINCT FROM s_acctbal OR c_custkey % 3 IS DISTINCT FROM s_suppkey % 2""",
)
def _(t):
    a = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), (F.col("c_custkey") % 3).alias("group"))
    b = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"), (F.col("s_suppkey") % 2).alias("group"))
    return diff.object_diff(a, b, ["id"], ["nationkey", "acctbal", "group"]).select("id", F.concat_ws(" ", "paths").alias("paths"))


@query(
    "object_equality",
    """SELECT c_custkey AS object, bool_and(c_nationkey IS NOT DISTINCT FROM s_nationkey AND c_custkey % 4 IS NOT DISTINCT FROM s_suppkey % 2) AS equal FROM customer JOIN supplier ON c_custkey = s_suppkey GROUP BY 1""",
)
def _(t):
    def leaves(df, key, nation, m):  # noqa: ANN001, ANN202
        return df.select(F.col(key).alias("object"), F.inline(F.array(*[F.struct(F.lit(p).alias("path"), v.cast("string").alias("value"), F.lit(d).alias("depth")) for p, v, d in (("nation", F.col(nation), 1), ("m", F.col(key) % m, 1), ("in.bal", F.rand(7), 2))])))

    c = t("customer").join(t("supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey", "left_semi")
    return diff.objects_equal(leaves(c, "c_custkey", "c_nationkey", 4), leaves(t("supplier"), "s_suppkey", "s_nationkey", 2))


@query(
    "snapshot_changes",
    "SELECT a.user_id, a.k, b.v AS before, a.v AS after FROM (SELECT user_id, event_type AS k, max(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL) a JOIN (SELECT user_id, event_type AS k, max(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL) b USING (user_id, k) WHERE a.v IS DISTINCT FROM b.v",
)
def _(t):
    e = t("events").withColumnRenamed("event_type", "k")
    snap = lambda d: d.groupBy("user_id", "k").agg(F.max("value").alias("v"))
    return diff.snapshot_join(snap(e.filter("ts < timestamp'2024-01-16'")), snap(e.filter("ts >= timestamp'2024-01-16'")), ["user_id", "k"], "v")


@query(
    "page_hash_changed",
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.text IS NULL THEN 'new' WHEN a.text IS NULL THEN 'gone' WHEN a.text = b.text THEN 'same' ELSE 'changed' END AS verdict FROM (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0) b USING (doc_id)",
)
def _(t):
    d = t("documents").select("doc_id", "text")
    now, then = d.filter("doc_id % 5 <> 0"), d.filter("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return diff.hash_changed(now, then, "doc_id", "text")


# --- paths


def _paths(t) -> KeyPaths:
    names = ("lineitem", "orders", "customer", "nation", "region", "part", "embeddings")
    return KeyPaths({n: t(n) for n in names}, [
        Edge("lineitem", "order", "l_orderkey", "orders", "o_orderkey"), Edge("lineitem", "part", "l_partkey", "part", "p_partkey"), Edge("orders", "customer", "o_custkey", "customer", "c_custkey"),
        Edge("customer", "nation", "c_nationkey", "nation", "n_nationkey"), Edge("nation", "region", "n_regionkey", "region", "r_regionkey"),
    ])


@query(
    "path_fk_chain",
    "SELECT l_orderkey, l_linenumber, r_name AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def _(t):
    return _paths(t).query("lineitem.order.customer.nation.region.r_name", ["l_orderkey", "l_linenumber"])


@query("path_index", "SELECT vec_id, embedding[4] AS value FROM embeddings")
def _(t):
    return _paths(t).query("embeddings.embedding[3]", ["vec_id"])


@query("path_cast_offset", f"WITH {OBJ_SQL} SELECT a.event_id, b.event_id AS container FROM OBJ a JOIN OBJ b ON b.addr = a.addr - 128")
def _(t):
    a, b = obj(t).select("event_id", (F.col("addr") - 128).alias("addr")), obj(t).select(F.col("event_id").alias("container"), "addr")
    return a.join(b, "addr").select("event_id", "container")


@query(
    "flagship_path_summary",
    """WITH x AS (SELECT r_name, l_partkey, l_orderkey * 64 AS lo, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE regexp_matches(r_name, '(?i)^.*a.*$'))
    SELECT r_name AS value, CAST(count(*) AS BIGINT) AS n, min(l_quantity) AS min_q, max(l_quantity) AS max_q, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM x GROUP BY 1""",
)
def flagship(t):  # noqa: ANN001, ANN201
    rows = _paths(t).query("lineitem.order.customer.nation.region.r_name", ["l_partkey", "l_quantity"]).filter(patterns.matches(F.col("value"), "*a*"))
    return rows.groupBy("value").agg(F.count("*").alias("n"), F.min("l_quantity").alias("min_q"), F.max("l_quantity").alias("max_q"), F.countDistinct("l_partkey").alias("parts"))


# --- expressions


@query(
    "expr_promotion",
    """SELECT p_partkey, CAST((p_size * 1000 + p_partkey) % 97 AS BIGINT) AS a, CAST((p_size - 30) / 2.0 AS DOUBLE) AS b, CAST(CASE WHEN p_size - 30 < 0 THEN 4294967296 + p_size - 30 ELSE p_size - 30 END AS BIGINT) AS c,
      CAST(CASE WHEN p_size - 30 >= 0 THEN CASE WHEN p_size - 30 < 5 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS d, CAST(CASE WHEN p_size - 30 < 5 THEN 1 ELSE 0 END AS BIGINT) AS e, CAST(trunc((p_size - 30) / 7) AS BIGINT) AS f, CAST((p_size - 30) - 7 * CAST(trunc((p_size - 30) / 7) AS BIGINT) AS BIGINT) AS g FROM part""",
)
def _(t):
    env = {"size": (F.col("p_size").cast("bigint"), "i32"), "key": (F.col("p_partkey"), "i64")}
    one = lambda s, n: expr.compile_expr(s, env)[0].alias(n)
    return t("part").select("p_partkey", one("(size * 1000 + key) % 97", "a"), one("(size - 30) / 2.0", "b"), one("size - 30 + 0u", "c"), one("size - 30 < 5u", "d"), one("size - 30 < 5", "e"), one("(size - 30) / 7", "f"), one("(size - 30) % 7", "g"))


@query("expr_wraparound", "SELECT p_partkey, CAST(CASE WHEN (x % 4294967296) >= 2147483648 THEN (x % 4294967296) - 4294967296 ELSE x % 4294967296 END AS BIGINT) AS a, CAST(x % 4294967296 AS BIGINT) AS b FROM (SELECT p_partkey, p_partkey::HUGEINT * 123456789 AS x FROM part)")
def _(t):
    env = {"k": (F.col("p_partkey"), "i32"), "u": (F.col("p_partkey"), "u32")}
    return t("part").select("p_partkey", expr.compile_expr("k * 123456789", env)[0].alias("a"), expr.compile_expr("u * 123456789u", env)[0].alias("b"))


@query("expr_bitfield", "SELECT p_partkey, CAST((p_partkey >> 3) & 31 AS BIGINT) AS f, CAST(((p_partkey & 255) | 1024) AS BIGINT) AS o, CAST(xor(p_partkey, 21) AS BIGINT) AS x FROM part")
def _(t):
    env = {"k": (F.col("p_partkey"), "i64")}
    return t("part").select("p_partkey", expr.bit_field(F.col("p_partkey"), 32, 24, 5).alias("f"), expr.compile_expr("k & 0xff | 1024", env)[0].alias("o"), expr.compile_expr("k ^ 21", env)[0].alias("x"))


@query("expr_shift", "SELECT p_partkey, CAST(p_size << 4 AS BIGINT) AS l, CAST(p_partkey >> 2 AS BIGINT) AS r, CAST(floor((p_size - 30) / 4.0) AS BIGINT) AS n FROM part")
def _(t):
    env = {"k": (F.col("p_partkey"), "i64"), "s": (F.col("p_size").cast("bigint"), "i32")}
    return t("part").select("p_partkey", expr.compile_expr("s << 4", env)[0].alias("l"), expr.compile_expr("k >> 2", env)[0].alias("r"), expr.compile_expr("(s - 30) >> 2", env)[0].alias("n"))


@query("expr_logical", "SELECT p_partkey, CAST(CASE WHEN p_size > 10 AND p_partkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS a, CAST(CASE WHEN p_size = 3 OR NOT (p_partkey % 5 <> 0) THEN 1 ELSE 0 END AS BIGINT) AS b, CAST(CASE WHEN p_size > 25 THEN -p_size ELSE p_size + 1 END AS BIGINT) AS c, CAST(-p_size - 1 AS BIGINT) AS d FROM part")
def _(t):
    env = {"k": (F.col("p_partkey"), "i64"), "s": (F.col("p_size").cast("bigint"), "i32")}
    one = lambda s, n: expr.compile_expr(s, env)[0].alias(n)
    return t("part").select("p_partkey", one("s > 10 && k % 2 == 0", "a"), one("s == 3 || !(k % 5)", "b"), one("s > 25 ? -s : s + 1", "c"), one("~s", "d"))


@query("flags_to_text", "SELECT p_partkey, concat_ws(' | ', CASE WHEN (p_size & 1) <> 0 THEN 'READ' END, CASE WHEN (p_size & 2) <> 0 THEN 'WRITE' END, CASE WHEN (p_size & 4) <> 0 THEN 'EXEC' END, CASE WHEN (p_size & 8) <> 0 THEN 'SHARED' END) AS flags, concat_ws('.', p_partkey >> 24 & 255, p_partkey >> 16 & 255, p_partkey >> 8 & 255, p_partkey & 255) AS ip FROM part")
def _(t):
    return t("part").select("p_partkey", expr.flags_text(F.col("p_size"), {1: "READ", 2: "WRITE", 4: "EXEC", 8: "SHARED"}).alias("flags"), expr.ipv4_text(F.col("p_partkey")).alias("ip"))


@query("text_padding", "SELECT p_partkey, lpad(p_name, 20, ' ') AS l, rpad(p_type, 12, '.') AS r, lpad(lower(to_hex(p_partkey)), 8, '0') AS h, upper(to_hex(p_partkey + 255)) AS s FROM part")
def _(t):
    h = F.lower(F.hex("p_partkey"))
    return t("part").select("p_partkey", F.lpad("p_name", 20, " ").alias("l"), F.rpad("p_type", 12, ".").alias("r"), F.lpad(h, 8, "0").alias("h"), expr.hex_add(h, F.lit("ff")).alias("s"))


# --- rules, validity


def _rules() -> list[rules.Rule]:
    return [
        rules.Rule("small_bolts", patterns.matches(F.col("p_name"), "*bolt") & (F.col("p_size") < 20), "bolt", 1),
        rules.Rule("any_bolt", patterns.matches(F.col("p_name"), "*bolt"), "fastener", 1),
        rules.Rule("promo", F.col("p_type") == "PROMO", "promo", 2),
        rules.Rule("red", patterns.matches(F.col("p_name"), "red*"), "red", 2),
        rules.Rule("off", F.lit(True), "never", 9, enabled=False),
    ]


_RULE_SQL = """r(no, name, prio, target) AS (VALUES (0, 'small_bolts', 1, 'bolt'), (1, 'any_bolt', 1, 'fastener'), (2, 'promo', 2, 'promo'), (3, 'red', 2, 'red')),
 m AS (SELECT p_partkey, no, name, prio, target FROM part, r WHERE (no = 0 AND p_name ILIKE '%bolt' AND p_size < 20) OR (no = 1 AND p_name ILIKE '%bolt') OR (no = 2 AND p_type = 'PROMO') OR (no = 3 AND p_name ILIKE 'red%')),
 top AS (SELECT * FROM m QUALIFY prio = max(prio) OVER (PARTITION BY p_partkey))"""


@query("rule_priority", f"WITH {_RULE_SQL} SELECT p_partkey, arg_min(name, no) AS rule_name, CAST(max(prio) AS INTEGER) AS priority, arg_min(target, no) AS target, count(DISTINCT target) > 1 AS ambiguous FROM top GROUP BY p_partkey")
def _(t):
    return rules.decide(rules.match(t("part"), _rules(), ["p_partkey"]), ["p_partkey"])


@query("rule_matches", f"WITH {_RULE_SQL} SELECT p_partkey, name AS rule_name, CAST(prio AS INTEGER) AS priority, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY prio DESC, no) AS INTEGER) AS rank FROM m")
def _(t):
    return rules.ranked(rules.match(t("part"), _rules(), ["p_partkey"]), ["p_partkey"]).select("p_partkey", "rule_name", "priority", "rank")


@query("conflict_lattice", f"WITH {OBJ_SQL} SELECT owner, CASE max(CASE kind WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE CASE WHEN prob > 0.9 THEN 3 ELSE 0 END END) WHEN 0 THEN 'none' WHEN 1 THEN 'replace' WHEN 2 THEN 'conflict' ELSE 'ignore' END AS verdict FROM OBJ GROUP BY owner")
def _(t):
    v = F.when(F.col("kind") == "view", "none").when(F.col("kind") == "click", "replace").when(F.col("kind") == "error", "conflict").when(F.col("prob") > 0.9, "ignore").otherwise("none")
    return rules.conflicts(obj(t).withColumn("v", v), ["owner"], "v")


@query(
    "object_validity",
    f"""WITH {OBJ_SQL}, {_LOG_SQL}, best AS (SELECT event_id, addr, size, kind, max(slot) AS slot FROM OBJ JOIN alloc ON slot <= addr GROUP BY ALL), hit AS (SELECT b.event_id, b.slot, slot_size, slot_type FROM best b JOIN alloc USING (slot) WHERE addr < slot + slot_size)
    SELECT event_id, CASE WHEN slot IS NULL THEN 'not_found' WHEN addr + size > slot + slot_size THEN 'invalid' WHEN slot_type IS NULL THEN 'no_slab_type' WHEN addr = slot AND kind = slot_type THEN 'valid' WHEN size < slot_size THEN 'embedded' ELSE 'conflict' END AS validity FROM OBJ LEFT JOIN hit USING (event_id)""",
)
def _(t):
    return validate.object_validity(obj(t), _log(t), "addr", "size", "kind", 8192).select("event_id", "validity")


@query(
    "joint_verdict",
    f"""WITH {OBJ_SQL}, x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'invalid' WHEN event_id % 5 = 1 THEN 'valid' WHEN event_id % 5 = 2 THEN 'embedded' ELSE 'not_found' END AS slab, event_id % 2 = 0 AS m, event_id % 3 = 0 AS h, event_id % 7 = 0 AS g FROM OBJ)
    SELECT event_id, CASE WHEN slab IN ('invalid', 'conflict') THEN 'invalid' WHEN h AND NOT m THEN 'invalid' WHEN slab IN ('valid', 'embedded') THEN 'valid' WHEN g THEN 'valid_global' WHEN h AND m THEN 'maybe' ELSE 'unknown' END AS verdict FROM x""",
)
def _(t):
    e = F.col("event_id")
    slab = F.when(e % 5 == 0, "invalid").when(e % 5 == 1, "valid").when(e % 5 == 2, "embedded").otherwise("not_found")
    return obj(t).select("event_id", validate.verdict(slab, e % 2 == 0, e % 3 == 0, e % 7 == 0).alias("verdict"))


@query(
    "cache_type_inference",
    """WITH caches AS (SELECT DISTINCT p_type || '_cache' AS cache, p_size AS object_size, p_type FROM part), types AS (SELECT DISTINCT p_type || '_' || p_brand AS name, p_size AS size FROM part UNION SELECT DISTINCT p_type, p_size FROM part WHERE p_size % 2 = 0),
    one AS (SELECT cache || ':' || object_size AS cache, p_type, object_size FROM caches), pairs AS (SELECT cache, name, name <> p_type AS inexact, abs(length(name) - length(p_type)) AS far FROM one JOIN types ON size = object_size AND (name = p_type OR starts_with(name, p_type)))
    SELECT cache, arg_min(name, (inexact, far, name)) AS type_name FROM pairs GROUP BY cache""",
)
def _(t):
    part = t("part")
    caches = part.select(F.concat("p_type", F.lit("_cache:"), F.col("p_size").cast("string")).alias("cache"), F.col("p_size").alias("object_size"), "p_type").distinct()
    named = part.select(F.concat_ws("_", "p_type", "p_brand").alias("name"), F.col("p_size").alias("size")).union(part.filter("p_size % 2 = 0").select("p_type", "p_size")).distinct().withColumn("type_id", F.col("name"))
    aliases = {f"{ty}_cache:{s}": ty for ty in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD") for s in range(1, 51)}
    return validate.cache_types(caches.drop("p_type"), named, aliases).select("cache", "type_name")


@query(
    "code_pointer_triage",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey AS ptr, l_suppkey FROM lineitem), c AS (SELECT *, CASE WHEN ptr < 100 THEN 'user_land' WHEN ptr = 777 THEN 'default' WHEN ptr >= 1990 THEN 'invalid' WHEN ptr % 17 = 0 THEN 'nx' WHEN ptr BETWEEN 500 AND 599 THEN 'direct_map'
      WHEN ptr IN (SELECT s_suppkey * 10 FROM supplier) THEN 'function' WHEN ptr BETWEEN 1200 AND 1399 THEN 'module' WHEN l_suppkey % 2 = 0 THEN 'suspicious_union' ELSE 'suspicious' END AS class FROM p)
    SELECT class, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY class""",
)
def _(t):
    known = t("supplier").select((F.col("s_suppkey") * 10).alias("l_partkey"), F.lit(True).alias("f"))
    p = F.col("l_partkey")
    rows = t("lineitem").join(known, "l_partkey", "left")
    cls = validate.pointer_triage(p, p < 100, p == 777, p < 1990, p % 17 == 0, p.between(500, 599), F.col("f"), p.between(1200, 1399), F.col("l_suppkey") % 2 == 0)
    return rows.groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


@query(
    "page_attribution",
    f"""WITH {OBJ_SQL} SELECT event_id, CASE WHEN addr BETWEEN 0 AND 50000 THEN 'code' WHEN addr BETWEEN 40000 AND 90000 THEN 'data' WHEN EXISTS (SELECT 1 FROM supplier WHERE addr BETWEEN s_suppkey * 6000 AND s_suppkey * 6000 + 999) THEN 'module' ELSE 'hidden' END AS page_class FROM OBJ""",
)
def _(t):
    s = t("supplier").sparkSession
    fixed = lambda a, b: s.createDataFrame([(a, b)], "start bigint, end bigint")
    modules = t("supplier").select((F.col("s_suppkey") * 6000).alias("start"), (F.col("s_suppkey") * 6000 + 999).alias("end"))
    return validate.attribute(obj(t).select("event_id", "addr"), "addr", "event_id", [("code", fixed(0, 50000)), ("data", fixed(40000, 90000)), ("module", modules)], 2048).select("event_id", "page_class")


@query("page_flags", f"WITH {OBJ_SQL} SELECT event_id, (addr // 64) % 2 = 1 AS present, (addr // 128) % 2 = 1 AS writeable, (addr // 256) % 2 = 1 AS \"user\" FROM OBJ WHERE (addr // 64) % 2 = 1 AND (addr // 256) % 2 = 0")
def _(t):
    f = validate.page_flags(F.col("event_id"))
    rows = obj(t).select("event_id", f["present"].alias("present"), f["writeable"].alias("writeable"), f["user"].alias("user"), f["nx"].alias("nx"), (~f["user"]).alias("supervisor"))
    return validate.executable_pages(rows).select("event_id", "present", "writeable", "user")


@query("linear_translation", f"WITH {OBJ_SQL} SELECT event_id, CASE WHEN addr BETWEEN 0 AND 99999 THEN addr + 1000000 WHEN addr BETWEEN 200000 AND 299999 THEN addr - 200000 ELSE -1 END AS physical FROM OBJ")
def _(t):
    return obj(t).select("event_id", F.coalesce(validate.translate_linear(F.col("addr"), [(0, 99999, 1_000_000), (200_000, 299_999, 0)]), F.lit(-1)).alias("physical"))


@query("objects_by_page", f"WITH {OBJ_SQL} SELECT event_id, unnest(range(addr // 256, (addr + size - 1) // 256 + 1)) AS frame FROM OBJ")
def _(t):
    return graph.objects_by_page(obj(t), "addr", "size", 256).select("event_id", "frame")


@query(
    "winning_objects",
    f"WITH {OBJ_SQL} SELECT event_id FROM OBJ a WHERE NOT EXISTS (SELECT 1 FROM OBJ b WHERE b.event_id BETWEEN a.event_id - 4 AND a.event_id + 4 AND b.event_id <> a.event_id AND a.addr <= b.end_ AND b.addr <= a.end_ AND (b.prob > a.prob OR (b.prob = a.prob AND b.event_id < a.event_id)))",
)
def _(t):
    return validate.highest_probability(obj(t).select("event_id", "addr", "end_", "prob"), "event_id", "addr", "end_", "prob", WIDTH).select("event_id")


# --- graphs, probabilities


@query(
    "propagate_probability",
    """SELECT o_orderkey, round((1 - 1e-5) * (1 - 1e-5) * (1 - 1e-5) * CASE WHEN c_acctbal < 0 THEN 0.01 ELSE 1.0 END * CASE WHEN o_totalprice > 450000 THEN 0.7 ELSE 1.0 END * CASE WHEN o_orderstatus = 'P' THEN 0.6 ELSE 1.0 END, 9) AS prob
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(t):
    yes = F.lit(True)
    n = t("nation").select("n_nationkey", graph.node_probability(F.lit(1.0), yes, yes, yes, F.lit(1.0)).alias("p0"))
    c = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", graph.node_probability(F.col("p0"), F.col("c_acctbal") >= 0, yes, yes, F.lit(1.0)).alias("p1"))
    o = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    share = F.when(F.col("o_orderstatus") == "P", 0.5).otherwise(1.0)
    return o.select("o_orderkey", F.round(graph.node_probability(F.col("p1"), yes, yes, F.col("o_totalprice") <= 450000, share), 9).alias("prob"))


@query(
    "reachability_frontier",
    """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'c' || c_custkey AS dst FROM nation JOIN customer ON n_nationkey = c_nationkey UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
    w AS (SELECT 'n3' AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth, round(0.5 ** min(depth), 9) AS score FROM w GROUP BY node""",
)
def _(t):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t("customer").select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst")).unionByName(t("orders").select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst")))
    e = e.unionByName(t("lineitem").select(key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst")).distinct()).withColumn("label", F.col("dst"))
    seed = t("nation").filter("n_nationkey = 3").select(key("n", "n_nationkey").alias("node"), F.array(key("n", "n_nationkey")).alias("path"), F.lit(1.0).alias("score"))
    return graph.expand(seed, e, 3, factor=0.5, least=0.1).select("node", "depth", F.round("score", 9).alias("score"))


def _tree(t) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    return (
        t("region").select(key("r", "r_regionkey").alias("node"), none.alias("parent")).unionByName(t("nation").select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent")))
        .unionByName(t("customer").select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("parent")))
    )


_TREE_SQL = "tree AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


@query("tree_ancestors", f"WITH {_TREE_SQL} SELECT a.node, concat_ws('.', a.parent, b.parent) AS above FROM tree a LEFT JOIN tree b ON a.parent = b.node")
def _(t):
    return graph.ancestors(_tree(t)).select("node", F.concat_ws(".", "above").alias("above"))


@query(
    "lowest_common_ancestor",
    """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT 'c' || x.k AS a, 'c' || y.k AS b, CASE WHEN x.k = y.k THEN 'c' || x.k WHEN x.n = y.n THEN 'n' || x.n WHEN x.r = y.r THEN 'r' || x.r END AS lca FROM c x JOIN c y ON y.k = (x.k * 7 + 3) % (SELECT count(*) FROM customer)""",
)
def _(t):
    n = t("customer").count()
    pairs = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("c"), ((F.col("c_custkey") * 7 + 3) % n).cast("string")).alias("b"))
    return graph.lowest_common_ancestor(pairs, graph.ancestors(_tree(t)))


@query("per_cpu_instances", "SELECT s_suppkey, n_nationkey AS cpu, s_suppkey * 64 + n_nationkey * 100000 AS address FROM supplier, nation WHERE n_nationkey < 4")
def _(t):
    cpus = t("nation").filter("n_nationkey < 4").select(F.col("n_nationkey").alias("cpu"), (F.col("n_nationkey") * 100000).alias("offset"))
    return graph.per_cpu(t("supplier").select("s_suppkey", (F.col("s_suppkey") * 64).alias("address")), cpus, "address").select("s_suppkey", "cpu", "address")


@query("subtype_resolution", "SELECT c_custkey, coalesce(s_name, c_mktsegment) AS type_id FROM customer LEFT JOIN supplier ON s_suppkey * 16 = c_custkey * 4")
def _(t):
    objects = t("customer").select("c_custkey", F.col("c_mktsegment").alias("type_id"), (F.col("c_custkey") * 4).alias("ops"))
    return graph.specialise(objects, t("supplier").select((F.col("s_suppkey") * 16).alias("address"), F.col("s_name").alias("special_type")), "ops").select("c_custkey", "type_id")


@query("module_rebase", "SELECT s_suppkey, s_suppkey * 8 + n_nationkey * 65536 AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0")
def _(t):
    v = t("supplier").select("s_suppkey", F.concat(F.lit("/lib/mod-"), F.col("s_nationkey").cast("string"), F.lit(".ko")).alias("orig_file"), F.lit(".data").alias("section"), (F.col("s_suppkey") * 8).alias("address"))
    m = t("nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("mod_"), F.col("n_nationkey").cast("string")).alias("module"))
    s = t("nation").select(F.concat(F.lit("mod_"), F.col("n_nationkey").cast("string")).alias("module"), F.lit(".data").alias("section"), (F.col("n_nationkey") * 65536).cast("bigint").alias("address"))
    return graph.rebase(v, m, s).select("s_suppkey", "address")


@query("watchers", f"WITH {OBJ_SQL} SELECT a.event_id, b.prob AS before, a.prob AS after FROM OBJ a JOIN (SELECT event_id - 1 AS event_id, prob FROM OBJ) b USING (event_id) WHERE abs(a.prob - b.prob) > 0.5")
def _(t):
    o = obj(t).select("event_id", "prob")
    return graph.watch(o.withColumn("event_id", F.col("event_id") - 1), o, "event_id", "prob", 0.5)


@query(
    "trace_fold_live",
    "SELECT user_id, CAST(sum(d) AS BIGINT) AS net, CASE sum(d) WHEN 1 THEN 'live' WHEN 0 THEN 'freed' ELSE 'anomaly' END AS state FROM (SELECT user_id, CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS d FROM events WHERE event_type IN ('signup', 'error')) GROUP BY user_id",
)
def _(t):
    e = t("events").filter(F.col("event_type").isin("signup", "error")).withColumn("d", F.when(F.col("event_type") == "signup", 1).otherwise(-1))
    return fold_trace(e, ["user_id"], "d")


@query("unsigned_order", f"WITH {OBJ_SQL}, x AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -event_id - 1 ELSE event_id END AS a FROM OBJ) SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id % 100 ORDER BY CASE WHEN a < 0 THEN 1 ELSE 0 END, a) AS INTEGER) AS rank FROM x")
def _(t):
    from pyspark.sql import Window

    a = F.when(F.col("event_id") % 2 == 0, -F.col("event_id") - 1).otherwise(F.col("event_id"))
    w = Window.partitionBy(F.col("event_id") % 100).orderBy(filters.unsigned_key(F.col("a")))
    return obj(t).select("event_id", a.alias("a")).withColumn("rank", F.row_number().over(w)).select("event_id", "rank")


# --- instances


_SAME = {"click": 0, "view": 0, "purchase": 1, "signup": 2, "error": 2}
_SAME_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _SAME.items())


@query("variables_of_type", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey % 7 IN (SELECT n_nationkey % 7 FROM nation WHERE n_regionkey = 2 AND n_nationkey < 12)")
def _(t):
    equal = t("nation").select(F.col("n_nationkey").alias("type_id"), (F.col("n_nationkey") % 7).alias("canon_id"))
    return instances.of_type(t("customer"), t("nation").filter("n_regionkey = 2 and n_nationkey < 12").select("n_nationkey"), equal, "c_nationkey").select("c_custkey", "c_name")


@query("instances_of_type", f"WITH {OBJ_SQL} SELECT event_id, addr FROM OBJ WHERE CASE kind {_SAME_SQL} END = 0")
def _(t):
    o = obj(t)
    kinds = o.sparkSession.createDataFrame(list(_SAME.items()), "type_id string, canon_id int")
    return instances.of_type(o, kinds.filter("type_id = 'view'").select("type_id"), kinds, "kind").select("event_id", "addr")


@query(
    "instance_filter",
    """SELECT o_orderkey FROM (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey * 2 END AS id FROM orders) o LEFT JOIN customer ON id > 0 AND id = c_custkey
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (c_custkey IS NULL OR c_mktsegment = 'BUILDING')""",
)
def _(t):
    found = t("orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey") * 2).alias("id"))
    return instances.matching(found, t("customer"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("c_mktsegment") == "BUILDING", "id", "c_custkey").select("o_orderkey")


@query(
    "new_nodes",
    f"""WITH {OBJ_SQL}, c AS (SELECT event_id, addr + (event_id % 5) * 8 AS s, addr + (event_id % 5) * 8 + 15 AS e, kind, kind = 'error' AS f FROM OBJ WHERE event_id % 3 = 0), k AS (SELECT addr AS s, end_ AS e, kind, kind = 'error' AS f FROM OBJ WHERE event_id % 3 <> 2)
    SELECT event_id FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.s <= c.s AND k.e >= c.e AND k.kind = c.kind) AND NOT EXISTS (SELECT 1 FROM k WHERE k.s <= c.e AND k.e >= c.s AND k.f AND c.f)""",
)
def _(t):
    o = obj(t).withColumn("is_function", F.col("kind") == "error")
    c = o.filter("event_id % 3 = 0").select("event_id", (F.col("addr") + (F.col("event_id") % 5) * 8).alias("start"), F.col("kind").alias("type"), "is_function").withColumn("end", F.col("start") + 15)
    k = o.filter("event_id % 3 <> 2").select(F.col("addr").alias("start"), F.col("end_").alias("end"), F.col("kind").alias("type"), "is_function")
    return instances.new_nodes(c, k, "event_id", WIDTH).select("event_id")


@query(
    "member_expansion",
    """WITH n AS (SELECT o_orderkey AS node, o_orderkey * 1000 AS address, o_orderpriority AS ty FROM orders), p AS (SELECT l_orderkey * 1000 + 16 AS address, min(l_partkey) * 64 AS value FROM lineitem GROUP BY l_orderkey UNION ALL SELECT l_orderkey * 1000 + 24, CASE WHEN min(l_suppkey) % 5 = 0 THEN 0 ELSE min(l_suppkey) * 64 END FROM lineitem GROUP BY l_orderkey),
    r AS (SELECT node, 'ptr' AS member, 0 AS place, node AS child_address, 'ruled' AS child_type, 'object' AS child_kind FROM n WHERE ty = '2-HIGH' AND node % 10 = 0)
    SELECT node, 'inl' AS member, 0 AS place, address + 8 AS child_address, 'inner' AS child_type, 'object' AS child_kind FROM n WHERE ty = '1-URGENT'
    UNION ALL SELECT node, 'arr', CAST(i AS INTEGER), address + 32 + i * 8, 'elem', 'object' FROM n, range(3) x(i) WHERE ty = '1-URGENT'
    UNION ALL SELECT node, 'ptr', 0, value, 'target', 'object' FROM n JOIN p ON p.address = n.address + 16 WHERE ty = '2-HIGH' AND value <> 0 AND node % 10 <> 0
    UNION ALL SELECT node, 'fn', 0, value, 'code', 'function' FROM n JOIN p ON p.address = n.address + 24 WHERE ty = '3-MEDIUM' AND value <> 0
    UNION ALL SELECT * FROM r""",
)
def _(t):
    nodes = t("orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("type_id"), (F.col("o_orderkey") * 1000).alias("address"))
    members = nodes.sparkSession.createDataFrame(
        [("1-URGENT", "inl", 8, "Struct", "inner", 16, 1), ("1-URGENT", "arr", 32, "Array", "elem", 8, 3), ("2-HIGH", "ptr", 16, "Pointer", "target", 8, 1), ("3-MEDIUM", "fn", 24, "FuncPointer", "code", 8, 1)],
        "type_id string, member string, offset long, kind string, ref_type string, size long, length int",
    )
    held = t("lineitem").groupBy("l_orderkey").agg((F.min("l_partkey") * 64).alias("p"), F.min("l_suppkey").alias("s"))
    at = lambda d: (F.col("l_orderkey") * 1000 + d).alias("address")
    pointers = held.select(at(16), F.col("p").alias("value")).unionByName(held.select(at(24), F.when(F.col("s") % 5 == 0, F.lit(0)).otherwise(F.col("s") * 64).alias("value")))
    ruled = nodes.filter("type_id = '2-HIGH' and node % 10 = 0").select("node", F.lit("ptr").alias("member"), F.col("node").alias("child_address"), F.lit("ruled").alias("child_type"))
    return instances.members_by_kind(nodes, members, pointers, ruled).select("node", "member", "place", "child_address", "child_type", "child_kind")


@query("list_instances", "SELECT o_custkey, CAST(row_number() OVER w - 1 AS INTEGER) AS place, o_orderkey AS item, lead(o_orderkey) OVER w AS list_next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _(t):
    lists = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("items"))  # one customer's orders
    return instances.list_elements(lists, "items").select("o_custkey", "place", "item", "list_next")


@query(
    "show_symbols",
    """SELECT r_name AS name, (SELECT string_agg(n_name, ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS members,
    concat_ws(',', CASE WHEN regexp_full_match(r_name, '.*A') THEN 'ends' END, CASE WHEN regexp_full_match(r_name, 'A.*') THEN 'starts' END) AS rules FROM region WHERE r_regionkey <= 3""",
)
def _(t):
    types = t("region").select(F.col("r_regionkey").alias("type_id"), F.col("r_name").alias("name"))
    members = t("nation").select(F.col("n_regionkey").alias("type_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("offset"))
    found = instances.shown(types, members, types.sparkSession.createDataFrame([("ends", ".*A"), ("starts", "A.*")], "rule string, pattern string"), F.col("type_id") <= 3)
    return found.select("name", F.array_join(F.transform("members", lambda m: m["name"]), ",").alias("members"), F.coalesce(F.array_join("rules", ","), F.lit("")).alias("rules"))


@query(
    "instance_methods",
    f"""WITH {OBJ_SQL}, x AS (SELECT event_id, addr * 1048576 + size AS a, size FROM OBJ) SELECT event_id, a + 4294967295 AS moved, a // 4294967296 AS high, a % 4294967296 AS low, a + size * 3 AS third,
    CAST(sign(event_id % 1000 - 500) AS INTEGER) AS side, event_id % 4 <> 0 AND a <> 0 AS valid FROM x""",
)
def _(t):
    a = F.col("addr") * 1048576 + F.col("size")
    rows = obj(t).select("event_id", a.alias("a"), "size", F.when(F.col("event_id") % 4 != 0, F.col("kind")).alias("type_id"))
    i = instances
    return rows.select("event_id", i.moved(F.col("a"), 4294967295).alias("moved"), i.high_word(F.col("a")).alias("high"), i.low_word(F.col("a")).alias("low"), i.element(F.col("a"), F.col("size"), F.lit(3)).alias("third"), i.compared(F.col("event_id") % 1000, F.lit(500)).alias("side"), i.is_valid(F.col("a"), F.col("type_id")).alias("valid"))


@query(
    "allocation_verdicts",
    f"""WITH {OBJ_SQL}, {_LOG_SQL}, g AS (SELECT event_id*64 AS address, event_type AS type FROM events WHERE event_id % 10 = 3), best AS (SELECT event_id, addr, max(slot) AS slot FROM OBJ JOIN alloc ON slot <= addr GROUP BY ALL),
    hit AS (SELECT b.event_id, b.slot, slot_size, slot_type FROM best b JOIN alloc USING (slot) WHERE addr < slot + slot_size)
    SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'invalid' WHEN slot IS NULL AND kind NOT IN (SELECT slot_type FROM alloc WHERE slot_type IS NOT NULL AND slot_type <> 'error') AND kind = 'error' THEN 'no_slab_type'
    WHEN slot IS NULL AND EXISTS (SELECT 1 FROM g WHERE address = addr AND type = kind) THEN 'valid_global' WHEN slot IS NULL THEN 'not_found' WHEN slot_type IS NULL THEN 'maybe' WHEN addr = slot AND kind = slot_type THEN 'valid'
    WHEN addr = slot AND slot_type = 'view' AND kind = 'click' THEN 'valid_cast' WHEN addr + size <= slot + slot_size THEN 'embedded' ELSE 'conflict' END AS verdict FROM
    (SELECT event_id, addr, size, CASE WHEN event_id % 8 = 0 AND kind = 'view' THEN 'click' ELSE kind END AS kind FROM OBJ) LEFT JOIN (SELECT event_id, slot, slot_size, CASE WHEN slot_type = 'error' THEN NULL ELSE slot_type END AS slot_type FROM hit) USING (event_id)""",
)
def _(t):
    o = obj(t).withColumn("kind", F.when((F.col("event_id") % 8 == 0) & (F.col("kind") == "view"), "click").otherwise(F.col("kind")))
    log = _log(t).withColumn("slot_type", F.when(F.col("slot_type") != "error", F.col("slot_type")))
    g = t("events").filter("event_id % 10 = 3").select((F.col("event_id") * 64).alias("address"), F.col("event_type").alias("type"))
    casts = o.sparkSession.createDataFrame([("view", "click")], "slot_type string, type string")
    return validate.allocation_verdict(o, log, g, casts, "addr", "size", "kind", 8192, F.col("event_id") % 11 != 0).select("event_id", "verdict")


@query(
    "expr_guarded",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size + 3 AS BIGINT) WHEN p_partkey % 2 = 1 THEN CAST(p_partkey * 2 AS BIGINT) END AS picked, CAST(p_size + 1 AS BIGINT) AS up, CAST(16 + p_size AS BIGINT) AS member, CAST(CASE WHEN p_size % 3 = 0 THEN 7 ELSE -2 END AS BIGINT) AS named FROM part""",
)
def _(t):
    names = {"p_size": (F.col("p_size").cast("bigint"), "i32"), "key": (F.col("p_partkey"), "i64"), **expr.enumerators({"RED": 7, "BLUE": -2, "THREE": 3})}
    picked, _ = expr.guarded([("p_size > 25", "p_size + THREE"), ("key % 2 == 1", "key * 2")], names)
    at = lambda text: expr.compile_expr(text, names, offsets=lambda ty, path: {("task", "list.next"): 16}.get((ty, path), -1))[0]
    return t("part").select("p_partkey", picked.alias("picked"), at("++p_size").alias("up"), at("offsetof(struct task, list.next) + p_size").alias("member"), at("p_size % THREE == 0 ? RED : BLUE").alias("named"))


# --- ranges from cells, exclusions, deep trees, the reverse map, recursive differences, rules by index, debug records


@query(
    "range_summary",
    f"""WITH {OBJ_SQL}, top AS (SELECT max(end_) + 1 AS m FROM OBJ), r AS (SELECT o_orderkey AS rid, o_orderkey * 7919 % m AS lo, o_orderkey * 7919 % m + o_custkey * 331 % 20000 AS hi FROM orders, top)
    SELECT rid, CAST(count(*) AS BIGINT) AS n, min(prob) AS min_prob, max(prob) AS max_prob, CAST(bit_or(bits) AS INTEGER) AS kinds, CAST(sum(size) AS BIGINT) AS bytes FROM r JOIN OBJ ON addr <= hi AND end_ >= lo GROUP BY rid""",
)
def _(t):
    o = obj(t)
    top = (o.agg(F.max("end_")).first()[0] or 0) + 1
    low = F.col("o_orderkey") * 7919 % top
    ranges = t("orders").select(F.col("o_orderkey").alias("rid"), low.alias("lo"), (low + F.col("o_custkey") * 331 % 20000).alias("hi"))
    size = lambda f: f.cast("bigint").alias("bytes")
    made = dyadic.RangeSummaries(o, "addr", "end_", [*intervals.summary("prob", "bits"), size(F.sum("size"))], [*intervals.merged_summary(), size(F.sum("bytes"))])
    return made.of_ranges(ranges, "rid", "lo", "hi")


@query(
    "point_summary",
    f"""WITH {OBJ_SQL} SELECT l_orderkey AS pid, CAST(count(*) AS BIGINT) AS n, min(prob) AS min_prob, max(prob) AS max_prob, CAST(bit_or(bits) AS INTEGER) AS kinds
    FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN OBJ ON l_orderkey * 43 BETWEEN addr AND end_ GROUP BY l_orderkey""",
)
def _(t):
    points = t("lineitem").select(F.col("l_orderkey").alias("pid"), (F.col("l_orderkey") * 43).alias("at")).distinct()
    return dyadic.RangeSummaries(obj(t), "addr", "end_", intervals.summary("prob", "bits"), intervals.merged_summary()).at_points(points, "pid", "at")


@query(
    "changed_without_patches",
    """WITH r AS (SELECT o_orderkey, o_orderkey * 50 AS s, o_orderkey * 50 + 20 + o_custkey % 60 AS e FROM orders), x AS (SELECT l_partkey * 37 + l_orderkey * 11 AS xs, l_partkey * 37 + l_orderkey * 11 + l_linenumber * 9 AS xe FROM lineitem WHERE l_returnflag = 'R'),
    m AS (SELECT *, max(xe) OVER (ORDER BY xs, xe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR xs > reach + 1 THEN 1 ELSE 0 END) OVER (ORDER BY xs, xe ROWS UNBOUNDED PRECEDING) AS g FROM m),
    d AS (SELECT min(xs) AS xs, max(xe) AS xe FROM i GROUP BY g), gaps AS (SELECT xe + 1 AS gs, coalesce(lead(xs) OVER (ORDER BY xs), 1125899906842624) - 1 AS ge FROM d UNION ALL SELECT -1, coalesce(min(xs), 1125899906842624) - 1 FROM d)
    SELECT o_orderkey, greatest(s, gs) AS s, least(e, ge) AS e FROM r JOIN gaps ON gs <= e AND ge >= s""",
)
def _(t):
    runs = t("orders").select("o_orderkey", (F.col("o_orderkey") * 50).alias("s"), (F.col("o_orderkey") * 50 + 20 + F.col("o_custkey") % 60).alias("e"))
    start = F.col("l_partkey") * 37 + F.col("l_orderkey") * 11
    patches = t("lineitem").filter("l_returnflag = 'R'").select(start.alias("xs"), (start + F.col("l_linenumber") * 9).alias("xe"))
    return intervals.subtract(runs, "s", "e", patches, "xs", "xe", 64)


@query(
    "type_relations",
    f"""WITH {OBJ_SQL}, p AS (SELECT a.event_id, a.kind AS ka, b.kind AS kb, a.addr AS s, a.end_ AS e, b.addr AS x, b.end_ AS y FROM OBJ a JOIN OBJ b ON b.addr <= a.end_ AND b.end_ >= a.addr AND a.event_id <> b.event_id),
    h AS (SELECT *, ka = 'click' AND kb = 'view' AS f, kb = 'click' AND ka = 'view' AS g FROM p)
    SELECT v, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN NOT ((s <= x AND e >= y) OR (x <= s AND y >= e)) THEN 'overlap' WHEN s = x AND e = y AND ka = kb THEN 'equal' WHEN s <= x AND e >= y AND f THEN 'first_embeds' WHEN x <= s AND y >= e AND g THEN 'second_embeds' ELSE 'cover' END AS v FROM h) GROUP BY v""",
)
def _(t):
    a = obj(t).select("event_id", "kind", "addr", "end_")
    b = a.select(F.col("event_id").alias("other"), F.col("kind").alias("k"), F.col("addr").alias("x"), F.col("end_").alias("y"))
    met = intervals.overlap_join(a, b, "addr", "end_", "x", "y", WIDTH).filter("event_id <> other")
    holds = lambda outer, inner: (F.col(outer) == "click") & (F.col(inner) == "view")
    said = intervals.type_relation(intervals.relation(F.col("addr"), F.col("end_"), F.col("x"), F.col("y")), F.col("kind") == F.col("k"), holds("kind", "k"), holds("k", "kind"))
    return met.groupBy(said.alias("v")).agg(F.count("*").alias("n"))


_CHAIN_SQL = "chain AS (SELECT c_custkey AS node, CASE WHEN c_custkey >= 40 THEN c_custkey - 40 WHEN c_custkey > 0 THEN (c_custkey - 1) // 3 END AS parent FROM customer)"


def _chains(t) -> DataFrame:
    """A tree of customers: bushy at the root, with 40 long branches."""
    k = F.col("c_custkey")
    return t("customer").select(k.alias("node"), F.when(k >= 40, k - 40).when(k > 0, F.floor((k - 1) / 3)).alias("parent"))


@query("tree_depths", f"WITH RECURSIVE {_CHAIN_SQL}, d AS (SELECT node, 0 AS depth FROM chain WHERE parent IS NULL UNION ALL SELECT c.node, d.depth + 1 FROM d JOIN chain c ON c.parent = d.node) SELECT node, CAST(depth AS BIGINT) AS depth FROM d")
def _(t):
    return graph.Jumps(_chains(t)).depths


@query(
    "deep_common_ancestor",
    f"""WITH RECURSIVE {_CHAIN_SQL}, u AS (SELECT node, node AS up, 0 AS d FROM chain UNION ALL SELECT u.node, c.parent, u.d + 1 FROM u JOIN chain c ON c.node = u.up WHERE c.parent IS NOT NULL), p AS (SELECT c_custkey AS a, (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS b FROM customer)
    SELECT a, b, CAST(arg_min(x.up, x.d) AS VARCHAR) AS lca FROM p JOIN u x ON x.node = a JOIN u y ON y.node = b AND y.up = x.up GROUP BY a, b""",
)
def _(t):
    n = t("customer").count()
    text = _chains(t).select(F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"))
    return graph.lowest_common_ancestor(t("customer").select(F.col("c_custkey").alias("a"), ((F.col("c_custkey") * 7 + 3) % n).alias("b")), graph.Jumps(text))


@query(
    "tree_in_lines",
    f"""WITH RECURSIVE {_CHAIN_SQL}, d AS (SELECT node, lpad(node::VARCHAR, 8, '0') AS path FROM chain WHERE parent IS NULL UNION ALL SELECT c.node, d.path || lpad(c.node::VARCHAR, 8, '0') FROM d JOIN chain c ON c.parent = d.node)
    SELECT node, CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS place, repeat('  ', CAST(length(path) // 8 - 1 AS INTEGER)) || node AS line FROM d""",
)
def _(t):
    return memory.tree_dump(_chains(t), "node").select("node", "place", "line")


_KEYED_SQL = "keyed AS (SELECT c_custkey + 1 AS node, CASE WHEN c_custkey < 31 THEN 2 * (c_custkey + 1) WHEN c_custkey % 2 = 0 THEN c_custkey + 1 + 32 END AS lft, CASE WHEN c_custkey < 31 THEN 2 * (c_custkey + 1) + 1 WHEN c_custkey % 2 = 1 THEN c_custkey + 1 + 32 END AS rgt FROM customer)"


@query(
    "keyed_tree_in_order",
    f"""WITH RECURSIVE {_KEYED_SQL}, d AS (SELECT node, lft, rgt, '' AS path FROM keyed WHERE node = 1 UNION ALL SELECT k.node, k.lft, k.rgt, d.path || CASE WHEN k.node = d.lft THEN 'a' ELSE 'c' END FROM d JOIN keyed k ON k.node = d.lft OR k.node = d.rgt)
    SELECT node, CAST(row_number() OVER (ORDER BY path || 'b') - 1 AS BIGINT) AS place FROM d""",
)
def _(t):
    k = F.col("c_custkey")
    node, long = k + 1, k + 33
    nodes = t("customer").select(node.alias("node"), F.when(k < 31, 2 * node).when(k % 2 == 0, long).alias("left"), F.when(k < 31, 2 * node + 1).when(k % 2 == 1, long).alias("right"))
    return trees.in_order(nodes).filter("root = 1").select("node", "place")


@query(
    "hash_chains",
    """WITH r AS (SELECT o_orderkey AS node, o_orderkey % 97 AS head, row_number() OVER (PARTITION BY o_orderkey % 97 ORDER BY o_orderkey) - 1 AS place FROM orders)
    SELECT -1 - head AS head, node, CAST(place AS BIGINT) AS place, NOT (place > 0 AND node % 13 = 0) AS linked FROM r""",
)
def _(t):
    rows = graph.neighbours_window(t("orders").select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 97).alias("head")), "head", "node")
    owner = -1 - F.col("head")
    pprev = F.when(F.col("prev").isNull(), owner).when(F.col("node") % 13 == 0, F.lit(-1000)).otherwise(F.col("prev") + 8)
    return trees.hash_chains(rows.filter("prev is null").select(owner.alias("head"), F.col("node").alias("first")), rows.select("node", "next", pprev.alias("pprev")), next_offset=8)


@query(
    "settled_probabilities",
    """WITH n AS (SELECT o_orderkey AS id, 0.5 + o_custkey % 50 / 101.0::DOUBLE AS i, CASE WHEN o_custkey % 5 = 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS f FROM orders), e AS (SELECT (o_orderkey - 1) // 4 AS parent, o_orderkey AS child FROM orders WHERE o_orderkey > 0),
    p0 AS (SELECT id, least(1.0::DOUBLE, i * f) AS p FROM n)
    """ + "".join(f""", p{k} AS (SELECT n.id, least(1.0::DOUBLE, i * coalesce(u.p, 1.0::DOUBLE) * coalesce(d.p, 1.0::DOUBLE) * f) AS p FROM n LEFT JOIN (SELECT child AS id, max(p) AS p FROM e JOIN p{k - 1} ON id = parent GROUP BY child) u USING (id) LEFT JOIN (SELECT parent AS id, avg(p) AS p FROM e JOIN p{k - 1} ON id = child GROUP BY parent) d USING (id))""" for k in range(1, 4)) + " SELECT id, round(p, 6) AS p FROM p3",
)
def _(t):
    nodes = t("orders").select(F.col("o_orderkey").alias("id"), (0.5 + F.col("o_custkey") % 50 / 101.0).alias("initial"), F.when(F.col("o_custkey") % 5 == 0, 2).otherwise(1).alias("encounters"))
    edges = t("orders").filter("o_orderkey > 0").select(F.floor((F.col("o_orderkey") - 1) / 4).alias("parent"), F.col("o_orderkey").alias("child"))
    return graph.fixed_point(nodes, edges, rounds=3).select("id", F.round("p", 6).alias("p"))


_MAP_LEAST, _MAP_STEPS = 0.45, 6


def _map_sql() -> str:
    """The reverse map by buckets, written out: what is in a bucket comes from the seeds, from better buckets, or from itself."""
    fate = lambda s, p, x: f"NOT EXISTS (SELECT 1 FROM {s} z WHERE z.p > {p} + 0.1 AND z.a <= {x}.a + {x}.size - 1 AND z.a + z.size - 1 >= {x}.a) AND NOT EXISTS (SELECT 1 FROM {s} z WHERE z.i = {x}.i AND z.ty = {x}.ty)"
    parts = []
    for b in range(_MAP_STEPS):
        high, low, s = 1 - b * 0.1, max(1 - (b + 1) * 0.1, _MAP_LEAST), f"s{b}"
        inside = lambda p: f"{p} > {low}::DOUBLE AND {p} <= {high}::DOUBLE"  # noqa: B023, E731
        parts.append(f"""b{b} AS (SELECT x.i, x.ty, x.p FROM (SELECT f.*, sp * f / (1 - 1e-5::DOUBLE) AS p FROM seeds JOIN f USING (i, ty) UNION SELECT f.*, z.p * f AS p FROM {s} z JOIN e ON e.i = z.i AND e.ty = z.ty JOIN f ON f.i = e.di AND f.ty = e.dty) x WHERE {inside("x.p")} AND {fate(s, "x.p", "x")}
          UNION SELECT f.i, f.ty, r.p * f.f FROM b{b} r JOIN e ON e.i = r.i AND e.ty = r.ty JOIN f ON f.i = e.di AND f.ty = e.dty WHERE {inside("r.p * f.f")} AND {fate(s, "r.p * f.f", "f")})""")
        parts.append(f"s{b + 1} AS MATERIALIZED (SELECT i, ty, p, a, size FROM {s} UNION ALL SELECT i, ty, max(p), min(a), min(size) FROM b{b} JOIN f USING (i, ty) GROUP BY i, ty)")
    return f"""WITH RECURSIVE o AS (SELECT c_custkey AS i, count(*) OVER () AS n FROM customer), k AS (SELECT i, ty, 2000 + 24 * i AS a, CASE ty WHEN 'A' THEN 40 ELSE 16 END AS size, n FROM o, (VALUES ('A'), ('B')) v(ty)),
    e AS MATERIALIZED (SELECT i, ty, di, dty FROM (SELECT i, ty, n, CASE ty WHEN 'A' THEN unnest([9 * i, 9 * i + 1, 13 * i]) ELSE unnest([9 * i, NULL, NULL]) END AS di, CASE ty WHEN 'A' THEN unnest(['B', 'A', 'A']) ELSE 'A' END AS dty FROM k) WHERE i > 0 AND di < n),
    h AS (SELECT i, ty, avg(CASE WHEN di % 9 <> 4 THEN 1.0 ELSE 0.0 END) AS share FROM e GROUP BY i, ty),
    f AS MATERIALIZED (SELECT i, ty, a, size, (1 - 1e-5::DOUBLE) * CASE WHEN i % 9 <> 4 THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END * CASE WHEN i % 4 <> 1 OR i = 1 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END * ((1 - coalesce(share, 1.0::DOUBLE)) * 0.2::DOUBLE + (1 - (1 - coalesce(share, 1.0::DOUBLE)))) AS f FROM k LEFT JOIN h USING (i, ty)),
    seeds AS (SELECT i, 'A' AS ty, 1.0::DOUBLE AS sp FROM o WHERE i = 1 UNION ALL SELECT i, 'B', 0.85::DOUBLE FROM o WHERE i % 31 = 3 UNION ALL SELECT i, 'A', 0.62::DOUBLE FROM o WHERE i % 17 = 4),
    s0 AS (SELECT i, ty, 0.0::DOUBLE AS p, a, size FROM f WHERE FALSE), {", ".join(parts)}
    SELECT a AS address, a + size - 1 AS end_, ty AS type_id, round(p, 9) AS prob FROM s{_MAP_STEPS}"""


@query("reverse_map", _map_sql())
def _(t):
    n = t("customer").count()
    spark = t("customer").sparkSession
    i, at = F.col("c_custkey"), (lambda c: c * 24 + 2000)
    aim = lambda offset, to: t("customer").filter(i > 0).select((at(i) + offset).alias("address"), F.when(to < n, at(to)).otherwise(0).alias("value"))
    pointers = aim(0, 9 * i).unionByName(aim(8, 9 * i + 1)).unionByName(aim(16, 13 * i))
    members = spark.createDataFrame([("A", "b", 0, "Pointer", "B", 8, 1), ("A", "next", 8, "Pointer", "A", 8, 1), ("A", "far", 16, "Pointer", "A", 8, 1), ("B", "a", 0, "Pointer", "A", 8, 1)], "type_id string, member string, offset long, kind string, ref_type string, size long, length int")
    k = (F.col("address") - 2000) / 24
    seed = lambda kind, p, test: t("customer").filter(test).select(at(i).alias("address"), F.lit(kind).alias("type_id"), F.lit(p).alias("prob"))
    seeds = seed("A", 1.0, i == 1).unionByName(seed("B", 0.85, i % 31 == 3)).unionByName(seed("A", 0.62, i % 17 == 4))
    build = revmap.ReverseMap(
        spark.createDataFrame([("A", 40), ("B", 16)], "type_id string, size long"), members, pointers, lambda d: d.withColumn("valid", k % 9 != 4), lambda d: d.withColumn("magic_ok", (k % 4 != 1) | (k == 1)),
        gap=0.1, least=_MAP_LEAST, width=WIDTH,
    )
    return build.build(seeds).select("address", F.col("end").alias("end_"), "type_id", F.round("prob", 9).alias("prob"))


@query("slab_map", f"WITH {OBJ_SQL} SELECT DISTINCT addr || ':' || kind AS node, addr AS address, end_, kind AS type_id FROM OBJ")
def _(t):
    return revmap.slab_map(obj(t).select(F.col("addr").alias("slot"), F.col("size").alias("slot_size"), F.col("kind").alias("slot_type"))).select("node", "address", F.col("end").alias("end_"), "type_id")


@query(
    "recursive_difference",
    """WITH w AS (SELECT o_orderkey AS k, o_orderstatus, o_orderpriority, c_mktsegment, n_nationkey, n_name, r_regionkey, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    p AS (SELECT a.k, a, b FROM w a JOIN w b ON b.k = a.k + 1)
    SELECT k AS root, 'status' AS path FROM p WHERE a.o_orderstatus <> b.o_orderstatus UNION ALL SELECT k, 'priority' FROM p WHERE a.o_orderpriority <> b.o_orderpriority UNION ALL SELECT k, 'cust.segment' FROM p WHERE a.c_mktsegment <> b.c_mktsegment
    UNION ALL SELECT k, 'cust.nation.name' FROM p WHERE a.n_name <> b.n_name UNION ALL SELECT k, 'cust.nation.region.name' FROM p WHERE a.r_name <> b.r_name""",
)
def _(t):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    value = lambda table, o, field, c: t(table).select(o.alias("object"), F.lit(field).alias("field"), F.col(c).alias("value"))
    link = lambda table, o, field, c: t(table).select(o.alias("object"), F.lit(field).alias("field"), c.alias("target"))
    o, c, n, r = key("o", "o_orderkey"), key("c", "c_custkey"), key("n", "n_nationkey"), key("r", "r_regionkey")
    values = value("orders", o, "status", "o_orderstatus").unionByName(value("orders", o, "priority", "o_orderpriority")).unionByName(value("customer", c, "segment", "c_mktsegment")).unionByName(value("nation", n, "name", "n_name")).unionByName(value("region", r, "name", "r_name"))
    back = link("region", r, "largest", key("r", "r_regionkey"))  # regions name themselves, a circle
    links = link("orders", o, "cust", key("c", "o_custkey")).unionByName(link("customer", c, "nation", key("n", "c_nationkey"))).unionByName(link("nation", n, "region", key("r", "n_regionkey"))).unionByName(back)
    last = t("orders").agg(F.max("o_orderkey")).first()[0] or 0
    pairs = t("orders").filter(F.col("o_orderkey") < last).select(F.col("o_orderkey").alias("root"), o.alias("a"), F.concat(F.lit("o"), (F.col("o_orderkey") + 1).cast("string")).alias("b"))
    return diff.recursive_diff(pairs, values, values, links, links)


def _name_rules() -> list[str]:
    """A thousand patterns over customers' names."""
    return [(f"Customer#{i * 7:09d}", f"*{i:04d}", f"customer#*{i % 100:02d}?{i % 10}*")[i % 3] for i in range(1000)]


@query(
    "rule_index",
    """WITH p AS (SELECT i AS rule_no, CASE i % 3 WHEN 0 THEN '^customer#' || lpad((i * 7)::VARCHAR, 9, '0') || '$' WHEN 1 THEN lpad(i::VARCHAR, 4, '0') || '$' ELSE '^customer#.*' || lpad((i % 100)::VARCHAR, 2, '0') || '.' || i % 10 END AS re FROM range(1000) r(i))
    SELECT c_custkey, CAST(rule_no AS INTEGER) AS rule_no FROM customer JOIN p ON regexp_matches(lower(c_name), re)""",
)
def _(t):
    names = t("customer").select("c_custkey", "c_name")
    return rules.RuleIndex(names.sparkSession, _name_rules()).tuned(names, "c_name").candidates(names, "c_name").select("c_custkey", "rule_no")


@rules.action("same")
def _same(at: Column) -> Column:
    """The member itself."""
    return at


@rules.action("even_half")
def _even_half(at: Column) -> Column:
    """Half of an even address; odd ones lead nowhere."""
    return F.when(at % 2 == 0, F.floor(at / 2))


@query(
    "rule_engine",
    """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) * 7 + 100000001 AS part FROM lineitem GROUP BY 1, 2), x AS (SELECT 'order_' || lower(o_orderstatus) AS ty, o_orderkey * 1000 AS a, l.n, l.part FROM orders JOIN l ON l.o = o_orderkey),
    g0 AS (SELECT ty, a, 'line' || n AS path, CASE WHEN ty = 'order_f' AND n = 1 THEN 'first' ELSE 'any_line' END AS rule_name, CASE WHEN ty = 'order_f' AND n = 1 THEN 'head' ELSE 'line' END AS target_type, a + n AS result, 0 AS generation FROM x
      UNION ALL SELECT ty, a, 'line2.part', 'part', 'part', part, 0 FROM x WHERE n = 2),
    g1 AS (SELECT DISTINCT 'part' AS ty, result AS a, '' AS path, 'halved' AS rule_name, 'half' AS target_type, result // 2 AS result, 1 AS generation FROM g0 WHERE target_type = 'part' AND result % 2 = 0),
    g2 AS (SELECT DISTINCT 'half', result, '', 'halved_again', 'quarter', result // 2, 2 FROM g1 WHERE result % 2 = 0)
    SELECT ty AS type_name, a AS address, path, rule_name, target_type, result, CAST(generation AS INTEGER) AS generation FROM (FROM g0 UNION ALL FROM g1 UNION ALL FROM g2)""",
)
def _(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg((F.min("l_partkey") * 7 + 100_000_001).alias("part"))
    lines = cut(lines.select((F.col("o") * 1000).alias("_own"), (F.col("o") * 1000 + F.col("n")).alias("_at"), "n", "part"))

    def extend(df: DataFrame) -> DataFrame:
        """An order's members are its lines, a line's member is its part."""
        if not df.limit(1).filter(F.size("path") < 2).count():  # all of one length
            return df.limit(0)
        if df.limit(1).filter(F.size("path") == 1).count():
            return df.join(lines, F.col("at") == F.col("_at")).select("type_name", "address", F.concat("path", F.array(F.lit("part"))).alias("path"), F.col("part").alias("at"))
        return df.join(lines, F.col("at") == F.col("_own")).select("type_name", "address", F.concat("path", F.array(F.concat(F.lit("line"), F.col("n").cast("string")))).alias("path"), F.col("_at").alias("at"))

    known = [
        rules.PathRule("first", "order_f", ["line1"], "same", "head", 2), rules.PathRule("any_line", "order_?", ["line*"], "same", "line", 1), rules.PathRule("part", "order_*", ["line2", "part"], "same", "part", 5),
        rules.PathRule("weak_part", "order_*", ["line3", "part"], "same", "weak", 1), rules.PathRule("halved", "part", [], "even_half", "half"), rules.PathRule("halved_again", "half", [], "even_half", "quarter"),
    ]
    orders = t("orders").select(F.concat(F.lit("order_"), F.lower("o_orderstatus")).alias("type_name"), (F.col("o_orderkey") * 1000).alias("address"))
    return rules.RuleEngine(known, extend).evaluate(orders).select("type_name", "address", F.array_join("path", ".").alias("path"), "rule_name", "target_type", "result", F.col("generation").cast("int").alias("generation"))


@query(
    "debug_members",
    """SELECT l_orderkey * 16 AS struct_id, l_orderkey * 16 + l_linenumber AS idx, 'line' || l_linenumber AS name, min(l_partkey) AS ref_type_id, CAST(l_linenumber * 8 AS BIGINT) AS offset_ FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey, l_linenumber""",
)
def _(t):
    hexed = lambda c: F.lower(F.hex(c))
    head = lambda depth, c, tag: F.concat(F.lit(f" <{depth}><"), hexed(c), F.lit(f">: Abbrev Number: 2 (DW_TAG_{tag})"))
    line = lambda df, at, *texts: df.select(F.explode(F.arrays_zip(F.array(*[at + k for k in range(len(texts))]).alias("line_no"), F.array(*texts).alias("line"))).alias("x")).select("x.*")
    o, m = F.col("o_orderkey"), F.col("l_orderkey") * 16 + F.col("l_linenumber")
    structs = line(t("orders"), o * 100, head(1, o * 16, "structure_type"), F.concat(F.lit("    <0>   DW_AT_name : order"), o.cast("string")))
    held = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).join(t("orders").select(o.alias("l_orderkey")), "l_orderkey", "left_semi")
    members = line(
        held, F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10, head(2, m, "member"), F.concat(F.lit("    <0>   DW_AT_name : line"), F.col("l_linenumber").cast("string")), F.concat(F.lit("    <0>   DW_AT_type : <0x"), hexed("p"), F.lit(">")),
        F.concat(F.lit("    <0>   DW_AT_data_member_location: 2 byte block: 23 8 (DW_OP_plus_uconst: "), (F.col("l_linenumber") * 8).cast("string"), F.lit(")")),
    )
    listing = structs.unionByName(members).withColumns({"file": F.lit("listing"), "split": F.floor(F.col("line_no") / 7321)})
    made = text_source.typed_rows(text_source.debug_records(listing, split="split"))["members"]
    return made.select("struct_id", "idx", "name", "ref_type_id", F.col("offset").alias("offset_"))


@query(
    "instance_checks",
    f"""WITH {OBJ_SQL} SELECT event_id, CASE WHEN kind IN ('click', 'view') THEN 'valid' END AS slab, CASE WHEN event_id % 3 <> 0 THEN size < 100 END AS magic, CASE WHEN prob > 0.5 THEN prob END AS prob FROM OBJ""",
)
def _(t):
    o = obj(t)
    slab = o.select("event_id", F.when(F.col("kind").isin("click", "view"), "valid").alias("slab"))
    magic = o.filter("event_id % 3 <> 0").select("event_id", (F.col("size") < 100).alias("magic"))
    return validate.verify_instance(slab, magic, o.filter("prob > 0.5").select("event_id", "prob"), "event_id")


@query(
    "function_pointers",
    """SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN l_suppkey % 7 <> 0 AND EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey // 2 AND p_size % 3 <> 0 AND p_size % 5 <> 0) AND l_partkey > 1 THEN 1 ELSE 0 END) AS BIGINT) AS callable FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)
def _(t):
    pages = t("part").select(F.col("p_partkey").alias("frame"), (F.col("p_size") % 3 != 0).alias("present"), (F.col("p_size") % 5 == 0).alias("nx"))
    aimed = F.when(F.col("l_suppkey") % 7 != 0, F.when(F.col("l_partkey") > 1, F.col("l_partkey") * 2048).otherwise(0))
    told = filters.valid_function_pointers(t("lineitem").select("l_orderkey", "l_linenumber", aimed.alias("target")), "target", pages)
    return told.groupBy("l_orderkey", "l_linenumber").agg(big(F.count("*"), "n"), big(F.sum(F.col("callable").cast("int")), "callable"))


# --- orders and customers as objects in memory: a page each


_ORDER_PAGE = 128
_FIRST_CUSTOMER = 1_000_000_000


def _le(c: Column, size: int) -> Column:
    """The hexadecimal digits of an integer's little-endian bytes."""
    digits = F.lpad(F.hex(c.cast("bigint")), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)])


def _order_image(t) -> tuple[typed.TypeTables, DataFrame]:
    """A catalog, and pages of 128 bytes: an order has owner (declared void*, with one candidate), total, status and priority, a customer nation and name."""
    padded = lambda c, n: F.rpad(F.hex(F.encode(c, "utf-8")), 2 * n, "0")
    owner = F.when(F.col("o_orderstatus") != "P", (F.col("o_custkey") + _FIRST_CUSTOMER) * _ORDER_PAGE).otherwise(0)
    data = F.concat(_le(owner, 8), _le(F.col("o_custkey") - 700, 4), F.lit("00000000"), padded(F.col("o_orderstatus"), 8), padded(F.col("o_orderpriority"), 16))
    orders = t("orders").select((F.col("o_orderkey") + 1).alias("frame"), F.unhex(F.rpad(data, 2 * _ORDER_PAGE, "0")).alias("data"))
    data = F.concat(_le(F.col("c_nationkey"), 8), padded(F.col("c_name"), 24))
    customers = t("customer").select((F.col("c_custkey") + _FIRST_CUSTOMER).alias("frame"), F.unhex(F.rpad(data, 2 * _ORDER_PAGE, "0")).alias("data"))
    spark = orders.sparkSession
    types = [
        (1, "Int32", "int32", 4, None, None), (2, "Int8", "char8", 1, None, None), (3, "Array", "char[16]", 16, 2, 16), (4, "Struct", "customer", 128, None, None),
        (5, "Pointer", "customer*", 8, 4, None), (6, "Struct", "order", 128, None, None), (7, "Array", "char[24]", 24, 2, 24), (8, "Pointer", "void*", 8, None, None),
    ]
    members = [(6, 0, "owner", 0, 8), (6, 1, "total", 8, 1), (6, 2, "status", 16, 2), (6, 3, "priority", 24, 3), (4, 0, "nation", 0, 1), (4, 1, "name", 8, 7)]
    tables = typed.TypeTables(
        spark.createDataFrame(types, "type_id bigint, kind string, name string, size bigint, ref_type bigint, length bigint"),
        spark.createDataFrame(members, "type_id bigint, idx int, name string, offset bigint, ref_type bigint"), spark.createDataFrame([(6, 0, 1, 5)], "type_id bigint, idx int, no int, ref_type bigint"),
    )
    return tables, orders.unionByName(customers)


_OWNER_SQL = "CASE WHEN o_orderstatus <> 'P' THEN (o_custkey + 1000000000) * 128"


@query(
    "typed_requests",
    f"""WITH x AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS request, l_linenumber AS n, (l_orderkey + 1) * 128 AS a, o_custkey - 700 AS total, o_orderstatus AS st, lower(hex(encode(o_orderpriority))) || repeat('00', 16 - strlen(o_orderpriority)) AS pr,
      {_OWNER_SQL} END AS own, c_name, c_nationkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
    y AS (SELECT *, printf('%016x', coalesce(own, 0)) AS h, printf('%08x', (total + 4294967296) % 4294967296) AS g FROM x),
    z AS (SELECT *, array_to_string([substr(h, 15 - 2 * i, 2) for i in range(8)], '') || array_to_string([substr(g, 7 - 2 * i, 2) for i in range(4)], '') || '00000000' AS l0, lower(hex(encode(st))) || repeat('00', 7) || substr(pr, 1, 16) AS l1, substr(pr, 17, 16) AS l2 FROM y),
    w AS (SELECT request, 0 AS line, 'int32' AS type_name, a + 8 AS address, total AS integer, NULL AS text, NULL AS error FROM z WHERE n = 1
      UNION ALL SELECT request, 0, CASE WHEN own IS NOT NULL THEN 'char[24]' END, own + 8, NULL, CASE WHEN own IS NOT NULL THEN c_name END, CASE WHEN own IS NULL THEN 'no member or not mapped' END FROM z WHERE n = 2
      UNION ALL SELECT request, 0, CASE WHEN own IS NOT NULL THEN 'int32' END, own, CASE WHEN own IS NOT NULL THEN c_nationkey END, NULL, CASE WHEN own IS NULL THEN 'no member or not mapped' END FROM z WHERE n = 3
      UNION ALL SELECT request, 0, 'int', a + 8, total, NULL, NULL FROM z WHERE n = 4 UNION ALL SELECT request, 0, 'char', a + 16, ascii(st), NULL, NULL FROM z WHERE n = 5
      UNION ALL SELECT request, 0, 'raw', a, NULL, l0, NULL FROM z WHERE n = 6 UNION ALL SELECT request, 1, 'raw', a + 16, NULL, l1, NULL FROM z WHERE n = 6 UNION ALL SELECT request, 2, 'raw', a + 32, NULL, l2, NULL FROM z WHERE n = 6
      UNION ALL SELECT request, 0, NULL, NULL, NULL, NULL, 'no member or not mapped' FROM z WHERE n = 7)
    SELECT request, CAST(line AS INTEGER) AS line, type_name, CAST(address AS BIGINT) AS address, CAST(integer AS BIGINT) AS integer, CASE WHEN type_name = 'raw' THEN trim(regexp_replace(text, '(..)', '\\1 ', 'g')) ELSE text END AS text, error FROM w""",
)
def _(t):
    tables, pages = _order_image(t)
    forms = ["order.total @ 0x{}", "order.owner.name @ {}", "order.owner.nation @ 0x{}", "int @ {}", "char @ 0x{}", "raw 40 @ 0x{}", "6.nothing@{}"]
    base = (F.col("l_orderkey") + 1) * _ORDER_PAGE
    ats = [base, base, base, base + 8, base + 16, base, base]
    spec = F.coalesce(*[F.when(F.col("l_linenumber") == n, F.concat(F.lit(f.split("{}")[0]), F.lower(F.hex(a)))) for n, (f, a) in enumerate(zip(forms, ats), 1)])
    asked = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request"), spec.alias("spec")).distinct()
    return typed.typed_reads(asked, "request", tables, pages, _ORDER_PAGE).drop("real")


@query(
    "instance_methods",
    f"""SELECT o_orderkey, 'described' AS what, 'Struct:128:4' AS told FROM orders UNION ALL SELECT o_orderkey, 'names', 'owner,total,status,priority' FROM orders UNION ALL SELECT o_orderkey, 'owner', '0:8:1' FROM orders
    UNION ALL SELECT o_orderkey, 'candidate', CAST({_OWNER_SQL} END AS VARCHAR) FROM orders UNION ALL SELECT o_orderkey, 'letter', CAST(ascii(substr(o_orderpriority, 3, 1)) AS VARCHAR) FROM orders
    UNION ALL SELECT o_orderkey, 'member' || i, CAST((o_orderkey + 1) * 128 + [0, 8, 16, 24][i + 1] AS VARCHAR) || ':' || [5, 1, 2, 3][i + 1] FROM orders, range(4) r(i)""",
)
def _(t):
    tables, pages = _order_image(t)
    rows = t("orders").select("o_orderkey", ((F.col("o_orderkey") + 1) * _ORDER_PAGE).alias("address"), F.lit(6).cast("bigint").alias("type_id"))
    at = typed.Instances(rows, tables, pages, _ORDER_PAGE)
    told = lambda df, what, *cs: df.select("o_orderkey", (what if isinstance(what, Column) else F.lit(what)).alias("what"), (F.concat_ws(":", *cs) if len(cs) > 1 else F.col(cs[0]).cast("string")).alias("told"))
    out = told(at.described(), "described", "kind", "size", "member_count")
    out = out.unionByName(told(at.member_names().withColumn("names", F.array_join("member_names", ",")), "names", "names"))
    out = out.unionByName(told(at.of_member("owner"), "owner", "member_offset", "member_type", "n_candidates"))
    out = out.unionByName(told(at.member("owner", candidate=1).dereferenced(1).rows, "candidate", "address"))
    out = out.unionByName(told(at.member("priority", declared=True).element(2).values(), "letter", "integer"))
    return out.unionByName(told(at.all_members().rows, F.concat(F.lit("member"), F.col("idx").cast("string")), "address", "type_id"))


@query(
    "variables_by_members",
    """WITH h0 AS (SELECT c_custkey AS c, c_custkey * 8 + 2 AS var_id FROM customer WHERE c_mktsegment = 'BUILDING'), h1 AS (SELECT o_custkey AS c, o_orderkey * 8 + 4 AS var_id FROM orders WHERE o_orderstatus = 'F'),
    few AS (SELECT c_custkey AS c FROM customer LEFT JOIN (SELECT c, count(*) AS n FROM (FROM h0 UNION ALL FROM h1) GROUP BY c) k ON k.c = c_custkey WHERE coalesce(n, 0) < 3),
    h2 AS (SELECT o_custkey AS c, l_partkey * 8 + 6 AS var_id, 'l' || l_linenumber || '.cust' AS path FROM few JOIN orders ON o_custkey = c JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
    SELECT c * 8 + 1 AS wanted, var_id, '' AS path, 0 AS hops FROM h0 UNION ALL SELECT c * 8 + 1, var_id, 'cust', 1 FROM h1 JOIN customer ON c_custkey = c UNION ALL SELECT c * 8 + 1, var_id, path, 2 FROM h2""",
)
def _(t):
    struct = lambda df, key, at: df.select((F.col(key) * 8 + at).alias("type_id"), F.lit("Struct").alias("kind"), F.lit(None).cast("bigint").alias("ref_type"))
    aimed = lambda df, key, at: df.select((F.col(key) * 8 + at + 1).alias("type_id"), F.lit("Pointer").alias("kind"), (F.col(key) * 8 + at).alias("ref_type"))
    given = [(t("customer"), "c_custkey", 1), (t("orders"), "o_orderkey", 3), (t("part"), "p_partkey", 5)]
    types = [f(*g) for g in given for f in (struct, aimed)]
    types = types[0].unionByName(types[1]).unionByName(types[2]).unionByName(types[3]).unionByName(types[4]).unionByName(types[5])
    members = t("orders").select((F.col("o_orderkey") * 8 + 3).alias("type_id"), F.lit("cust").alias("name"), (F.col("o_custkey") * 8 + 2).alias("ref_type"))
    lines = t("lineitem").select((F.col("l_partkey") * 8 + 5).alias("type_id"), F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_orderkey") * 8 + 4).alias("ref_type")).distinct()
    ids = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey") * 8 + 2).unionByName(t("orders").filter("o_orderstatus = 'F'").select((F.col("o_orderkey") * 8 + 4).alias("((c_custkey * 8) + 2)"))).toDF("type_id")
    ids = ids.unionByName(t("part").select((F.col("p_partkey") * 8 + 6).alias("type_id")))
    return typed.variables_using(t("customer").select((F.col("c_custkey") * 8 + 1).alias("type_id")), types, members.unionByName(lines), ids.select(F.col("type_id").alias("var_id"), "type_id"), 3, 2)
