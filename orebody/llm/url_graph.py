"""URL filters: rules first, then trust and distrust over the host graph. DataFrame operations only.

Hosts are linked by absolute links in their pages, and each host and its parent domain of two labels or more are linked both ways, whether or
not the parent has pages, so that the hosts of a domain share in its standing.
Personalised PageRank spreads trust along the links from hosts whose pages rules allow; distrust spreads against the links
from hosts whose pages rules block (who links to a blocked host is suspect). A host is blocked when distrust less trust
reaches a threshold.

Scores are the fixed point of x(v) = seed(v) + d * sum of x(u) * weight(u, v), to within a tolerance: what rounds after the n-th add to
all hosts together is at most d^n / (1 - d) of the seeds, which gives the number of rounds. Seeds are the
shares of a host's pages that rules allow or block, so that without links a host is judged by its own pages.

Edge cases: a null url, or one without ://, has an empty host and path, fits no rule and is allowed; null html has no
links; repeated pages count as often as they stand in the table; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import ascii_lower, discard, materialize, salted_join

#: (host, path prefix, verdict), as the contract states them.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DAMPING = 0.85
TOLERANCE = 1e-3  # of the seeds' sum, for what is left out of the scores
THRESHOLD = 0.5
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path written together) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last when() put around is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def rounds_for(damping: float, tolerance: float) -> int:
    """The least n with damping^n / (1 - damping) <= tolerance."""
    return max(1, math.ceil(math.log(tolerance * (1 - damping)) / math.log(damping)))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (src, dst) between different hosts."""
    hosts = pages.select(url_host(F.col(url)).alias("src"), F.col(html).alias("_h"))
    links = hosts.select("src", F.explode(F.array_distinct(F.regexp_extract_all("_h", F.lit(LINK), F.lit(1)))).alias("_to")).select("src", ascii_lower(F.col("_to")).alias("dst"))
    known = hosts.select("src").union(links.select("dst")).filter("src <> ''").distinct()
    labels = F.split("src", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))  # a host, its parent and so on
    steps = known.filter(F.size(labels) > 2).select(F.explode(F.arrays_zip(F.slice(chain, 1, F.size(labels) - 2).alias("a"), F.slice(chain, 2, F.size(labels) - 2).alias("b"))).alias("s"))
    steps = steps.select(F.explode(F.array(F.struct(F.col("s.a").alias("src"), F.col("s.b").alias("dst")), F.struct(F.col("s.b").alias("src"), F.col("s.a").alias("dst")))).alias("e")).select("e.src", "e.dst")
    return links.unionByName(steps).filter("src <> '' AND dst <> '' AND src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Trust along the edges and distrust against them, to within `tolerance` or for a given number of rounds. seeds: host, trust, distrust;
    the same columns come back, over all hosts."""
    edges = materialize(edges.select("src", "dst"), "edges")
    both = seeds.select("host", F.inline(F.array(F.struct(F.lit("t").alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit("d").alias("kind"), F.col("distrust").alias("seed")))))
    if edges.isEmpty():
        return seeds.select("host", "trust", "distrust")
    ways = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit("t").alias("kind")).unionByName(edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit("d").alias("kind")))
    degrees = ways.groupBy("host", "kind").agg((damping / F.count("*")).alias("w"))
    flow = materialize(salted_join(ways, degrees, ["host", "kind"], salts=8, by=["to"]), "flow")
    both = materialize(both.unionByName(ways.select(F.col("to").alias("host"), "kind", F.lit(0.0).alias("seed"))).groupBy("host", "kind").agg(F.sum("seed").alias("seed")), "seeds")
    score, held = both.select("host", "kind", F.col("seed").alias("x")), None
    for i in range(rounds_for(damping, tolerance) if rounds is None else rounds):
        got = salted_join(flow, score.filter("x <> 0"), ["host", "kind"], salts=8, by=["to"]).groupBy(F.col("to").alias("host"), "kind").agg(F.sum(F.col("x") * F.col("w")).alias("y"))  # a hub's links are dealt out
        score = both.join(got, ["host", "kind"], "left").select("host", "kind", (F.col("seed") + F.coalesce("y", F.lit(0.0))).alias("x"))
        if i % 4 == 3:
            score, old = materialize(score, "score"), held
            held = score
            discard(*([old] if old is not None else []))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("x")).otherwise(0.0))
    return score.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, key: str = "page_id", url: str = "url", html: str = "html", damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """Columns: key, host, path, rule, verdict, host_trust, host_distrust."""
    rules = RULES if rules is None else rules
    parsed = pages.select(key, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumn("rule", rule).withColumn("_said", verdict)
    share = lambda v: (F.sum(F.when(F.col("_said") == v, 1).otherwise(0)) / F.count("*")).alias({"allow": "trust", "block": "distrust"}[v])
    seeds = judged.filter("host <> ''").groupBy("host").agg(share("allow"), share("block"))
    scores = propagate(seeds, host_edges(pages, url, html), damping, tolerance=tolerance).select("host", F.round("trust", 6).alias("host_trust"), F.round("distrust", 6).alias("host_distrust"))
    spread = F.pmod(F.xxhash64(key, "path"), F.lit(16)).cast("int")  # one host may have a third of all pages
    salted = scores.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    out = judged.withColumn("_salt", spread).join(salted, ["host", "_salt"], "left").drop("_salt")
    bad = F.coalesce(F.col("host_distrust"), F.lit(0.0)) - F.coalesce(F.col("host_trust"), F.lit(0.0)) >= threshold
    return out.select(key, "host", "path", "rule", F.coalesce("_said", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("host_trust", F.lit(0.0)).alias("host_trust"), F.coalesce("host_distrust", F.lit(0.0)).alias("host_distrust"))


def op5_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by its host's standing in the link graph."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def _op5_sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered)
    said = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered)
    link = LINK.replace("(?i)", "").replace("'", "''")
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rounds = rounds_for(DAMPING, TOLERANCE)
    steps = "".join(
        f""", s{i + 1} AS MATERIALIZED (
  SELECT n.host, n.kind, n.seed + {DAMPING} * coalesce(g.y, 0) AS x FROM nodes n LEFT JOIN (
    SELECT f.dest AS host, f.kind, sum(s.x * d.w) AS y FROM flow f JOIN s{i} s USING (host, kind) JOIN degrees d USING (host, kind) GROUP BY 1, 2) g USING (host, kind))"""
        for i in range(rounds)
    )
    return f"""
WITH parsed AS (
  SELECT page_id, html, {lower("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), judged AS (
  SELECT *, CASE {rule} END AS rule, CASE {said} END AS said FROM parsed
), seeds AS (
  SELECT host, sum(CASE WHEN said = 'allow' THEN 1 ELSE 0 END) / count(*) AS trust, sum(CASE WHEN said = 'block' THEN 1 ELSE 0 END) / count(*) AS distrust
  FROM judged WHERE host <> '' GROUP BY host
), links AS (
  SELECT host AS src, {lower("unnest(regexp_extract_all(html, '" + link + "', 1, 'i'))")} AS dst FROM parsed
), hosts AS (SELECT host AS h FROM parsed WHERE host <> '' UNION SELECT dst FROM links WHERE dst <> ''
), chains AS (SELECT string_split(h, '.') AS l, unnest(range(1, len(string_split(h, '.')) - 1)) AS i FROM hosts
), steps AS (SELECT array_to_string(l[i:], '.') AS a, array_to_string(l[i + 1:], '.') AS b FROM chains
), edges AS (
  SELECT DISTINCT src, dst FROM (SELECT src, dst FROM links UNION ALL SELECT a, b FROM steps UNION ALL SELECT b, a FROM steps) WHERE src <> '' AND dst <> '' AND src <> dst
), flow AS (
  SELECT src AS host, dst AS dest, 't' AS kind FROM edges UNION ALL SELECT dst, src, 'd' FROM edges
), degrees AS (
  SELECT host, kind, 1.0::DOUBLE / count(*) AS w FROM flow GROUP BY 1, 2
), nodes AS (
  SELECT host, kind, sum(seed) AS seed FROM (
    SELECT host, 't' AS kind, trust::DOUBLE AS seed FROM seeds UNION ALL SELECT host, 'd', distrust::DOUBLE FROM seeds UNION ALL SELECT dest, kind, 0::DOUBLE FROM flow) GROUP BY 1, 2
), s0 AS (SELECT host, kind, seed AS x FROM nodes){steps}, scores AS (
  SELECT host, round(sum(CASE WHEN kind = 't' THEN x ELSE 0 END), 6) AS host_trust, round(sum(CASE WHEN kind = 'd' THEN x ELSE 0 END), 6) AS host_distrust FROM s{rounds} GROUP BY host
)
SELECT page_id, host, path, rule,
  coalesce(said, CASE WHEN coalesce(host_distrust, 0) - coalesce(host_trust, 0) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(host_trust, 0)::DOUBLE AS host_trust, coalesce(host_distrust, 0)::DOUBLE AS host_distrust
FROM judged LEFT JOIN scores USING (host)
"""


OP5_SQL = _op5_sql()
