"""URL filters: rules, and trust and distrust along the host graph.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest
rule wins. Other urls get the verdict of their host. Trust is personalised PageRank from the pages that an allow
rule fits; distrust is the same on reversed links from the pages that a block rule fits (who links to blocked
pages is suspect). Links are the absolute references in the html; relative ones stay on their host. Both masses
are scaled to pages, and a host is blocked if its distrust exceeds its trust by :data:`LIMIT` of its pages.

Links are added up per pair of hosts before anything is joined, so a host with a third of all pages is one node.
Mass of hosts without links is not passed on. Twelve rounds of one join and one aggregate; the lineage is cut
by a written table every :data:`CUT` rounds.

A null url or one without "://" has an empty host and path; no rule fits it and it seeds and links nothing,
so it is allowed. Null html has no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import query, table
from tidewatch.session import written

#: rule -> verdict; the host ends at the first slash
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
DAMPING, ROUNDS, CUT, LIMIT = 0.85, 12, 4, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REFERENCE = r"""(?i)(?:href|src)\s*=\s*["']?([^"'\s>]+)"""


def rest_of(url: Column) -> Column:
    """What follows the first "://", or the empty text."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, start = rule.split("/", 1)
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _verdict(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for r, v in rules.items():
        out = F.when(rule == r, F.lit(v)).otherwise(out)
    return out


def host_masses(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Per host: pages, allowed and blocked pages, and trust and distrust in pages."""
    seen = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce("html", F.lit("")).alias("html")).filter("host != ''")
    seen = seen.withColumn("verdict", _verdict(rule_for(F.col("host"), F.col("path"), rules), rules)).withColumn("refs", F.regexp_extract_all("html", F.lit(_REFERENCE), F.lit(1)))
    away = F.filter("refs", lambda r: F.contains(r, F.lit("://")))
    seen = seen.select("host", "verdict", (F.size("refs") - F.size(away)).alias("own"), F.filter(F.transform(away, host_of), lambda h: h != "").alias("away"))
    seen = written(seen, "page-links")
    hosts = seen.groupBy("host").agg(F.count("*").alias("pages"), F.count(F.when(F.col("verdict") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"), F.sum("own").alias("own"))
    hosts = written(hosts, "hosts")
    links = seen.select("host", F.explode("away").alias("target")).groupBy("host", "target").agg(F.count("*").alias("n"))
    links = links.union(hosts.filter("own > 0").select("host", F.col("host").alias("target"), "own")).groupBy("host", "target").agg(F.sum("n").alias("n"))
    links = written(links, "host-links")
    sides = links.select(F.lit("trust").alias("kind"), F.col("host").alias("frm"), F.col("target").alias("to"), "n").union(links.select(F.lit("distrust"), "target", "host", "n"))
    sent = sides.groupBy("kind", "frm").agg(F.sum("n").alias("total"))
    edges = written(sides.join(sent, ["kind", "frm"]).select("kind", "frm", "to", (F.col("n") / F.col("total")).alias("share")), "edges")
    # seeds in pages: the masses stay in pages as well
    seeds = hosts.select(F.lit("trust").alias("kind"), "host", F.col("allowed").cast("double").alias("seed")).union(hosts.select(F.lit("distrust"), "host", F.col("blocked").cast("double"))).filter("seed > 0")
    mass = seeds.withColumnRenamed("seed", "mass")
    for k in range(1, ROUNDS + 1):
        passed = edges.join(mass.withColumnRenamed("host", "frm"), ["kind", "frm"]).select("kind", F.col("to").alias("host"), (F.col("share") * F.col("mass") * DAMPING).alias("mass"))
        mass = passed.union(seeds.select("kind", "host", F.col("seed") * (1 - DAMPING))).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if k % CUT == 0:
            mass = written(mass, "mass")
    wide = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust"))
    return hosts.join(wide, "host", "left").select("host", "pages", "allowed", "blocked", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judged(pages: DataFrame, columns: list[str], rules: dict[str, str] = RULES) -> DataFrame:
    """The chosen columns with host, path, rule and verdict of each url."""
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    hosts = host_masses(pages, rules).select("host", (F.round((F.col("distrust") - F.col("trust")) / F.col("pages"), 9) >= LIMIT).alias("bad"))
    url = F.col("url")
    rows = pages.select(*(F.col(c).alias(n) for c, n in names.items()), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    ruled = F.coalesce(_verdict(F.col("rule"), rules), F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(hosts, "host", "left").select(*(F.col(n).alias(c) for c, n in names.items()), "host", "path", "rule", ruled.alias("verdict"))


def _oracle() -> str:
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract(coalesce({rest}, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    case = " ".join(
        f"WHEN (host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'" for r in sorted(RULES, key=lambda r: (-len(r), r))
    )
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items())
    pattern = _REFERENCE.replace("'", "''")
    target = host.replace("url", "r")
    steps = "".join(
        f""",
m{k} AS (SELECT kind, host, sum(mass) AS mass FROM (SELECT e.kind, e."to" AS host, share * mass * {DAMPING} AS mass FROM edges e JOIN m{k - 1} m ON e.kind = m.kind AND e.frm = m.host
        UNION ALL SELECT kind, host, mass * {1 - DAMPING} FROM m0) GROUP BY kind, host)"""
        for k in range(1, ROUNDS + 1)
    )
    return f"""
WITH u AS (SELECT page_id, html, {host} AS host, regexp_extract(coalesce({rest}, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {case} END AS rule FROM u),
v AS (SELECT *, CASE rule {verdict} END AS verdict FROM r),
refs AS (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{pattern}', 1)) AS r FROM v WHERE host <> ''),
links AS (SELECT host, target, count(*) AS n FROM (SELECT host, CASE WHEN contains(r, '://') THEN {target} ELSE host END AS target FROM refs) WHERE target <> '' GROUP BY ALL),
sides AS (SELECT 'trust' AS kind, host AS frm, target AS "to", n FROM links UNION ALL SELECT 'distrust', target, host, n FROM links),
edges AS (SELECT kind, frm, "to", n / sum(n) OVER (PARTITION BY kind, frm) AS share FROM sides),
m0 AS (SELECT * FROM (SELECT 'trust' AS kind, host, CAST(count(*) FILTER (verdict = 'allow') AS DOUBLE) AS mass FROM v WHERE host <> '' GROUP BY host
       UNION ALL SELECT 'distrust', host, CAST(count(*) FILTER (verdict = 'block') AS DOUBLE) FROM v WHERE host <> '' GROUP BY host) WHERE mass > 0){steps},
h AS (SELECT host, count(*) AS n FROM v GROUP BY host),
bad AS (SELECT h.host, round((coalesce(sum(CASE kind WHEN 'distrust' THEN mass ELSE -mass END), 0)) / any_value(n), 9) >= {LIMIT} AS bad FROM h LEFT JOIN m{ROUNDS} m ON h.host = m.host GROUP BY h.host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict FROM v JOIN bad USING (host)
"""


@query("op2_link_graph_propagation", _oracle())
def op2_link_graph_propagation(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judged(table(spark, folder, "pages"), ["page_id"])
