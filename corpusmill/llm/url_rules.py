"""Verdicts on urls by rules and, where none fits, by trust and distrust over the host graph (operator 11): DataFrame functions only.

A rule is a verdict for a host with all its subdomains and a start of the path; the longest rule that fits decides.
Hosts of which rules allow (block) more than half of the pages are trusted (blocked) seeds, with that share as
their weight. Trust is the personalised PageRank from the trusted seeds over the hosts' links; distrust is that from the
blocked seeds over the same links reversed, so that it falls on those who link to bad hosts. A host is blocked
where its distrust exceeds its trust and the mean distrust of all hosts.

An edge is a link by full or protocol-relative address from a page of one host to another host; its weight is the
number of pages that have it. PageRank is summed as the series seeds + damped steps; mass that
meets a host without links leaves it, and the final division by the sum gives what sending it back to the seeds gives.

Defined results: a null url, or one without ://, has an empty host and path, no rule, and is allowed; null html has no
links; null ids and repeated rows are judged alike (repeated pages count in shares and weights as often as they occur); without
edges the seeds' own masses decide; an empty table gives no rows; columns beyond page_id, url and html are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, salted_join

#: (verdict, host, start of the path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, STEPS = 0.85, 20
#: Of a host's pages, the share above which a verdict by rule makes it a seed.
SEED_SHARE = 0.5
#: Times the mean distrust of all hosts.
LEAST_DISTRUST = 1.0
#: Blocked hosts whose names may be broadcast; more are joined with salts.
FEW_HOSTS = 10_000
#: The part of a link that follows //, up to the end of the host.
LINK = r"""(?i)<a[\x20\x09-\x0D](?:[^>]*[\x20\x09-\x0D"'])?href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\x20\x09-\x0D]*)"""


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ://, ASCII letters lower-cased, and the path up to a query or fragment."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule (null where none fits) and ruling."""
    host, path = host_and_path(F.col("url"))
    at = pages.withColumns({"host": host, "path": path})
    text = ruling = F.lit(None).cast("string")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last, outermost test is the longest rule's
        fits = ((F.col("host") == name) | F.endswith("host", F.lit(f".{name}"))) & F.startswith("path", F.lit(start))
        text, ruling = F.when(fits, name + start).otherwise(text), F.when(fits, verdict).otherwise(ruling)
    return at.withColumns({"rule": text, "ruling": ruling})


def host_edges(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> src, dst, weight: between different hosts, the number of pages of src that link to dst."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), ascii_lower))
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    return links.where((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def host_seeds(pages: DataFrame, share: float = SEED_SHARE) -> DataFrame:
    """pages (host, ruling) -> host, trust, distrust: the share of its pages allowed or blocked by rules, 0 where not above `share`."""
    parts = pages.where(F.col("host") != "").groupBy("host").agg(F.avg((F.col("ruling") == "allow").cast("double")).alias("allowed"), F.avg((F.col("ruling") == "block").cast("double")).alias("blocked"), F.count("*").alias("n"), F.count("ruling").alias("ruled"))

    def over(mean: str) -> Column:
        part = F.coalesce(F.col(mean) * F.col("ruled") / F.col("n"), F.lit(0.0))
        return F.when(part > share, part).otherwise(0.0)

    return parts.select("host", over("allowed").alias("trust"), over("blocked").alias("distrust"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """seeds (host, trust, distrust), edges (src, dst, weight) -> host, trust, distrust, each of sum 1 where it has a seed.

    Trust follows the edges, distrust their reverse; both move in one join a step. A step's masses are checkpointed and the
    steps end early when nothing moves any more. Hosts that neither reaches have no row.
    """
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("frm"), F.col("dst").alias("to"), "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("frm"), F.col("src").alias("to"), "weight")
    )
    totals = ways.groupBy("kind", "frm").agg(F.sum("weight").alias("total"))
    shares = cut(ways.join(totals, ["kind", "frm"]).select("kind", "frm", "to", (F.col("weight") / F.col("total")).alias("share")))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("mass")) for k in ("trust", "distrust")])).alias("each")
    mass = cut(seeds.select("host", kinds).select("each.kind", "host", "each.mass").where("mass > 0"))
    terms = [mass]
    while len(terms) <= steps:
        here = mass.withColumnRenamed("host", "frm")
        mass = cut(here.join(shares, ["kind", "frm"]).groupBy("kind", F.col("to").alias("host")).agg((F.sum(F.col("mass") * F.col("share")) * damping).alias("mass")))
        if mass.isEmpty():
            break
        terms.append(mass)
    sums = cut(reduce(DataFrame.unionByName, terms).groupBy("kind", "host").agg(F.sum("mass").alias("mass")))
    whole = dict(sums.groupBy("kind").agg(F.sum("mass")).collect())  # two numbers
    return sums.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass") / whole.get(k, 1.0))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])


def blocked_hosts(scores: DataFrame, n_hosts: int, least: float = LEAST_DISTRUST) -> DataFrame:
    """scores (host, trust, distrust) -> the hosts that are blocked, to nine decimals."""
    return scores.where((F.round(F.col("distrust") * n_hosts, 9) >= least) & (F.round(F.col("distrust") - F.col("trust"), 9) > 0)).select("host")


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, steps: int = STEPS, share: float = SEED_SHARE, least: float = LEAST_DISTRUST) -> DataFrame:
    """pages (page_id, url, html) -> page_id, host, path, rule, verdict: one row a page.

    Pages are counted and their links summed by host before any shuffle; html is read once, for the edges alone.
    """
    at = ruled(pages.select("page_id", "url", "html"), rules)
    edges, seeds = cut(host_edges(at)), cut(host_seeds(at, share))
    n_hosts = seeds.select("host").union(edges.select("dst")).distinct().count()
    blocked = cut(blocked_hosts(propagate(seeds, edges, damping, steps), n_hosts, least).withColumn("_blocked", F.lit(True)))
    verdict = F.coalesce("ruling", F.when(F.col("_blocked"), "block").otherwise("allow"))
    if blocked.count() <= FEW_HOSTS:
        judged = at.join(F.broadcast(blocked), "host", "left")
    else:  # a host with a third of all pages is dealt over many tasks
        judged = salted_join(at, blocked, "host", F.col("page_id"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _steps_sql() -> str:
    step = ", mass{k} AS (SELECT m.kind, s.to_host AS host, sum(m.mass * s.share) * {d} AS mass FROM mass{j} m JOIN shares s ON m.kind = s.kind AND m.host = s.frm GROUP BY ALL)"
    return "".join(step.format(k=k, j=k - 1, d=DAMPING) for k in range(1, STEPS + 1))


def _rules_sql(column: str) -> str:
    given = {"rule": lambda v, h, p: h + p, "ruling": lambda v, h, p: v}[column]
    longest = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{given(v, h, p)}'" for v, h, p in longest) + " END"


OP11_SQL = rf"""
WITH rest AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
located AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, {_rules_sql("rule")} AS rule, {_rules_sql("ruling")} AS ruling FROM located),
links AS (
  SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1),
    lambda x: translate(x, '{string.ascii_uppercase}', '{string.ascii_lowercase}')))) AS dst FROM ruled WHERE host <> ''),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS weight FROM links WHERE dst <> '' AND src <> dst GROUP BY ALL),
ways AS (SELECT 'trust' AS kind, src AS frm, dst AS to_host, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges),
shares AS MATERIALIZED (SELECT kind, frm, to_host, weight / sum(weight) OVER (PARTITION BY kind, frm) AS share FROM ways),
parts AS MATERIALIZED (
  SELECT host, count(*) FILTER (ruling = 'allow') / count(*) AS trust, count(*) FILTER (ruling = 'block') / count(*) AS distrust
  FROM ruled WHERE host <> '' GROUP BY host),
mass0 AS (
  SELECT 'trust' AS kind, host, trust AS mass FROM parts WHERE trust > {SEED_SHARE}
  UNION ALL SELECT 'distrust', host, distrust FROM parts WHERE distrust > {SEED_SHARE}){_steps_sql()},
sums AS MATERIALIZED (SELECT kind, host, sum(mass) AS mass FROM ({" UNION ALL ".join(f"SELECT * FROM mass{k}" for k in range(STEPS + 1))}) GROUP BY ALL),
scores AS (
  SELECT host, coalesce(sum(mass / whole) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass / whole) FILTER (kind = 'distrust'), 0) AS distrust
  FROM sums JOIN (SELECT kind, sum(mass) AS whole FROM sums GROUP BY kind) USING (kind) GROUP BY host),
hosts AS (SELECT count(*) AS n FROM (SELECT host FROM parts UNION SELECT dst FROM edges)),
blocked AS (SELECT host FROM scores, hosts WHERE round(distrust * n, 9) >= {LEAST_DISTRUST} AND round(distrust - trust, 9) > 0)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""
