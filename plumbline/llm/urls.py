"""URL filters: rules by host and path, and for the rest trust and distrust that spread over the link graph.

Pages judged by a rule are the seeds. Trust is a personalised PageRank that starts at hosts with allowed
pages and follows links; distrust starts at hosts with blocked pages and follows links backwards, since
who links to a blocked host shares in its standing. A host's seed is the share of its pages that the
rules judge, and every step keeps ``1 - DAMPING`` of it, so a host that is blocked whole and knows no one
has a distrust of ``1 - DAMPING``. A host is blocked if its distrust reaches ``THRESHOLD`` of that and is
larger than its trust. Hosts that no seed reaches are allowed, and so are urls without a host.

All of it is joins and aggregates over hosts and host edges. Pages and links fold to hosts before the
first shuffle, both directions spread in the same step, and each step reads the one before from the
shared folder.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.texts import literal_rows, small_side, stored

DAMPING = 0.85
STEPS = 10
THRESHOLD = 0.5
PLACES = 9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = "://([^/?#]*)"
PATH = "://[^/?#]*([^?#]*)"
LINK = """[hH][rR][eE][fF]\\s*=\\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'<>\\s]+)"""
#: Host, path and verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: str) -> Column:
    return F.coalesce(lowered(F.regexp_extract(F.col(url), HOST, 1)), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), PATH, 1), F.lit(""))


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host`` and the ``rules`` of it and of every domain above it, longest first."""
    labels = F.split("host", "[.]")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    found = hosts.select("host", F.explode(above).alias("rule_host")).join(rules, "rule_host")
    rule = F.concat("rule_host", "rule_path")
    entry = F.struct(F.length(rule).alias("size"), rule.alias("rule"), "rule_path", "verdict")
    return found.groupBy("host").agg(F.sort_array(F.collect_set(entry), asc=False).alias("rules"))


def spread(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """``host``, ``trust``, ``distrust`` of every host that has one.

    ``edges``: ``src``, ``dst``, ``links``. ``seeds``: ``host``, ``trust``, ``distrust``.
    """
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "links")
    arcs = forward.union(backward)
    out = arcs.groupBy("kind", "host").agg(F.sum("links").alias("total"))
    arcs = stored(arcs.join(out, ["kind", "host"]).withColumn("part", F.col("links") / F.col("total")).drop("links", "total"), "arcs")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("seed")) for k in ("trust", "distrust")]))
    start = seeds.select("host", kinds.alias("k")).select("k.kind", "host", "k.seed").where("seed > 0")
    start = stored(start.withColumn("value", (1 - damping) * F.col("seed")).drop("seed"), "seeds")
    state = start
    for _ in range(steps if edges.take(1) else 0):
        passed = arcs.join(state, ["kind", "host"]).select("kind", F.col("to").alias("host"), (damping * F.col("part") * F.col("value")).alias("value"))
        state = stored(passed.unionByName(start).groupBy("kind", "host").agg(F.sum("value").alias("value")), "ranks")
    of = [F.round(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0.0)), PLACES).alias(k) for k in ("trust", "distrust")]
    return state.groupBy("host").agg(*of)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    url: str = "url",
    html: str = "html",
    steps: int = STEPS,
    damping: float = DAMPING,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (NULL without one), ``verdict``, ``trust``, ``distrust``.

    The longest fitting rule wins. A NULL url or one without ``://`` has an empty host and path, fits no
    rule and is allowed. NULL html has no links; a link to the own host is none. Repeated rows count as
    pages of their host. Other columns are kept unless they carry one of these names; an empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    names = {"host", "path", "rule", "verdict", "trust", "distrust"}
    rest = pages.drop(*[c for c in pages.columns if c in names - {url, html}])
    table = spark.sql(f"SELECT * FROM VALUES {literal_rows(rules)} AS t(rule_host, rule_path, verdict)")
    split = rest.withColumns({"host": host_of(url), "path": path_of(url)})

    seen = pages.select(host_of(url).alias("host"), path_of(url).alias("path"), F.col(html).alias("html"))
    by_path = seen.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    by_path = stored(by_path, "host-paths")
    fitting = stored(fitting_rules(by_path.select("host").distinct(), table), "host-rules")

    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0))
    judged = by_path.join(small_side(fitting), "host", "left").withColumn("verdict", first["verdict"])
    share = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)) / F.sum("n")
    seeds = judged.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    linked = F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
    edges = seen.where("host <> ''").select(F.col("host").alias("src"), linked.alias("link"))
    edges = edges.select("src", lowered(F.col("link")).alias("dst"))
    edges = stored(edges.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links")), "host-edges")
    ranks = spread(edges, seeds, steps, damping)
    known = stored(
        fitting.join(ranks, "host", "full").select(F.col("host").alias("__host"), F.struct("rules", "trust", "distrust").alias("__k")),
        "hosts",
    )
    k = F.col("__k")
    # A limit at the same precision as the ranks.
    limit = round(threshold * (1 - damping), PLACES)
    rule = F.get(F.filter(k["rules"], lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0))
    joined = split.join(small_side(known), F.col("host") == F.col("__host"), "left")
    trust, distrust = F.coalesce(k["trust"], F.lit(0.0)), F.coalesce(k["distrust"], F.lit(0.0))
    by_graph = F.when((distrust >= limit) & (distrust > trust), "block").otherwise("allow")
    return joined.withColumns(
        {
            "rule": rule["rule"],
            "verdict": F.coalesce(rule["verdict"], by_graph),
            "trust": trust,
            "distrust": distrust,
        }
    ).drop("__host", "__k")
