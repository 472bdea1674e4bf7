"""Verdicts on urls: rules first, then trust and distrust along links. DataFrame operations only.

Trust starts on the hosts of pages that a rule allows and flows along links; distrust
starts on the hosts of pages that a rule blocks and flows against them. Both are
personalised PageRanks whose seeds count pages, so they can be set against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# (host, path, verdict); the longest that fits wins.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DAMPING = 0.85
ROUNDS = 12
# Rounds between checkpoints.
SPAN = 4
# Rounds go on until no host's mass changes by a larger share of itself in one.
TOLERANCE = 1e-6
# A host is blocked if distrust is over this share of its trust and distrust.
BLOCK_SHARE = 0.5
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]*)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def links(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: how many pages of one host link to another."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    found = found.select("src", F.explode("to").alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return found.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``host, mass``: the seeds' mass (``host, seed``) after flowing along ``src, dst, weight``.

    Each round a host passes a share of its mass on, in proportion to the weights.
    What has nowhere to go is lost. There are at least ``rounds`` rounds, and more until
    no new host is reached and no host's mass changes by more than ``TOLERANCE`` of it.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    shares = cut(edges.join(total, "src").select("src", "dst", (DAMPING * F.col("weight") / F.col("all")).alias("share")))
    held = seeds.select("host", ((1 - DAMPING) * F.col("seed")).alias("own"))
    mass = held.select("host", F.col("own").alias("mass"))
    if shares.isEmpty():
        return mass
    none, k = F.lit(0.0), 0
    while True:
        k += 1
        moved = shares.join(mass, shares["src"] == mass["host"]).select(F.col("dst").alias("host"), (F.col("share") * F.col("mass")).alias("part"), none.alias("before"))
        after = moved.union(held.select("host", "own", none)).union(mass.select("host", none, "mass"))
        after = after.groupBy("host").agg(F.sum("part").alias("mass"), F.sum("before").alias("before"))
        if k % SPAN:
            mass = after.select("host", "mass")
            continue
        after = cut(after)
        mass = after.select("host", "mass")
        # A new host had no mass before.
        if k >= rounds and after.where(F.abs(F.col("mass") - F.col("before")) > TOLERANCE * F.col("mass")).isEmpty():
            return mass


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    ``pages`` needs ``page_id``, ``url`` and ``html``. A rule's verdict holds where one
    fits; else the host's: block if distrust exceeds its share of trust and distrust,
    allow otherwise, also where neither arrives. Null urls and urls without ``://`` have
    an empty host and path, fit no rule and are allowed. Null html has no links.
    Rows that repeat are judged each and count each; an empty table gives an empty
    result; other columns are not read.
    """
    host, path = host_of(F.col("url").cast("string")), path_of(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says)
    edges = cut(links(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))))
    starts = rows.where("says IS NOT NULL AND host <> ''").groupBy("host", "says").agg(F.count("*").cast("double").alias("seed"))
    starts = cut(starts)
    trust = propagated(edges, starts.where("says = 'allow'"), rounds)
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagated(reverse, starts.where("says = 'block'"), rounds)
    both = trust.select("host", F.col("mass").alias("good"), F.lit(0.0).alias("bad"))
    both = both.union(distrust.select("host", F.lit(0.0), "mass")).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # A hair's breadth keeps the order of sums from deciding.
    blocked = both.where(F.col("bad") > BLOCK_SHARE * (F.col("good") + F.col("bad")) * (1 + 1e-9)).select("host", F.lit("block").alias("found"))
    out = rows.join(blocked, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", "found", F.lit("allow")).alias("verdict"))


def judge_sql(rules: list[tuple[str, str, str]] = RULES, rounds: int = ROUNDS) -> str:
    """The same rows as SQL over the table ``pages``, one query part for each round."""
    fits = {
        (h, p): f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, _ in rules
    }
    order = sorted(rules, key=lambda r: -len(r[0]) - len(r[1]))
    rule = " ".join(f"WHEN {fits[h, p]} THEN '{h}{p}'" for h, p, _ in order)
    says = " ".join(f"WHEN {fits[h, p]} THEN '{v}'" for h, p, v in order)
    link = LINK.replace("'", "''")
    lower = "translate({}, '" + UPPER + "', '" + LOWER + "')"
    parts = [
        f"u AS (SELECT page_id, html, {lower.format(f'''coalesce(regexp_extract(url, '{URL}', 1), '')''')} AS host,"
        f" coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages)",
        f"r AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {says} END AS says FROM u)",
        f"l AS (SELECT host AS src, {lower.format('dst')} AS dst FROM"
        f" (SELECT host, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS dst FROM u))",
        "e AS (SELECT src, dst, count(*) AS w FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2)",
        "s AS (SELECT host, says, CAST(count(*) AS DOUBLE) AS seed FROM r WHERE says IS NOT NULL AND host <> '' GROUP BY 1, 2)",
    ]
    for name, kind, a, b in (("t", "allow", "src", "dst"), ("d", "block", "dst", "src")):
        parts.append(
            f"{name}w AS (SELECT {a} AS a, {b} AS b, {DAMPING} * w / sum(w) OVER (PARTITION BY {a}) AS share FROM e)"
        )
        parts.append(f"{name}0 AS (SELECT host, {1 - DAMPING} * seed AS own, {1 - DAMPING} * seed AS mass FROM s WHERE says = '{kind}')")
        for k in range(1, rounds + 1):
            parts.append(
                f"{name}{k} AS (SELECT host, sum(part) AS mass FROM (SELECT b AS host, share * mass AS part FROM {name}w"
                f" JOIN {name}{k - 1} ON a = host UNION ALL SELECT host, own FROM {name}0) GROUP BY 1)"
            )
    parts.append(
        f"v AS (SELECT host, sum(good) AS good, sum(bad) AS bad FROM (SELECT host, mass AS good, 0.0 AS bad FROM t{rounds}"
        f" UNION ALL SELECT host, 0.0, mass FROM d{rounds}) GROUP BY 1)"
    )
    return (
        "WITH " + ", ".join(parts) + " SELECT page_id, r.host, path, rule, coalesce(says, CASE WHEN bad >"
        f" {BLOCK_SHARE} * (good + bad) * (1 + 1e-9) THEN 'block' END, 'allow') AS verdict FROM r LEFT JOIN v ON r.host = v.host"
    )
