"""URL filter by propagation of trust and distrust over the link graph of hosts.

Rules decide first: a rule names a host with its subdomains and a beginning of the path, and the
longest that fits wins. A host with mostly allowed pages is a trusted seed, one with mostly blocked
pages a blocked seed. Trust is the personalised PageRank from the trusted seeds along the links;
distrust is that of the blocked seeds against them, as pages that link to bad hosts are suspect. A
host whose distrust exceeds its trust ``ratio`` times is blocked, for all urls without a rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import LOWER, UPPER, boxed, quoted, stored

#: the inside of a tag, and the host of every absolute link among its attributes
_TAG = "<([^<>]+)"
_LINK = r"""(?i)(?:^|[\s"'/])(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule (host/path) or NULL; ``rules`` is a short list kept in the plan."""
    fits = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fit = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        fits = F.when(fit, F.lit(rule)).otherwise(fits)
    return fits


def host_edges(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """(src, dst, n): links between different hosts, from the absolute links of all pages."""
    tags = F.regexp_extract_all(html, F.lit(_TAG), 1)
    links = F.flatten(F.transform(tags, lambda tag: F.regexp_extract_all(tag, F.lit(_LINK), 1)))
    found = pages.select(host.alias("src"), F.explode(links).alias("dst"))
    found = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) by power iteration.

    ``edges`` (src, dst, n) is followed forwards by trust and backwards by distrust, in proportion to
    n; ``seeds`` (host, good, bad) holds the restart shares of every host. What a host without links
    would pass on returns to the seeds. Each round is stored; it stops when nothing moves by more
    than ``tolerance`` in sum. As a round shrinks what moves by ``damping``, from at most 4, that
    many rounds are enough for every graph; the job fails if ``rounds`` are given that are not.
    """
    if not 0 < damping < 1 or tolerance <= 0:
        raise ValueError("damping lies between 0 and 1, tolerance above 0")
    if rounds is None:
        rounds = math.ceil(math.log(tolerance / 4) / math.log(damping)) + 1 if tolerance < 4 else 1
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    steps = edges.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("ahead"), (F.col("n") / F.col("total")).alias("w"))
    steps = steps.unionByName(
        edges.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(False).alias("ahead"), (F.col("n") / F.col("total")).alias("w"))
    )
    steps = stored(steps, "steps")
    ranks = stored(seeds.select("host", "good", "bad", F.col("good").alias("trust"), F.col("bad").alias("distrust")), "ranks")
    if steps.isEmpty():
        return ranks.select("host", "trust", "distrust")
    for _ in range(rounds):
        share = F.col("w") * F.when(F.col("ahead"), F.col("trust")).otherwise(F.col("distrust"))
        moved = steps.join(ranks, F.col("a") == F.col("host")).groupBy("b").agg(
            F.sum(F.when(F.col("ahead"), share)).alias("t"), F.sum(F.when(~F.col("ahead"), share)).alias("d")
        )
        new = ranks.join(moved, F.col("host") == F.col("b"), "left").select(
            "host", "good", "bad", (damping * F.coalesce("t", F.lit(0.0))).alias("t"), (damping * F.coalesce("d", F.lit(0.0))).alias("d"), "trust", "distrust"
        )
        new = stored(new, "moved")
        sums = new.agg(F.sum("t"), F.sum("d"), F.sum("good"), F.sum("bad")).first()
        back = [(has or 0) - (got or 0) for got, has in ((sums[0], sums[2]), (sums[1], sums[3]))]  # seeds' shares sum to 1 or 0
        new = new.select(
            "host", "good", "bad", (F.col("t") + back[0] * F.col("good")).alias("trust"), (F.col("d") + back[1] * F.col("bad")).alias("distrust"),
            (F.abs(F.col("t") + back[0] * F.col("good") - F.col("trust")) + F.abs(F.col("d") + back[1] * F.col("bad") - F.col("distrust"))).alias("change"),
        )
        ranks = stored(new, "ranks")
        if (ranks.agg(F.sum("change")).first()[0] or 0) <= tolerance:
            break
        ranks = ranks.drop("change")
    else:
        raise RuntimeError(f"trust still moves by more than {tolerance} after {rounds} rounds")
    return ranks.select("host", "trust", "distrust")


def judge(
    pages: DataFrame,
    rules: dict[str, str],
    url_col: str = "url",
    html_col: str = "html",
    ratio: float = 1.0,
    damping: float = 0.85,
    rounds: int | None = None,
    tolerance: float = 1e-6,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust of every url.

    ``rules`` maps host/path to allow or block. Null urls and those without ``://`` have an empty
    host and path and no part in the graph. Hosts that no seed reaches are allowed, as are ties.
    Null and empty html has no links. Repeated rows stay; columns with the new names are replaced.
    """
    new = ("host", "path", "rule", "verdict", "trust", "distrust")
    rows = boxed(pages, *(c for c in new if c not in (url_col, html_col)))
    url, html = F.col(f"row.{quoted(url_col)}"), F.col(f"row.{quoted(html_col)}")
    rows = rows.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule, says in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    rows = rows.withColumn("said", verdict)

    edges = stored(host_edges(rows, F.col("host"), html), "edges")
    own = rows.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("yes"), F.count_if(F.col("said") == "block").alias("no")
    )
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = own.join(linked, "host", "full").select("host", F.expr("coalesce(2 * yes > n, false)").alias("y"), F.expr("coalesce(2 * no > n, false)").alias("x"))
    hosts = stored(hosts, "hosts")
    total = hosts.agg(F.count_if("y"), F.count_if("x")).first()
    seeds = hosts.select(
        "host", (F.col("y").cast("double") / max(1, total[0])).alias("good"), (F.col("x").cast("double") / max(1, total[1])).alias("bad")
    )
    scores = propagate(edges, seeds, damping, rounds, tolerance)
    zero = F.lit(0.0)
    out = rows.join(scores, "host", "left")
    by_method = F.when(F.coalesce("distrust", zero) > ratio * F.coalesce("trust", zero), "block").otherwise("allow")
    kept = [F.col(f"row.{quoted(c)}").alias(c) for c in pages.columns if c not in new]
    return out.select(
        *kept, "host", "path", "rule", F.coalesce("said", by_method).alias("verdict"), F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust")
    )
