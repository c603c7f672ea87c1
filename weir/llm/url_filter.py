"""URL filters: rules first, then trust propagated over the link graph of hosts.

Native: DataFrame functions only. Host edges come from the pages' links; trust starts at hosts
that allow rules name, distrust at hosts that block rules name and runs against the links; both
are personalised PageRank. A host with more distrust than trust, beyond a margin, is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import Scratch, lower_ascii

#: (rule, verdict), in the order of the contract.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING = 0.85
ROUNDS = 12
#: Rounds between written tables: lineage stays short, and small graphs don't pay a job a round.
ROUNDS_A_TABLE = 4
#: Distrust must exceed trust by so much of one seed's weight, however many seeds there are.
MARGIN = 1e-4


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for urls without ://."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return host, path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits a host or its subdomains and begins the path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # longer ones stand outside
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between hosts, counted. Relative links stay on their host."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    targets = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    link = F.col("link")
    dst = (
        F.when(link.rlike(r"^(?i)https?://"), lower_ascii(F.regexp_extract(link, r"^(?i)https?://([^/?#]*)", 1)))
        .when(link.startswith("//"), lower_ascii(F.regexp_extract(link, r"^//([^/?#]*)", 1)))
        .when(link.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), F.lit(""))  # mailto:, javascript:
        .otherwise(F.col("host"))
    )
    # a page's links are collapsed to hosts before anything is shuffled
    links = pages.select(url_parts(F.col("url"))[0].alias("host"), F.explode(targets).alias("link"))
    return links.select(F.col("host").alias("src"), dst.alias("dst")).where("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def pagerank(edges: DataFrame, seeds: DataFrame, scratch: Scratch, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, score: personalised PageRank from seeds (host, weight), weights scaled to sum 1.

    src, dst, n of edges: a source deals its score by n; a host without out-links keeps none, its
    mass is lost. Sums are combined before each shuffle, every few rounds are written to the
    shared folder, and hosts number far fewer than pages.
    """
    total = seeds.agg(F.sum("weight")).first()[0] or 0.0
    start = scratch.table(seeds.where(F.lit(total > 0)).select("host", (F.col("weight") / F.lit(total or 1.0)).alias("score")))
    out_n = edges.groupBy("src").agg(F.sum("n").alias("out_n"))
    shares = scratch.table(edges.join(out_n, "src").select("src", "dst", (F.col("n") / F.col("out_n")).alias("share")))
    score = kept = start
    for done in range(1, rounds + 1):
        flow = shares.join(score.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * F.lit(damping)).alias("score"))
        jump = start.select("host", (F.col("score") * F.lit(1 - damping)).alias("score"))
        score = flow.unionByName(jump).groupBy("host").agg(F.sum("score").alias("score"))
        if done % ROUNDS_A_TABLE == 0 or done == rounds:
            score = scratch.table(score)
            if kept is not start:
                scratch.drop(kept)
            kept = score
    return score


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, rounds: int = ROUNDS, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row.

    A rule's verdict holds; without one, a page is blocked if its host's distrust exceeds its
    trust by the margin, and allowed otherwise (also without host or links). Both are compared
    times the seeds' total weight, so that other hosts' seeds don't thin them; the columns sum to 1. Seeds are weighted
    by the share of a host's pages that rules allow or block. Rows are neither dropped nor
    merged; null urls have empty host and path; null html has no links.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    edges = scratch.table(host_edges(pages))
    seeds = scratch.table(rows.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("allow"), F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("block")))
    trust = pagerank(edges, seeds.where("allow > 0").select("host", F.col("allow").alias("weight")), scratch, rounds)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = pagerank(turned, seeds.where("block > 0").select("host", F.col("block").alias("weight")), scratch, rounds)
    scores = scratch.table(
        trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
        .groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    )
    totals = seeds.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    scratch.drop(edges, seeds)
    n = scores.count()
    from weir.llm.common import small

    joined = rows.join(small(scores, n), "host", "left")
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(d * F.lit(totals.block or 0.0) > t * F.lit(totals.allow or 0.0) + margin, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), t.alias("trust"), d.alias("distrust"))


def op9(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
