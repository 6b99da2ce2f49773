"""URL rules, and trust and distrust that spread over links between hosts. Built of DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.llm.common import checkpointed, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ://, up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; rules: (verdict, host, path), a list short enough to be written in a plan."""
    table = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules])
    fits = F.filter(table, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(fits)


def link_edges(pages: DataFrame, host: Column, html: str = "html") -> DataFrame:
    """(source, target, n): links between different hosts. A relative link stays on its host and makes no edge."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    found = pages.select(host.alias("source"), F.explode(F.transform(links, lambda u: F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("x:"), u)).otherwise(u))).alias("link"))
    target, _ = host_and_path(F.col("link"))
    found = found.select("source", target.alias("target")).filter((F.col("source") != F.col("target")) & (F.col("target") != "") & (F.col("source") != ""))
    return found.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, least: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) of every host that is a seed or is reached.

    seeds: (host, trusted, blocked), the shares of each host in both restarts. Trust is a PageRank that restarts at trusted
    hosts and follows links; distrust restarts at blocked hosts and runs against links. Mass without a way on returns to the
    seeds. Rounds go on until no host's score moves by more than `least` of itself, so that the furthest host reached counts
    like the nearest; damping ends them, or `rounds` if given. Moves below 1e-300 don't count, as doubles end there. Every
    round is written to the checkpoint folder; only three numbers reach the driver. Partial sums precede each shuffle, so a host with most links is no hot spot.
    """
    out = edges.groupBy("source").agg(F.sum("n").alias("all_out"))
    into = edges.groupBy("target").agg(F.sum("n").alias("all_in"))
    weighted = checkpointed(edges.join(out, "source").join(into, "target").select("source", "target", (F.col("n") / F.col("all_out")).alias("ahead"), (F.col("n") / F.col("all_in")).alias("back")))
    ways = weighted.select(F.col("source").alias("host"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(weighted.select("target", F.lit(0), F.lit(1))).groupBy("host").agg(F.max("a").alias("leads"), F.max("b").alias("led"))
    nodes = seeds.join(ways, "host", "full").na.fill(0)
    scores = checkpointed(nodes.select("host", "trusted", "blocked", "leads", "led", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust")))
    linked = not weighted.isEmpty()
    share = lambda new, was: F.when(F.abs(F.col(new) - F.col(was)) > 1e-300, F.abs(F.col(new) - F.col(was)) / F.greatest(new, was)).otherwise(0.0)
    done = 0
    while linked and (rounds is None or done < rounds):
        done += 1
        lost = scores.agg(F.sum(F.when(F.col("leads") == 0, F.col("trust")).otherwise(0.0)), F.sum(F.when(F.col("led") == 0, F.col("distrust")).otherwise(0.0))).first()
        held = scores.select(F.col("host"), "trust", "distrust")
        sent = weighted.join(held.select(F.col("host").alias("source"), "trust"), "source").select(F.col("target").alias("host"), (F.col("trust") * F.col("ahead")).alias("t"), F.lit(0.0).alias("d"))
        sent = sent.union(weighted.join(held.select(F.col("host").alias("target"), "distrust"), "target").select(F.col("source").alias("host"), F.lit(0.0), F.col("distrust") * F.col("back")))
        got = sent.groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        fresh = scores.join(got, "host", "left").select(
            "host", "trusted", "blocked", "leads", "led", F.col("trust").alias("was_t"), F.col("distrust").alias("was_d"),
            (F.lit(1 - damping) * F.col("trusted") + F.lit(damping) * (F.coalesce("t", F.lit(0.0)) + F.lit(lost[0] or 0.0) * F.col("trusted"))).alias("trust"),
            (F.lit(1 - damping) * F.col("blocked") + F.lit(damping) * (F.coalesce("d", F.lit(0.0)) + F.lit(lost[1] or 0.0) * F.col("blocked"))).alias("distrust"),
        )
        scores = checkpointed(fresh)
        moved = scores.agg(F.max(F.greatest(share("trust", "was_t"), share("distrust", "was_d")))).first()[0] or 0.0
        if moved <= least:
            break
    return scores.select("host", "trust", "distrust")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], threshold: float = 0.5, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, distrust) of every page.

    The longest fitting rule decides. Other pages get their host's verdict: block where distrust / (trust + distrust) is at
    least `threshold`, allow elsewhere and where neither score arrives. A host is a seed on the side that rules give more
    than half of its pages. A null URL or one without :// has an empty host and path, and is allowed; null pages have no
    links. Repeated rows are judged alike. Other columns are not read.
    """
    host, path = host_and_path(F.col(url))
    urls = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("fit", first_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))
    counts = checkpointed(urls.filter("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("a"), F.count(F.when(F.col("ruled") == "block", 1)).alias("b")))
    sums = counts.agg(F.count(F.when(F.col("a") * 2 > F.col("n"), 1)), F.count(F.when(F.col("b") * 2 > F.col("n"), 1))).first()
    share = lambda c, n: F.when(F.col(c) * 2 > F.col("n"), F.lit(1.0 / max(n, 1))).otherwise(0.0)
    seeds = counts.select("host", share("a", sums[0]).alias("trusted"), share("b", sums[1]).alias("blocked"))
    scores = propagate(checkpointed(link_edges(pages, host, html)), seeds)
    ratio = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    verdicts = scores.select("host", F.when(F.col("trust") + F.col("distrust") > 0, ratio).alias("distrust"))
    judged = urls.join(small(verdicts, scores.count()), "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("distrust") >= threshold, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "distrust")
