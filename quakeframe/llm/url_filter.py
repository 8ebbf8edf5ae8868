"""URL filters whose regular expressions run on fetched candidates only, in SQL.

Each pattern rule names literal tokens that any URL it fits must hold.  Tokens are
counted over all distinct URLs; a rule is indexed by its rarest one.  A URL's tokens
fetch the rules indexed by them and only those rules' expressions run; of the rules that
fit, the longest wins.  A rule without such a token runs on every URL.  Where none fits, the pattern rules of the method (DEFAULT_RULES)
decide in the same way, and at last the default verdict.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no
rule; equal URLs get equal verdicts; pages with a null id are returned as they are; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN_BREAK = "[./:_-]+"


@dataclass(frozen=True)
class Rule:
    """tier 0 rules win over tier 1; size ranks within a tier."""

    name: str | None
    tier: int
    size: int
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def prefix_rule(text: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the path starts so.

    A token that the path's end may cut short (``/en/7`` also fits ``/en/71``) isn't one
    that a URL must hold whole, so it doesn't index the rule.
    """
    host, slash, rest = text.partition("/")
    pieces = re.split(TOKEN_BREAK, slash + rest)
    tokens = [x for x in re.split(TOKEN_BREAK, host) + pieces[:-1] if x]
    return Rule(text, 0, len(text), verdict, rf"^([^/]*\.)?{re.escape(host)}{re.escape(slash + rest)}", tuple(dict.fromkeys(tokens)))


#: The contract's rules.
PREFIX_RULES = (
    prefix_rule("com/en/", "block"),
    prefix_rule("example.com/en/7", "allow"),
    prefix_rule("net/de/", "allow"),
    prefix_rule("example.net/de/8", "block"),
    prefix_rule("org/es/", "block"),
)


def word_rule(word: str) -> Rule:
    """A pattern rule of the method: the word as a whole token of host or path; a word with breaks is several tokens."""
    tokens = tuple(dict.fromkeys(x for x in re.split(TOKEN_BREAK, word) if x))
    return Rule(None, 1, len(word), "block", rf"(^|[./:_-]){re.escape(word)}([./:_-]|$)", tokens)


#: The method's own rules, for URLs that no listed rule fits.
DEFAULT_RULES = tuple(word_rule(x) for x in ("casino", "poker", "porn", "xxx", "viagra", "warez", "torrent"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """A row for each token; a rule that names none stands under the empty token, which every URL then has."""
    rows = [(i, r.name, r.tier, r.size, r.verdict, r.pattern, t) for i, r in enumerate(rules) for t in r.tokens or ("",)]
    return spark.createDataFrame(rows, "rule_id int, name string, tier int, size int, verdict string, pattern string, token string")


def indexed_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule once, under that of its tokens which fewest URLs hold (ties: first token)."""
    counts = urls.select(F.explode("tokens").alias("token")).join(rules.select("token").distinct(), "token")
    counts = counts.groupBy("token").count()
    held = rules.join(counts, "token", "left").withColumn("held", F.struct(F.coalesce("count", F.lit(0)), "token"))
    first = held.groupBy("rule_id").agg(F.min_by(F.struct("token", "name", "tier", "size", "verdict", "pattern"), "held").alias("r"))
    return first.select("rule_id", "r.*")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = PREFIX_RULES + DEFAULT_RULES, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    seen = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = seen.where("url is not null").select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    tokens = F.array_distinct(F.split(F.concat("host", "path"), TOKEN_BREAK))
    if any(not r.tokens for r in rules):
        tokens = F.array_union(tokens, F.array(F.lit("")))
    urls = urls.select("url", F.concat("host", "path").alias("place"), tokens.alias("tokens"))
    urls = durable(urls)
    index = durable(indexed_rules(urls, rule_table(spark, rules)))
    fetched = urls.select("url", "place", F.explode("tokens").alias("token")).join(index, "token").where("place rlike pattern")
    rank = F.struct(-F.col("tier"), F.col("size"), -F.col("rule_id"))
    verdicts = fetched.groupBy("url").agg(F.max_by(F.struct("name", "verdict"), rank).alias("won"))
    # Null URLs have no verdict of their own and stay out of the join, where they would meet in one task.
    judged = seen.where("url is not null").join(verdicts, "url", "left").unionByName(seen.where("url is null"), allowMissingColumns=True)
    return judged.select(
        "page_id", host.alias("host"), path.alias("path"), F.col("won.name").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict")
    )
