"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch candidates, only those run.

Every rule is a regular expression over the host and path, joined (a path is empty or starts with "/", which no host
holds), with the literal tokens that any URL it fits must hold. The rule is
filed under the one of its tokens that fewest URLs hold. Distinct URLs are split into tokens, the tokens are joined with
the index, and regular expressions run on the candidates only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what separates tokens of hosts, paths and rules.
SEPARATORS = r"[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """verdict 'allow' or 'block'; host rules (name like 'example.org/es/') outrank patterns, longer ones shorter ones."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(name: str, verdict: str) -> Rule:
    """A rule for a host, all its subdomains, and the paths that start as given."""
    host, slash, path = name.partition("/")
    escape = lambda s: "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#/" else c for c in s)
    tokens = [t for t in host.split(".") if t]
    # the path's last piece may be a mere prefix of a URL's token ("/en/1" fits "/en/17"), so it is no literal token
    tokens += [t for t in path.split("/")[:-1] if t]
    return Rule(name, verdict, rf"^([^/]*\.)?{escape(host.lower())}{escape(slash + path)}", tuple(dict.fromkeys(tokens)), 1_000_000 + len(name))


def pattern_rule(name: str, verdict: str, pattern: str, tokens: tuple[str, ...], rank: int) -> Rule:
    return Rule(name, verdict, pattern, tokens, rank)


#: The rules of the contract, and a few pattern rules of our own that judge what no host rule fits; without one: allow.
HOST_RULES = (host_rule("org/", "allow"), host_rule("example.org/es/", "block"), host_rule("example.org/en/1", "block"), host_rule("com/fr/", "allow"), host_rule("com/de/", "block"))
PATTERN_RULES = (
    pattern_rule("blog-html", "block", r"^blog\.[^/]*/.*\.html$", ("blog", "html"), 30),
    pattern_rule("mobile-es", "block", r"^m\.[^/]*/es/", ("m", "es"), 20),
    pattern_rule("net-en-9", "block", r"^[^/]*\.net/en/9[0-9]*", ("net", "en"), 10),
)


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.tokens), r.rank) for r in rules], "rule string, verdict string, pattern string, tokens array<string>, rank int")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, rule_verdict): the highest-ranking rule that fits each row's URL, null where none does.

    Null URLs and URLs without '://' have an empty host and path, which no rule with a literal token fits. Repeated rows
    stay; a URL is judged once however many rows have it. Rules without any literal token are candidates for every URL.
    Ties of rank go to the rule first in code-point order. Empty tables give no rows. Rules are a user's list and are
    joined by token; whether they are broadcast is left to Spark's size check.
    """
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    distinct = parsed.select("host", "path").distinct()
    tokens = distinct.withColumn("token", F.explode(F.array_distinct(F.array_append(F.split(F.concat_ws(" ", "host", F.lower("path")), SEPARATORS), F.lit("")))))
    wanted = rules.withColumn("token", F.explode(F.transform("tokens", F.lower)))
    counts = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    filed = wanted.join(counts, "token", "left").groupBy("rule", "verdict", "pattern", "rank").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token"))["token"].alias("token"))
    index = filed.unionByName(rules.where(F.size("tokens") == 0).select("rule", "verdict", "pattern", "rank", F.lit("").alias("token")))
    fits = tokens.join(index, "token").where(F.expr("regexp_like(concat(host, path), pattern)"))
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.col("rank")).alias("rank"), "rule", "verdict")).alias("best"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best")
    judged = parsed.join(best, (parsed["host"] == best["b_host"]) & (parsed["path"] == best["b_path"]), "left")
    return judged.select("id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))
