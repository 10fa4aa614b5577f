"""URL rules indexed by their rarest literal token.

Every rule is a regular expression over host and path together with literal
tokens that each matching URL must hold (host labels and whole path segments).
Each rule is filed under that one of its tokens which the fewest URLs of the
table hold. URL tokens fetch their rules by a join, and only those rules run
their expressions, once per distinct host and path.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofspark.llm.common import column_of

MAX_BROADCAST_RULES = 100_000
"""Larger rule lists are joined by shuffle."""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_pattern(rule: Rule) -> str:
    r"""Matches host and path of the rule's host and its subdomains where the path starts with the rule's."""
    return rf"^(?:[^/?#]*\.)?\Q{rule.host}\E\Q{rule.path}\E" if rule.path else rf"^(?:[^/?#]*\.)?\Q{rule.host}\E(?:/|$)"


def rule_tokens(rule: Rule) -> list[str]:
    """Tokens that a matching URL must hold: host labels, and path segments closed by a slash."""
    return [f"h:{x}" for x in rule.host.split(".") if x] + [f"p:{x}" for x in rule.path.split("/")[1:-1] if x]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def url_tokens(host: Column, path: Column) -> Column:
    segments = F.filter(F.split(path, "/", -1), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.transform(F.filter(F.split(host, r"\.", -1), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)),
            F.transform(segments, lambda x: F.concat(F.lit("p:"), x)),
        )
    )


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row per rule: id, text, verdict, pattern, tokens."""
    rows = [
        F.struct(
            F.lit(i).alias("rule_id"),
            F.lit(r.text).alias("rule"),
            F.lit(r.verdict).alias("verdict"),
            F.lit(rule_pattern(r)).alias("pattern"),
            F.array(*[F.lit(t) for t in rule_tokens(r)]).alias("tokens"),
        )
        for i, r in enumerate(rules)
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def rarest_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Rules with the one of their tokens that the fewest distinct (host, path) hold."""
    wanted = rules.select("rule_id", F.explode("tokens").alias("token"))
    used = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi")
    counts = used.groupBy("token").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.coalesce("n", F.lit(0)), "token"))
    best = wanted.join(counts, "token", "left").withColumn("k", first).filter("k = 1").select("rule_id", "token")
    return rules.drop("tokens").join(best, "rule_id")


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict per page.

    Among the rules that fit, the longest text wins; of equally long ones the
    longer path, then ``block``. Without a fitting rule the rule is null and the
    verdict is ``default``. Null urls, and urls without ``://``, have empty host
    and path. Every row appears, equal rows too; other columns are not read.
    """
    spark = pages.sparkSession
    host, path = split_url(column_of(pages, url))
    rows = pages.select(column_of(pages, id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = rows.select("host", "path").distinct().withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    index = rarest_index(rule_table(spark, rules), urls)
    if len(rules) <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    fetched = urls.select("host", "path", F.explode("tokens").alias("token")).join(index, "token")
    fits = fetched.filter(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    order = F.struct(F.length("rule"), F.length("rule") - F.instr("rule", "/"), F.col("verdict") == "block", "rule")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(order.alias("o"), "rule", "verdict")).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
