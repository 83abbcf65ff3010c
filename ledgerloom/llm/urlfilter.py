"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over host and path, with the literal tokens (runs of letters and digits) that any
match must contain. The tokens' frequencies are counted over the URLs, each rule is filed under its rarest one, and a
URL fetches by equality the rules filed under its own tokens; only those are run. The rules that fit are ranked by
length. A rule without a literal token has to be run on every URL.

Tokens are counted before they are joined, and rules meet URLs in an ordinary equality join, so a frequent token that a
rule must be filed under (a bare top-level domain) is split like any hot key, or the rules are broadcast where Spark
finds them small. Null URLs and those without `://` have empty host and path, and are allowed. Repeated rows are judged
each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """`name` is reported for the rules a caller states; words that only flag a host have none."""

    verdict: str
    name: str | None
    pattern: str
    tokens: list[str]
    rank: int


TOKEN = "[0-9A-Za-z]+"

# Words that mark a host as unwanted where no stated rule fits.
FLAGGED_WORDS = ("adult", "casino", "gambling", "malware", "phishing", "pills", "porn", "spam", "torrent", "warez", "xxx")


def prefix_rule(verdict: str, rule: str) -> Rule:
    """A host and all its subdomains, with paths that start as the rule's: `example.org/es/`."""
    host, _, path = rule.partition("/")
    tokens = re.findall(TOKEN, host) + re.findall(f"{TOKEN}(?=[^0-9A-Za-z])", path)
    return Rule(verdict, rule, f"^([^/]*\\.)?{re.escape(host)}/{re.escape(path)}", tokens, len(rule))


def flagged_word(word: str) -> Rule:
    """A host with this word between other characters than letters and digits."""
    return Rule("block", None, f"^([^/]*[^0-9a-z/])?{word}([^0-9a-z]|$)", [word], 0)


STATED = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def default_rules() -> list[Rule]:
    return [prefix_rule(*r) for r in STATED] + [flagged_word(w) for w in FLAGGED_WORDS]


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", group)


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """row, page_id, host, path, rule, verdict of every row of `pages` (page_id, url)."""
    spark = pages.sparkSession
    host = F.translate(_part(F.col("url"), 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), _part(F.col("url"), 2).alias("path"))
    urls = urls.withColumn("target", F.concat("host", "path"))
    tokens = F.array_distinct(F.regexp_extract_all("target", F.lit(f"({TOKEN})"), 1))

    listed = [(i, *r) for i, r in enumerate(default_rules() if rules is None else rules)]
    table = spark.createDataFrame(listed, "id int, verdict string, name string, pattern string, tokens array<string>, rank int")
    literal = table.select("id", F.explode("tokens").alias("token"))
    seen = urls.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        literal.join(seen, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r")).select("id", F.col("r.token").alias("token"))
    )
    filed = table.drop("tokens").join(rarest, "id", "left").withColumn("token", F.coalesce("token", F.lit("")))

    # The empty token stands for rules that have none, and keeps URLs without tokens.
    fetched = urls.withColumn("token", F.explode(F.concat(F.array(F.lit("")), tokens))).join(filed, "token", "left")
    fits = F.col("pattern").isNotNull() & F.expr("target RLIKE pattern")
    best = F.max(F.when(fits, F.struct(F.col("name").isNotNull().alias("stated"), "rank", F.length("pattern").alias("size"), "name", "verdict")))
    judged = fetched.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return judged.select("row", "page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
