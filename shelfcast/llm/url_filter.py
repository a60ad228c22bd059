"""URL filter: rules indexed by their rarest literal token; a URL's tokens fetch the rules worth running.

A rule has a host, a path prefix and a verdict and fits the host and all its subdomains where the
path starts with the prefix. Its literal tokens are the runs of letters and digits that are whole
in the rule (the last run of a path prefix is not: the URL may go on). Each rule is filed under the
one of its tokens that the fewest URLs carry; a rule without tokens is filed under the empty token,
which every URL fetches. Only fetched rules run their regular expression; the longest that fits wins.

The list of rules is an argument of at most ``MAX_INLINE`` entries and travels inside the plan as a
map, so a URL is judged in its scan task without a shuffle. A longer list is judged in blocks of that
size, one after another over the same row, and gives the same answer. Only built-in expressions run.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_INLINE = 512
RULE_TYPE = "array<struct<size:int,pattern:string,rule:string,verdict:string>>"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Regular expression over host and path put together; the host ends at the first slash."""
        return f"^(?:[^/]*\\.)?\\Q{self.host}\\E\\Q{self.path}\\E" if self.path else f"^(?:[^/]*\\.)?\\Q{self.host}\\E(?:/|$)"

    @property
    def tokens(self) -> list[str]:
        text = self.name if self.path else self.host + "/"
        return sorted({t for t in re.split("[^0-9A-Za-z]+", text)[:-1] if t})


#: The rules of the query, as its contract states them.
PAGE_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty without ``://`` or for null."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, ascii_uppercase, ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct literal tokens; the empty one is always among them."""
    split = F.split(F.concat(host, path), "[^0-9A-Za-z]+")
    return F.array_distinct(F.concat(split, F.array(F.lit(""))))


def token_counts(urls: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """How many URLs carry each of the given tokens: one row per token comes back."""
    wanted = F.array(*[F.lit(t) for t in tokens]) if tokens else F.array().cast("array<string>")
    found = urls.select(F.explode(F.array_intersect("tokens", wanted)).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def index_rules(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Each rule under its rarest token; ties go to the longer, then the smaller token."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        best = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        index.setdefault(best, []).append(rule)
    return index


def _fetched(index: dict[str, list[Rule]]) -> Column:
    """The rules that the row's tokens fetch."""
    pairs = []
    for token, rules in index.items():
        listed = F.array(*[F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.pattern).alias("pattern"), F.lit(r.name).alias("rule"),
                                    F.lit(r.verdict).alias("verdict")) for r in rules])
        pairs += [F.lit(token), listed]
    table = F.create_map(*pairs)
    hits = F.filter(F.transform("tokens", lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull())
    return F.flatten(hits)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``pages`` that do not clash, with ``host``, ``path``, ``rule`` and ``verdict`` added.

    ``rule`` is null and ``verdict`` is ``default`` where no rule fits. Null, empty and odd URLs have an
    empty host and path, which no rule fits. Repeated rows are judged one by one. Of fitting rules with
    equal length the greater (pattern, rule, verdict) wins. An input column named like an added one is replaced.
    """
    added = {"host", "path", "rule", "verdict"}
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in added]
    host, path = url_host(F.col(f"`{url_col}`")), url_path(F.col(f"`{url_col}`"))
    named = pages.select(F.struct(*keep).alias("row"), host.alias("host"), path.alias("path"))
    urls = named.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    counts = token_counts(urls, sorted({t for r in rules for t in r.tokens}))
    best = F.lit(None).cast("struct<size:int,pattern:string,rule:string,verdict:string>")
    judged = urls.withColumn("best", best)
    for at in range(0, len(rules), MAX_INLINE):
        index = index_rules(rules[at:at + MAX_INLINE], counts)
        whole = F.concat("host", "path")
        fit = F.filter(_fetched(index).cast(RULE_TYPE), lambda r: F.rlike(whole, r["pattern"]))
        judged = judged.withColumn("best", F.array_max(F.concat(F.array("best"), fit)))
    return judged.select("row.*", "host", "path", F.col("best.rule").alias("rule"),
                         F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT u.page_id, u.host, u.path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS v
  FROM u JOIN r ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)
  GROUP BY u.page_id, u.host, u.path)
SELECT u.page_id, u.host, u.path, m.rule AS rule, coalesce(m.v, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id AND u.host = m.host AND u.path = m.path
"""


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, PAGE_RULES).drop("url")
