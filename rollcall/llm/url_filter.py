r"""URL filtering by pattern rules indexed by their rarest literal token.

A rule has a host and a path prefix, or a pattern with ``*``. Each rule is one
regular expression over ``host || path``. Its literal tokens (runs of letters,
digits and bytes over 0x7F that the rule bounds on both sides) are counted over
all URLs, and the rule is filed under the rarest. A URL looks up its own tokens
and runs the regular expressions of the rules found there, no others. A rule
without a literal token is filed under the empty token, which each URL has.

Everything is DataFrame work: distinct URLs are exploded into tokens, joined
with the rule index, tested, and reduced to the best rule by ``max``. A URL that
makes up a third of all rows is judged once; the verdicts are checkpointed, so that
the join back to the rows is one of plain exchanges whose hot partitions AQE can split.

Defined results: null, empty or ``://``-less URLs have empty host and path and
get the default verdict; URLs of any length are judged whole; repeated rows are all
returned; among rules of equal length that fit, block wins, then the greater rule
string; rules tied on their rarest token are filed under the least; extra columns
are kept, but for those named as the four that are added; an empty table gives no
rows, and without rules every URL gets the default verdict.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, table

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
TOKEN = WORD + "+"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: An index of at most this many rules is broadcast; a larger one is shuffled.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` (with ``*``) is matched anywhere in host || path, and only if host is empty."""

    action: str
    host: str = ""
    path: str = ""
    pattern: str = ""

    def __post_init__(self):
        if self.path and self.path[0] != "/":
            raise ValueError(f"a path starts with a slash: {self.path!r}")

    @property
    def text(self) -> str:
        return self.pattern or self.host + self.path

    @property
    def regex(self) -> str:
        quote = lambda s: re.sub(f"({BREAK})", r"\\\1", s)
        if self.pattern:
            # the first place of each part behind the one before is as good as any: no way back, so a long URL takes one pass
            return "(?s)^" + "".join(f"(?>.*?{quote(part)})" for part in self.pattern.split("*") if part)
        return rf"(?s)^(?:[^/]*\.)?{quote(self.host)}" + (quote(self.path) or r"(?=/|\z)")

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that must appear as whole tokens in any URL that fits."""
        if self.pattern:
            whole = rf"(?<=(?!\*){BREAK}){TOKEN}(?=(?!\*){BREAK})"
            return sorted(set(re.findall(whole, self.pattern)))
        return sorted({*re.findall(TOKEN, self.host), *re.findall(rf"{TOKEN}(?={BREAK})", self.path)})


#: Fixed values of the query op1_url_filter.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def parsed(urls: DataFrame) -> DataFrame:
    """Adds host (between ``://`` and the first of / ? #, A-Z lower-cased) and path (from there up to ? or #)."""
    rest = F.when(F.locate("://", F.col("url")) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumn("host", ascii_lower(host)).withColumn("path", path)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.action, r.text, r.regex, t) for i, r in enumerate(rules) for t in r.tokens or [""]]
    return spark.createDataFrame(rows, "rule_id int, action string, rule string, regex string, token string")


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Each row of ``pages`` (with ``url``) with host, path, rule and verdict added."""
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    urls = parsed(pages.select("url").where(F.col("url").isNotNull()).distinct())
    index = rule_table(spark, rules)
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    # rules are few words against all URLs' tokens: count those only, then take each rule's rarest
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.concat("host", F.lit("/"), "path"), F.lit(f"({TOKEN})"), 1)))
    exploded = urls.select("url", F.concat("host", "path").alias("target"), F.explode(tokens).alias("token"))
    counts = exploded.join(index.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        index.join(counts, "token", "left")
        .groupBy("rule_id")
        .agg(F.min_by(F.struct("action", "rule", "regex", "token"), F.struct(F.coalesce("n", F.lit(0)), "token")).alias("r"))
        .select("r.*")
    )
    if len(rules) <= BROADCAST_RULES:
        rarest = F.broadcast(rarest)
    best = (
        exploded.join(rarest, "token")
        .where(F.expr("regexp_like(target, regex)"))
        .groupBy("url")
        .agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "block").alias("b"), "rule", "action")).alias("best"))
        .select("url", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    )
    best = checkpointed(best, thin=True)
    out = parsed(pages.select(*keep)).join(best, "url", "left")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(*keep, "host", "path", "rule", "verdict")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM u
), q AS (
  SELECT page_id,
    translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM p
), r(rhost, rpath, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT q.page_id, q.host, q.path, r.rhost || r.rpath AS rule, r.action,
    row_number() OVER (PARTITION BY q.page_id, q.host, q.path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM q LEFT JOIN r ON (q.host = r.rhost OR right(q.host, length(r.rhost) + 1) = '.' || r.rhost) AND starts_with(q.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
