"""URL filters: host-suffix and path-prefix expressions, short hash prefixes,
full digests, rule precedence. DataFrame functions only.

Every distinct (host, path) is expanded into (host suffix + path prefix)
expressions, the prefixes ending at a slash (or empty). A rule is keyed by its
host and the longest such prefix of its path. Both sides carry a SHA-256; the
equi-join runs on its first 4 bytes, then the full digest, the whole rule path
and precedence are confirmed. Expressions with more labels or slashes than
any rule has cannot match, so they are not made.

Precedence: the longest host + path wins; at equal length the longer host,
then block before allow. Without a fitting rule the verdict is ``default``.

Defined cases: a null url or one without ``://`` has empty host and path and
no rule; an empty path fits only rules with an empty path; repeated rows and
null page ids each keep their row; an empty table or rule list gives an empty
result or all default. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import lower_ascii, materialise

#: Fixed values of the query: (action, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
PREFIX_HEX = 8


def url_parts(url) -> tuple:
    """(host, path) columns of a url column."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "action string, rule_host string, rule_path string")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Winning rule per (host, path): columns host, path, rule, action."""
    key_path = F.regexp_extract("rule_path", r"(?s)^(.*/)", 1)
    keyed = rules.select(
        "action", "rule_host", "rule_path",
        F.sha2(F.concat("rule_host", key_path), 256).alias("rule_digest"))
    most = rules.agg(F.max(F.size(F.split("rule_host", r"\."))),
                     F.max(F.size(F.split("rule_path", "/")) - 1)).first()
    labels, depth = (most[0] or 0), (most[1] or 0)
    u = urls.select("host", "path").distinct()
    u = u.withColumn("l", F.split("host", r"\.")).withColumn("p", F.split("path", "/"))
    u = u.withColumn("suffix", F.explode(F.expr(
        f"transform(sequence(greatest(1, size(l) - {labels} + 1), size(l)), i -> array_join(slice(l, i, size(l)), '.'))")))
    u = u.withColumn("prefix", F.explode(F.expr(
        "concat(array(''), if(size(p) < 2, cast(array() as array<string>), "
        f"transform(sequence(1, least(size(p) - 1, {max(depth, 1)})), i -> concat(array_join(slice(p, 1, i), '/'), '/'))))")))
    u = u.select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
    hit = u.withColumn("short", F.substring("digest", 1, PREFIX_HEX)).join(
        keyed.withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX)), "short")
    hit = hit.filter((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = hit.groupBy("host", "path").agg(F.max(F.struct(
        F.length(rule).alias("n"), F.length("rule_host").alias("h"), (F.col("action") == "block").alias("b"),
        rule.alias("rule"), F.col("action").alias("action"))).alias("best"))
    return best.select("host", "path", "best.rule", "best.action")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    host, path = url_parts(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    best = materialise(match_rules(own, rules), "url-rules")     # written: the join can split a hot url
    return own.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


ORACLE = r"""
WITH rules(action, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
parts AS (
  SELECT row_number() OVER () AS k, page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
ranked AS (
  SELECT k, rh || rp AS rule, action,
    row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC, length(rh) DESC, action DESC) AS r
  FROM parts JOIN rules
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (k)
"""
