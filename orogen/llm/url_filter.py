"""URL filters: expand each URL into host suffixes and path prefixes, look the expressions up by hash.

An expression is a host suffix followed by a path prefix, as in example.org/en/. Rules are looked up
by an equi-join on the first 32 bits of the expression's digest; the full digest confirms a hit, and
of several hits the longest rule wins. URLs are reduced to their distinct (host, short path) pairs
before they are expanded, so a host with a third of all rows is expanded once per path prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hot_join, materialize

#: (verdict, expression); fixed by the task.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: What a URL gets that no rule fits: a block list lets the rest pass.
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. Null, or no '://': both empty."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.regexp_replace(text, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _digest(expression: Column) -> list[Column]:
    full = F.sha2(expression, 256)
    return [F.substring(full, 1, 8).alias("prefix"), full.alias("digest")]


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict to pages, one row out per row in.

    rules: verdict, rule (host, then path from its first '/'). A rule fits its host and all
    subdomains if the path starts with the rule's path; the longest rule wins, and of two equal ones
    'block'. No rule: rule is null and the verdict is the default. Null or malformed URLs have an
    empty host and path, which only an equal rule can fit. Columns of pages named like the added ones
    are replaced. Path prefixes are cut only at lengths that some rule has, of which there are at most as
    many as the longest rule has characters.
    """
    sizes = rules.where("rule is not null").select((F.length("rule") - F.instr("rule", "/") + 1).alias("n")).distinct()
    lengths = sorted(r["n"] for r in sizes.collect())
    host, path = split_url(F.col(url))
    own = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    given = pages.select(F.struct(*own).alias("row"), host.alias("host"), path.alias("path")).withColumn("short", F.substring("path", 1, max(lengths, default=0)))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.split(F.lit(",".join(map(str, lengths))), ",").cast("array<int>") if lengths else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(cuts, lambda n: n <= F.length("short")), lambda n: F.substring(F.col("short"), F.lit(1), n))
    counted = materialize(given.groupBy("host", "short").agg(F.count(F.lit(1)).alias("n")), "url-keys")
    tried = (
        counted.withColumn("suffix", F.explode(suffixes))
        .withColumn("cut", F.explode(prefixes))
        .withColumn("expression", F.concat("suffix", "cut"))
        .select("host", "short", "n", *_digest(F.col("expression")))
    )
    listed = rules.where("rule is not null").select(F.col("rule"), F.col("verdict"), *_digest(F.col("rule")))
    hits = tried.join(listed, "prefix").where(tried["digest"] == listed["digest"])
    best = hits.groupBy("host", "short").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule"))).alias("best"), F.max("n").alias("n"))
    # hosts with many of the pages get their rule by broadcast
    out = hot_join(given, materialize(best, "url-best"), ["host", "short"], counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], how="left")
    return out.select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u
), r(verdict, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), keys AS (
  SELECT DISTINCT host, path FROM p
), best AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM keys, r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2
)
SELECT page_id, p.host AS host, p.path AS path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON best.host = p.host AND best.path = p.path
"""
