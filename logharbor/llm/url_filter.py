"""URL rules by hashed expressions.

Each URL is expanded into host suffixes times path prefixes (cut at slashes), each rule
into the one expression it must equal: its host and its path up to the last slash.  Both
meet in an equi-join on the first 32 bits of the expression's SHA-256; then the full
digest and the rest of the rule's path are confirmed, and the longest rule wins, with
the longer host and then ``block`` breaking ties.

Expansion stops at the label and slash counts that occur among the rules (two numbers),
beyond which no rule can fit.  Catalyst broadcasts the rules only while they are small;
otherwise the join shuffles, and a hot expression is split as a skewed key.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and gets the default verdict.  A rule's path is compared as it stands, so ``com/``
does not fit a URL without any path.  Repeated rows keep their count.  An empty page table
gives an empty result, an empty rule table the default for all.  Only the named columns
are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import column_or_null, staged, table

#: The contract's rules.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
DEFAULT = "allow"
PREFIX_HEX = 8


def _lower(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> Column:
    """struct<host, path> of a URL."""
    rest = F.when(
        F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))
    )
    return F.struct(
        F.coalesce(_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (verdict, rule) with their host, path, expression digest and its prefix."""
    cut = F.regexp_extract("rule", "^[^/]*", 0)
    path = F.substring(F.col("rule"), F.length(cut) + 1, F.length("rule"))
    folder = F.regexp_extract(path, "^(?:.*/)?", 0)
    digest = F.sha2(F.concat(_lower(cut), folder), 256)
    return rules.where(F.col("rule").isNotNull()).select(
        F.col("verdict").alias("rule_verdict"),
        "rule",
        _lower(cut).alias("rule_host"),
        path.alias("rule_path"),
        folder.alias("rule_folder"),
        digest.alias("rule_digest"),
        F.substring(digest, 1, PREFIX_HEX).alias("short"),
    )


def _expressions(max_labels: int, max_slashes: int) -> Column:
    labels = F.split(F.col("host"), r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), n - max_labels + 1), n),
        lambda i: F.array_join(F.slice(labels, i, n), "."),
    )
    parts = F.split(F.col("path"), "/", -1)
    slashes = F.least(F.size(parts) - 1, F.lit(max_slashes))
    prefixes = F.transform(
        F.sequence(F.lit(0), slashes),
        lambda j: F.when(j == 0, F.lit("")).otherwise(
            F.concat(F.array_join(F.slice(parts, F.lit(1), j), "/"), F.lit("/"))
        ),
    )
    return F.flatten(
        F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, url, host, path, rule and verdict of each row of ``pages``."""
    known = rule_table(rules)
    limits = known.agg(
        F.max(F.size(F.split("rule_host", r"\.", -1))),
        F.max(F.size(F.split("rule_folder", "/", -1)) - 1),
    ).first()
    max_labels, max_slashes = limits[0] or 1, limits[1] or 0
    rows = pages.select(
        column_or_null(pages, "page_id", "bigint").alias("page_id"),
        column_or_null(pages, "url", "string").alias("url"),
    )
    # each URL is judged once; only its verdict meets the rows that repeat it
    urls = (
        rows.select("url")
        .distinct()
        .withColumn("u", split_url(F.col("url")))
        .select("url", "u.host", "u.path")
    )
    expanded = urls.withColumn(
        "expression", F.explode(_expressions(max_labels, max_slashes))
    ).withColumn("digest", F.sha2("expression", 256))
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith(
        F.col("path"), F.col("rule_path")
    )
    candidate = F.when(
        fits,
        F.struct(
            F.length("rule").alias("rule_length"),
            F.length("rule_host").alias("host_length"),
            (F.col("rule_verdict") == "block").alias("blocks"),
            "rule",
            "rule_verdict",
        ),
    )
    best = (
        expanded.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
        .join(known, "short", "left")
        .groupBy("url", "host", "path")
        .agg(F.max(candidate).alias("best"))
    )
    # written, so that the join with a URL that many rows share can be split
    judged = staged(
        best.select(
            F.col("url").alias("judged_url"),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
        ),
        "judged-urls",
    )
    return rows.join(judged, F.col("url").eqNullSafe(F.col("judged_url"))).drop("judged_url")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    rules = spark.createDataFrame(RULES, "verdict string, rule string")
    return filter_urls(table(spark, sf_dir, "pages"), rules).select(
        "page_id", "host", "path", "rule", "verdict"
    )


_FITS = "(u.host = '{h}' OR ends_with(u.host, '.{h}')) AND starts_with(u.path, '{p}')"


def sql() -> str:
    """The same in plain SQL: rules tried from the longest to the shortest."""
    cases, verdicts = [], []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, slash, path = rule.partition("/")
        fits = _FITS.format(h=host, p=slash + path)
        cases.append(f"WHEN {fits} THEN '{rule}'")
        verdicts.append(f"WHEN {fits} THEN '{verdict}'")
    return f"""
WITH rest AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages
), u AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*'), '{string.ascii_uppercase}',
                   '{string.ascii_lowercase}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
)
SELECT page_id, host, path, CASE {" ".join(cases)} END AS rule,
       CASE {" ".join(verdicts)} ELSE '{DEFAULT}' END AS verdict
FROM u"""
