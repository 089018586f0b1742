"""Quality rules judged by host.

1. Every document is measured in its own row: words, symbols, repeated lines, words in
   repeated windows.  No shuffle, no Python.
2. Rule failures are summed by host (``source``), map-side first, so a host with a third
   of all rows costs one row per task.
3. A beta prior is fitted to the hosts' failure rates by moments, per rule; each host's
   rate is shrunk to it.  A rule is enforced on hosts whose shrunk rate exceeds
   ``tolerance``; elsewhere a lone failure is taken as an accident.
4. The verdicts, one row per host, are joined back to the measured rows; every row is kept
   or dropped by its own measurements.

Defined results: a null text has no words and fails the base rule.  Null hosts form one
host of their own.  Repeated rows are judged row by row, each counts for its host.  An
empty table gives an empty result.  Only the named columns are read, extra ones and
clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import bind, column_or_null, staged, table, total, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

#: Document rules: a failure is an expression over the measurements.
RULES = ("symbols", "lines", "shape")


def _covered(hashes: Column, width: int) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def flagged(s: Column) -> Column:
        def twin(j: Column, by: int, h: Column) -> Column:
            return F.coalesce(F.get(s, j + F.lit(by))["h"] == h, F.lit(False))

        hits = F.transform(
            s, lambda e, j: F.when(twin(j, -1, e["h"]) | twin(j, 1, e["h"]), e["i"])
        )
        return F.sort_array(F.filter(hits, lambda i: i.isNotNull()))

    def length(f: Column) -> Column:
        step = F.transform(
            f,
            lambda i, j: F.least(
                F.lit(width), F.coalesce(F.get(f, j + F.lit(1)) - i, F.lit(width))
            ),
        )
        return total(step)

    return bind(bind(ordered, flagged), length)


def _repeated_words(words: Column, width: int) -> Column:
    n = F.size(words)
    singles = F.transform(words, lambda w: F.xxhash64(w))
    hashes = bind(
        singles,
        lambda a: F.transform(
            F.sequence(F.lit(0), n - F.lit(width)),
            lambda i: F.xxhash64(*(F.get(a, i + F.lit(j)) for j in range(width))),
        ),
    )
    return F.when(n <= width, F.lit(0).cast("bigint")).otherwise(
        bind(
            hashes,
            lambda h: F.when(
                F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")
            ).otherwise(_covered(h, width)),
        )
    )


def measure(docs: DataFrame, window: int = WINDOW, beside: Sequence[Column] = ()) -> DataFrame:
    """``beside``, doc_id, source and the measurements of each row of ``docs``."""
    text = F.coalesce(column_or_null(docs, "text", "string"), F.lit(""))
    narrow = docs.select(
        *beside,
        column_or_null(docs, "doc_id", "bigint").alias("doc_id"),
        column_or_null(docs, "source", "string").alias("source"),
        text.alias("text"),
    )
    t = F.col("text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    by_words = bind(
        words_of(t),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            total(F.transform(w, lambda x: F.length(x))).alias("word_chars"),
            _repeated_words(w, window).alias("n_repeat_words"),
        ),
    )
    by_lines = bind(
        lines,
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        ),
    )
    carried = [c for c in narrow.columns if c != "text"]
    return narrow.select(
        *carried,
        by_words.alias("w"),
        by_lines.alias("l"),
        (F.size(F.split(t, SYMBOLS)) - 1).cast("bigint").alias("n_symbols"),
    ).select(
        *carried,
        "w.n_words",
        "w.word_chars",
        "n_symbols",
        "l.n_dup_lines",
        "w.n_repeat_words",
        "l.n_lines",
    )


def base_failure() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_failures() -> dict[str, Column]:
    """Failure of each document rule, in terms of the measurements."""
    n = F.col("n_words")
    return {
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "lines": (F.col("n_dup_lines") >= 5) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "shape": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    }


def host_verdicts(measured: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """One row per host: documents, shrunk failure rate and verdict of each rule.

    The prior Beta(a, b) has the mean m and variance v of the hosts' rates: a + b =
    m(1-m)/v - 1, kept within 1 and 1000; a shrunk rate is (failures + a) / (documents + a + b).
    """
    hosts = measured.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        *(F.sum(c.cast("bigint")).alias(f"f_{r}") for r, c in rule_failures().items()),
    )
    hosts = staged(hosts, "hosts")
    rates = {r: F.col(f"f_{r}") / F.col("n_docs") for r in RULES}
    moments = hosts.agg(
        *(F.coalesce(F.avg(rates[r]), F.lit(0.0)).alias(f"m_{r}") for r in RULES),
        *(F.coalesce(F.var_pop(rates[r]), F.lit(0.0)).alias(f"v_{r}") for r in RULES),
    ).first()  # one row: two numbers a rule
    rate = {}
    for r in RULES:
        mean, variance = moments[f"m_{r}"], moments[f"v_{r}"]
        strength = mean * (1 - mean) / variance - 1 if variance > 0 else 1000.0
        strength = max(1.0, min(1000.0, strength))
        rate[r] = (F.col(f"f_{r}") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.select(
        F.col("source").alias("host"),
        "n_docs",
        *(rate[r].alias(f"rate_{r}") for r in RULES),
        *((rate[r] > tolerance).alias(f"enforce_{r}") for r in RULES),
    )


def judge(docs: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Measurements, base verdict and final verdict of each row of ``docs``."""
    measured = staged(measure(docs), "measured")
    verdicts = host_verdicts(measured, tolerance)
    joined = measured.join(verdicts, F.col("source").eqNullSafe(F.col("host")), "left")
    rejected = F.lit(False)
    for rule, failed in rule_failures().items():
        rejected = rejected | (failed & F.coalesce(F.col(f"enforce_{rule}"), F.lit(False)))
    return joined.select(
        *measured.columns,
        base_failure().alias("base_failed"),
        (~base_failure() & ~rejected).alias("kept"),
    )


def quality_filter(docs: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Every row is measured once and written beside its measurements, without its columns
    if it fails the base rule.  The hosts are judged on what is written; then every row meets
    the verdict of its host.  Only hosts with an enforced rule are joined, which Catalyst
    broadcasts while their written table is small.
    """
    measured = measure(docs, beside=[F.struct("*").alias("row")])
    written = staged(
        measured.withColumn("row", F.when(~base_failure(), F.col("row"))), "measured-rows"
    )
    verdicts = host_verdicts(written.drop("row"), tolerance)
    enforced = [f"enforce_{r}" for r in RULES]
    strict = staged(verdicts.where(" OR ".join(enforced)).select("host", *enforced), "verdicts")
    passed = written.where(F.col("row").isNotNull())
    joined = passed.join(strict, F.col("source").eqNullSafe(F.col("host")), "left")
    failures = F.lit(0)
    for rule, failed in rule_failures().items():
        counts = failed & F.coalesce(F.col(f"enforce_{rule}"), F.lit(False))
        failures = failures + counts.cast("int")
    return joined.where(failures == 0).select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def sql() -> str:
    """The same with windows and hosts as joins."""
    tests = {
        "symbols": "10 * n_symbols > 3 * n_words",
        "lines": "n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines",
        "shape": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    }
    failures = ", ".join(f"count(*) FILTER ({c}) AS f_{r}" for r, c in tests.items())
    moments = ", ".join(
        f"avg(f_{r} / n) AS m_{r}, var_pop(f_{r} / n) AS v_{r}" for r in tests
    )
    strength = ", ".join(
        f"CASE WHEN v_{r} > 0 THEN greatest(1, least(1000, m_{r} * (1 - m_{r}) / v_{r} - 1)) "
        f"ELSE 1000 END AS k_{r}"
        for r in tests
    )
    enforced = ", ".join(f"(f_{r} + m_{r} * k_{r}) / (n + k_{r}) > 0.02 AS e_{r}" for r in tests)
    rejected = " OR ".join(f"(h.e_{r} AND ({c}))" for r, c in tests.items())
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows)
  WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) r(j) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, d.source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
), hosts AS (
  SELECT source, count(*) AS n, {failures} FROM m GROUP BY source
), prior AS (
  SELECT *, {strength} FROM (SELECT {moments} FROM hosts)
), verdicts AS (
  SELECT source, {enforced} FROM hosts, prior
), judged AS (
  SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, ({rejected}) AS rejected
  FROM m JOIN verdicts h ON h.source IS NOT DISTINCT FROM m.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM judged"""
