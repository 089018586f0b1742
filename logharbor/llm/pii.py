"""Personal data: overlapping candidates, boosted trees, calibrated thresholds.

Everything runs as DataFrame expressions inside each document's row:

1. Generators with high recall propose overlapping spans.  The base generators with their
   checks give the base spans, which always stay; the others propose forms the base
   misses (grouped cards inside longer runs of digits, local phone numbers, ``(at)`` mail
   addresses, defanged addresses).
2. Each candidate gets a code for its format and context.  Codes are small integers with a
   proven bound (``CODES``), so the training set of any corpus collapses to at most so many
   rows of counts; nothing is sampled.
3. Gradient-boosted trees (Spark ML) are fitted to the counts.  Labels are weak: base
   candidates that pass or fail their check, and lone numbers, which are not personal.
4. On held-out documents each kind gets the lowest threshold whose precision still holds.
   The codes above it are the accepted ones; a candidate is redacted if its code is among
   them.

Positions come from splitting the text at the matches and adding up lengths, in code
points.  The patterns equal the contract's but never rescan a run of characters: runs are
entered at their start only and repeated groups are possessive, so long texts neither
overflow the matcher's stack nor take quadratic time.

Defined results: a null or empty text has no spans; repeated rows are judged row by row; a
table without labelled candidates of both classes gets base spans only; an empty table gives
an empty result.  Only the named columns are read; ``redact`` keeps all others as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import bind, column_or_null, staged, table, total

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Generator:
    kind: str
    pattern: str
    #: a text without this has no match
    needs: str
    #: base spans that pass the check are always kept
    base: bool = False
    #: label of every candidate of this generator, if it is known beforehand
    label: int | None = None


GENERATORS = (
    Generator(
        "email",
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        base=True,
    ),
    Generator("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9]\\.[0-9]", base=True),
    Generator(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
        "[0-9][0-9 -]{11}",
        base=True,
    ),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", base=True),
    Generator(
        "card",
        r"(?<![0-9])[0-9]{4}([ .-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
        "[0-9]{4}[ .-]?[0-9]{4}",
    ),
    Generator(
        "phone",
        r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
        "[0-9]{3}[ .-][0-9]{4}",
    ),
    Generator(
        "email",
        rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++"
        r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
        "\\(at\\)|\\[at\\]",
    ),
    Generator("ip", r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])", "\\[\\.\\]"),
    Generator(
        "phone",
        r"(?<![0-9+().@/-])(?<![0-9+().-]\x20)[0-9]{7,12}(?![0-9])(?![ ().-]+[0-9])",
        "[0-9]{7}",
        label=0,
    ),
)

#: Values of each part of a code: kind, digits, separators, plus, parenthesis, Luhn, octets,
#: obfuscated, character before, character after, keyword before.
RADIX = (4, 21, 5, 2, 2, 2, 2, 2, 3, 3, 2)
CODES = 4 * 21 * 5 * 2**5 * 3 * 3 * 2

_KEYWORDS = "(?i)tel|phone|fon|call|mail|card|visa|konto|ip|addr|contact|mobil|fax"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: bind(
            F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return total(doubled) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes(kind: str, match: Column) -> Column:
    """The contract's check of a match of each kind."""
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & luhn(_digits(match))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _side(c: Column) -> Column:
    """0 for an end or a space, 1 for a letter or digit, 2 for anything else."""
    return (
        F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 1).otherwise(2)
    )


def _code(kind: str, match: Column, before: Column, after: Column) -> Column:
    digits = _digits(match)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    parts = (
        F.lit(KINDS.index(kind)),
        F.least(F.length(digits), F.lit(RADIX[1] - 1)),
        F.least(
            F.length(match) - F.length(F.regexp_replace(match, "[ .()-]", "")),
            F.lit(RADIX[2] - 1),
        ),
        flag(F.startswith(match, F.lit("+"))),
        flag(F.contains(match, F.lit("("))),
        flag(F.length(digits).between(13, 19) & luhn(digits)),
        flag(F.replace(F.replace(match, F.lit("["), F.lit("")), F.lit("]"), F.lit("")).rlike(
            rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        flag(match.rlike(r"\(at\)|\[at\]|\[\.\]|\[dot\]|\(dot\)")),
        _side(F.right(before, F.lit(1))),
        _side(F.left(after, F.lit(1))),
        flag(F.right(before, F.lit(24)).rlike(_KEYWORDS)),
    )
    code = F.lit(0)
    for part, radix in zip(parts, RADIX, strict=True):
        code = code * radix + part
    return code.cast("int")


_CANDIDATE = "struct<kind:int,start:int,end:int,base:boolean,label:int,code:int>"


def _placing(g: Generator, text: Column) -> Callable[[Column], Column]:
    def place(matches: Column) -> Column:
        pieces = F.when(F.size(matches) > 0, F.split(text, g.pattern, -1))
        return bind(pieces, lambda p: _candidates(g, matches, p))

    return place


def _candidates(g: Generator, matches: Column, pieces: Column) -> Column:
    """Candidates of one generator, with their places."""
    spots = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(matches)),
        matches,
        lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n")),
    )
    starts = F.aggregate(
        spots,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["n"]).alias("at"),
            F.concat(a["all"], F.array(a["at"] + s["gap"])).alias("all"),
        ),
        lambda a: a["all"],
    )

    def candidate(match: Column, i: Column, places: Column) -> Column:
        ok = passes(g.kind, match)
        if g.label is not None:
            label = F.lit(g.label)
        elif g.base:
            label = ok.cast("int")
        else:
            label = F.when(~ok, F.lit(0)) if g.kind == "card" else F.lit(None).cast("int")
        start = F.get(places, i)
        return F.struct(
            F.lit(KINDS.index(g.kind)).alias("kind"),
            start.alias("start"),
            (start + F.length(match)).alias("end"),
            (ok if g.base else F.lit(False)).alias("base"),
            label.alias("label"),
            _code(g.kind, match, F.get(pieces, i), F.get(pieces, i + F.lit(1))).alias("code"),
        )

    found = bind(
        starts, lambda places: F.transform(matches, lambda m, i: candidate(m, i, places))
    )
    return F.when(F.size(matches) > 0, found.cast(f"array<{_CANDIDATE}>")).otherwise(
        F.array().cast(f"array<{_CANDIDATE}>")
    )


def with_candidates(docs: DataFrame, name: str = "pii_candidates") -> DataFrame:
    """``docs`` with one more column: the candidates of each text."""
    text = F.coalesce(column_or_null(docs, "text", "string"), F.lit(""))
    found = []
    for g in GENERATORS:
        matches = F.when(
            text.rlike(g.needs), F.regexp_extract_all(text, F.lit(g.pattern), F.lit(0))
        ).otherwise(F.array().cast("array<string>"))

        found.append(bind(matches, _placing(g, text)))
    return docs.withColumn(name, F.flatten(F.array(*found)))


def code_counts(candidates: DataFrame, column: str, holdout: int = 4) -> DataFrame:
    """Positive and negative labels of each code, in training and in held-out documents."""
    each = candidates.select(
        (F.abs(F.xxhash64("doc_id")) % holdout == 0).alias("held"), F.explode(column).alias("c")
    ).select("held", "c.code", "c.label")
    count = lambda held, label: F.count(
        F.when((F.col("held") == held) & (F.col("label") == label), 1)
    )
    return each.groupBy("code").agg(
        count(False, 1).alias("positive"),
        count(False, 0).alias("negative"),
        count(True, 1).alias("held_positive"),
        count(True, 0).alias("held_negative"),
    )


def _features(counts: DataFrame) -> DataFrame:
    rest, columns = F.col("code"), []
    for i, radix in reversed(list(enumerate(RADIX))):
        columns.append((rest % radix).cast("double").alias(f"x{i}"))
        rest = F.floor(rest / radix)
    return counts.select(*counts.columns, *columns)


def accepted_codes(
    candidates: DataFrame,
    column: str,
    precision: float = 0.98,
    least: float = 0.5,
    rounds: int = 12,
) -> list[int]:
    """Codes whose boosted score passes the calibrated threshold of their kind; at most ``CODES``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = staged(code_counts(candidates, column), "pii-codes")
    sums = counts.agg(F.sum("positive"), F.sum("negative")).first()
    if not sums[0] or not sums[1]:
        return []
    vectors = VectorAssembler(
        inputCols=[f"x{i}" for i in range(len(RADIX))], outputCol="features"
    ).transform(_features(counts))
    labelled = vectors.select(
        "features",
        F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("label"), F.col("positive").alias("n")),
                F.struct(F.lit(0.0).alias("label"), F.col("negative").alias("n")),
            )
        ).alias("l"),
    ).select("features", "l.label", F.log1p(F.col("l.n")).alias("weight"))
    model = GBTClassifier(
        maxIter=rounds, maxDepth=4, stepSize=0.3, weightCol="weight", seed=4, minInstancesPerNode=1,
        checkpointInterval=-1, cacheNodeIds=False,
    ).fit(labelled.where("weight > 0").coalesce(1))
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(vectors).select(
        "code",
        F.floor(F.col("code") / (CODES // RADIX[0])).alias("kind"),
        vector_to_array("probability")[1].alias("score"),
        "held_positive",
        "held_negative",
    )
    accepted: list[int] = []
    rows = scored.collect()  # bounded by the number of codes
    for kind in range(len(KINDS)):
        own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: -r["score"])
        threshold, hits, misses = 1.1, 0, 0
        for r in own:
            hits, misses = hits + r["held_positive"], misses + r["held_negative"]
            if r["score"] < least or hits < precision * (hits + misses):
                break
            threshold = r["score"]
        accepted += [r["code"] for r in own if r["score"] >= threshold]
    return sorted(accepted)


def spans_of(candidates: Column, accepted: list[int]) -> Column:
    """struct<base, spans>: sorted spans (kind, start, end) of base and of all accepted."""
    span = lambda c: F.struct(c["kind"], c["start"], c["end"])
    base = F.sort_array(F.transform(F.filter(candidates, lambda c: c["base"]), span))
    chosen = F.filter(
        candidates,
        lambda c: ~c["base"] & c["label"].isNull() & c["code"].isin(accepted),
    )

    def both(b: Column) -> Column:
        added = F.filter(
            F.transform(chosen, span),
            lambda e: ~F.exists(b, lambda x: (x["start"] <= e["start"]) & (x["end"] >= e["end"])),
        )
        return F.struct(
            b.alias("base"),
            F.sort_array(F.array_distinct(F.concat(b, added))).alias("spans"),
        )

    return bind(base, both)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id with its base spans and all spans."""
    narrow = docs.select(
        column_or_null(docs, "doc_id", "bigint").alias("doc_id"),
        column_or_null(docs, "text", "string").alias("text"),
    )
    found = staged(with_candidates(narrow, "c").select("doc_id", "c"), "pii")
    accepted = accepted_codes(found, "c")
    return found.select("doc_id", spans_of(F.col("c"), accepted).alias("s")).select(
        "doc_id", "s.base", "s.spans"
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind, as ``[EMAIL]``.

    Candidates are proposed twice, to fit the trees and to redact, so nothing but the
    counts of the codes is written in between.
    """
    if "text" not in docs.columns:
        return docs
    text = F.col("text")
    narrow = docs.select(
        column_or_null(docs, "doc_id", "bigint").alias("doc_id"), text.cast("string").alias("text")
    )
    accepted = accepted_codes(with_candidates(narrow, "c"), "c")
    rows = with_candidates(docs.select(F.struct("*").alias("row"), text.cast("string").alias("text")), "c")
    in_order = F.sort_array(
        F.transform(
            spans_of(F.col("c"), accepted)["spans"],
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    rows = rows.select("row", "text", in_order.alias("spans"))
    spans = F.col("spans")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    # each span yields the text since the last one and its mark; overlaps yield one mark
    pieces = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= a["at"],
                F.concat(
                    a["out"],
                    F.array(
                        F.substring(text, a["at"] + 1, s["start"] - a["at"]),
                        F.get(names, s["kind"]),
                    ),
                ),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
    )
    rebuilt = bind(
        pieces,
        lambda p: F.concat(
            F.array_join(p["out"], ""),
            F.substring(text, p["at"] + 1, F.length(text)),
        ),
    )
    clean = F.when(F.size(spans) > 0, rebuilt).otherwise(text)
    return rows.select(F.col("row").withField("text", clean).alias("row")).select("row.*")


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = (count(k).alias(f"n_{name}") for k, name in enumerate(KINDS))
    return find_pii(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *counts,
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )
