"""Chat formatting of conversations made of typed content parts.

A turn is a list of parts (text, image, audio, document).  A visitor flattens them in
order: neighbouring texts are joined and escaped as one, any other part becomes a
placeholder, and a plain text is a turn of one text part.  Turns are visited row by row,
wherever they lie; the pieces are gathered by conversation, which is the output row, and there
placeholders get their numbers, which run through the conversation.  An attachment entry
records number, turn, type, reference and how many tokens it will take once expanded.

Template: ``<|im_start|>role`` newline ``text<|im_end|>`` newline.  Inside texts and roles
``<`` followed by k tildes and ``|`` gets one more tilde, so no ``<|`` remains and
undoing it is exact.  A line break in a role becomes ``<|nl|>``.  A placeholder names the type
with all but letters, digits, dots, dashes and underscores as dashes; the entry has it as it is.

The loss mask covers the escaped text of assistant turns, as spans of code points both in
the whole output (``start``, ``end``) and in the turn's segment (``from``, ``to``).

Defined results: null text or role is empty; null parts count as no parts; a conversation
with a null id is one of its own.  Turns with equal numbers are ordered by role, then
text; repeated rows stay.  An empty table gives an empty result.  Only the named
columns are read, so extra and clashing ones do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import bind, column_or_null, table, total

OPEN, CLOSE, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"

#: Tokens an attachment expands to: (unit the size counts, units a token).
TOKEN_RATES = {"image": 196.0, "audio": 0.04, "document": 0.5}

PART = "struct<type:string,text:string,ref:string,size:double>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", r"<~$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def expanded_tokens(part: Column) -> Column:
    """Tokens of an attachment by its size (pixels, seconds, characters), at least one."""
    size = F.coalesce(part["size"], F.lit(0.0))
    rate = F.lit(1.0)
    for kind, per_token in TOKEN_RATES.items():
        rate = F.when(part["type"] == kind, F.lit(per_token)).otherwise(rate)
    return F.greatest(F.lit(1), F.ceil(size / rate)).cast("bigint")


def _kind(kind: Column) -> Column:
    """A part's type as it may stand in a placeholder."""
    plain = F.regexp_replace(kind, "[^A-Za-z0-9._-]", "-")
    return F.when(plain == "", F.lit("part")).otherwise(plain)


def visit(parts: Column) -> Column:
    """Flatten typed parts to struct<pieces, attachments>, in their order.

    ``pieces`` are the escaped texts before, between and behind the attachments, so there is
    one more of them.
    """
    known = F.filter(
        F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()
    )
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    attachments = F.transform(
        F.filter(known, lambda p: ~is_text(p)),
        lambda p: F.struct(
            p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")
        ),
    )
    # texts are gathered until an attachment or the end, as a ``<|`` may lie across parts
    pieces = F.aggregate(
        known,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text")),
        lambda a, p: F.when(
            is_text(p),
            F.struct(
                a["done"].alias("done"),
                F.concat(a["text"], F.coalesce(p["text"], F.lit(""))).alias("text"),
            ),
        ).otherwise(
            F.struct(
                F.concat(a["done"], F.array(escape(a["text"]))).alias("done"),
                F.lit("").alias("text"),
            )
        ),
        lambda a: F.concat(a["done"], F.array(escape(a["text"]))),
    )
    return F.struct(pieces.alias("pieces"), attachments.alias("attachments"))


def _body(turn: Column, before: Column) -> Column:
    """Text of a turn whose first attachment has the number ``before`` + 1."""
    marked = F.transform(
        turn["attachments"],
        lambda a, i: F.concat(
            F.get(turn["pieces"], i), F.lit("<|"), _kind(a["type"]), F.lit("_"),
            (before + i + 1).cast("string"), F.lit("|>"),
        ),
    )
    return F.concat(F.array_join(marked, ""), F.get(turn["pieces"], F.size(marked)))


def _turn(turn: Column, before: Column) -> Column:
    """Segment of a turn, where its body lies in it, and its attachments with their numbers."""

    def with_body(body: Column) -> Column:
        head = F.concat(F.lit(OPEN), _role(turn["role"]), F.lit("\n"))
        return F.struct(
            turn["role"].alias("role"),
            F.concat(head, body, F.lit(CLOSE + "\n")).alias("segment"),
            F.length(head).alias("from"),
            F.length(body).alias("chars"),
            F.transform(
                turn["attachments"],
                lambda a, i: F.struct(
                    (before + i + 1).cast("bigint").alias("number"),
                    a["type"].alias("type"),
                    a["ref"].alias("ref"),
                    a["tokens"].alias("tokens"),
                ),
            ).alias("attachments"),
        )

    return bind(_body(turn, before), with_body)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: formatted text, loss mask, attachments, token counts.

    ``turns`` has conv_id, turn, role and either ``parts`` (array of type, text, ref,
    size) or a plain ``text``.  Attachments are numbered through the conversation and carry
    the place of their turn.
    """
    text = F.coalesce(column_or_null(turns, "text", "string"), F.lit(""))
    if "parts" in turns.columns:
        parts = F.col("parts").cast(f"array<{PART}>")
    else:
        plain = F.struct(F.lit("text"), text, F.lit(None).cast("string"), F.lit(None).cast("double"))
        parts = F.array(plain).cast(f"array<{PART}>")
    flat = visit(parts)
    role = F.coalesce(column_or_null(turns, "role", "string"), F.lit(""))
    visited = turns.select(
        column_or_null(turns, "conv_id", "bigint").alias("conv_id"),
        column_or_null(turns, "turn", "bigint").alias("turn"),
        role.alias("role"),
        flat.alias("flat"),
    ).select("conv_id", F.struct("turn", "role", "flat.pieces", "flat.attachments").alias("t"))
    gathered = visited.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("sorted"))
    before = F.aggregate(
        F.transform("sorted", lambda t: F.size(t["attachments"])),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, n: F.struct(
            (a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")
        ),
        lambda a: a["all"],
    )
    gathered = gathered.withColumn("before", before).select(
        "conv_id", F.zip_with("sorted", "before", _turn).alias("ts")
    )
    lengths = F.transform("ts", lambda t: F.length(t["segment"]).cast("bigint"))
    starts = F.aggregate(
        lengths,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda a, n: F.struct(
            (a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")
        ),
        lambda a: a["all"],
    )
    spans = F.zip_with(
        F.col("ts"),
        F.col("starts"),
        lambda t, s: F.struct(
            s.alias("segment_start"),
            t["from"].cast("bigint").alias("from"),
            (t["from"] + t["chars"]).cast("bigint").alias("to"),
            (s + t["from"]).alias("start"),
            (s + t["from"] + t["chars"]).alias("end"),
            (t["role"] == "assistant").alias("assistant"),
        ),
    )
    numbered = F.transform("spans", lambda s, i: F.struct(i.alias("turn_no"), s.alias("s")))
    return (
        gathered.withColumn("starts", starts)
        .withColumn("spans", spans)
        .select(
            "conv_id",
            F.array_join(F.transform("ts", lambda t: t["segment"]), "").alias("formatted"),
            F.transform(
                F.filter(numbered, lambda s: s["s"]["assistant"]),
                lambda s: F.struct(
                    s["turn_no"].cast("bigint").alias("turn_no"),
                    s["s"]["from"].alias("from"),
                    s["s"]["to"].alias("to"),
                    s["s"]["start"].alias("start"),
                    s["s"]["end"].alias("end"),
                ),
            ).alias("loss_spans"),
            F.flatten(
                F.transform(
                    "ts",
                    lambda t, i: F.transform(
                        t["attachments"], lambda a: a.withField("turn_no", i.cast("bigint"))
                    ),
                )
            ).alias("attachments"),
            total(
                F.transform(
                    F.flatten(F.transform("ts", lambda t: t["attachments"])),
                    lambda a: a["tokens"],
                )
            ).alias("attachment_tokens"),
        )
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text, segment) parsed from a formatted conversation."""
    segments = F.filter(
        F.split(formatted, r"<\|im_start\|>"), lambda s: s != F.lit("")
    )

    def parse(segment: Column) -> Column:
        head = F.substring_index(segment, "\n", 1)
        skip = F.length(head) + 1
        body = F.substring(segment, skip + 1, F.length(segment) - skip - len(CLOSE) - 1)
        return F.struct(
            unescape(F.replace(head, F.lit(BREAK), F.lit("\n"))).alias("role"),
            unescape(body).alias("text"),
            F.concat(F.lit(OPEN), segment).alias("segment"),
        )

    return F.transform(segments, parse)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text and loss mask."""
    says = CLOSE + OPEN + "assistant ok"
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(says).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = format_chats(turns.unionByName(probe))
    back = chats.withColumn("turns", read_back(F.col("formatted")))
    masked = bind(
        F.col("turns"),
        lambda turns: F.transform(
            "loss_spans",
            lambda s: unescape(
                F.substring(
                    F.get(turns, s["turn_no"].cast("int"))["segment"],
                    (s["from"] + 1).cast("int"),
                    (s["to"] - s["from"]).cast("int"),
                )
            ),
        ),
    )
    said = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return back.withColumn("loss", F.array_join(masked, "")).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def sql() -> str:
    """The same digests straight from the table, with the template's lengths added up."""
    says = CLOSE + OPEN + "assistant ok"
    frame = len(OPEN) + len(CLOSE) + 2
    escaped = r"regexp_replace({0}, '<(~*)\|', '<~\1|', 'g')"
    role = f"replace({escaped.format('role')}, chr(10), '{BREAK}')"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{says}' UNION ALL SELECT -1, 1, 'assistant', '{says}'
), loss AS (
  SELECT conv_id, string_agg(text, '' ORDER BY turn) AS said
  FROM t WHERE role = 'assistant' GROUP BY conv_id
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
         CAST(sum({frame} + length({role}) + length({escaped.format("text")})) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT c.conv_id, c.n_turns, c.turns_sha256, length(coalesce(l.said, '')) AS loss_chars,
       sha256(coalesce(l.said, '')) AS loss_sha256, c.formatted_chars
FROM chats c LEFT JOIN loss l ON l.conv_id = c.conv_id"""
