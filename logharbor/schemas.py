"""Row layouts shared by all operators, and the header names records travel with."""

from pyspark.sql import types as T

# Header names other tools read from the records.
SOURCE_OFFSET_HEADER = "restore.source-offset"
FILE_INDEX_HEADER = "plan-restore.partition-file-index"
TOPICS_SHA_HEADER = "plan-restore.topics-sha"

# Status codes of a (group, topic) during translation.
SCHEDULED = 0
IN_PROGRESS = 1
SKIPPED = 2
ALREADY_RESTORED = 3
RESTORED = 4

# Defaults.
MIN_SEGMENT_BYTES = 5 * 1024 * 1024
POLL_RECORDS = 10_000
IDLE_THRESHOLD_MS = 5_000
LARGE_TOPIC_MB = 92_160

TP = ["topic", "partition"]

RECORD = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", T.MapType(T.StringType(), T.BinaryType(), False), False),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)

PLAN = T.StructType(
    [
        T.StructField("plan_seq", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.StringType()),
        T.StructField("file_index", T.LongType()),
        T.StructField("topics_sha", T.StringType()),
    ]
)

PARTITION_OFFSET = T.StructType(
    [
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("leader_epoch", T.IntegerType()),
        T.StructField("metadata", T.StringType()),
    ]
)

GROUPS = T.StructType(
    [
        T.StructField("group_id", T.StringType()),
        T.StructField(
            "topics",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("topic", T.StringType()),
                        T.StructField("partitions", T.ArrayType(PARTITION_OFFSET)),
                    ]
                )
            ),
        ),
    ]
)
