import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logharbor import archive_log, plan_restore, restore_log
from logharbor.operators import archive as A
from logharbor.operators import audit as C
from logharbor.schemas import GROUPS, RECORD
from logharbor.shared import job_tables, new_path, shared_folder, staged, staged_split, written_folders
from logharbor.sources import storage as S


def log(spark, n=400):
    data = [
        (b"k%d" % i if i % 7 else None, b"v" * (i % 30), {"h": b"%d" % i}, t, p, 1_000 + i, i + 10 * p)
        for t in ("orders", "pay ments")
        for p in (0, 1, 11)
        for i in range(n)
        if i % 13
    ]
    return spark.createDataFrame(data, RECORD)


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert new_path(spark, "x") != new_path(spark, "x")
    assert rows(staged(spark.range(3), "t")) == [(0,), (1,), (2,)]


def test_a_finished_job_leaves_no_staged_table(spark):
    with job_tables(spark):
        table = staged(spark.range(10), "owned")
        path = table.inputFiles()[0].rsplit("/", 1)[0]
        assert table.count() == 10 and written_folders(spark, path)
    assert not written_folders(spark, path)
    outside = staged(spark.range(2), "free")
    assert outside.count() == 2


def test_snapshot_versions(spark):
    path = new_path(spark, "snapshot")
    data = lambda n: spark.createDataFrame([(f"g{i}", []) for i in range(n)], GROUPS)
    with pytest.raises(ValueError, match="no complete snapshot"):
        S.read_snapshot(spark, path)
    for n in (1, 2, 3):
        S.write_snapshot(data(n), path)
        assert S.read_snapshot(spark, path).count() == n
    assert len(written_folders(spark, path)) == 2
    # a version that was not finished does not count
    data(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{path}/version-000000000004"
    )
    assert S.read_snapshot(spark, path).count() == 3


def test_objects_are_read_by_topic_folder(spark):
    root = new_path(spark, "objects")
    records = log(spark)
    topics = [r["topic"] for r in records.select("topic").distinct().collect()]
    for topic in topics:
        records.where(F.col("topic") == topic).coalesce(1).write.parquet(f"{root}/{topic}/0")
    listed = S.list_objects(spark, root, "p")
    assert listed.count() == len(topics)
    wanted = listed.where(F.col("path").startswith(f"p/{topics[0]}/"))
    got = S.read_objects(spark, root, "p", "parquet", wanted)
    assert {r["topic"] for r in got.select("topic").distinct().collect()} == {topics[0]}
    assert all(f"/{topics[0]}/" in f for f in got.inputFiles() if root.split(":")[-1] in f)
    nothing = spark.createDataFrame([("p/none/0/x",)], "path string")
    assert S.read_objects(spark, root, "p", "parquet", nothing).isEmpty()


def test_excluded_folders_are_pruned(spark):
    records = log(spark)
    archived = archive_log(records, "b", min_size=900, poll_records=16, flush=True)
    root = new_path(spark, "archive")
    S.write_archive(archived.rows, root)
    kept = S.read_archive(spark, root, "b", exclude="^pay")
    assert {r["topic"] for r in kept.select("topic").distinct().collect()} == {
        r["topic"] for r in records.select("topic").distinct().collect() if not r["topic"].startswith("pay")
    }
    scan = next(
        line for line in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line
    )
    assert re.search(r"PartitionFilters: \[.*p_topic", scan)


def test_plan_from_wire(spark):
    plan = spark.createDataFrame([(0, "p/t/0/", "p/t/0/t-0-0000000000000000005.avro", 1, "sha")], "plan_seq bigint, key string, value string, file_index bigint, topics_sha string")
    wire = S.plan_to_wire(plan).withColumn("offset", F.lit(3).cast("bigint")).withColumn("partition", F.lit(2))
    got = S.plan_from_wire(wire).first()
    assert (got["topic"], got["partition"], got["file_index"], got["topics_sha"], got["plan_seq"]) == ("t", "0", 1, "sha", 3 * 65536 + 2)
    bare = wire.withColumn("headers", F.array().cast(wire.schema["headers"].dataType))
    assert S.plan_from_wire(bare).first()["file_index"] is None


def test_staged_split(spark):
    df = spark.range(10).withColumn("odd", F.col("id") % 2 == 1)
    even, odd = staged_split(df, "split", "odd")
    assert rows(even) == [(i,) for i in range(0, 10, 2)]
    assert rows(odd) == [(i,) for i in range(1, 10, 2)]
    assert staged_split(df.where("not odd"), "split", "odd")[1] is None
    nothing, every = staged_split(df.where("odd"), "split", "odd")
    assert nothing.isEmpty() and every.count() == 5


def test_archive_plan_restore_round_trip(spark):
    records = log(spark)
    archived = archive_log(records, "backup", min_size=900, poll_records=16, flush=True)
    root = new_path(spark, "archive")
    S.write_archive(archived.rows, root)
    manifest = staged(archived.manifest, "manifest")
    assert manifest.where("not closed").count() <= 6
    archive = S.read_archive(spark, root, "backup")
    assert rows(C.rows_per_file(archive)) == rows(manifest, "path", "rows")
    planned = plan_restore(S.manifest_objects(manifest), "backup", "pay, .*")
    plan_path = new_path(spark, "plan")
    S.write_plan(planned.plan, plan_path)
    plan = S.read_plan(spark, plan_path)
    assert plan.orderBy("plan_seq").first()["topic"] == "pay ments"
    restored = restore_log(plan, archive, topic_prefix="r.")
    topics = new_path(spark, "topics")
    S.write_topics(restored, topics)
    target = S.read_topics(spark, topics)
    assert target.count() == records.count()
    assert C.restore_content_diff(records, target, "r.").isEmpty()
    assert C.restore_duplicates(target).isEmpty()
    assert C.restore_order_violations(target).isEmpty()
    assert C.restore_count_diff(records, target, "r.").isEmpty()
    assert restore_log(plan, archive, target, "r.").isEmpty()


def test_reading_some_files_prunes_folders(spark):
    archived = archive_log(log(spark), "backup", min_size=900, poll_records=16, flush=True)
    root = new_path(spark, "archive")
    S.write_archive(archived.rows, root)
    files = archived.manifest.where("topic = 'orders' and partition = 11").limit(3).select("path")
    files = staged(files, "files")
    some = S.read_archive(spark, root, "backup", files=files)
    assert rows(some.select("path").distinct()) == rows(files)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_plain_objects(spark):
    root = new_path(spark, "objects")
    part = log(spark, 60).where("topic = 'orders' and partition = 0")
    part.coalesce(1).write.parquet(f"{root}/orders/0/orders-0-0000000000000000000.avro")
    listed = S.list_objects(spark, root, "backup").where(F.col("path").endswith(".parquet"))
    (path, length), = rows(listed)
    assert path.startswith("backup/orders/0/orders-0-") and length > 0
    back = S.read_objects(spark, root, "backup", fmt="parquet")
    assert rows(back.select("path").distinct()) == [(path,)]
    assert back.count() == part.count()


def test_kafka_options():
    options = S.kafka_source_options("b:1", "orders, ^pay", 500, {"kafka.security.protocol": "SSL"})
    assert options["subscribePattern"] == ".*(?:orders).*|.*(?:^pay).*"
    assert options["maxOffsetsPerTrigger"] == "500"
    assert options["startingOffsets"] == "earliest"
    assert options["kafka.security.protocol"] == "SSL"
    assert S.kafka_sink_options("b:1")["kafka.enable.idempotence"] == "true"


def test_kafka_rows_carry_the_time(spark):
    one = S.kafka_rows(log(spark, 2)).first()
    assert [h["key"] for h in one["headers"]] == ["h", "logharbor.timestamp-ms"]


def test_empty_snapshot_is_valid(spark):
    from logharbor.schemas import GROUPS

    path = new_path(spark, "snapshot")
    S.write_snapshot(spark.createDataFrame([], GROUPS), path)
    assert S.read_snapshot(spark, path).count() == 0


def test_written_segments_are_in_order(spark):
    archived = archive_log(log(spark), min_size=900, poll_records=16)
    root = new_path(spark, "archive")
    S.write_archive(archived.rows, root)
    stored = spark.read.parquet(root).withColumn("at", F.monotonically_increasing_id())
    falls = stored.selectExpr(
        "offset", "at", "lag(offset) over (partition by input_file_name() order by at) as before"
    ).where("offset <= before")
    assert falls.isEmpty()
    assert A.committed_offsets(archived.manifest).count() == 6
