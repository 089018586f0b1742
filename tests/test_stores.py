"""Stores that several runs share: objects, plan journal, offset index, commit log."""

import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.operators import audit as C
from logharbor.operators import groups as G
from logharbor.operators import intervals as I
from logharbor.plans.jobs import plan_restore
from logharbor.schemas import RECORD, TP
from logharbor.shared import create_file, new_path, read_file, remove_folder, staged, written_folders
from logharbor.sources import objects as O
from logharbor.sources import storage as S
from logharbor.sources.commit_log import CommitLog, LostRace
from logharbor.sources.followed import SourceBlocks, translate_followed
from logharbor.sources.journal import PlanJournal
from logharbor.sources.offset_index import OffsetIndex
from logharbor.sources.print_tree import PrintTree, differing_blocks, tree_diff
from logharbor.streaming.folding import FoldedTable

ARCHIVED = T.StructType([*RECORD.fields, T.StructField("segment", T.LongType())])


def archived(spark, partitions, segments, size, first=0):
    data = []
    for p in range(partitions):
        for s in range(segments):
            start = first + s * size
            data += [(b"k", bytes([65 + o % 26]) * (o % 5), {"h": b"v"}, "t", p, 1000 + o, o, start) for o in range(start, start + size)]
    return spark.createDataFrame(data, ARCHIVED)


# --- objects -------------------------------------------------------------------------------


def test_objects_are_read_back_with_rows_and_sizes(spark):
    root = new_path(spark, "objects")
    table = archived(spark, 2, 3, 40)
    manifest = O.write_objects(table, root, "pre").collect()
    assert len(manifest) == 6 and {r["rows"] for r in manifest} == {40}
    back = S.read_objects(spark, root, "pre", fmt="parquet")
    assert rows(back.drop("path", "headers")) == rows(table.drop("segment", "headers"))
    assert {r["path"]: r["length"] for r in S.list_objects(spark, root, "pre").collect()} == {r["path"]: r["length"] for r in manifest}
    assert "pre/t/1/t-1-0000000000000000040.avro" in {r["path"] for r in manifest}
    again = O.write_objects(archived(spark, 1, 2, 40, first=400), root, "pre")
    assert again.count() == 2 and O.written_objects(spark, root, "pre").count() == 8
    assert written_folders(spark, f"{root}/_jobs") == []
    assert O.write_objects(table.limit(0), root).count() == 0


def test_a_hot_partition_is_written_by_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        manifest = O.write_objects(archived(spark, 1, 40, 5), new_path(spark, "objects"))
        assert manifest.select("task").distinct().count() >= 4 and manifest.count() == 40
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_a_write_that_breaks_off_leaves_nothing_to_see(spark):
    root = new_path(spark, "objects")
    O.write_objects(archived(spark, 1, 2, 10), root)
    before = rows(S.list_objects(spark, root))
    broken = archived(spark, 1, 8, 10, first=100).withColumn(
        "timestamp", F.when(F.col("offset") == 150, F.raise_error(F.lit("killed")).cast("bigint")).otherwise(F.col("timestamp"))
    )
    with pytest.raises(Exception, match="killed"):
        O.write_objects(broken, root)
    assert rows(S.list_objects(spark, root)) == before
    assert rows(O.written_objects(spark, root).select("path", "length")) == before
    # drafts of a driver that died before the commit are forgotten
    job = O.draft_objects(archived(spark, 1, 2, 10, first=500), root)
    remove_folder(spark, f"{root}/_jobs/{job}/committed")
    assert O.recover_objects(spark, root) == [] and rows(S.list_objects(spark, root)) == before


def test_a_committed_write_is_finished(spark):
    root = new_path(spark, "objects")
    table = archived(spark, 2, 4, 10)
    job = O.draft_objects(table, root)
    assert S.list_objects(spark, root).where(F.col("path").startswith("t/")).count() == 0
    # it had moved one object when it died
    listed = json.loads(read_file(spark, f"{root}/_jobs/{job}/committed"))
    first = spark.read.parquet(f"{root}/_jobs/{job}/lists/{listed[0]}").limit(1)
    list(O._moved(iter(first.toArrow().to_batches()), root))
    assert O.recover_objects(spark, root) == [job]
    assert O.recover_objects(spark, root) == []
    assert S.read_objects(spark, root, fmt="parquet").count() == table.count()
    assert O.written_objects(spark, root).count() == 8


# --- plan journal --------------------------------------------------------------------------


def listing(spark, names):
    return spark.createDataFrame([(n, 10) for n in names], "path string, length bigint")


def names(topic, partition, offsets):
    return [f"p/{topic}/{partition}/{topic}-{partition}-{o:019d}.avro" for o in offsets]


def planned(spark, objects, journal):
    plan = plan_restore(listing(spark, objects), "p", journal=journal)
    return plan, [(r["plan_seq"], r["value"], r["file_index"]) for r in plan.plan.orderBy("plan_seq").collect()]


def test_a_torn_page_is_planned_again_and_late_objects_are_told_apart(spark):
    journal = PlanJournal(spark, new_path(spark, "journal"), page=3)
    first = [*names("a", 0, [0, 10, 20]), *names("b", 0, [0, 5, 9]), *names("b", 1, [0])]
    plan, whole = planned(spark, first, journal)
    assert plan.late.count() == 0 and len(whole) == 7
    pages = journal.write_pages(plan.plan)
    assert [r["records"] for r in pages.orderBy("page").collect()] == [3, 3, 1]
    assert journal.last_page() is None and journal.read().count() == 0  # nothing is closed yet
    journal.close_pages(pages.where("page < 2"))
    assert journal.last_page().file == names("b", 0, [9])[0] and journal.read().count() == 6
    # objects that came later: in a finished topic, inside the resumed folder, behind its end
    second = [*first, *names("a", 1, [0]), *names("b", 0, [7, 12])]
    plan, rest = planned(spark, second, journal)
    assert {r["path"] for r in plan.late.collect()} == {names("a", 1, [0])[0], names("b", 0, [7])[0]}
    assert rest == [(6, names("b", 0, [12])[0], 4), (7, names("b", 1, [0])[0], 1)]
    assert journal.append(plan.plan) == 2
    assert [r["plan_seq"] for r in journal.read().orderBy("plan_seq").collect()] == list(range(8))
    assert planned(spark, second, journal)[1] == []


def test_a_journal_closes_only_what_follows_without_holes(spark):
    journal = PlanJournal(spark, new_path(spark, "journal"), page=2)
    plan, _ = planned(spark, names("a", 0, range(0, 60, 10)), journal)
    pages = journal.write_pages(plan.plan.where("plan_seq <> 2"))
    with pytest.raises(ValueError, match="page 1 does not follow"):
        journal.close_pages(pages)
    assert journal.last_page().page == 0
    pages = journal.write_pages(plan.plan.where("plan_seq > 1"))
    # another writer closed the page, but died before its record was whole
    create_file(spark, f"{journal.root}/closed/{1:012d}.json", '{"page": 1,')
    assert journal.last_page().page == 0
    with pytest.raises(ValueError, match="another writer"):
        journal.close_pages(pages)
    assert journal.append(plan.plan.where("plan_seq > 1")) == 4  # removes the torn record first
    with pytest.raises(ValueError, match="not selected any more"):
        planned(spark, names("z", 0, [1]), journal)
    with pytest.raises(ValueError, match="made for a topic list"):
        planned(spark, [*names("a", 0, [0]), *names("c", 0, [0])], journal)


# --- offset index --------------------------------------------------------------------------


def restored_rows(spark, partitions, first, last):
    data = [
        (b"k", b"v", {}, "r.t", p, 5, o, 3 * o + p) for p in range(partitions) for o in range(first, last) if o % 10 != 4
    ]
    schema = T.StructType([*RECORD.fields, T.StructField("source_offset", T.LongType())])
    return spark.createDataFrame(data, schema)


def log_files(df, log):
    return {f for f in df.inputFiles() if log.rpartition("/")[2] in f}


def test_lookups_read_only_the_files_they_need(spark):
    log, root = new_path(spark, "log"), new_path(spark, "index")
    index = OffsetIndex(spark, log, root, width=16)
    assert index.extend() == 0 and index.latest().count() == 0
    for first, last in ((0, 100), (100, 200), (200, 260)):
        S.write_topics(restored_rows(spark, 3, first, last), log, run=16)
        assert index.extend() >= 3
    assert index.extend() == 0
    all_files = log_files(S.read_topics(spark, log), log)
    wanted = spark.createDataFrame(
        [("r.t", 0, 14), ("r.t", 0, 105), ("r.t", 1, 259), ("r.t", 2, 260), ("r.t", 9, 0), ("r.t", 2, -5)],
        "topic string, partition int, start_offset bigint",
    )
    got = index.records_at(wanted)
    found = {(r["partition"], r["start_offset"]): r["offset"] for r in got.collect()}
    assert found == {(0, 14): 15, (0, 105): 105, (1, 259): 259, (2, -5): 0}
    assert 0 < len(log_files(got, log)) <= 4 < len(all_files)
    latest = index.latest()
    assert {r["partition"]: (r["offset"], r["source_offset"]) for r in latest.collect()} == {p: (259, 777 + p) for p in range(3)}
    assert len(log_files(latest, log)) == 3
    # what the index does not know yet is read as well
    S.write_topics(restored_rows(spark, 1, 260, 263), log, run=16)
    assert {r["partition"]: r["offset"] for r in index.latest().collect()} == {0: 262, 1: 259, 2: 259}


def test_gaps_between_blocks_and_files_are_bridged(spark):
    log = new_path(spark, "log")
    index = OffsetIndex(spark, log, new_path(spark, "index"), width=8)
    schema = T.StructType([*RECORD.fields, T.StructField("source_offset", T.LongType())])
    offsets = [0, 1, 7, 40, 41, 100]
    data = spark.createDataFrame([(None, None, {}, "r.t", 0, 5, o, o) for o in offsets], schema)
    S.write_topics(data, log, run=8)
    index.extend()
    wanted = spark.range(0, 101).select(F.lit("r.t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("start_offset"))
    got = {r["start_offset"]: r["offset"] for r in index.records_at(wanted).select(*TP, "start_offset", "offset").collect()}
    assert got == {i: min(o for o in offsets if o >= i) for i in range(101)}


# --- commit log ----------------------------------------------------------------------------


def commits(spark, *entries):
    return spark.createDataFrame(list(entries), "group_id string, topic string, partition int, offset bigint")


def test_the_newest_commit_wins_through_compaction(spark):
    log = CommitLog(spark, new_path(spark, "commits"))
    assert log.version() == (0, []) and log.read().count() == 0
    assert log.append(commits(spark, ("g", "t", 0, 5), ("g", "t", 1, 9))) == 1
    assert log.append(commits(spark, ("g", "t", 0, 3), ("h", "t", 0, 1))) == 2
    expected = [("g", "t", 0, 3, -1), ("g", "t", 1, 9, -1), ("h", "t", 0, 1, -1)]
    assert rows(log.read()) == expected
    assert log.compact() == 3 and len(log.version()[1]) == 1 and rows(log.read()) == expected
    assert rows(log.read(1)) == [("g", "t", 0, 5, -1), ("g", "t", 1, 9, -1)]
    assert log.forget(keep=1) == 2 and rows(log.read()) == expected and log.compact() == 3


def test_a_lost_race_is_refused(spark):
    root = new_path(spark, "commits")
    ours, theirs = CommitLog(spark, root), CommitLog(spark, root)
    start = ours.append(commits(spark, ("g", "t", 0, 1)))
    theirs.append(commits(spark, ("g", "t", 0, 2)), based_on=start)
    with pytest.raises(LostRace):
        ours.append(commits(spark, ("g", "t", 0, 3)), based_on=start)
    assert rows(ours.read()) == [("g", "t", 0, 2, -1)]
    assert len(written_folders(spark, f"{root}/runs")) == 2  # the refused run is gone
    # a writer that died while it wrote its version leaves the one before it standing
    create_file(spark, f"{root}/versions/{3:012d}.json", '["')
    assert rows(ours.read()) == [("g", "t", 0, 2, -1)]
    assert ours.append(commits(spark, ("g", "t", 0, 4))) == 4 and rows(ours.read()) == [("g", "t", 0, 4, -1)]


# --- runs of offsets -----------------------------------------------------------------------


def offsets_of(runs):
    return {(r["topic"], r["partition"], o) for r in runs.collect() for o in range(r["first"], r["last"] + 1)}


def positions(spark, points):
    return spark.createDataFrame([(t, p, o) for t, p, o in points], "topic string, partition int, at bigint")


def test_runs_are_sets_of_offsets(spark):
    width = 8
    rnd = random.Random(width)
    left = {("a", p, o) for p in range(2) for o in range(80) if rnd.random() < 0.7} | {("b", 0, 3)}
    right = {("a", p, o) for p in range(2) for o in range(90) if rnd.random() < 0.4} | {("c", 0, 9), ("c", 0, 10)}
    of = lambda points: staged(I.runs_of(positions(spark, [*points, *list(points)[:5]]), "at", width), "runs")
    a, b = of(left), of(right)
    assert offsets_of(a) == left and offsets_of(b) == right
    for got, expected in ((I.difference(a, b, width), left - right), (I.union(a, b, width), left | right)):
        got = staged(got, "runs")
        assert offsets_of(got) == expected
        assert rows(got) == rows(of(expected))  # maximal runs, none of which touch
    within = I.rows_within(positions(spark, left | right), b, "at", width)
    assert {tuple(r) for r in within.collect()} == right
    assert I.difference(a, a, width).count() == 0 and I.runs_of(positions(spark, left).limit(0), "at").count() == 0


# --- folded manifests ----------------------------------------------------------------------


def test_folders_stay_bounded_and_a_crash_changes_nothing(spark):
    root = new_path(spark, "job")
    table = FoldedTable(root, "manifest", width=4)

    def put(n):
        spark.createDataFrame([(n,)], "n int").write.mode("overwrite").parquet(f"{root}/manifest/round_no={n}")

    most = 0
    for n in range(50):
        put(n)
        table.fold(spark, before=n - 1)
        put(n)  # the last round may run again
        most = max(most, len(table.paths(spark)))
        if n % 7 == 0 or n == 49:
            assert rows(table.read(spark)) == [(i,) for i in sorted(range(n + 1), key=str)]
    assert most <= 4 + 4 + 3 and len(table.rounds(spark)) < 8
    before, paths = table.version(spark), table.paths(spark)
    # it ended after the part was written, and again while the version file was
    spark.createDataFrame([(99,)], "n int").write.parquet(f"{root}/manifest-folded/parts/lost")
    create_file(spark, f"{root}/manifest-folded/versions/{before.number + 1:012d}.json", '{"upto": 49, "pa')
    assert table.version(spark) == before and table.paths(spark) == paths
    for n in range(50, 56):
        put(n)
    assert table.fold(spark, before=55)
    assert rows(table.read(spark)) == [(i,) for i in sorted(range(56), key=str)]
    assert "lost" not in written_folders(spark, f"{root}/manifest-folded/parts")


# --- followed translation and fingerprint trees --------------------------------------------


def restored_part(spark, first, count, partitions=(0, 1), mark=None):
    """Records of a restored log whose source offsets are 3 apart, ``mark`` changes one value."""
    data = [
        (b"k", b"!" if o == mark and p == 0 else b"v%d" % o, {"h": b"1"}, "r.t", p, 1000 + o, o, 3 * o)
        for p in partitions
        for o in range(first, first + count)
    ]
    return spark.createDataFrame(data, T.StructType([*RECORD.fields, T.StructField("source_offset", T.LongType())]))


class Watched(SourceBlocks):
    """Notes the files that are read."""

    seen: list[list[str]]

    def read(self, files):
        self.seen.append(files)
        return super().read(files)


def group_entries(spark, targets):
    data = [(f"g{i}", "t", p, target + 1, target) for i, (p, target) in enumerate(targets)]
    return spark.createDataFrame(data, "group_id string, topic string, partition int, offset bigint, target bigint")


def test_followed_translation_equals_the_whole_one_and_reads_new_files_only(spark):
    log, root = new_path(spark, "topics"), new_path(spark, "blocks")
    table = Watched(spark, log, root, width=16)
    table.seen = []
    # below the start, found, between two records, last of a part, in a later part, beyond the log, no such partition
    entries = group_entries(spark, [(0, -1), (0, 30), (1, 31), (0, 57), (0, 58), (1, 90), (1, 150), (0, 500), (7, 3)])
    reads = []

    def appends():
        for first in (0, 20, 40):
            S.write_topics(restored_part(spark, first, 20), log, run=8)
            before = set(table.rows().select("file").distinct().toPandas()["file"])
            table.seen.clear()
            yield first
            reads.append((before, [f for files in table.seen for f in files]))

    resolved, remaining = translate_followed(entries, table, appends(), "r.")
    names_ = ["group_id", "partition", "case", "restored_offset"]
    whole = G.translate_offsets(entries, S.read_topics(spark, log), "r.", width=16).where("case <> 'pending'")
    late = {r["group_id"]: r["round"] for r in resolved.collect()}
    assert late == {"g0": 1, "g1": 1, "g2": 1, "g3": 1, "g4": 2, "g5": 2, "g6": 3}
    # an entry keeps the answer of its round; only "tip" is what a longer log calls "exact"
    got = {(a, b, "exact" if c == "tip" else c, d) for a, b, c, d in rows(resolved, *names_)}
    assert got == {(a, b, "exact" if c == "tip" else c, d) for a, b, c, d in rows(whole, *names_)}
    assert rows(remaining, "group_id") == [("g7",), ("g8",)]
    for before, read in reads[1:]:
        assert read and not before & set(read)
    assert table.extend() == 0
    again = SourceBlocks(spark, log, root, width=16).translate(entries, "r.")
    assert rows(again.where("case <> 'pending'"), *names_) == rows(whole, *names_)


def test_followed_translation_of_logs_out_of_order_and_without_rows(spark):
    log = new_path(spark, "topics")
    table = SourceBlocks(spark, log, new_path(spark, "blocks"), width=8)
    entries = group_entries(spark, [(0, 5), (0, 40), (0, 100)])
    assert {r["case"] for r in table.translate(entries, "r.").collect()} == {"pending"}
    rng = random.Random(5)
    for n in range(4):
        part = restored_part(spark, 10 * n, 10, (0,))
        # a target whose source offsets do not rise, and records without any
        shifted = F.when(F.col("offset") % 7 == 3, F.lit(-1)).otherwise(F.col("source_offset") + rng.randrange(20))
        S.write_topics(part.withColumn("source_offset", shifted.cast("bigint")), log, run=4)
        want = G.translate_offsets(entries, S.read_topics(spark, log), "r.", width=8)
        assert rows(table.translate(entries, "r.")) == rows(want)


class WatchedTree(PrintTree):
    def read(self, files):
        self.seen = files
        return super().read(files)


def test_tree_diff_reads_only_files_that_differ(spark):
    trees = []
    for mark in (None, 70):
        log = new_path(spark, "topics")
        tree = WatchedTree(spark, log, new_path(spark, "prints"), width=24, fan=2, levels=2)
        for first in (0, 64):
            S.write_topics(restored_part(spark, first, 64, mark=mark), log, run=8)
            tree.extend()
        trees.append(tree)
    left, right = trees
    assert rows(tree_diff(left, right)) == [("r.t", 0, 210, "changed")]
    assert len(left.seen) == 1 == len(right.seen) and left.rows().select("file").distinct().count() > 1
    # the spans above a differing block are the only ones that differ
    assert rows(differing_blocks(left, right)) == [("r.t", 0, 192)]
    # an append to one side is found without a rebuild, also in a partition the other side lacks
    S.write_topics(restored_part(spark, 128, 3, partitions=(1, 2)), right.log, run=8)
    got = rows(tree_diff(left, right))
    whole = C.restore_content_diff(
        S.read_topics(spark, left.log).drop("offset").withColumnRenamed("source_offset", "offset"),
        S.read_topics(spark, right.log),
    )
    assert got == rows(whole) and len(got) == 7
    assert tree_diff(left, left).isEmpty() and left.seen == []


def test_trees_of_empty_logs_and_of_other_shapes(spark):
    def tree(**how):
        return PrintTree(spark, new_path(spark, "topics"), new_path(spark, "prints"), **how)

    assert tree_diff(tree(), tree()).isEmpty()
    filled = tree(width=8, fan=2, levels=1)
    S.write_topics(restored_part(spark, 0, 5, (0,)), filled.log)
    found = tree_diff(tree(width=8, fan=2, levels=1), filled)
    assert rows(found, "source_offset", "verdict") == [(o, "extra") for o in (0, 12, 3, 6, 9)]
    with pytest.raises(ValueError, match="differently"):
        tree_diff(tree(fan=2), tree(fan=4))
