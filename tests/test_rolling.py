import base64
import random
import subprocess
import sys

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from logharbor.operators import archive as A
from logharbor.operators import rolling
from logharbor.operators.rolling import _chunk_steps, _cut, _thread, roll_segments


def fold(sizes, firsts, min_size):
    """Literal roll: append a batch, close when the size is reached."""
    out, size, first = [], 0, None
    for n, offset in zip(sizes, firsts):
        first = offset if first is None else first
        size += n
        out.append((first, size >= min_size))
        if size >= min_size:
            size, first = 0, None
    return out


def threaded(steps, fan):
    """The levels of the roll without Spark."""
    levels = [steps]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rolling, "FAN", fan)
        while levels[-1]["chunk"].max() >= fan:
            groups = levels[-1].groupby(levels[-1]["chunk"] // fan)
            levels.append(pd.concat([rolling._combine(g) for _, g in groups]))
    known = levels.pop().assign(open_bytes=0, open_first=-1)
    entries = _thread(known)
    for level in reversed(levels):
        above = entries.rename(columns={"chunk": "group"})
        known = level.assign(group=level["chunk"] // fan).merge(above, on=["topic", "partition", "group"])
        entries = pd.concat([_thread(g) for _, g in known.groupby("group")])
    return entries


@settings(max_examples=300, deadline=None)
@given(
    sizes=st.lists(st.integers(0, 40), min_size=1, max_size=60),
    min_size=st.integers(1, 60),
    chunk=st.integers(1, 15),
    fan=st.sampled_from([2, 3, 16]),
)
def test_steps_equal_a_literal_fold(sizes, min_size, chunk, fan):
    firsts = [i * 10 for i in range(len(sizes))]
    batches = pd.DataFrame(
        {
            "topic": "t",
            "partition": 0,
            "batch_no": range(len(sizes)),
            "rows": 1,
            "bytes": sizes,
            "first_offset": firsts,
            "last_offset": firsts,
        }
    )
    batches["chunk"] = batches["batch_no"] // chunk
    steps = pd.concat([_chunk_steps(g, min_size) for _, g in batches.groupby("chunk")])
    entered = batches.merge(threaded(steps, fan), on=["topic", "partition", "chunk"])
    cut = pd.concat([_cut(g, min_size) for _, g in entered.groupby("chunk")])
    got = [(int(s), bool(c)) for s, c in zip(cut["segment"], cut["closes"])]
    assert got == fold(sizes, firsts, min_size)


@pytest.mark.parametrize(("chunk", "fan"), [(3, 16), (3, 2), (8192, 16)])
def test_roll_on_spark(spark, chunk, fan, monkeypatch):
    monkeypatch.setattr(rolling, "FAN", fan)
    rng = random.Random(3)
    data, expected = [], []
    for partition in range(3):
        sizes = [rng.choice([0, 1, 5, 20, 90]) for _ in range(50)]
        firsts = [i * 4 for i in range(50)]
        for i, (n, f) in enumerate(zip(sizes, firsts)):
            data.append(("t", partition, i, 4, n, f, f + 3))
        expected += [(partition, i, *x) for i, x in enumerate(fold(sizes, firsts, 60))]
    schema = "topic string, partition int, batch_no bigint, rows bigint, bytes bigint, first_offset bigint, last_offset bigint"
    rolled = roll_segments(spark.createDataFrame(data, schema).repartition(7), 60, chunk)
    got = sorted(tuple(r) for r in rolled.select("partition", "batch_no", "segment", "closes").collect())
    assert got == sorted(expected)


@settings(max_examples=100, deadline=None)
@given(
    sizes=st.lists(st.integers(0, 40), min_size=1, max_size=60),
    min_size=st.integers(1, 60),
    chunk=st.integers(1, 15),
)
def test_one_call_takes_many_chunks(sizes, min_size, chunk):
    """All chunks, groups and threads of a partition in a call each."""
    firsts = [i * 10 for i in range(len(sizes))]
    batches = pd.DataFrame(
        {"topic": "t", "partition": 0, "batch_no": range(len(sizes)), "rows": 1, "bytes": sizes,
         "first_offset": firsts, "last_offset": firsts}
    )
    batches["chunk"] = batches["batch_no"] // chunk
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rolling, "FAN", 3)
        levels = [_chunk_steps(batches.sample(frac=1, random_state=1), min_size)]
        while levels[-1]["chunk"].max() > 0:
            levels.append(rolling._combine(levels[-1].sample(frac=1, random_state=1)))
    entries = _thread(levels.pop().assign(open_bytes=0, open_first=-1))
    for level in reversed(levels):
        above = entries.rename(columns={"chunk": "group"})
        entries = _thread(level.assign(group=level["chunk"] // 3).merge(above, on=["topic", "partition", "group"]))
    cut = _cut(batches.merge(entries, on=["topic", "partition", "chunk"]), min_size)
    got = [(int(s), bool(c)) for s, c in zip(cut["segment"], cut["closes"])]
    assert got == fold(sizes, firsts, min_size)


def test_calls_follow_the_batches_not_the_chunk(spark, monkeypatch):
    """500 chunks of 4 batches a partition: as they fit in one call, every step makes one."""
    calls = spark.sparkContext.accumulator(0)

    def counted(function):
        def call(pdf, *rest):
            calls.add(1)
            return function(pdf, *rest)

        return call

    for function in (_chunk_steps, rolling._combine, _thread, _cut):
        monkeypatch.setattr(rolling, function.__name__, counted(function))
    n, rng = 2_000, random.Random(5)
    data, expected = [], []
    for partition in range(2):
        sizes = [rng.choice([0, 1, 5, 20, 90]) for _ in range(n)]
        firsts = [i * 4 for i in range(n)]
        data += [("t", partition, i, 4, b, f, f + 3) for i, (b, f) in enumerate(zip(sizes, firsts))]
        expected += [(partition, i, *x) for i, x in enumerate(fold(sizes, firsts, 600))]
    schema = "topic string, partition int, batch_no bigint, rows bigint, bytes bigint, first_offset bigint, last_offset bigint"
    rolled = roll_segments(spark.createDataFrame(data, schema).repartition(7), 600, 4)
    got = sorted(tuple(r) for r in rolled.select("partition", "batch_no", "segment", "closes").collect())
    assert got == sorted(expected)
    assert 0 < calls.value <= 2 * 7  # steps, two levels up, three down, cut


def test_tables_stay_as_small_as_a_segment():
    """A partition of many equal small batches: no group grows with it."""
    n, per_segment = 20_000, 500
    batches = pd.DataFrame(
        {"topic": "t", "partition": 0, "batch_no": range(n), "rows": 1, "bytes": 10,
         "first_offset": range(n), "last_offset": range(n)}
    )
    batches["chunk"] = batches["batch_no"] // 100
    level = pd.concat([_chunk_steps(g, 10 * per_segment) for _, g in batches.groupby("chunk")])
    while level["chunk"].max() >= rolling.FAN:
        groups = level.groupby(level["chunk"] // rolling.FAN)
        assert max(len(g) for _, g in groups) <= rolling.FAN * (per_segment + 2)
        level = pd.concat([rolling._combine(g) for _, g in groups])


def test_published_segments_hold_exactly_their_batches(spark):
    """Two polls a partition: only those reaching the size are published, a flush publishes the rest."""
    counts = {(0, 0): 10, (1, 0): 20, (0, 1): 20, (1, 1): 10, (0, 2): 5}
    data, at = [], {0: 0, 1: 0}
    for (partition, batch), n in sorted(counts.items(), key=lambda x: x[0][1]):
        for _ in range(n):
            data.append((b"k", b"v" * 9, {}, "t", partition, 0, at[partition], batch))
            at[partition] += 1
    schema = "key binary, value binary, headers map<string,binary>, topic string, partition int, timestamp bigint, offset bigint, batch_no bigint"
    log = spark.createDataFrame(data, schema)
    rolled = roll_segments(A.poll_batches(log), 200)
    names = ["partition", "first_offset", "rows"]
    closed = sorted(tuple(r) for r in A.segment_manifest(rolled, "p").select(*names).collect())
    assert closed == [(0, 0, 30), (1, 0, 20)]
    flushed = A.segment_manifest(rolled, "p", flush=True)
    assert sorted(tuple(r) for r in flushed.select(*names).collect()) == [(0, 0, 30), (0, 30, 5), (1, 0, 20), (1, 20, 10)]
    commits = A.committed_offsets(A.segment_manifest(rolled))
    assert sorted(tuple(r) for r in commits.select("partition", "committed").collect()) == [(0, 30), (1, 20)]
    assert A.open_rows(log, commits).count() == 15


@pytest.mark.parametrize("function", [_chunk_steps, rolling._combine, _thread, _cut])
def test_functions_run_where_the_package_is_missing(tmp_path, function):
    sent = base64.b64encode(cloudpickle.dumps(function)).decode()
    code = f"import base64, pickle; pickle.loads(base64.b64decode('{sent}')); import sys; assert 'logharbor' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)


def test_min_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        roll_segments(spark.createDataFrame([], "topic string"), 0)
