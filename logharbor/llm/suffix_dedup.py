"""Removal of passages that repeat across documents: every byte covered by a string of
``LENGTH`` bytes that also starts in a document with a smaller id.

Suffixes need to be compared by their first ``LENGTH`` bytes only, and most of them start no
repeated string.  So the sort is led up to by lossless steps:

1. Equal texts: only the first keeps going, the others are covered whole.
2. Cover: a window of ``LENGTH`` bytes is sampled at its smallest hash of ``GRAM`` bytes.  The
   choice depends on the window's bytes alone, so equal windows have equal samples.  (A
   cover by residues needs the triples of two thirds of all positions; this one needs a
   thirteenth.)  Samples are exchanged as sorted arrays; those that occur in one document
   only cannot start a repeat.
3. Stretches of windows with the same recurring sample are sent, with the bytes they span,
   to the range of that sample; a stretch that a chunk holds in several documents is sent
   for the smallest of them, which covers the others.
4. In each range the remaining suffixes are sorted: each ``LENGTH``-byte prefix is named by a
   96-bit fingerprint, names are sorted with their owners, and adjacent equal names show
   which suffixes also start in a document with a smaller id.

A sample whose different surroundings span more than ``HOT`` bytes in all chunks together (a short
phrase that very many documents hold) would make one range as large as the corpus.  The answers of
step 2 carry the weight of every sample, so each chunk knows these samples: it names their windows itself,
keeps the smallest owner of each name, and deals the names by their own hash.  Equal windows
have equal names, so they still meet, and nothing else has to.

Work is done on chunks of about ``CHUNK`` characters, kept compressed; a longer text is a
chunk of its own.  Questions and answers between chunks are arrays dealt by hash ranges, so
a passage that a third of all documents hold adds one entry per chunk, not per document.

Defined results: null texts are empty; rows without an id come after all ids and do not
cover each other, nor do rows that repeat an id (2^63 - 1 stands for none); an empty table gives an empty result.  Only
doc_id and text are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import column_or_null, staged, table
from logharbor.llm.textcode import _BASE, _INVERSE, U, _values, mix, powers
from logharbor.llm.tokens import blocks_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, GRAM = 50, 25
CHUNK = 1_500_000
#: Bytes of text for each range of hashes.
RANGE = 8 << 20
#: Bytes of different stretches above which the windows of a sample are dealt one by one.
HOT = 2 << 20
#: Tasks over which the rows of one text are dealt when they are compared with its first.
SALTS = 32
#: A sample within one document and these many bytes is asked about, any other is sent unasked.
LIGHT = 256
#: Ranges below this hold names of single windows, those up to -1 what a chunk covers by itself.
_OWN = 64
LAST_ID = (1 << 63) - 1

_CHUNK = "chunk bigint, ids binary, ends binary, bytes binary"


class Chunk:
    """Items (byte strings with an id each) laid out in one array."""

    def __init__(self, ids: bytes, ends: bytes, packed: bytes):
        import zstandard

        self.ids = np.frombuffer(ids, dtype="<i8")
        self.ends = np.frombuffer(ends, dtype="<i8")
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.raw = zstandard.decompress(packed)
        self.bytes = np.frombuffer(self.raw, dtype=np.uint8)

    @classmethod
    def of(cls, raw: bytes) -> Chunk:
        """A chunk for its bytes only."""
        made = cls.__new__(cls)
        made.raw, made.bytes = raw, np.frombuffer(raw, dtype=np.uint8)
        return made

    @staticmethod
    def row(ids: list[int], items: list[bytes]) -> dict:
        import hashlib

        import zstandard

        ends = np.cumsum([len(x) for x in items]).astype("<i8").tobytes()
        own = np.array(ids, dtype="<i8").tobytes()
        raw = b"".join(items)
        name = hashlib.blake2b(own + ends + raw, digest_size=8).digest()
        return {
            "chunk": int.from_bytes(name, "little", signed=True),
            "ids": own,
            "ends": ends,
            "bytes": zstandard.ZstdCompressor(level=9).compress(raw),
        }

    def hashes(self, width: int, seed: int = 0) -> np.ndarray:
        """Hash of the ``width`` bytes from each position."""
        n = len(self.bytes)
        if n < width:
            return np.empty(0, dtype=U)
        values = _values() if not seed else mix(_values() + U(seed))
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(values[self.bytes] * powers(_BASE, n), out=sums[1:])
        h = sums[width:] - sums[:-width]
        h *= powers(_INVERSE, n)[: n - width + 1]
        return mix(h)

    def range_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each range."""
        n = len(self.bytes)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(_values()[self.bytes] * powers(_BASE, n), out=sums[1:])
        return mix((sums[end] - sums[start]) * powers(_INVERSE, n + 1)[start])

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows with equal samples, run-length coded: item, start, count, sample."""
        empty = np.empty(0, dtype=np.int64)
        g = self.hashes(GRAM)
        n = len(self.bytes) - LENGTH + 1
        if n <= 0:
            return empty, empty, empty, np.empty(0, dtype=U)
        low, width = g, 1
        span = LENGTH - GRAM + 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[span - width : span - width + n])
        counts = np.maximum(0, self.ends - self.starts - LENGTH + 1)
        item = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum(counts) - counts
        at = np.arange(len(item)) - first[item] + self.starts[item]
        f = low[at]
        new = np.ones(len(f), dtype=bool)
        new[1:] = (f[1:] != f[:-1]) | (item[1:] != item[:-1])
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(f)))
        # smallest hashes crowd at the low end: mixed once more, they fill all ranges alike
        return item[head], at[head], length, mix(f[head])


def _key(f: np.ndarray, bits: int) -> np.ndarray:
    """Leading 32 + bits bits: the range and a 32-bit rest."""
    return f >> U(32 - bits)


def _light_and_heavy(
    item: np.ndarray, key: np.ndarray, count: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys that occur in one item and span little there, and the others."""
    if not len(key):
        return key, key
    order = np.lexsort((item, key))
    key, item, size = key[order], item[order], count[order] + LENGTH - 1
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    last = np.append(head, len(key))[1:] - 1
    heavy = (item[head] != item[last]) | (np.add.reduceat(size, head) > LIGHT)
    return key[head][~heavy], key[head][heavy]


def _weights(c: Chunk, at: np.ndarray, count: np.ndarray, key: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Bytes that the different stretches of each heavy key span."""
    if not len(heavy):
        return np.empty(0, dtype="<u4")
    mine = np.isin(key, heavy)
    at, size, key = at[mine], count[mine] + LENGTH - 1, key[mine]
    name = c.range_hashes(at, at + size)
    order = np.lexsort((name, key))
    name, key, size = name[order], key[order], size[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, size = key[new], size[new]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return np.minimum(np.add.reduceat(size, head), 0xFFFFFFFF).astype("<u4")


def _rest(keys: np.ndarray) -> np.ndarray:
    return (keys & U(0xFFFFFFFF)).astype("<u4")


def _split(keys: np.ndarray, values: np.ndarray) -> dict[int, bytes]:
    """Values of sorted keys by range."""
    of = (keys >> U(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    ends = np.append(cuts, len(of))[1:]
    return {int(of[a]): values[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)}


def _chunks_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Chunk]]:
    for row in batch.to_pylist():
        yield row["chunk"], Chunk(row["ids"], row["ends"], row["bytes"])


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        ids = batch.column("doc_id").to_pylist()
        for part in blocks_of(texts, CHUNK):
            items = [t.encode("utf-8", "surrogatepass") for t in texts[part]]
            yield pa.RecordBatch.from_pylist([Chunk.row(ids[part], items)], schema=_chunk_schema())


def _chunk_schema() -> pa.Schema:
    kind = pa.binary()
    return pa.schema([("chunk", pa.int64()), ("ids", kind), ("ends", kind), ("bytes", kind)])


def _ask(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for chunk, c in _chunks_of(batch):
            item, at, count, f = c.samples()
            key = _key(f, bits)
            alone, heavy = _light_and_heavy(item, key, count)
            one, more = _split(alone, _rest(alone)), _split(heavy, _rest(heavy))
            weighed = _split(heavy, _weights(c, at, count, key, heavy))
            ranges = sorted(one.keys() | more.keys())
            yield pa.RecordBatch.from_pydict(
                {
                    "range": pa.array(ranges, pa.int32()),
                    "chunk": pa.array([chunk] * len(ranges), pa.int64()),
                    "alone": pa.array([one.get(r, b"") for r in ranges], pa.binary()),
                    "heavy": pa.array([more.get(r, b"") for r in ranges], pa.binary()),
                    "weights": pa.array([weighed.get(r, b"") for r in ranges], pa.binary()),
                }
            )


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which light keys of a chunk also occur elsewhere, and which of its keys are hot."""
    alone = [np.frombuffer(b, dtype="<u4") for b in pdf["alone"]]
    heavy = [np.frombuffer(b, dtype="<u4") for b in pdf["heavy"]]
    weights = [np.frombuffer(b, dtype="<u4") for b in pdf["weights"]]
    every = np.concatenate(alone + heavy)
    weight = np.concatenate([np.full(sum(map(len, alone)), LENGTH, dtype="<u4"), *weights])
    order = np.argsort(every, kind="stable")
    every, weight = every[order], weight[order]
    head = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    size = np.diff(np.append(head, len(every)))
    again = every[head][size > 1]
    hot = every[head][np.add.reduceat(weight.astype(np.int64), head) > HOT]
    keys = [a[np.isin(a, again, assume_unique=True)].tobytes() for a in alone]
    asked = (np.concatenate(x) for x in zip(alone, heavy, strict=True)) if len(hot) else ()
    hots = [x[np.isin(x, hot)].tobytes() for x in asked] or b""
    answers = pd.DataFrame({"chunk": pdf["chunk"], "range": pdf["range"], "keys": keys, "hot": hots})
    return answers[(answers["keys"].map(len) > 0) | (answers["hot"].map(len) > 0)]


def ask_and_answer(chunks: DataFrame, total_bytes: int) -> DataFrame:
    """``chunks`` with the sample keys that each shares with other chunks."""
    bits = max(2, min(24, (total_bytes // 3 // RANGE).bit_length()))
    asked = chunks.mapInArrow(
        lambda batches: _ask(batches, bits),
        "range int, chunk bigint, alone binary, heavy binary, weights binary",
    )
    answers = staged(
        asked.groupBy("range").applyInPandas(_answer, "chunk bigint, range int, keys binary, hot binary"),
        "answers",
    )
    by_chunk = answers.groupBy(F.col("chunk").alias("asker")).agg(
        F.collect_list(F.struct("range", "keys", "hot")).alias("answers")
    )
    return chunks.join(by_chunk, chunks["chunk"] == by_chunk["asker"], "left").select(
        *chunks.columns, "answers", F.lit(bits).alias("bits")
    )


def _recurring(c: Chunk, answers: list[dict] | None, bits: int):
    """Windows whose sample may recur in another item: item, start, count, sample, whether it is hot."""
    item, at, count, f = c.samples()
    key = _key(f, bits)
    _, heavy = _light_and_heavy(item, key, count)

    def told(name: str) -> list[np.ndarray]:
        return [np.frombuffer(a[name], dtype="<u4").astype(U) | (U(a["range"]) << U(32)) for a in answers or []]

    hit = np.isin(key, np.concatenate([heavy, *told("keys")]))
    hot = np.isin(key, np.concatenate([heavy[:0], *told("hot")]))
    hit |= hot
    return item[hit], at[hit], count[hit], f[hit], hot[hit]


def _single_windows(c: Chunk, item: np.ndarray, at: np.ndarray, count: np.ndarray, bits: int):
    """Windows of hot samples, dealt by their own names: per range, places, checks, owners, names.

    The first range has the places that the chunk covers by itself.
    """
    head = np.cumsum(count) - count
    place = np.arange(int(count.sum())) + np.repeat(at - head, count)
    owner = c.ids[np.repeat(item, count)]
    name = c.hashes(LENGTH)[place]
    check = (c.hashes(LENGTH, 1)[place] >> U(32)).astype("<u4")
    order = np.lexsort((place, owner, check, name))
    place, owner, name, check = place[order], owner[order], name[order], check[order]
    new = np.ones(len(name), dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (check[1:] != check[:-1])
    own = owner > owner[np.flatnonzero(new)][np.cumsum(new) - 1]
    if own.any():
        n = int(own.sum())
        yield None, place[own], np.ones(n, dtype="<u4"), owner[own], b""
    sent = np.flatnonzero(~own)
    of = (name[sent] >> U(64 - max(1, bits - 3))).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    for a, b in zip(cuts.tolist(), np.append(cuts, len(of))[1:].tolist(), strict=True):
        which = sent[a:b]
        yield -1 - _OWN - int(of[a]), place[which], check[which], owner[which], name[which].astype("<u8").tobytes()


def _stretches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Stretches of windows with a recurring sample, by range of the sample.

    Rows with a negative range carry what a chunk covers by itself.
    """
    import zstandard

    for batch in batches:
        for row in batch.to_pylist():
            c = Chunk(row["ids"], row["ends"], row["bytes"])
            item, at, count, f, hot = _recurring(c, row["answers"], row["bits"])
            if not len(item):
                continue
            out = []
            if hot.any():
                out = list(_single_windows(c, item[hot], at[hot], count[hot], bits))
                item, at, count, f = item[~hot], at[~hot], count[~hot], f[~hot]
            owner = c.ids[item]
            name = c.range_hashes(at, at + count + LENGTH - 1)
            order = np.lexsort((owner, name, f))
            owner, name, f, at, count = (x[order] for x in (owner, name, f, at, count))
            new = np.ones(len(f), dtype=bool)
            new[1:] = (f[1:] != f[:-1]) | (name[1:] != name[:-1])
            smallest = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
            own = owner > smallest
            if own.any():
                out.append((None, at[own], count[own], owner[own], b""))
            sent = np.flatnonzero(~own)  # every place of it in that document
            of = (f[sent] >> U(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            pack = zstandard.ZstdCompressor(level=3).compress
            for a, b in zip(cuts.tolist(), np.append(cuts, len(of))[1:].tolist(), strict=True):
                which = sent[a:b]
                spans = zip(at[which].tolist(), count[which].tolist(), strict=True)
                packed = pack(b"".join([c.raw[x : x + n + LENGTH - 1] for x, n in spans]))
                out.append((int(of[a]), at[which], count[which], owner[which], packed))
            covers = -1 - row["chunk"] % _OWN
            kinds = {1: "<u4", 2: "<u4", 3: "<i8"}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([covers if x[0] is None else x[0] for x in out], pa.int32()),
                    pa.array([row["chunk"]] * len(out), pa.int64()),
                    *(pa.array([x[i].astype(kind).tobytes() for x in out], pa.binary()) for i, kind in kinds.items()),
                    pa.array([x[4] for x in out], pa.binary()),
                ],
                names=["range", "chunk", "places", "counts", "owners", "spans"],
            )


def stretches(chunks: DataFrame, total_bytes: int) -> DataFrame:
    """What chunks send to be compared, by range."""
    bits = max(2, min(24, (total_bytes // RANGE).bit_length()))
    return ask_and_answer(chunks, total_bytes).mapInArrow(
        lambda batches: _stretches(batches, bits),
        "range int, chunk bigint, places binary, counts binary, owners binary, spans binary",
    )


def _batched(spans: pd.Series, counts: list[np.ndarray], size: int = 1 << 20):
    """Unpacked spans and the window counts of their stretches, about ``size`` bytes at a time."""
    import zstandard

    raw, own, held = [], [], 0
    for packed, count in zip(spans, counts, strict=True):
        raw.append(zstandard.decompress(packed))
        own.append(count)
        held += len(raw[-1])
        if held >= size:
            yield b"".join(raw), np.concatenate(own)
            raw, own, held = [], [], 0
    if raw:
        yield b"".join(raw), np.concatenate(own)


def _window_names(raw: bytes, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of fingerprint of every window of the stretches laid out in ``raw``."""
    count = count.astype(np.int64)
    start = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    head = np.cumsum(count) - count
    pos = np.arange(int(count.sum())) + np.repeat(start - head, count)
    c = Chunk.of(raw)
    return c.hashes(LENGTH)[pos], (c.hashes(LENGTH, 1)[pos] >> U(32)).astype(np.uint32)


def _larger_owners(name: np.ndarray, check: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which entries have an owner above the smallest of their name."""
    order = np.lexsort((owner, check, name))
    name = name[order]
    check = check[order]
    owner = owner[order]
    new = np.ones(len(name), dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (check[1:] != check[:-1])
    del name, check
    head_of = np.flatnonzero(new)
    larger = owner > np.repeat(owner[head_of], np.diff(np.append(head_of, len(owner))))
    covered = np.empty(len(owner), dtype=bool)
    covered[order] = larger
    return covered


def _compare_names(pdf: pd.DataFrame) -> pd.DataFrame:
    """Like :func:`_compare_adjacent` for windows that come with their names."""
    places, checks, owners, names = (
        [np.frombuffer(b, dtype=kind) for b in pdf[column]]
        for column, kind in (("places", "<u4"), ("counts", "<u4"), ("owners", "<i8"), ("spans", "<u8"))
    )
    covered = _larger_owners(np.concatenate(names), np.concatenate(checks), np.concatenate(owners))
    ends = np.cumsum([len(x) for x in places])
    out = []
    for place, hit in zip(places, np.split(covered, ends[:-1]), strict=True):
        at = np.sort(place[hit])
        out.append(np.stack([at, np.ones_like(at)], axis=1).astype("<u4").tobytes())
    found = pd.DataFrame({"chunk": pdf["chunk"], "covered": out})
    return found[found["covered"].map(len) > 0]


def _compare_adjacent(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sort the suffixes of one range; those that equal one of a smaller owner are covered."""
    read = lambda column, kind: [np.frombuffer(b, dtype=kind) for b in pdf[column]]
    places, counts = read("places", "<u4"), read("counts", "<u4")
    if pdf["range"].iloc[0] < -_OWN:
        return _compare_names(pdf)
    if pdf["range"].iloc[0] < 0:
        pairs = [np.stack([p, n], axis=1) for p, n in zip(places, counts, strict=True)]
        return pd.DataFrame({"chunk": pdf["chunk"], "covered": [x.tobytes() for x in pairs]})
    sizes = [len(x) for x in places]
    place, count = np.concatenate(places).astype(np.int64), np.concatenate(counts).astype(np.int64)
    head = np.cumsum(count) - count
    named = [_window_names(*part) for part in _batched(pdf["spans"], counts)]
    name = np.concatenate([n for n, _ in named])
    check = np.concatenate([c for _, c in named])
    del named
    # ranks of the ids, as they are compared only
    _, rank = np.unique(np.concatenate(read("owners", "<i8")), return_inverse=True)
    owner = np.repeat(rank.astype(np.int32), count)
    covered = _larger_owners(name, check, owner)
    del name, check, owner
    # covered windows as (place, count), per chunk
    at = np.flatnonzero(covered)
    stretch = np.searchsorted(head, at, side="right") - 1
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (stretch[1:] != stretch[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    at, stretch = at[first], stretch[first]
    pairs = np.stack([place[stretch] + at - head[stretch], length], axis=1).astype("<u4")
    chunk_of = np.searchsorted(np.cumsum(sizes), stretch, side="right")
    cuts = np.searchsorted(chunk_of, np.arange(len(sizes) + 1))
    out = [pairs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    found = pd.DataFrame({"chunk": pdf["chunk"], "covered": out})
    return found[found["covered"].map(len) > 0]


def _remove(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        for row in batch.to_pylist():
            c = Chunk(row["ids"], row["ends"], row["bytes"])
            edge = np.zeros(len(c.bytes) + 1, dtype=np.int32)
            for cut in row["cuts"] or []:
                spans = np.frombuffer(cut, dtype="<u4").reshape(-1, 2).astype(np.int64)
                np.add.at(edge, spans[:, 0], 1)
                np.add.at(edge, spans[:, 0] + spans[:, 1] + LENGTH - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            out: dict[str, list] = {k: [] for k in _RESULT}
            kept_bytes = c.bytes[~gone].tobytes() if gone.any() else c.raw
            kept_before = np.concatenate([[0], np.cumsum(~gone)])
            for i, (a, b) in enumerate(zip(c.starts.tolist(), c.ends.tolist(), strict=True)):
                own = gone[a:b]
                n = int(own.sum())
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
                kept = kept_bytes[kept_before[a] : kept_before[b]]
                out["doc_id"].append(None if c.ids[i] == LAST_ID else int(c.ids[i]))
                out["n_bytes"].append(b - a)
                out["n_removed"].append(n)
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if with_text else None)
            yield pa.RecordBatch.from_pydict(out, schema=_result_schema())


_RESULT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _result_schema() -> pa.Schema:
    long = pa.int64()
    kinds = (long, long, long, long, pa.string(), pa.binary())
    return pa.schema(list(zip(_RESULT, kinds, strict=True)))


def _later_copies(known: DataFrame) -> DataFrame:
    """Rows whose text a row with a smaller id has too.

    The smallest id of a text is found map-side first.  Only texts that several rows hold are
    joined back, and each of them by ``SALTS`` keys, so that rows of one text are dealt to as many tasks.
    """
    first = (
        known.groupBy("sha")
        .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .where(F.col("last_id") > F.col("first_id"))
        .select("sha", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = known.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first.hint("merge"), ["sha", "salt"])
    return joined.where(F.col("doc_id") > F.col("first_id")).select(known.columns)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    rows = docs.select(
        F.coalesce(column_or_null(docs, "doc_id", "bigint"), F.lit(LAST_ID)).alias("doc_id"),
        F.coalesce(column_or_null(docs, "text", "string"), F.lit("")).alias("text"),
    )
    known = staged(
        rows.select(
            "doc_id",
            F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
            F.octet_length("text").cast("bigint").alias("n_bytes"),
        ),
        "texts",
    )
    copies = staged(_later_copies(known), "copies")
    gone = copies.select(F.col("doc_id").alias("copy_id"), F.col("sha").alias("copy_sha")).distinct()
    # the same join at every size: the list of copies grows with the input
    kept = rows.join(
        gone.hint("merge"),
        (F.col("doc_id") == F.col("copy_id"))
        & (F.sha2(F.col("text").cast("binary"), 256) == F.col("copy_sha")),
        "left_anti",
    )
    chunks = staged(kept.mapInArrow(_pack_texts, _CHUNK), "chunks")
    total = known.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]

    covered = staged(
        stretches(chunks, total).groupBy("range").applyInPandas(
            _compare_adjacent, "chunk bigint, covered binary"
        ),
        "covered",
    )
    cuts = covered.groupBy(F.col("chunk").alias("cut_chunk")).agg(
        F.collect_list("covered").alias("cuts")
    )
    result = (
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        "kept binary"
    )
    cleaned = (
        chunks.join(cuts, chunks["chunk"] == cuts["cut_chunk"], "left")
        .select("ids", "ends", "bytes", "cuts")
        .mapInArrow(lambda batches: _remove(batches, with_text), result)
    )
    long = F.col("n_bytes") >= LENGTH
    whole = copies.select(
        F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.when(long, F.col("n_bytes")).otherwise(0).cast("bigint").alias("n_removed"),
        long.cast("bigint").alias("n_spans"),
        F.when(long, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    if not with_text:
        return cleaned.drop("kept").unionByName(whole)
    short = rows.select("text", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"))
    short = short.where(F.octet_length("text") < LENGTH).dropDuplicates(["text_sha"])
    texts = whole.join(short, F.col("kept_sha256") == F.col("text_sha"), "left").select(
        *whole.columns, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept")
    )
    return cleaned.unionByName(texts)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and the digest of what is kept."""
    return remove_repeats(table(spark, sf_dir, "documents"))
