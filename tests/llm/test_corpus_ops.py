"""Packing, joins, sampling, models and search against brute force and odd rows."""

import collections
import hashlib
import pathlib
import random
import re
import tempfile
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from logharbor.llm import mixing as M
from logharbor.llm import nearest as N
from logharbor.llm import ngram_join as J
from logharbor.llm import packing as B
from logharbor.llm import quality_model as K
from logharbor.llm import suffix_dedup as S
from logharbor.llm import tokens as T
from logharbor.llm.queries import llm_queries

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PLAIN = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.tokenizer_path(T.TOKENIZER))


def token_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_gives_the_library_s_ids(library):
    rnd = random.Random(1)
    texts = ["", " ", "a" * 3000, "don't  stop\n\n x\t y ²½", "日本 <|endoftext|> x", "naïve—“q” …\x1c\x85z", "ÿ" * 999]
    letters = "abcdeéß AB12.,'\n\t-–…Ω漢<|>_"
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(200))) for _ in range(500)]
    assert T.Encoder(T.TOKENIZER).encode(texts) == [
        np.asarray(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts
    ]


def test_best_fit_fills_the_tightest_bin():
    bins = B.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert [sorted(b) for b in bins] == [[0, 2], [1, 3, 4]]
    assert B.best_fit(np.array([], dtype=np.int64), 10) == []
    assert B.pieces_of(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and B.pieces_of(2048, 2048) == [(0, 2048)]


def check_packing(library, docs, pieces, capacity=2048):
    expected = collections.Counter()
    for r in docs:
        ids = token_ids(library, r["text"])
        for i, (start, n) in enumerate(B.pieces_of(len(ids), capacity)):
            crc = zlib.crc32(np.array(ids[start : start + n], dtype="<u4").tobytes())
            expected[(r["doc_id"], i, start, n, crc)] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == expected
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in pieces)


def test_packing(spark, library):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()
    used, total = check_packing(library, docs, llm_queries()["op1_packing"](spark, MIDDLE).collect())
    assert used <= -(-total // 2048) + 2


def test_packing_of_odd_rows_in_many_rounds(spark, library):
    rows = [(1, None), (2, ""), (3, "x " * 3000), (3, "x " * 3000), (None, "null id"), (5, "a b c")]
    rows += [(i, "word " * (i % 40)) for i in range(10, 400)]
    docs = spark.createDataFrame(rows, PLAIN).repartition(16).withColumn("length", F.lit("clash"))
    pieces = B.pack_documents(docs, capacity=128, slack=2, fan_in=2).collect()
    used, total = check_packing(library, docs.collect(), pieces, 128)
    assert used <= 1.05 * total / 128 + 2
    assert B.pack_documents(docs.limit(0)).count() == 0
    for r in B.packed_sequences(docs.where("doc_id = 5 or doc_id is null")).collect():
        assert len(r["ids"]) == r["n_tokens"] == sum(r["lengths"])
        texts = {5: "a b c", None: "null id"}
        assert list(r["ids"]) == [t for d in r["doc_ids"] for t in token_ids(library, texts[d])]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked_by_hand(rows, least=0.8):
    texts = collections.defaultdict(list)
    for d, t in rows:
        if d is not None:
            texts[t or ""].append(d)
    names = list(texts)
    sets = [shingles(t) for t in names]
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = collections.Counter()
    for a in range(len(names)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= least * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    members = collections.defaultdict(list)
    for i, t in enumerate(names):
        members[root(i)] += texts[t]
    return {
        (d, t): (min(members[root(i)]) if sets[i] else d, links[i])
        for i, t in enumerate(names) for d in texts[t]
    }


def near_rows(seed, n):
    rnd = random.Random(seed)
    rows, base = [], [f"w{i}" for i in range(120)]
    for i in range(n):
        words = list(base if i % 3 else [f"v{seed}_{i // 30}_{k}" for k in range(60)])
        for _ in range(rnd.randrange(0, 5)):
            words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_near_duplicates(spark, monkeypatch):
    rows = near_rows(3, 180)
    rows += [(500 + i, rows[4][1]) for i in range(40)]
    rows += [(600, None), (601, ""), (602, " \n"), (None, rows[4][1]), (603, "a b c"), (604, "a  b c"), (605, "a b d"), (7, rows[7][1])]
    rows += [(700, "long " + " ".join(map(str, range(30_000)))), (701, "other " + " ".join(map(str, range(30_000))))]
    docs = spark.createDataFrame(rows, PLAIN).withColumn("class_id", F.lit("clash"))
    expected = linked_by_hand(rows)
    texts = collections.defaultdict(set)
    for d, t in rows:
        texts[d].add(t or "")
    for piece in (256, 24):
        monkeypatch.setattr(J, "PIECE", piece)
        got = J.near_duplicates(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is None:
                assert r["class_id"] is None
            else:
                (text,) = texts[r["doc_id"]]
                assert (r["class_id"], r["n_links"]) == expected[r["doc_id"], text]
    kept = J.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {c for c, _ in expected.values()} | {None}
    assert J.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_class_stays(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, alone = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"v{i}" for i in range(40))
    other = " ".join(f"u{i}" for i in range(40))
    rows = [(3, near), (2, text), (2, text), (5, text), (5, alone), (5, alone), (2, near), (8, ""), (8, None), (9, "")]
    rows += [(None, other)] * 30 + [(None, None), (None, ""), (11, "only words here"), (12, text)]
    columns = {"gone_id": F.lit(2), "node": F.lit("clash"), "gone_node": F.lit(b"x")}
    docs = spark.createDataFrame(rows, PLAIN).withColumns(columns)
    kept = J.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["text"] or "") for r in kept.collect())
    of_class = [k for k in got if k[1] in (text, near)]
    assert len(of_class) == 1 and of_class[0][0] == 2
    expected = {(5, alone), (8, ""), (9, ""), (None, other), (None, ""), (11, "only words here"), of_class[0]}
    assert got == dict.fromkeys(expected, 1)


def test_near_duplicates_of_the_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    expected = {d: v for (d, _), v in linked_by_hand(docs).items()}
    for r in llm_queries()["op2_ngram_join"](spark, SMALL).collect():
        assert (r["class_id"], r["n_links"]) == expected[r["doc_id"]]


def removed_by_hand(rows, length=50):
    last = 1 << 62
    rows = sorted((last if d is None else d, (t or "").encode()) for d, t in rows)
    first: dict[bytes, int] = {}
    for d, b in rows:
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = []
    for d, b in rows:
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((None if d == last else d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("alphabet", ["ab ", "abcdeé "])
@pytest.mark.parametrize("hot", [S.HOT, 600, 0])
def test_repeats(spark, alphabet, hot, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 3000)
    monkeypatch.setattr(S, "HOT", hot)
    rnd = random.Random(len(alphabet))
    base = ["".join(rnd.choice(alphabet) for _ in range(200)) for _ in range(5)]
    rows = [
        (rnd.randrange(70) if i % 17 else None,
         "".join(rnd.choice(base)[rnd.randrange(100) :][: rnd.randrange(20, 110)] for _ in range(rnd.randrange(1, 7))))
        for i in range(90)
    ]
    rows += [(3, rows[5][1]), (100, ""), (101, None), (102, "x" * 49), (103, "x" * 49), (104, "x" * 300), (105, "x" * 70), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(200, "é" * 20_000 + base[0]), (201, "y" * 30_000)]
    docs = spark.createDataFrame(rows, PLAIN).withColumn("bytes", F.lit(1))
    got = S.remove_repeats(docs, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == removed_by_hand(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert S.remove_repeats(docs.limit(0)).count() == 0


def _phrase_in_many_surroundings(spark, monkeypatch):
    """A third of 6000 documents hold one phrase of 40 bytes, each between bytes of its own."""
    monkeypatch.setattr(S, "CHUNK", 60_000)
    monkeypatch.setattr(S, "RANGE", 1 << 14)
    rnd = random.Random(40)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrase, passage = word(40), word(70)
    rows = []
    for i in range(6000):
        text = word(40)
        text += phrase if i % 3 == 0 else ""
        text += word(40)
        text += phrase[:30] + passage if i % 50 == 1 else ""
        rows.append((i, text))
    return spark.createDataFrame(rows, PLAIN), rows


def _most_windows(sent):
    """Windows that the largest group holds."""
    held = {}
    for r in sent.collect():
        if r["range"] < -64:  # single windows
            n = len(r["places"]) // 4
        elif r["range"] >= 0:
            n = int(np.frombuffer(r["counts"], dtype="<u4").sum())
        else:
            continue
        held[r["range"]] = held.get(r["range"], 0) + n
    return max(held.values())


def test_a_phrase_with_many_surroundings_is_split(spark, monkeypatch):
    docs, rows = _phrase_in_many_surroundings(spark, monkeypatch)
    want, whole, most = removed_by_hand(rows), S.stretches, {}
    for hot in (1 << 14, 1 << 30):
        sent = []
        monkeypatch.setattr(S, "HOT", hot)
        monkeypatch.setattr(S, "stretches", lambda *a, sent=sent: sent.append(whole(*a).cache()) or sent[0])
        got = S.remove_repeats(docs).drop("kept").collect()
        assert sorted((tuple(r) for r in got), key=str) == want
        most[hot] = _most_windows(sent[0])
        sent[0].unpersist()
    # all surroundings of the phrase meet in one range, unless they are dealt by window
    assert most[1 << 30] > 20_000 and most[1 << 14] < 7000, most


def test_repeats_of_the_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = llm_queries()["op3_suffix_dedup"](spark, SMALL).collect()
    assert sorted((tuple(r) for r in got), key=str) == removed_by_hand(rows)


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    level = 0.0
    for _ in range(len(names) + 1):
        full = {s for s in names if 2 * sizes[s] <= weight[s] * level}
        left = sum(weight[s] for s in names if s not in full)
        if not left:
            break
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / left
    return {s: min(2.0 * sizes[s], weight[s] * level) for s in names}


def test_mixing(spark):
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randrange(1, 60), rnd.choice(["a", "b", "é", "z", "zz", None, ""])) for i in range(2000)]
    rows += [(5000, None, "empty"), (5001, "", "a"), (None, "x y", "b"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        taken[source[r["doc_id"]]] += r["taken"]
    target = targets_by_hand(sizes)
    for r in got:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
    for s, want in target.items():
        assert abs(taken[s] - want) <= 130
    again = M.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert M.mix(docs.limit(0)).count() == 0
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns


@pytest.mark.parametrize("rows", [
    [(None, "w " * (1 + i % 30), "hot") for i in range(1500)],
    [(7, "the same nine words stand in every one", "hot")] * 1500,
])
def test_mixing_draws_rows_that_share_an_id_one_by_one(spark, rows):
    rows = [*rows, *((10_000 + i, "x " * 45, "cold") for i in range(300))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    target = targets_by_hand(sizes)
    assert any(target[s] % sizes[s] for s in sizes)  # some source is drawn, not copied whole
    got = M.mix(docs.repartition(5)).withColumn("hot", F.col("doc_id").isNull() | (F.col("doc_id") < 10_000)).collect()
    for hot, source in ((True, "hot"), (False, "cold")):
        taken = sum(r["taken"] for r in got if r["hot"] == hot)
        assert abs(taken - target[source]) <= max(r["size"] for r in got if r["hot"] == hot)
    again = M.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(str(Row(**{k: r[k] for k in r.asDict() if k != "hot"})) for r in got)
    mixed = collections.Counter(r["source"] for r in M.mixed_documents(docs).collect())
    words = {s: sum(len(t.split()) for _, t, x in rows if x == s) / sum(x == s for _, _, x in rows) for s in sizes}
    for s in sizes:
        assert abs(mixed[s] * words[s] - target[s]) <= 0.05 * target[s]


def test_pareto_order_is_that_of_random_by_inclusion_odds(spark):
    """The draw with unequal chances against one computed by hand from the same random numbers."""
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2], float(1 + i % 5)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, weight double")
    sized = M._sized(docs, "weight")
    plan = M.mixing_plan(sized, M.WEIGHTS, M.FACTOR, M.CEILING, 6, True)
    drawn = M._copies(sized, plan, M.CEILING, 6).collect()
    for source in "ab":
        own = [r for r in drawn if r["source"] == source]
        level, target = own[0]["level"], own[0]["target"]
        expected = {r["doc_id"]: min(M.CEILING, r["weight"] * level) for r in own}
        assert sum(expected[r["doc_id"]] * r["size"] for r in own) == pytest.approx(target)
        whole = {i: int(e) for i, e in expected.items()}
        taken = sum(whole[r["doc_id"]] * r["size"] for r in own)

        def ratio(r):
            u = ((r["draw"] & ((1 << 52) - 1)) + 0.5) / (1 << 52)
            c = expected[r["doc_id"]] - whole[r["doc_id"]]
            return u / (1 - u) / (c / (1 - c))

        numbers = {
            r["doc_id"]: r["draw"]
            for r in sized.select("doc_id", F.xxhash64(F.lit(6), "key", "number").alias("draw")).collect()
        }
        own = [{**r.asDict(), "draw": numbers[r["doc_id"]]} for r in own]
        open_ = sorted((r for r in own if expected[r["doc_id"]] > whole[r["doc_id"]]), key=ratio)
        copies = dict(whole)
        for r in open_:
            if taken + r["size"] / 2 > target:
                break
            copies[r["doc_id"]] += 1
            taken += r["size"]
        assert copies == {r["doc_id"]: r["copies"] for r in own}


def test_mixing_by_document_weight(spark):
    rows = [(i, "w " * (1 + i % 30), "ab"[i % 2], float(1 + i % 5)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, weight double")
    copies = collections.defaultdict(list)
    for r in M.mix(docs, weight="weight").collect():
        copies[1 + r["doc_id"] % 5].append(r["copies"])
    assert np.mean(copies[1]) < np.mean(copies[3]) <= np.mean(copies[5])


def test_quality_model(spark):
    got = llm_queries()["op7_quality_model"](spark, MIDDLE).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    right = [r["predicted"] == labels[r["doc_id"]] for r in held]
    assert len(held) > 20 and np.mean(right) > 0.9


def test_quality_model_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (None, "x"), (4, "w " * 100_000), (4, "w"), (9_007_199_254_740_993, "big id")], PLAIN
    ).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (77, 0)], "doc_id bigint, quality int")
    got = K.score_quality(docs, labels).collect()
    assert len(got) == 6 and {r["doc_id"] for r in got} == {1, 2, None, 4, 9_007_199_254_740_993}
    both = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (9_007_199_254_740_993, 1)], "doc_id bigint, quality int")
    assert K.score_quality(docs, both).count() == 6
    assert K.score_quality(docs, labels.limit(0)).first()["score"] == 0.5
    assert K.score_quality(docs.limit(0), both).count() == 0


def test_pool_adjacent_rises():
    rnd = np.random.default_rng(0)
    n = rnd.integers(0, 5, 100)
    levels = K.pool_adjacent(n, rnd.binomial(n, np.linspace(0, 1, 100)))
    assert (np.diff(levels) >= -1e-12).all() and 0 <= levels.min() and levels.max() <= 1


def isotonic_by_hand(n, ones):
    """Least-squares rising fit by its min-max formula, drawn through the middles of its steps."""
    at = np.flatnonzero(n)
    level = []
    for i in range(len(at)):
        means = [
            min(sum(ones[at[a : b + 1]]) / sum(n[at[a : b + 1]]) for b in range(i, len(at))) for a in range(i + 1)
        ]
        level.append(max(means))
    steps = []
    for bin_, value in zip(at, level, strict=True):
        if steps and abs(steps[-1][0] - value) < 1e-12:
            steps[-1][2] = bin_
        else:
            steps.append([value, bin_, bin_])
    return np.interp(np.arange(len(n)), [(a + b) / 2 for _, a, b in steps], [v for v, _, _ in steps])


@pytest.mark.parametrize("seed", range(4))
def test_pool_adjacent_is_the_isotonic_fit(seed):
    rnd = np.random.default_rng(seed)
    n = rnd.integers(0, 4, 40)
    n[7] = 3
    ones = rnd.binomial(n, np.linspace(0, 1, 40))
    assert np.allclose(K.pool_adjacent(n, ones), isotonic_by_hand(n, ones), atol=1e-12)


def test_ridge_equals_least_squares_of_all_rows(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model = K.fit(K.measures(docs).repartition(5), labels, features=32, ridge=0.5, seed=7)
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    rows = [(np.array(r["x"]), known[r["doc_id"]], zlib.crc32(str(r["doc_id"]).encode()) % 5)
            for r in K.measures(docs).collect() if r["doc_id"] in known]
    x = np.array([v for v, _, f in rows if f > 1])
    y = np.array([q for _, q, f in rows if f > 1], dtype=float)
    assert np.allclose(model.make.mean, x.mean(axis=0)) and len(x) > 100
    z = model.make(x)
    # ridge as plain least squares with a row for each coefficient
    beta, *_ = np.linalg.lstsq(
        np.vstack([z, np.sqrt(0.5) * np.eye(z.shape[1])]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None
    )
    assert np.abs(model.beta - beta).max() < 1e-6
    n, ones = np.zeros(K.BINS), np.zeros(K.BINS)
    for v, q, f in rows:
        if f == 1:
            at = int(model.place(v[None])[0])
            n[at] += 1
            ones[at] += q
    assert np.allclose(model.levels, isotonic_by_hand(n, ones), atol=1e-9)
    by_raw = model.score(x)[np.argsort(z @ model.beta)]
    assert (np.diff(by_raw) >= -1e-12).all() and 0 <= by_raw[0] and by_raw[-1] <= 1


def near_by_hand(vectors, queries, k=20):
    out = {}
    for q in queries:
        scores = sorted((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out[q] = [i for _, i in scores[:k]]
    return out


def test_nearest_reaches_its_recall(spark):
    table = spark.read.parquet(f"{MIDDLE}/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in table.collect()}
    got = collections.defaultdict(list)
    for r in llm_queries()["op9_nearest"](spark, MIDDLE).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i in vectors if i % 20 == 0]
    expected = near_by_hand(vectors, queries)
    assert set(got) == set(queries)
    recall = np.mean([len({v for _, v, _ in got[q]} & set(expected[q])) / 20 for q in queries])
    assert recall >= 0.9
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(s == pytest.approx(float(np.dot(vectors[q], vectors[v])), abs=1e-12) for _, v, s in found)


def test_multiprobe_reaches_its_recall_on_many_vectors(spark):
    """20,000 different vectors around the given ones; no length is searched whole."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    given = np.array([r["embedding"] for r in table.orderBy("vec_id").collect()], dtype=float)
    rng = np.random.default_rng(9)
    drawn = np.repeat(given, 10, axis=0)
    drawn += rng.normal(size=drawn.shape) * given.std(axis=0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(drawn)], "vec_id bigint, embedding array<double>")
    got = nearest_ids(rows)
    assert set(got) == set(range(0, 20_000, 20)) and all(len(v) == 20 for v in got.values())
    scores = drawn[::20] @ drawn.T
    scores[np.arange(1000), np.arange(0, 20_000, 20)] = -np.inf
    best = np.argpartition(-scores, 20, axis=1)[:, :20]
    shares = [len(set(got[20 * i]) & set(best[i].tolist())) / 20 for i in range(1000)]
    assert np.mean(shares) >= 0.9


def test_nearest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, float(i % 3)]) for i in range(400)]
    rows += [(1000, None), (1020, [0.0, 0.0, 0.0]), (1040, [nan, 1.0, 0.0]), (1060, [inf, 0.0, 0.0]), (1080, [None, 1.0, 0.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (2000, [1.0, 2.0]), (2001, [2.0, 1.0]), (20, rows[20][1])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("key", F.lit(1))
    vectors = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and i not in (1020, 1040, 1060, 1080)}
    got = collections.defaultdict(list)
    for r in N.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    queries = [i for i in vectors if i % 20 == 0]
    assert dict(got) == near_by_hand(vectors, queries)
    assert N.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def nearest_ids(table, **how):
    got = collections.defaultdict(list)
    found = N.nearest(table, F.col("vec_id") % 20 == 0, **how)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    return dict(got)


@pytest.mark.parametrize("lengths", [{8: 10}, {8: 300, 5: 15, 3: 21}])
def test_nearest_returns_all_of_few_candidates(spark, lengths):
    rng = np.random.default_rng(4)
    drawn = [(dim, i) for dim, n in lengths.items() for i in range(n)]
    vectors = {1 + i if i else 0: rng.normal(size=dim) for i, (dim, _) in enumerate(drawn)}
    rows = [(i, v.tolist()) for i, v in vectors.items()]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    expected = near_by_hand(vectors, [i for i in vectors if i % 20 == 0])
    got = nearest_ids(table)
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in expected.items()}
    for q, v in expected.items():
        assert len(v) == 20 or got[q] == v


def test_nearest_of_outliers_looks_everywhere(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 64)
    rng = np.random.default_rng(5)
    # queries lie on one side but two, whose own side is nearly empty
    middle = np.array([5.0, 0, 0, 0, 0, 0])
    vectors = {i: middle + 0.3 * rng.normal(size=6) for i in range(800)}
    vectors |= {i: -middle + 0.3 * rng.normal(size=6) for i in (1000, 1001, 1020, 1021)}
    rows = [(i, v.tolist()) for i, v in vectors.items()]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest_ids(table)
    expected = near_by_hand(vectors, [1000, 1020])
    assert {q: got[q] for q in expected} == expected
    assert len(got) == 42 and all(len(v) == 20 for v in got.values())


def test_nearest_holds_bounded_shares_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = {20 * i: rng.normal(size=8) for i in range(700)}  # all of them ask
    rows = [(i, v.tolist()) for i, v in vectors.items()]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    expected = near_by_hand(vectors, list(vectors))
    folder = tempfile.mkdtemp(prefix="run-")
    real = N._search

    def counted(rows, queries, k):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write(str(len(queries)))
        return real(rows, queries, k)

    monkeypatch.setattr(N, "ASKING", 64)
    monkeypatch.setattr(N, "SCORES", 50)
    monkeypatch.setattr(N, "_search", counted)
    # every query is a pilot and none may miss a neighbour, so the result is exact
    assert nearest_ids(table, pilots=700, recall=1.0) == expected
    held = [int(p.read_text()) for p in pathlib.Path(folder).iterdir()]
    assert len(held) >= 700 // 64 and max(held) < 2 * 64


def test_pipeline(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, docs
    from logharbor.llm.common import staged

    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = staged(stage(spark, kept, SMALL), "stage")
        assert kept.columns == columns
        seen[name] = kept.collect()
    # one text of each linked group is left, and it is the smallest id
    after_rules = [(r["doc_id"], r["text"]) for r in seen["quality rules"]]
    linked = linked_by_hand(after_rules)
    assert {r["doc_id"] for r in seen["n-gram Jaccard join"]} == {c for c, _ in linked.values()}
    assert not any(re.search(r"[\w.]+@\w+\.\w+", r["text"]) for r in seen["PII"])
    result = corpus_pipeline.run(spark, SMALL)
    corpus_pipeline.STAGES[0][1](spark, docs.limit(5), SMALL)  # frees nothing that the result reads
    packed = result.collect()
    tokens = collections.Counter()
    for r in packed:
        at = 0
        for d, n in zip(r["doc_ids"], r["lengths"], strict=True):
            tokens[d] += n
            at += n
        assert at == len(r["ids"]) == r["n_tokens"] <= 2048
    expected = collections.Counter()
    for r in seen["mixing sources to target weights"]:
        expected[r["doc_id"]] += len(token_ids(library, r["text"]))
    assert tokens == expected


def test_pipeline_of_odd_rows_leaves_only_its_result(spark, tmp_path):
    """Null ids, repeated rows and columns named like the operators' own, through all stages."""
    from logharbor.shared import shared_folder

    plain = spark.read.parquet(f"{SMALL}/documents.parquet").drop("n_chars")
    extra = plain.limit(20).withColumn("doc_id", F.lit(None).cast("bigint"))
    names = ("pii_candidates", "gone_id", "row", "node", "key", "number", "label", "copies", "c", "w")
    docs = plain.unionByName(extra).unionByName(plain.limit(30))
    docs = docs.withColumns({n: F.concat(F.lit(n), F.coalesce("text", F.lit("")).substr(1, 3)) for n in names})
    home = pathlib.Path(shared_folder(spark).removeprefix("file:")) / spark.sparkContext.applicationId
    kept, folders = docs, []
    before = {p.name for p in home.iterdir()} if home.exists() else set()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SMALL)
        out.write.parquet(f"{tmp_path}/{i}")
        folders.append({p.name for p in home.iterdir()} - before)
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert kept.columns == docs.columns and kept.count() > 100
            for n in names:
                assert kept.where(~F.col(n).startswith(n)).count() == 0
    # a stage's own tables are gone when the next one has started
    assert all(not earlier & later for earlier, later in zip(folders, folders[1:]))
    assert kept.count() > 0


def test_empty_pipeline(spark):
    kept = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SMALL)
        assert kept.count() == 0
