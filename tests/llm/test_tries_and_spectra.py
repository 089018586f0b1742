"""Circulant MinHash, whitening and the prefix trie against brute force and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logharbor.llm import circulant as C
from logharbor.llm import prefix_trie as T
from logharbor.llm import whitening as W
from logharbor.llm.queries import llm_queries
from logharbor.llm.textcode import U

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- circulant MinHash ---------------------------------------------------------------------


def sets_by_hand(texts):
    out = []
    for text in texts:
        w = re.findall(WORD, (text or "").translate(LOWER))
        out.append({tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()})
    return out


def components_by_hand(rows):
    sets = sets_by_hand([t for _, t in rows])
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for n, (i, _) in enumerate(rows):
        common = collections.Counter()
        for g in sets[n] if i is not None else ():
            common.update(where[g])
            where[g].append(n)
        for m, c in common.items():
            if 100 * c >= 80 * (len(sets[n]) + len(sets[m]) - c):
                root[top(n)] = top(m)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[top(n)] = min(least.get(top(n), i), i)
    out = []
    for n, (i, _) in enumerate(rows):
        c = None if i is None else least[top(n)]
        out.append((i, len(sets[n]), c, i is None or i == c))
    return sorted(out, key=str)


def test_second_permutation_is_one():
    x = np.random.default_rng(1).integers(0, 1 << 32, 200_000, dtype=np.uint64).astype(np.uint32)
    x = np.unique(x)
    assert len(np.unique(C.second_permutation(x))) == len(x)


def test_coordinates_are_shifts_of_one_permutation():
    text, h = np.array([0, 0, 2]), np.array([5, 9, 7], dtype=U)
    got = C.coordinates(text, h, 3, 6, 11)
    placed = C.first_permutation(h, 11)
    for k in range(6):
        each = C.second_permutation(placed + np.uint32(k))
        assert got[0, k] == min(each[:2]) and got[2, k] == each[2]
    assert not got[1].any()


def test_coordinates_estimate_the_similarity():
    rng = np.random.default_rng(2)
    shared, alone = rng.integers(0, 1 << 62, 800).astype(U), rng.integers(0, 1 << 62, 200).astype(U)
    a, b = np.concatenate([shared, alone[:100]]), np.concatenate([shared, alone[100:]])
    text = np.repeat([0, 1], [len(a), len(b)])
    s = C.coordinates(text, np.concatenate([a, b]), 2, 2000, 11)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.04


def test_components_of_the_documents(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = llm_queries()["op11_circulant_minhash"](spark, MIDDLE)
    assert as_rows(got) == components_by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_components_of_odd_rows_in_small_pieces(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(60)]
    rows = [(i, None) for i in range(3)] + [(3, ""), (4, " \n\t"), (5, "A b"), (6, "a  B"), (7, "é É"), (8, "É é")]
    for i in range(100, 180):  # copies of one text at various distances, many on the edge
        own = list(base)
        for _ in range(rnd.randrange(6)):
            own[rnd.randrange(60)] = rnd.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(i, rows[20][1].upper()) for i in range(200, 230)]  # equal sets
    rows += [(None, rows[20][1]), (None, rows[21][1]), (100, "other words stand here now"), (rows[30][0], rows[30][1])]
    rows.append((300, " ".join(rnd.choice(words) for _ in range(30_000))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit("clash"))
    assert as_rows(C.near_copies(docs, star=3, piece=2)) == components_by_hand(rows)
    assert C.near_copies(docs.limit(0)).count() == 0


def test_only_open_buckets_are_looked_at_again(spark, monkeypatch):
    """2000 different near texts share buckets; one comparison a member closes them."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    pieces = []
    real = C.residual_links

    def counted(*args):
        out = real(*args)
        pieces.append(out.count())
        return out

    monkeypatch.setattr(C, "residual_links", counted)
    got = C.near_copies(docs).collect()
    assert {r["component_id"] for r in got} == {0} and pieces == [0]


# --- whitening -----------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["random", "repeated", "steep", "diagonal"])
def test_components_of_a_matrix(n, kind):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    e = {
        "random": rng.uniform(0, 5, n),
        "repeated": np.concatenate([np.full(n // 2, 2.0), np.linspace(0, 1, n - n // 2)]),
        "steep": 10.0 ** -np.linspace(0, 14, n),
        "diagonal": rng.integers(1, 4, n).astype(float),
    }[kind]
    a = np.diag(e) if kind == "diagonal" else q @ np.diag(e) @ q.T
    values, vectors = W.components_of((a + a.T) / 2)
    assert np.abs(values - np.sort(e)[::-1]).max() < 1e-13 * 5
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * 5


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    e = np.concatenate([-(10.0 ** -rng.uniform(0, 12, 15)), 10.0 ** -rng.uniform(0, 12, 25)])
    a = q @ np.diag(e) @ q.T
    u = W.polar_factor((a + a.T) / 2)
    assert np.abs(u @ u - np.eye(40)).max() < 1e-13 and round(np.trace(u)) == 10


def whitened_by_hand(rows, k=16):
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    u = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(u), [int(v) for v in u.sum(axis=0)]
    c = u - u.mean(axis=0)
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    deviation = {i: sum((n * a - b) ** 2 for a, b in zip(v, s)) for i, v in x.items()}
    white = {i: (np.array(v) - u.mean(axis=0)) @ w[:, :k] / np.sqrt(e[:k]) for i, v in x.items()}
    return n, deviation, white, e[:k] / e.sum()


def test_whitening_of_the_embeddings(spark):
    table = spark.read.parquet(f"{MIDDLE}/embeddings.parquet")
    n, deviation, white, explained = whitened_by_hand([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = collections.defaultdict(dict)
    for r in llm_queries()["op12_whitening"](spark, MIDDLE).collect():
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-10
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-10)
        got[r["vec_id"]][r["component"]] = r["whitened"]
    assert set(got) == set(white) and all(sorted(v) == list(range(1, 17)) for v in got.values())
    ours = np.array([[got[i][k] for k in range(1, 17)] for i in sorted(got)])
    hand = np.array([white[i] for i in sorted(got)])
    sign = np.sign((ours * hand).sum(axis=0))
    assert np.abs(ours - hand * sign).max() < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(None, rows[1][1]), (5, rows[5][1])]
    good = list(rows)
    rows += [(200, None), (201, [nan, 1.0, 2.0]), (202, [1.0, None, 2.0]), (203, [-inf, 0.0, 0.0]), (204, [])]
    rows += [(300 + i, [float(i), 1.0]) for i in range(4)]  # one direction has no variance
    rows += [(400, [1.0] * 5), (401, [1.0] * 5)]  # a single distinct vector
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("x", F.lit(1))
    got = W.whiten(table.repartition(5)).collect()
    per = collections.Counter(r["vec_id"] for r in got)
    assert {i: 3 * c for i, c in collections.Counter(i for i, _ in good).items()} == {
        i: c for i, c in per.items() if i is None or i < 200
    }
    assert all(per[300 + i] == 1 for i in range(4)) and not {200, 201, 202, 203, 204, 400, 401} & set(per)
    n, deviation, _, _ = whitened_by_hand(good)
    assert all(r["n"] == n and r["deviation"] == deviation[r["vec_id"]] for r in got if r["vec_id"] in deviation)
    assert W.whiten(table.limit(0)).count() == 0


def test_deviation_beyond_a_long_is_null():
    fit = W.Fit(3, [3 * (1 << 40), 0])
    x = np.array([[1 << 40, 0], [1 << 41, 5], [(1 << 40) + (1 << 29), 1], [(1 << 40) + 700_000_000, 1]])
    assert fit.deviation(x) == [0, None, (3 << 29) ** 2 + 9, 2_100_000_000**2 + 9]


# --- prefix trie ---------------------------------------------------------------------------


def trie_by_hand(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    for turns in convs.values():
        turns.sort(key=lambda t: t[0])
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = convs.get(c - int(math.fmod(c, 20)), [])
        built[c] = [t[1:] for t in base[:h]] + [t[1:] for t in turns[h:]]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        words = len(re.findall(WORD, k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * words
            leaves[k[:d]] += not children[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(k), parent, len(m), children[k], leaves[k], saved[k], sha))
    return sorted(out, key=str)


def test_trie_of_the_conversations(spark):
    table = spark.read.parquet(f"{MIDDLE}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(llm_queries()["op13_prefix_trie"](spark, MIDDLE)) == trie_by_hand(rows)


def odd_conversations():
    rnd = random.Random(13)
    rows = []
    for c in [*range(-45, 130), 10_000_001]:
        if c % 20 == 0 and rnd.random() < 0.3:
            continue  # the base of some is absent
        for t in range(rnd.randrange(1, 7)):
            rows.append((c, t if t else None, rnd.choice(["user", None]), rnd.choice(["a b", "a", "", None, "x\ny z"])))
    rows += [(500, t, "user", f"t {t}") for t in range(120)]  # long
    rows += [(500 + i, t, "user", f"t {t}") for i in (1, 2, 20) for t in range(40)]
    rows += [(None, 1, "user", "no conversation"), (900, 3, "user", "same"), (900, 3, "user", "same")]
    return rows


def test_trie_of_odd_rows_in_small_units(spark):
    rows = odd_conversations()
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    table = table.withColumn("depth", F.lit("clash")).repartition(4)
    got = T.prefix_trie(table, fanout=3, band=7, shard=20, places=16, piece=12)
    assert as_rows(got) == trie_by_hand(rows)
    assert T.prefix_trie(table.limit(0)).count() == 0


def test_slots_are_minimal_and_perfect():
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 62), 1 << 62, (2, 50_000)).view(U)
    slots = T.SlotTable(*keys)
    assert sorted(slots.slots) == list(range(50_000))
    assert (slots.find(*keys) == slots.slots).all()
    assert (slots.find(keys[0], keys[1] ^ U(1)) == -1).all()
    assert not len(T.SlotTable(keys[0, :0], keys[1, :0]).slots)
    with pytest.raises(ValueError, match="not distinct"):
        T.SlotTable(keys[0, [1, 1]], keys[1, [1, 1]])
