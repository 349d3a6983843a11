"""Near-duplicate texts and vectors against brute force."""

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from textweir.llm import embedding_dedup as E
from textweir.llm import minhash as M
from textweir.llm.common import normal_word
from textweir.llm.components import components


def groups_of(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {(i, find(i)) for i in ids if find(i) != i}


def shingle_set(text):
    w = [x for t in (text or "").split() if (x := normal_word(t))]
    return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()


def brute_texts(rows, threshold):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None and t is not None]
    sets = [(i, s) for i, s in sets if s]
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if len(x & y) >= threshold * len(x | y)]
    return groups_of(pairs, {i for i, _ in sets})


def pairs_of(df):
    return {tuple(r) for r in df.collect()}


def test_components(spark):
    edges = [(2, 1), (3, 2), (4, 3), (9, 8), (8, 9), (5, 5), (None, 1), (20, 4), (21, 20)]
    assert pairs_of(components(spark.createDataFrame(edges, "u bigint, v bigint"))) == {(2, 1), (3, 1), (4, 1), (20, 1), (21, 1), (9, 8)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_registers():
    rng = np.random.default_rng(0)
    for jaccard in (0.3, 0.6, 0.9):
        n = 4000
        shared = int(n * 2 * jaccard / (1 + jaccard))
        both = rng.integers(0, 2**63, shared).astype(np.uint64)
        a, b = (np.concatenate((both, rng.integers(0, 2**63, n - shared).astype(np.uint64))) for _ in range(2))
        k = M.registers(np.repeat([0, 1], n), np.concatenate((a, b)), 2, 1024)
        union = M.registers(np.zeros(2 * n, int), np.concatenate((a, b)), 1, 1024)
        assert (M.merge(k[0], k[1]) == union[0]).all()
        size = M.cardinality(k)
        assert size == pytest.approx([n, n], rel=0.15)
        assert M.estimate(k[0], size[0], k[1:], size[1:])[0] == pytest.approx(jaccard, abs=0.08)


def test_texts_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    want = brute_texts([tuple(r) for r in docs.collect()], M.THRESHOLD)
    got = pairs_of(M.near_duplicates(docs))
    assert len(got & want) >= 0.95 * len(want) and got <= want | got & want and not got - want
    kept = M.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(got)


def test_odd_texts(spark):
    base = " ".join(f"w{k}" for k in range(200))
    near = base.replace("w7 ", "x7 ")
    rows = [(1, base, "p"), (2, near, None), (2, near, None), (3, None, "q"), (None, base, "r"), (4, "", "s"), (5, " ... ", "t"), (6, "a", "u"), (7, "A!", "v"), (8, "other words here", "w"), (9, base.upper() + " ", "x"), (10, "word " * 30_000, None), (11, "word " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string")
    got = pairs_of(M.near_duplicates(df))
    assert got == {(2, 1), (9, 1), (7, 6), (11, 10)} == brute_texts([r[:2] for r in rows], M.THRESHOLD)
    kept = M.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.id for r in kept.collect()), key=repr) == sorted(["p", "q", "r", "s", "t", "u", "w", None], key=repr)
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_thousands_of_copies(spark):
    text = " ".join(f"w{k}" for k in range(100))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" n"), (F.col("id") % 300).cast("string"))).otherwise("")).alias("text"))
    assert pairs_of(M.near_duplicates(df)) == {(k, 0) for k in range(1, 3000)}


def brute_vectors(ids, x, threshold):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = np.argwhere(np.triu(x @ x.T >= threshold, 1))
    return groups_of([(ids[a], ids[b]) for a, b in hit], set(ids))


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(3)
    seeds = rng.standard_normal((120, 32))
    x = np.concatenate([seeds, *(seeds[:60] + rng.standard_normal((60, 32)) * s for s in (0.05, 0.15, 0.25, 0.32, 0.4))])
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>, key int")
    want, got = brute_vectors(ids, x, E.THRESHOLD), pairs_of(E.near_vectors(df))
    assert want and not got - want and len(got & want) >= 0.97 * len(want)
    assert E.drop_near_vectors(df).count() == len(x) - len(got)


def test_buckets_are_gone_through_exactly():
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.standard_normal((150, 8)) * s for c, s in zip(rng.standard_normal((4, 8)) * 2, (0.1, 0.3, 0.5, 0.8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    edges = [(int(a), int(b)) for a, b in E.bucket_forest(ids, x, 0.95, block=20)]
    assert all(x[a] @ x[b] >= 0.95 - 1e-12 for a, b in edges) and groups_of(edges, ids.tolist()) == brute_vectors(ids.tolist(), x, 0.95)


def test_recall_of_the_tables():
    for n in (10, 10**6, 10**10):
        hashes, tables = E.plan_tables(n)
        assert 1 - (1 - E.collision(np.sqrt(0.1)) ** hashes) ** tables >= 0.99
    assert E.plan_tables(10**10)[0] > E.plan_tables(10**6)[0]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.001], "b"), (2, [2.0, 0.001], "b"), (3, None, "c"), (None, [1.0, 0.0], "d"), (4, [], "e"), (5, [0.0, 0.0], "f"), (6, [0.0, 0.0], "g"), (7, [float("nan"), 1.0], "h"), (8, [1.0, 0.0, 0.0], "i"), (9, [None, 1.0], "j"), (10, [0.0, -1.0], "k"), (11, [0.0, -1.0], "l"), (12, [float("nan"), 1.0], "m")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, key string")
    assert pairs_of(E.near_vectors(df)) == {(2, 1), (11, 10)}
    assert E.drop_near_vectors(df).columns == df.columns and E.drop_near_vectors(df).count() == len(rows) - 3
    assert E.near_vectors(df.limit(0)).count() == 0


def test_copies_of_copies_in_large_groups(spark):
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for g in range(60):
        base = [f"g{g}w{k}" for k in range(300)]

        def edited(words, n, mark):
            out = list(words)
            for k in rng.choice(len(words), n, replace=False):
                out[k] = f"{mark}x{k}"
            return out

        copies = [base, *(edited(base, 6, f"g{g}c{k}") for k in range(29))]
        own = [(g * 100 + k, " ".join(x)) for k, x in enumerate([*copies, edited(copies[29], 22, f"g{g}y")])]
        rows += own
        want |= brute_texts(own, M.THRESHOLD)
    got = pairs_of(M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got <= want and len(want - got) <= 1 and sum(i % 100 == 30 for i, _ in want) > 30


def test_chains_behind_many_leads(spark):
    """y is near x alone, and x is near eight leads that come before either."""
    rows, want = [], set()
    for g in range(60):
        base = [f"g{g}w{k}" for k in range(300)]
        x = [f"g{g}x{k}" if k in (40, 90, 140, 190) else w for k, w in enumerate(base)]
        y = [f"g{g}y{k}" if k % 13 == 5 else w for k, w in enumerate(x)]
        leads = [[f"g{g}l{n}" if k == 299 - n else w for k, w in enumerate(base)] for n in range(8)]
        own = [(g * 100 + k, " ".join(t)) for k, t in enumerate([*leads, x, y])]
        rows += own
        want |= brute_texts(own, M.THRESHOLD)
    assert sum(i % 100 == 9 for i, _ in want) == 60
    sets = [shingle_set(t) for _, t in rows[:10]]
    assert all(len(sets[k] & sets[9]) < M.THRESHOLD * len(sets[k] | sets[9]) for k in range(8))
    got = pairs_of(M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got <= want and len(want - got) <= 1
