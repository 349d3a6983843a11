"""Engines and result algebra against numpy and plain Python."""

import numpy as np
import pytest

from textweir.search import result as R
from textweir.search.auto import auto_engine
from textweir.search.base import Search
from textweir.search.dense import DenseConfig, DenseSearch, as_matrix, parse_factory, train
from textweir.search.index import Index
from textweir.search.lookup import GroupLookupSearch, TopkSearch

NEG = float("-inf")


def vectors(spark, n, d, field, seed):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"`__idx__` bigint, `{field}.vector` array<double>")


def long(spark, rows):
    return spark.createDataFrame(rows or [], "qid bigint, idx bigint, score double")


def as_dict(df):
    return {(r.qid, r.idx): r.score for r in df.collect()}


def test_merge(spark):
    a = [(0, 0, 100.1), (0, 1, 101.2), (0, 2, 102.3), (1, 10, 10.1), (1, 12, 10.2), (1, -1, NEG)]
    b = [(0, 2, 102.1), (0, 3, 103.2), (0, -1, NEG), (1, 12, 12.1), (1, 13, 13.2), (1, 13, 1.0)]
    got = as_dict(R.sum_scores(long(spark, a), long(spark, b)))
    assert got == pytest.approx({(0, 0): 100.1, (0, 1): 101.2, (0, 2): 204.4, (0, 3): 103.2, (1, 10): 10.1, (1, 12): 22.3, (1, 13): 14.2})
    got = as_dict(R.merge_results(long(spark, [(0, 1, 5.0), (0, 2, 3.0), (1, 7, NEG)]), long(spark, [(0, 2, 4.0), (0, 9, 1.0), (1, 8, 2.0)])))
    assert got == {(0, 1): 6.0, (0, 2): 7.0, (0, 9): 4.0, (1, 7): NEG, (1, 8): 2.0}
    wide = R.to_wide(long(spark, [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 5.0)]), 4).first()
    assert wide["idx"] == [3, 1, 2, -1] and wide["score"] == [5.0, 1.0, 1.0, NEG]
    back = as_dict(R.to_long(R.to_wide(long(spark, a), 4), "qid", "idx", "score"))
    assert (1, -1) not in back and back[0, 2] == 102.3


def best(q, v, k):
    return np.argsort(-(q @ v.T), axis=1)[:, :k]


@pytest.mark.parametrize("factory", ["flat", "IVF1,Flat", "PCAR8,IVF4,Flat", "OPQ2_8,IVF4,Flat"])
def test_dense(spark, factory):
    v, corpus = vectors(spark, 300, 8, "index", 1)
    q, queries = vectors(spark, 16, 8, "query", 2)
    engine = DenseSearch(DenseConfig(k=10, factory=factory)).build(corpus)
    got = {r["__idx__"]: r["index.idx"] for r in engine(queries).collect()}
    assert [got[i] for i in range(16)] == best(q, v, 10).tolist()


def test_product_codes(spark):
    v, corpus = vectors(spark, 400, 8, "index", 1)
    q, queries = vectors(spark, 20, 8, "query", 2)
    found = DenseSearch(DenseConfig(k=20, factory="IVF4,PQ4x6")).build(corpus).search(queries).collect()
    want = best(q, v, 5)
    hit = np.mean([len({r.idx for r in found if r.qid == i} & set(want[i])) / 5 for i in range(20)])
    assert hit >= 0.9


def test_factory():
    f = parse_factory("OPQ16_64,IVF100,PQ8x4fs")
    assert (f.rotation, f.parts, f.dim, f.lists, f.codes, f.bits) == ("OPQ", 16, 64, 100, 8, 4)
    for bad in ("IVF100", "Flat", "IVF,Flat"):
        with pytest.raises(ValueError):
            parse_factory(bad)
    with pytest.raises(ValueError):
        train(np.eye(6), parse_factory("IVF1,PQ4"))
    import pyarrow as pa

    with pytest.raises(ValueError):
        as_matrix(pa.array([[1.0], [1.0, 2.0]]))


def test_lookup(spark):
    g = np.linspace(0, 10, 1000).astype(int).tolist()
    corpus = spark.createDataFrame(list(enumerate(g)), "`__idx__` bigint, `index.group_idx` bigint")
    queries = spark.createDataFrame([(i, i if i < 12 else None) for i in range(13)], "`__idx__` bigint, `query.group_idx` bigint")
    for r in GroupLookupSearch({"k": 120}).build(corpus)(queries).collect():
        own = [i for i, x in enumerate(g) if x == r["query.group_idx"]]
        assert r["index.idx"] == own + [-1] * (120 - len(own))
        assert all((i == -1) == (s == NEG) and (i == -1 or s == 0) for i, s in zip(r["index.idx"], r["index.score"]))


def test_index_chain_and_storage(spark, tmp_path):
    v, corpus = vectors(spark, 100, 8, "index", 1)
    q, queries = vectors(spark, 50, 8, "query", 2)
    engines = [{"name": "dense", "config": {"k": 50}}, {"name": "topk", "config": {"k": 10}}]
    index = Index(corpus, engines, cache_dir=str(tmp_path))
    out = index(queries)
    assert out.columns == ["__idx__", "query.vector", "index.idx", "index.score"]
    got = {r["__idx__"]: r["index.idx"] for r in out.collect()}
    assert [got[i] for i in range(50)] == best(q, v, 10).tolist()
    path = index.engines[0].path
    again = Search.load_from_path(spark, path)
    assert again.config.k == 50 and len(again) == 100 and as_dict(again.search(queries)) == as_dict(index.engines[0].search(queries))
    assert index.engines[0].exists(spark)
    index.engines[0].rm(spark)
    assert not index.engines[0].exists(spark)
    with pytest.raises(ValueError):
        Index(corpus, [])
    with pytest.raises(ValueError):
        Index(corpus, [auto_engine("dense"), auto_engine("topk", {"query_field": "other"})])
    with pytest.raises(ValueError):
        auto_engine("none")
    with pytest.raises(ValueError):
        TopkSearch()(queries)


def test_results_of_two_engines_are_merged(spark):
    text = ["red apple", "green apple pie", "blue sky", None, ""]
    corpus = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(text)], "`__idx__` bigint, `index.text` string, `index.group_idx` int")
    queries = spark.createDataFrame([(0, "Apple pie!", 0), (1, "nothing here", 1), (2, None, None)], "`__idx__` bigint, `query.text` string, `query.group_idx` int")
    out = Index(corpus, [auto_engine("bm25", {"k": 3}), auto_engine("lookup", {"k": 3})])(queries)
    got = {r["__idx__"]: (r["index.idx"], r["index.score"]) for r in out.collect()}
    # the lookup's hits get the least score of the others and the other way round
    assert set(got[0][0]) == {1, 0, 2} and got[0][0][0] == 1 and got[1][0] == [1, 3, -1] and got[2][0] == [-1, -1, -1]
    filled = auto_engine("lookup", {"k": 4, "fill_missing": True}).build(corpus)(queries)
    assert all(0 <= i < 5 for r in filled.collect() for i in r["index.idx"])


def test_exact_search_hands_on_k_for_a_partition(spark, monkeypatch):
    """Not for each pair of blocks; before, the rows that were sorted grew with the square of the table."""
    from textweir.search import dense

    monkeypatch.setattr(dense, "top_k", lambda found, k: found.withColumn("rank", dense.F.lit(1)))
    _, corpus = vectors(spark, 3 * dense.BLOCK, 4, "index", 1)
    _, queries = vectors(spark, 20, 4, "query", 2)
    search = lambda q, v: dense.exact_search(*(x.coalesce(1).toDF("id", "vector") for x in (q, v)), 3)
    assert search(queries, corpus).count() == 20 * 3


@pytest.mark.parametrize("metric", ["inner_product", "l2"])
@pytest.mark.parametrize("scale", [1e-20, 1.0, 1e20])
def test_screening_loses_nothing(metric, scale):
    """Repeated vectors, near ties that single precision can't tell apart, and numbers that it can't hold."""
    from textweir.search.dense import Best, exact_scores

    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 6)).repeat(30, axis=0)
    x[::2] += 1e-9 * rng.standard_normal((600, 6))
    x *= scale
    ids = rng.permutation(len(x))
    q = x[rng.permutation(len(x))[:50]]
    found = Best(np.arange(50), q, 7, metric)
    for i in range(0, len(x), 500):
        found.meet(ids[i : i + 500], x[i : i + 500])
    found.settle()
    for i in range(50):
        s = exact_scores(q[i : i + 1], x, metric)
        assert found.idx[found.row == i].tolist() == ids[np.lexsort((ids, -s))[:7]].tolist()


def test_all_lists_are_an_exact_search(spark):
    """No task gathers a list and all queries, as the cogrouped lists do."""
    v, corpus = vectors(spark, 300, 8, "index", 1)
    q, queries = vectors(spark, 16, 8, "query", 2)
    found = DenseSearch(DenseConfig(k=10, factory="PCAR8,IVF4,Flat", nprobe=4)).build(corpus).search(queries)
    assert "CoGroup" not in found._jdf.queryExecution().toString()
    got = {i: [r.idx for r in sorted(found.collect(), key=lambda r: -r.score) if r.qid == i] for i in range(16)}
    assert [got[i] for i in range(16)] == best(q, v, 10).tolist()


def bm25_case(spark):
    rng = np.random.default_rng(5)
    text = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 30) if x < 40) for _ in range(120)]
    corpus = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate([*text, *text[:20], None])], "`__idx__` bigint, `index.text` string, `index.kind` string")
    asked = [(i, f"w{i} w1 w{i + 1} w1 none", "abc"[i % 3] if i else None) for i in range(12)]
    return text, corpus, spark.createDataFrame(asked, "`__idx__` bigint, `query.text` string, `query.kind` string")


@pytest.mark.parametrize("filtered", [False, True])
def test_bm25_in_parts_and_chunks(spark, monkeypatch, filtered, tmp_path):
    from collections import Counter
    from math import log

    from textweir.search import bm25

    for name in ("ASKED", "CHUNK"):
        monkeypatch.setattr(bm25, name, 13)
    text, corpus, queries = bm25_case(spark)
    docs = [Counter(t.split()) for t in [*text, *text[:20], ""]]
    mean = sum(d.total() for d in docs) / len(docs)
    want = {}
    for q in queries.collect():
        scores = {}
        for i, d in enumerate(docs):
            if filtered and q["query.kind"] != "ab"[i % 2] and i < 140 or filtered and i == 140:
                continue
            own = [(w, d[w]) for w in q["query.text"].split() if d[w]]
            df = {w: sum(w in x for x in docs) for w, _ in own}
            s = sum(log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d.total() / mean)) for w, tf in own)
            if own:
                scores[i] = round(s, 9)
        want |= {(q["__idx__"], i): scores[i] for i in sorted(scores, key=lambda i: (-scores[i], i))[:5]}
    engine = auto_engine("bm25", {"k": 5, "filter_key": "kind" if filtered else None}, path=str(tmp_path)).build(corpus)
    assert as_dict(engine.search(queries)) == pytest.approx(want, abs=2e-9)


def test_bm25_hands_on_k_for_a_partition(spark, monkeypatch):
    """Before, each pair of a query and a row that share a term was shuffled."""
    from textweir.search import bm25

    monkeypatch.setattr(bm25, "top_k", lambda found, k: found.withColumn("rank", bm25.F.lit(1)))
    _, corpus, queries = bm25_case(spark)
    assert auto_engine("bm25", {"k": 3}).build(corpus.coalesce(1)).search(queries).count() == 12 * 3


@pytest.mark.parametrize("chunk", [1, 7])
def test_bm25_chunks_change_nothing(monkeypatch, chunk):
    import pyarrow as pa

    from textweir.search import bm25

    asked = bm25.Asked(pa.table({"qid": [5, 5, 9, 9, 9], "term": ["a", "b", "a", "c", "d"], "w": [1.0, 2.0, 3.0, 4.0, 5.0]}))
    tokens = pa.array([["a", "x", "a"], [], ["c", "b", "a"], ["x"], ["d", "d"]]).slice(0)
    monkeypatch.setattr(bm25, "CHUNK", chunk)
    out = np.zeros((5, 2))
    for begin, n, row, term, tf in asked.postings(tokens):
        out[begin : begin + n] = asked.scores(n, row, term, tf * 1.0, None)
    assert out.tolist() == [[2, 6], [0, 0], [3, 7], [0, 0], [0, 10]]


def test_partitions_of_results_grow_with_the_input(spark, tmp_path, monkeypatch):
    """Before, they were as many for any input, and a task's memory grew with it."""
    rows = [(q, i, float(q * i % 7)) for q in range(200) for i in range(5)]
    long(spark, rows).write.parquet(str(tmp_path / "r"))
    found = spark.read.parquet(str(tmp_path / "r"))
    want = {f: as_dict(getattr(R, f)(found, found.filter("idx > 2"))) for f in ("merge_results", "sum_scores")}
    monkeypatch.setattr(R, "SHARE", 100, raising=False)
    for f, result in want.items():
        got = getattr(R, f)(found, found.filter("idx > 2"))
        assert got.rdd.getNumPartitions() > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert as_dict(got) == result
