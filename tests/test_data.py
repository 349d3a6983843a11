"""Tokens, batches, models, stores and whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweir.operators import collate, datasets, predict
from textweir.operators.basics import Identity
from textweir.operators.passages import GeneratePassages
from textweir.operators.report import PrintContent, collapse_repeats, describe, pretty_decode
from textweir.operators.tokenizer import RegexTokenizer, TokenizerPipe, from_file
from textweir.search.index import Index
from textweir.sources import tables


def linear(batch):
    return {"vector": np.array(batch["data"], float) @ np.arange(16).reshape(8, 2)}


def data(spark, n=30):
    x = np.random.default_rng(0).standard_normal((n, 8))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "`__idx__` bigint, data array<double>")


def test_passages_of_documents(spark):
    docs = spark.createDataFrame([("one two three four five six", "T: ", 7), (None, None, 8), ("", "x", 9)], "`document.text` string, `title.text` string, `document.idx` int")
    t = RegexTokenizer(r"\w+")
    tokens = TokenizerPipe(t, field="title")(TokenizerPipe(t, field="document", return_offsets_mapping=True)(docs))
    cut = GeneratePassages(size=6, stride=5, field="document", prepend_field="title", start_tokens=[1], end_tokens=[2], global_keys=["idx", "none"]).transform(tokens)
    rows = sorted(cut.collect(), key=lambda r: r["document.passage_idx"])
    assert [r["document.idx"] for r in rows] == [7] * 3 and all(len(r["document.input_ids"]) == 6 for r in rows)
    assert rows[0]["document.text"] == "T: one two three" and rows[1]["document.text"] == "T: three four five"
    assert rows[0]["document.input_ids"][:2] == [1, t.id_of("T")] and rows[0]["document.attention_mask"] == [1] * 6
    assert rows[0]["document.offset_mapping"][0] == [-1, -1]
    with pytest.raises(KeyError):
        GeneratePassages(size=4, stride=2).transform(docs)


def test_tokenizers(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,)], "text string")
    rows = TokenizerPipe(from_file("/opt/tokenizers/byte_bpe_50k.json"), return_offsets_mapping=True, max_length=1).transform(df).collect()
    assert rows[0]["offset_mapping"] == [[0, 5]] and rows[1]["input_ids"] == [] and rows[2]["input_ids"] is None
    got = RegexTokenizer(r"\w+", {"a": 5}, specials=([7], [8]))(["a b a"], max_length=4)
    assert got["input_ids"] == [[7, 5, 1, 8]]


def test_collate(spark):
    rows = [{"f.x": 1, "g.y": 2}, {"f.x": 3, "g.y": 4}]
    assert collate.Collate(["f.x"])(rows) == {"f.x": [1, 3]} and collate.DeCollate()({"a": [1, 2]}) == [{"a": 1}, {"a": 2}]
    with pytest.raises(ValueError):
        collate.DeCollate()({"a": [1], "b": [1, 2]})
    batch = {"f.input_ids": [[1, 2], [3]], "f.attention_mask": [[1, 1], [1]], "f.passage_mask": [[1, 0], [1]], "f.text": ["a", "b"], "g.z": [0, 0]}
    out = collate.CollateField("f", tokenizer=RegexTokenizer(pad_token_id=9), exclude=["text"], special_padding_tokens={"passage_mask": 0})(batch)
    assert out == {"f.input_ids": [[1, 2], [3, 9]], "f.attention_mask": [[1, 1], [1, 0]], "f.passage_mask": [[1, 0], [1, 0]]}
    assert collate.CollateField("none")(batch) == {}
    nested = {"f.input_ids": [[[1, 2], [3]], [[4]]], "f.attention_mask": [[[1, 1], [1]], [[1]]]}
    assert collate.CollateField("f", tokenizer=RegexTokenizer(), nesting_level=1)(nested)["f.input_ids"] == [[[1, 2], [3, 0]], [[4, 0]]]
    assert collate.ToTensor()({"v": [[1, 2], [3, 4]], "s": ["a", "b"]})["v"] == [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(Exception, match="different lengths"):
        collate.ToTensor()({"v": [[1, 2], [3]]})
    assert collate.batches(spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i int, x string"), 2, "i").orderBy("batch").collect()[0]["x"] == ["a", "b"]


def test_predict(spark, tmp_path):
    x, df = data(spark)
    model = predict.PredictWithoutCache(linear, input_filter=lambda k: k == "data")
    want = x @ np.arange(16).reshape(8, 2)
    got = {r["__idx__"]: r.vector for r in model(df).collect()}
    assert np.allclose([got[i] for i in range(30)], want, atol=1e-4)
    cached = predict.Predict(model, str(tmp_path), predict.CacheConfig("float16"), requires_cache=True)
    fp = cached.cache(df)
    assert cached.cache(df) == fp != cached.cache(df.limit(3))
    half = {r["__idx__"]: r.vector for r in cached(df, cache_fingerprint=fp).collect()}
    assert np.allclose([half[i] for i in range(30)], want.astype(np.float16), atol=1e-2)
    with pytest.raises(ValueError):
        predict.PredictWithCache(model, str(tmp_path)).transform(df)
    with pytest.raises(ValueError):
        predict.CacheConfig("float64")
    zero = spark.createDataFrame([(i, [0.0]) for i in range(3)], "`__idx__` bigint, vector array<float>")
    for bad, n in ((zero, 3), (zero, 4), (zero.withColumn("vector", F.when(F.col("__idx__") == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.col("vector"))), 3)):
        with pytest.raises(ValueError):
            predict.validate_store(bad, n)


def test_index_with_a_model(spark, tmp_path):
    x, df = data(spark)
    model = predict.PredictWithoutCache(linear, input_filter=lambda k: k == "data")
    corpus, queries = (df.select("__idx__", F.col("data").alias(f"{f}.data")) for f in ("document", "query"))
    index = Index(corpus, [{"name": "dense", "config": {"k": 5, "index_field": "document"}}], model=model, cache_dir=str(tmp_path))
    y = (x @ np.arange(16).reshape(8, 2)).astype(np.float32).astype(float)
    out = index(queries)
    assert set(out.columns) == {"__idx__", "query.data", "document.idx", "document.score"}
    got = {r["__idx__"]: r["document.idx"] for r in out.collect()}
    assert [got[i] for i in range(30)] == np.argsort(-(y @ y.T), axis=1)[:, :5].tolist()


def test_datasets(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string"), spark.createDataFrame([(3, "z")], "k int, s string")
    assert datasets.concatenate_datasets([a, b]).count() == 3 and datasets.concatenate_datasets([{"t": a}, {"t": b, "v": b}])["t"].count() == 3
    with pytest.raises(ValueError):
        datasets.concatenate_datasets([a, {"t": b}])
    assert datasets.take_subset(a, 5).count() == 2 and datasets.take_subset({"t": a}, 0.5)["t"].count() == 1
    with pytest.raises(ValueError):
        datasets.take_subset(a, 1.5)
    assert datasets.keep_only_columns(a, ["s", "zz"]).columns == ["s"] and datasets.keep_only_columns(a) is a and datasets.remove_columns(a, ["s"]).columns == ["k"]
    assert datasets.get_column_names({"t": a, "v": b}) == ["k", "s"] and datasets.format_size_difference(a, b) == "rows: 2 -> 1"
    assert list(datasets.iter_batch_egs({"a": [1, 2]})) == [{"a": 1}, {"a": 2}] and datasets.get_batch_eg({"a": [1, 2]}, 1) == {"a": 2}
    assert datasets.get_dataset_fingerprints({"t": a})["t"] != datasets.get_dataset_fingerprints(b)
    assert datasets.zip_by_position(a, a.select((F.col("k") * 2).alias("d"))).where("k * 2 = d").count() == 2


def test_sources(spark, tmp_path, capsys):
    df = spark.range(10).repartition(3).cache()
    assert sorted(r[0] for r in tables.with_row_index(df).select("__idx__").collect()) == list(range(10))
    spark.createDataFrame([(1, "a")], "k int, s string").write.csv(str(tmp_path / "x.csv"))
    assert tables.read_table(spark, str(tmp_path / "x.csv")).count() == 1
    tables.write_json(spark, str(tmp_path / "j.json"), {"a": [1, None]})
    assert tables.read_json(spark, str(tmp_path / "j.json")) == {"a": [1, None]}
    assert tables.to_dict(tables.from_dict(spark, {"a": [1, 2]})) == {"a": [1, 2]}
    store = tables.Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.write(df)
    assert not store.exists()
    assert collapse_repeats(["a", "P", "P"], "P") == ["a", "2x(P)"] and pretty_decode([1, 2], lambda x: str(x)) == "[1, 2]"
    one = spark.createDataFrame([([[1, 2]], None)], "a array<array<int>>, b string")
    assert describe(one, nulls=True)[1] == {"key": "b", "depth": 0, "leaf": "string", "rows": 1, "nulls": 1}
    assert PrintContent(["a"], n=2)(one).columns == ["a", "b"] and "1: 2" in capsys.readouterr().out
    assert Identity.get_eg({"a": [1, 2]}, 1) == {"a": 2}


def test_texts_are_tokenized_some_at_a_time(spark):
    """A worker's memory is that of a slice, not of a batch of 10,000 rows."""

    def count(texts, **_):
        bytes_ = sum(len(x.encode()) for x in texts)
        return {"input_ids": [[len(texts), bytes_] for _ in texts], "attention_mask": [[1, 1] for _ in texts]}

    rows = [(i, None if i % 7 == 0 else "é" * (i % 500) if i != 5 else "x" * 300_000) for i in range(2500)]
    got = TokenizerPipe(count)(spark.createDataFrame(rows, "i int, text string").coalesce(1)).collect()
    assert [r.text for r in got] == [t for _, t in rows]
    assert all((r.input_ids is None) == (r.text is None) for r in got)
    seen = [r.input_ids for r in got if r.text is not None]
    assert max(n for n, _ in seen) <= 1000
    assert max(b for n, b in seen if n > 1) <= 1 << 18 and got[5].input_ids == [1, 300_000]
