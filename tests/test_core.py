"""Pipes, conditions and fingerprints on the literal cases."""

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from textweir.core import condition as C
from textweir.core.fingerprint import Fingerprintable, get_fingerprint, iter_leaves, map_leaves, named_leaves, reduce_leaves, table_fingerprint
from textweir.operators import basics as B
from textweir.operators import collate, nesting, passages, pipelines, predict, report, tokenizer
from textweir.search.lookup import TopkSearch

BATCH = {"a": [1, 2, 3], "b": [4, 5, 6]}


def numbered(batch):
    names = "".join(sorted(batch))
    return {"dummy": [f"{names}-{i + 1}" for i in range(len(next(iter(batch.values()))))]}


def test_conditions(spark):
    df = spark.createDataFrame([(1, "x")], "`f.a` int, `g.b` string")
    assert C.Contains("b")("abc") and not C.Contains("z")("abc")
    assert C.In(["a"])("a") and C.In("abc")("b") and not C.In(["a"])("b")
    assert C.HasPrefix("f.")("f.a") and C.Not(C.HasPrefix("g"))("f.a") and C.Static(True)("x")
    assert C.Reduce(C.Contains("a"), True)("a") and C.Reduce(C.Contains("z"), C.Contains("a"), reduce_op=any)("a")
    with pytest.raises(TypeError):
        C.Reduce(3)
    assert C.HasKeyWithPrefix("f.")(df) and not C.HasKeyWithPrefix("h.")({"f.a": []}) and C.HasKeys(["f.a"])([{"f.a": 1}, {}])
    assert C.AllValuesOfType(list)({"a": [1]}) and not C.AllValuesOfType(list)({"a": np.zeros(1)})


def test_protocol(spark):
    assert B.Identity()(BATCH) == BATCH
    assert B.Lambda(numbered, schema="dummy string", batch_size=10)({"a": [1], "b": [2]}) == {"dummy": ["ab-1"]}
    got = B.Lambda(numbered, schema="dummy string", input_filter=C.In(["a"]), update=True)({"a": [1], "b": [2]})
    assert got == {"a": [1], "b": [2], "dummy": ["a-1"]}
    df = spark.createDataFrame([(k, k) for k in range(1, 5)], "a long, b long").coalesce(1)
    rows = B.Lambda(numbered, schema="dummy string", batch_size=2)(df)
    assert rows.columns == ["a", "b", "dummy"] and [r.dummy for r in rows.orderBy("a").collect()] == ["ab-1", "ab-2", "ab-1", "ab-2"]
    assert B.Identity()({"train": df})["train"].columns == ["a", "b"]
    assert B.GetKey("a")(df, remove_columns=["b"]).columns == ["a"]
    with pytest.raises(ValueError):
        B.Identity()(df, idx=3)
    with pytest.raises(AttributeError):
        B.FilterKeys(C.In(["a"]), update=True)
    with pytest.raises(AttributeError):
        B.Identity(update=True)([{"a": 1}])
    with pytest.raises(TypeError):
        B.Identity()([1, 2])
    assert B.Identity()([{"a": 1}, {"a": 2}]) == {"a": [1, 2]}
    assert B.Identity()({}) == {}


def test_max_num_proc():
    inner, middle = B.Identity(), pipelines.Sequential(B.Identity())
    inner._max_num_proc, middle._max_num_proc = 1, 2
    assert middle.max_num_proc == 2 and pipelines.Sequential(middle, inner).max_num_proc == 1 and B.Identity().max_num_proc is None


def test_projections(spark):
    assert B.RenameKeys({"a": "x", "q": "y"})(BATCH) == {"x": [1, 2, 3]}
    assert list(B.RenameKeys({"a": "x"}, update=True)(BATCH)) == ["a", "b", "x"]
    assert list(B.ReplaceInKeys("a", "c")(BATCH)) == ["c", "b"] and list(B.AddPrefix("d.")(BATCH)) == ["d.a", "d.b"]
    assert B.DropKeys(["a", "zz"])(BATCH) == {"b": [4, 5, 6]} and B.CopyBatch()(BATCH) == BATCH
    with pytest.raises(ValueError):
        B.DropKeys()
    with pytest.raises(KeyError):
        B.GetKey("zz")(BATCH)
    with pytest.raises(KeyError):
        B.Apply({"zz": lambda x: x})(BATCH)
    assert B.Apply({"a": lambda x: x + 1}, element_wise=True)({"a": [[1], [2, 3]], "b": [1, 2]}) == {"a": [[2], [3, 4]], "b": [1, 2]}
    assert B.ApplyToAll(lambda x: x + 1, element_wise=True)({"a": [[1], [2]], "b": [1, 2]}) == {"a": [[2], [3]], "b": [2, 3]}
    times = B.Lambda(lambda df, n=1: df.select((F.col("a") * n).alias("a")), allow_kwargs=True)
    spy = B.Partial(times, {"n": 3})
    df = spark.createDataFrame([(2,)], "a int")
    assert spy.transform(df).first()[0] == 6 and spy.transform(df, n=5).first()[0] == 10
    assert B.FirstEg()([{"a": 1}, {"a": 2}]) == {"a": 1}


def test_pipelines(spark):
    assert pipelines.Sequential(B.AddPrefix("x."), None, B.Apply({"x.a": lambda v: v * 2}))(BATCH) == {"x.a": [2, 4, 6], "x.b": [4, 5, 6]}
    both = pipelines.Parallel(B.RenameKeys({"a": "x"}), B.Identity(), B.GetKey("a"))
    assert both(BATCH) == {"x": [1, 2, 3], **BATCH}
    with pytest.raises(Exception, match="different values of a"):
        pipelines.Parallel(B.Identity(), B.ApplyToAll(lambda x: x + 1))(BATCH)
    assert set(pipelines.Gate(True, B.Identity())(BATCH)) == {"a", "b"} and pipelines.Gate(False, B.Identity())(BATCH) == {}
    assert set(pipelines.Gate(lambda df: "q" in df.columns, B.Identity(), B.AddPrefix("z"))(BATCH)) == {"za", "zb"}
    assert pipelines.Gate(False, None, update=True)(BATCH) == BATCH
    with pytest.raises(pipelines.PipeProcessError) as e:
        pipelines.Sequential(pipelines.Sequential(B.GetKey("zz")))(BATCH)
    assert isinstance(e.value.cause, KeyError)
    got = pipelines.BlockSequential([("one", B.AddPrefix("p.")), ("none", None)], pprint=True)(BATCH)
    assert list(got) == ["p.a", "p.b"]


class Thing(Fingerprintable):
    _no_fingerprint = ("unsafe",)

    def __init__(self, value, unsafe, child=None):
        self.value, self.unsafe, self.child = value, unsafe, child


def test_fingerprints(spark):
    a, b, d = Thing("aaa", "aaa", Thing(1, 2)), Thing("aaa", "bbb", Thing(1, 3)), Thing("bbb", "aaa", Thing(1, 2))
    assert a.fingerprint == b.fingerprint != d.fingerprint
    assert a.copy(value="bbb").fingerprint == d.fingerprint and a.to_json_struct()["__name__"] == "Thing" and a.picklable(reduce=True)
    assert get_fingerprint(3) == "<3>" and get_fingerprint({"a": 1, "b": 2}) == get_fingerprint({"b": 2, "a": 1})
    assert get_fingerprint(lambda x: x + 1) != get_fingerprint(lambda x: x + 2)
    one, two = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(2,), (1,)], "a int")
    assert table_fingerprint(one) == table_fingerprint(two) != table_fingerprint(one.limit(1))
    x = {"a": 1, "b": {"c": 2, "d": [3, 4]}}
    assert map_leaves(x, lambda v: v + 1) == {"a": 2, "b": {"c": 3, "d": [4, 5]}} and list(iter_leaves(x)) == [1, 2, 3, 4]
    assert reduce_leaves(x, sum) == 10 and list(named_leaves(x, "c")) == [2]


PIPES = [
    B.Identity(), B.GetKey("a"), B.FilterKeys(C.In(["a"])), B.DropKeys(["a"]), B.AddPrefix("a"), B.ReplaceInKeys("a", "b"), B.RenameKeys({"a": "b"}), B.CopyBatch(), B.Partial(B.Identity()), B.Lambda(numbered, schema="dummy string"),
    B.Apply({"a": F.upper}), B.ApplyToAll(F.upper), B.ApplyToEachExample(B.Identity()), B.FirstEg(), pipelines.Sequential(B.Identity()), pipelines.Parallel(B.Identity()), pipelines.ParallelbyField({"f": B.Identity()}), pipelines.Gate(True, None),
    pipelines.BlockSequential([("a", B.Identity())]), nesting.Flatten(), nesting.Nest([1]), nesting.ApplyAsFlatten(B.Identity()), nesting.Nested(B.Identity()), nesting.NestedLevel1(B.Identity()), nesting.Expand(-1, 2), passages.GeneratePassages(size=3, stride=2),
    collate.Collate(), collate.DeCollate(), collate.Padding(), collate.ToTensor(), collate.CollateField("a"), tokenizer.TokenizerPipe(tokenizer.RegexTokenizer()), predict.PredictWithoutCache(numbered), report.PrintBatch(), report.PrintContent(["a"]), TopkSearch(),
]


@pytest.mark.parametrize("pipe", PIPES, ids=lambda p: type(p).__name__)
def test_every_pipe_is_stable_and_can_be_sent(pipe):
    again = cloudpickle.loads(cloudpickle.dumps(pipe))
    assert again.fingerprint == pipe.fingerprint == pipe.copy().fingerprint
    pipe.check_picklable()


def test_pipes_on_streams(spark, tmp_path):
    spark.range(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    out = pipelines.Sequential(B.AddPrefix("x."), B.Apply({"x.id": lambda v: v * 2})).transform(stream)
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 6, 8, 10]
