"""Arrays, nesting and passages against numpy and plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweir.functions import arrays as A
from textweir.functions.passages import gen_passages
from textweir.operators import basics as B
from textweir.operators import nesting as N

NESTED = {"a": [[[1, 2, 3], [1, 2, 3]], [[3, 2, 1], [1, 1, 1]]], "b": [[[1, 2, 3], [1, 2, 3]], [[3, 2, 1], [1, 1, 1]]]}


def value(spark, expr, x, kind):
    return spark.createDataFrame([(x,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_array_functions(spark):
    assert value(spark, lambda x: A.flatten_nested(x, 2), [[[1, 2], [3, 4]], [[5, 6], [7, 8]]], "array<array<array<int>>>") == list(range(1, 9))
    for shape in ([-1, 8], [8, -1], [8, -1, 2, 2], [2, 2, 2, 2, -1]):
        assert value(spark, lambda x: A.nested(x, shape), list(range(64)), "array<int>") == np.arange(64).reshape(shape).tolist()
    assert A.infer_missing_dims(128, [8, -1, 2]) == [8, 8, 2]
    with pytest.raises(ValueError):
        A.infer_missing_dims(10, [3, -1])
    with pytest.raises(ValueError):
        A.infer_missing_dims(0, [0, -1])
    with pytest.raises(Exception, match="make"):
        value(spark, lambda x: A.nested(x, [3, -1]), [1, 2], "array<int>")
    for n in (1, 4):
        assert value(spark, lambda x: A.expand(x, 2, -1, n), [[1, 2, 3]], "array<array<int>>") == np.repeat(np.array([[1, 2, 3]])[..., None], n, 2).tolist()
        assert value(spark, lambda x: A.expand(x, 1, 0, n), [1, 2, 3], "array<int>") == [[1, 2, 3]] * n
    assert value(spark, lambda x: A.pad_to_length(x, 3, -1), [1], "array<int>") == [1, -1, -1]
    assert value(spark, lambda x: A.pad_to_length(x, 1, -1), [1, 2], "array<int>") == [1]
    assert value(spark, lambda x: A.pad_to_length(x, 1, -1), None, "array<int>") is None
    assert value(spark, A.unique, [3, 1, 3], "array<int>") == [1, 3]
    assert value(spark, lambda x: A.masked_fill(x, lambda v: v < 0, F.lit(9)), [-1, 2], "array<int>") == [9, 2]
    assert A.longest_common_prefix([[1, 2, 3], [1, 2, 4]]) == [1, 2]


def test_shapes(spark):
    assert N.infer_batch_shape({"a": [1, 2], "b": [[1], [2, 3]]}) == [2] and N.infer_batch_shape(NESTED) == [2, 2, 3]
    assert N.infer_nesting_level({"a": [1]}) == 0 and N.infer_nesting_level({"b": [["x"]]}) == 1
    assert N.table_shape(spark.createDataFrame([([[1, 2], [3, 4]],), ([[1, 2], [3, 5]],)], "a array<array<int>>")) == [2, 2, 2]


def test_nesting(spark):
    drop = lambda cols: {k: F.filter(v, lambda x: x < 3) for k, v in cols.items()}
    assert N.Nested(drop, level=2)(NESTED)["a"] == [[[1, 2], [1, 2]], [[2, 1], [1, 1, 1]]]
    assert N.Nested(drop)({"a": [[1, 2, 3]] * 2, "b": [[1, 2, 3]] * 2}) == {"a": [[1, 2]] * 2, "b": [[1, 2]] * 2}
    flat = N.Flatten(2)(NESTED)
    assert flat["a"] == [x for r in NESTED["a"] for y in r for x in y] and N.Nest([2, 2, 3])(flat) == NESTED and N.Flatten()(NESTED, level=2) == flat
    with pytest.raises(ValueError):
        N.Nest()(flat)
    plus = B.Apply({"a": lambda v: v + 1})
    assert N.ApplyAsFlatten(plus, level=2)(NESTED)["a"] == (np.array(NESTED["a"]) + 1).tolist()
    tens = B.Lambda(lambda x: {"a": [v * 10 for v in x["a"]]}, schema="a long")
    assert N.ApplyAsFlatten(tens, level=2)(NESTED)["a"] == (np.array(NESTED["a"]) * 10).tolist()
    assert N.ApplyAsFlatten(tens, level=["a"])({"a": [[1, 2], [], [3]]}) == {"a": [[10, 20], [], [30]]}
    with pytest.raises(ValueError):
        N.ApplyAsFlatten(plus, level=["zz"])({"a": [[1]]})
    with pytest.raises(Exception, match="different lengths"):
        N.ApplyAsFlatten(plus)({"a": [[1]], "b": [[1, 2]]})
    shapes = [np.array(N.Expand(a, n)({"x": [1, 2, 3]})["x"]).shape for a, n in ((-1, 1), (-1, 2), (0, 2), (0, 5))]
    assert shapes == [(3, 1), (3, 2), (2, 3), (5, 3)]


def model_passages(x, size, stride, start=(), end=(), pad=None):
    room, step = size - len(start) - len(end), stride - len(start) - len(end)
    shared, out = room - step, []
    for i in range(0, len(x), step):
        part, left = x[i : i + room], math.ceil(shared / 2) if i else 0
        if len(part) > left:
            fill = room - len(part) if pad is not None else 0
            window = [*start, *part, *end, *[pad] * fill]
            own = set(range(len(start) + left, len(start) + room - shared // 2)) & set(range(len(window) - fill))
            out.append((window, [int(j in own) for j in range(len(window))]))
    return out


def test_passages(spark):
    settings = [(10, 7, None, (), ()), (10, 10, None, (), ()), (10, 10, -1, (), ()), (10, 8, -1, (1, 2), ()), (4, 3, None, (), (9,)), (12, 8, 0, (5,), (6, 7))]
    for size, stride, pad, start, end in settings:
        data = [list(range(n)) for n in (0, 1, 2, 5, 9, 10, 11, 19, 23, 99, 100)]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x array<int>")
        got = df.select("i", gen_passages(F.col("x"), "int", size=size, stride=stride, start_tokens=start, end_tokens=end, pad_token=pad).alias("w")).collect()
        for r in got:
            assert [(w["tokens"], w["mask"]) for w in r.w] == model_passages(data[r.i], size, stride, start, end, pad)
            if not end:
                assert [t for w in r.w for t, m in zip(w["tokens"], w["mask"]) if m] == data[r.i]
    with pytest.raises(ValueError):
        gen_passages(F.lit(None), "int", size=3, stride=4)
