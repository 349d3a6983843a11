"""Operators on column sets and on values."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.columns import array_depth, c, type_of
from ..core.pipe import Pipe


class Identity(Pipe):
    def _exprs(self, cols, kinds, **kwargs):
        return dict(cols)


class GetKey(Pipe):
    """Just one column; KeyError where the table hasn't got it."""

    def __init__(self, key: str, **kwargs):
        super().__init__(**kwargs)
        self.key = key

    def _exprs(self, cols, kinds, **kwargs):
        if self.key not in cols:
            raise KeyError(self.key)
        return {self.key: cols[self.key]}


class FilterKeys(Pipe):
    """The columns whose names meet a condition."""

    _allows_update = _allows_input_filter = False

    def __init__(self, condition, **kwargs):
        super().__init__(**kwargs)
        self.condition = condition

    def _exprs(self, cols, kinds, **kwargs):
        return {x: v for x, v in cols.items() if self.condition(x)}


class DropKeys(Pipe):
    """All columns but those named and those that meet the condition; names that aren't there don't matter."""

    _allows_update = _allows_input_filter = False

    def __init__(self, keys=None, condition=None, **kwargs):
        if keys is None and condition is None:
            raise ValueError("DropKeys needs keys or a condition")
        super().__init__(**kwargs)
        self.keys, self.condition = list(keys or ()), condition

    def _exprs(self, cols, kinds, **kwargs):
        return {x: v for x, v in cols.items() if x not in self.keys and not (self.condition and self.condition(x))}


class AddPrefix(Pipe):
    def __init__(self, prefix: str, **kwargs):
        super().__init__(**kwargs)
        self.prefix = prefix

    def _exprs(self, cols, kinds, **kwargs):
        return {self.prefix + x: v for x, v in cols.items()}


class ReplaceInKeys(Pipe):
    """A part of all names replaced by another, wherever it is; of columns whose names become the same the last stays."""

    def __init__(self, a: str, b: str, **kwargs):
        super().__init__(**kwargs)
        self.a, self.b = a, b

    def _exprs(self, cols, kinds, **kwargs):
        return {x.replace(self.a, self.b): v for x, v in cols.items()}


class RenameKeys(Pipe):
    """The renamed columns alone (with update: beside the others, old names too); names that aren't there are skipped."""

    def __init__(self, keys: Mapping[str, str], **kwargs):
        super().__init__(**kwargs)
        self.keys = dict(keys)

    def _exprs(self, cols, kinds, **kwargs):
        return {new: cols[old] for old, new in self.keys.items() if old in cols}


class CopyBatch(Identity):
    """Tables don't change, so a copy is the table."""

    def __init__(self, deep: bool = False, **kwargs):
        super().__init__(**kwargs)
        self.deep = deep


class Partial(Pipe):
    """A pipe with keyword arguments given beforehand; those given when it is called go first."""

    def __init__(self, pipe: Pipe, pipe_kwargs: Mapping | None = None, **kwargs):
        super().__init__(**kwargs)
        self.pipe, self.pipe_kwargs = pipe, dict(pipe_kwargs or {})

    row_wise = property(lambda self: self.pipe.row_wise)

    def _exprs(self, cols, kinds, **kwargs):
        return self.pipe.exprs(cols, kinds, **{**self.pipe_kwargs, **kwargs})

    def _apply(self, df, carry, **kwargs):
        return self.pipe.transform(df, carry, **{**self.pipe_kwargs, **kwargs})


class Lambda(Pipe):
    """Any function. Without a schema it takes a table and gives one, and becomes part of the plan.

    With a schema (DDL) it takes dicts of columns (lists), about batch_size rows each, and gives such dicts, with as many rows
    as it likes; it runs in Python workers on Arrow batches. Carried columns then stand only for batches whose number
    of rows stays. Keyword arguments reach it if allow_kwargs is set.
    """

    def __init__(self, op: Callable, schema: str | None = None, allow_kwargs: bool = False, batch_size: int = 100, **kwargs):
        super().__init__(**kwargs)
        self.op, self.schema, self.allow_kwargs, self.batch_size = op, schema, allow_kwargs, batch_size

    def _apply(self, df, carry, **kwargs):
        kwargs = kwargs if self.allow_kwargs else {}
        if self.schema is None:
            return self.op(df, **kwargs)
        spark, op, size = df.sparkSession, self.op, self.batch_size
        own = spark.createDataFrame([], self.schema).schema
        full = spark.createDataFrame([], self.schema).select(*(F.lit(None).cast(type_of(df, x)).alias(x) for x in carry), "*").schema
        kinds = {f.name: _arrow(f.dataType) for f in own}
        seen = [x for x in df.columns if x not in carry]

        def run(batches):
            for big in batches:
                for i in range(0, big.num_rows, size):
                    batch = big.slice(i, size)
                    got = op({x: batch.column(x).to_pylist() for x in seen}, **kwargs)
                    out = [pa.array(got[x], k) for x, k in kinds.items()]
                    n = len(out[0]) if out else batch.num_rows
                    if carry and n != batch.num_rows:
                        raise ValueError(f"{n} rows from {batch.num_rows}: other columns can't be kept; use transform()")
                    yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in carry), *out], names=[*carry, *kinds])

        return df.mapInArrow(run, full)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def leaves(op: Callable[[Column], Column], depth: int) -> Callable[[Column], Column]:
    """op on the elements of arrays of this depth."""
    return op if depth == 0 else lambda x: F.transform(x, leaves(op, depth - 1))


class Apply(Pipe):
    """Functions of columns, by name; other columns stay. element_wise: on the innermost elements of nested arrays.

    A function takes a column and gives one; a Python function of values is wrapped by udf(), a pandas one by
    pandas_udf(). KeyError where a column isn't there.
    """

    def __init__(self, ops: Mapping[str, Callable], element_wise: bool = False, **kwargs):
        super().__init__(**kwargs)
        self.ops, self.element_wise = dict(ops), element_wise

    def _exprs(self, cols, kinds, **kwargs):
        if missing := [x for x in self.ops if x not in cols]:
            raise KeyError(missing[0])
        depth = lambda x: array_depth(kinds[x]) if self.element_wise else 0
        return {x: leaves(self.ops[x], depth(x))(v) if x in self.ops else v for x, v in cols.items()}


class ApplyToAll(Pipe):
    """A function of every column; element_wise: of the elements of each, one level down."""

    def __init__(self, op: Callable, element_wise: bool = False, allow_kwargs: bool = False, **kwargs):
        super().__init__(**kwargs)
        self.op, self.element_wise, self.allow_kwargs = op, element_wise, allow_kwargs

    def _exprs(self, cols, kinds, **kwargs):
        op = (lambda x: self.op(x, **kwargs)) if self.allow_kwargs else self.op
        return {x: leaves(op, int(self.element_wise and array_depth(kinds[x]) > 0))(v) for x, v in cols.items()}


class ApplyToEachExample(Pipe):
    """A pipe on every row; as rows don't meet in a pipe of expressions, that is the pipe."""

    def __init__(self, pipe: Pipe, **kwargs):
        super().__init__(**kwargs)
        self.pipe = pipe

    row_wise = property(lambda self: self.pipe.row_wise)

    def _exprs(self, cols, kinds, **kwargs):
        return self.pipe.exprs(cols, kinds, **kwargs)

    def _apply(self, df, carry, **kwargs):
        return self.pipe.transform(df, carry, **kwargs)


class FirstEg(Pipe):
    """The first row by an order column, else the table's first; one row is moved."""

    _allows_update = False

    def __init__(self, order: str = "__idx__", **kwargs):
        super().__init__(**kwargs)
        self.order = order

    def _apply(self, df: DataFrame, carry, **kwargs):
        by = [x for x in df.columns if x == self.order] or carry[:1]
        return (df.orderBy(*map(c, by)) if by else df).limit(1)

    def _rows(self, rows, **kwargs):
        return dict(rows[0])
