"""Pipes: operators over tables that are built once and put together; each adds to a plan and runs nothing.

A pipe sees the columns of a table that its input_filter lets through and gives others. Columns that are carried
are passed on without being seen, so that an operator can be put beside a table's other columns in one narrow stage.
"""

from __future__ import annotations

import numbers
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

from .columns import c, hidden
from .fingerprint import Fingerprintable, get_fingerprint, named_leaves

RESERVED = ("batched", "with_indices", "idx")


def plain(x):
    """Arrays as lists, whatever holds them."""
    if isinstance(x, np.ndarray) or hasattr(x, "tolist"):
        return x.tolist()
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def batch_size(batch: Mapping) -> int:
    """Length of the columns, None aside; ValueError where they differ."""
    sizes = {len(v) for v in batch.values() if v is not None}
    if len(sizes) > 1:
        raise ValueError(f"columns of different lengths: { {k: len(v) for k, v in batch.items() if v is not None} }")
    return sizes.pop() if sizes else 0


def to_table(spark: SparkSession, batch: Mapping, order: str | None = None) -> DataFrame:
    """A dict of equally long columns as a table; order names a column to hold the rows' places."""
    n = batch_size(batch)
    data = {k: pa.array(plain(v)) if v is not None else pa.nulls(n) for k, v in batch.items()}
    if order:
        data[order] = pa.array(range(n), pa.int64())
    return spark.createDataFrame(pa.table(data))


def to_batch(df: DataFrame, order: str | None = None) -> dict[str, list]:
    """The other way; for results that are known to be small."""
    got = (df.orderBy(c(order)) if order else df).toArrow()
    return {k: got[k].to_pylist() for k in got.column_names if k != order}


class Pipe(Fingerprintable):
    """Base of all operators. Subclasses write _exprs if each row gives one row, else _apply.

    input_filter: a condition on names; other columns aren't seen. update: the input's columns stay, the output's
    take the place of those with the same names.
    """

    _allows_update = True
    _allows_input_filter = True
    #: Partitions that the operator may run in at the same time, None: any number.
    _max_num_proc: int | None = None

    def __init__(self, *, input_filter=None, update: bool = False, id: str | None = None):
        if update and not self._allows_update:
            raise AttributeError(f"{type(self).__name__} has no update")
        if input_filter is not None and not self._allows_input_filter:
            raise AttributeError(f"{type(self).__name__} has no input_filter")
        self.input_filter, self.update, self.id = input_filter, update, id

    # what a subclass writes

    def _exprs(self, cols: dict[str, Column], kinds: dict[str, DataType], **kwargs) -> dict[str, Column]:
        """The output by name, as expressions over the input's, whose types are given."""
        raise NotImplementedError(f"{type(self).__name__} says neither _exprs nor _apply")

    def _apply(self, df: DataFrame, carry: list[str], **kwargs) -> DataFrame:
        seen = {f.name: f.dataType for f in df.schema.fields if f.name not in carry}
        return df.select(*map(c, carry), *(v.alias(k) for k, v in self._exprs({x: c(x) for x in seen}, seen, **kwargs).items()))

    @property
    def row_wise(self) -> bool:
        """Whether the pipe is a set of expressions, so that it can be used within arrays too."""
        return type(self)._exprs is not Pipe._exprs

    def exprs(self, cols: dict[str, Column], kinds: dict[str, DataType], **kwargs) -> dict[str, Column]:
        """The output, or with update the input too, as expressions."""
        seen = [x for x in cols if self.input_filter is None or self.input_filter(x)]
        out = self._exprs({x: cols[x] for x in seen}, {x: kinds[x] for x in seen}, **kwargs)
        return {**cols, **out} if self.update else out

    def kinds(self, kinds: dict[str, DataType], **kwargs) -> dict[str, DataType]:
        """Types of the output of exprs, by analysing a plan of no rows."""
        empty = SparkSession.active().createDataFrame([], StructType([StructField(x, k) for x, k in kinds.items()]))
        made = self.exprs({x: c(x) for x in kinds}, kinds, **kwargs)
        return {f.name: f.dataType for f in empty.select(*(v.alias(k) for k, v in made.items())).schema.fields}

    # what a user calls

    def transform(self, df: DataFrame, carry=(), **kwargs) -> DataFrame:
        """The output alone, or with update the input's columns too."""
        carry = list(carry)
        names = [x for x in df.columns if x not in carry]
        seen = [x for x in names if self.input_filter is None or self.input_filter(x)]
        if not self.update:
            return self._apply(df.select(*map(c, [*carry, *seen])), carry, **kwargs)
        kept = hidden(len(names))
        before = df.select(*map(c, [*carry, *seen]), *(c(x).alias(k) for x, k in zip(names, kept)))
        after = self._apply(before, [*carry, *kept], **kwargs)
        return merged(after, carry, dict(zip(names, kept)))

    def dataset(self, df: DataFrame, remove_columns=None, **kwargs) -> DataFrame:
        """The output merged onto the table's columns, less remove_columns. An operator that changes the number of
        rows repeats the other columns with the row that they come from."""
        if wrong := [x for x in RESERVED if x in kwargs]:
            raise ValueError(f"reserved: {', '.join(wrong)}")
        names, kept = df.columns, hidden(len(df.columns))
        before = df.select("*", *(c(x).alias(k) for x, k in zip(names, kept)))
        most = self.max_num_proc
        if most:
            before = before.coalesce(most)
        out = merged(self.transform(before, kept, **kwargs), [], dict(zip(names, kept)))
        return out.drop(*(x for x in remove_columns or ())) if remove_columns else out

    def __call__(self, data, **kwargs):
        """Tables as dataset() has them, dicts of tables split by split; dicts of columns and lists of rows as
        transform() has them, with a result of the same kind."""
        if isinstance(data, DataFrame):
            return self.dataset(data, **kwargs)
        if isinstance(data, Mapping) and data and all(isinstance(v, DataFrame) for v in data.values()):
            return {k: self.dataset(v, **kwargs) for k, v in data.items()}
        if isinstance(data, Mapping):
            return self._local(data, **kwargs)
        if isinstance(data, list):
            if not all(isinstance(x, Mapping) for x in data):
                raise TypeError("a list of rows holds dicts")
            if self.update:
                raise AttributeError("rows can't be updated; give columns")
            return self._rows(data, **kwargs)
        raise TypeError(f"a pipe takes a table, a dict or a list of dicts, not {type(data).__name__}")

    def _local(self, batch: Mapping, **kwargs) -> dict:
        (order,) = hidden()
        spark = SparkSession.active()
        return to_batch(self.transform(to_table(spark, batch, order), [order], **kwargs), order)

    def _rows(self, rows: list[dict], **kwargs):
        return self._local({k: [r.get(k) for r in rows] for k in rows[0]} if rows else {}, **kwargs)

    @property
    def max_num_proc(self) -> int | None:
        """The least _max_num_proc of the pipe and all that it is made of."""
        found = [x for x in named_leaves(_tree(self), "_max_num_proc") if isinstance(x, numbers.Integral)]
        return min(found, default=None)

    def check_picklable(self) -> None:
        """ValueError where the pipe can't be sent to the executors."""
        try:
            cloudpickle.dumps(self)
        except Exception as e:
            raise ValueError(f"{type(self).__name__} can't be pickled") from e

    @staticmethod
    def get_eg(data, idx: int, filter_op=None, order: str = "__idx__"):
        """One row: of a table that whose order column says idx, of a dict of columns the one at the place."""
        if isinstance(data, DataFrame):
            return data.where(c(order) == idx).select(*(c(x) for x in data.columns if filter_op is None or filter_op(x)))
        return {k: v[idx] for k, v in data.items() if filter_op is None or filter_op(k)}

    @property
    def cache_key(self) -> str:
        return get_fingerprint(self)


def merged(df: DataFrame, carry: list[str], kept: dict[str, str]) -> DataFrame:
    """Carried columns, then those of kept under their names unless the output has them, then the output."""
    gone = {*carry, *kept.values()}
    out = [x for x in df.columns if x not in gone]
    old = [c(x) if x in out else c(k).alias(x) for x, k in kept.items()]
    return df.select(*map(c, carry), *old, *(c(x) for x in out if x not in kept))


def _tree(x) -> object:
    if isinstance(x, Pipe):
        return {"_max_num_proc": x._max_num_proc} | {k: _tree(v) for k, v in vars(x).items() if k != "_max_num_proc"}
    if isinstance(x, Mapping):
        return {k: _tree(v) for k, v in x.items()}
    return [_tree(v) for v in x] if isinstance(x, (list, tuple)) else x
