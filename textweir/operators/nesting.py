"""Operators on nested columns: flatten, nest, and run a pipe at a depth."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from ..core.columns import array_depth, c, hidden, type_of
from ..core.pipe import Pipe, batch_size, to_batch, to_table
from ..functions.arrays import expand, infer_missing_dims, longest_common_prefix

IDX = "__idx__"


def infer_shape(x) -> list[int]:
    """Shape of nested lists: the dimensions that are the same throughout; ragged ones end it."""
    if not isinstance(x, (list, tuple)) and not hasattr(x, "shape"):
        return []
    if hasattr(x, "shape"):
        return list(x.shape)
    shapes = [infer_shape(v) for v in x]
    return [len(x), *longest_common_prefix(shapes)] if shapes else [0]


def infer_batch_shape(batch: dict) -> list[int]:
    """What the shapes of all columns begin with."""
    return longest_common_prefix([infer_shape(v) for v in batch.values() if v is not None])


def infer_nesting_level(data) -> int:
    """Of a table the least array depth of its columns, of a dict of columns the dimensions that they share less one."""
    if isinstance(data, DataFrame):
        return min((array_depth(f.dataType) for f in data.schema.fields), default=0)
    return max(len(infer_batch_shape(data)) - 1, 0)


def table_shape(df: DataFrame, columns: Sequence[str] | None = None) -> list[int]:
    """Rows, then the sizes of the arrays for as long as they are the same in all rows and columns; one pass a level."""
    names = list(columns or df.columns)
    level, shape = min((array_depth(type_of(df, x)) for x in names), default=0), [df.count()]
    for depth in range(level):
        def sizes(x: Column, d: int) -> Column:
            return F.array(F.size(x)) if d == 0 else F.flatten(F.transform(x, lambda v: sizes(v, d - 1)))

        each = [sizes(c(x), depth) for x in names]
        low, high = df.agg(F.min(F.array_min(F.concat(*each))), F.max(F.array_max(F.concat(*each)))).first()
        if low is None or low != high:
            break
        shape.append(low)
    return shape


def _zip(cols: list[Column], elements: list[DataType]) -> Column:
    """Arrays of a row as one array of structs with fields 0, 1, …; a row whose arrays differ in length fails."""
    fields = [StructField(str(k), kind) for k, kind in enumerate(elements)]
    packed = F.arrays_zip(*cols).cast(ArrayType(StructType(fields)))
    if len(cols) < 2:
        return packed
    same = reduce(lambda a, b: a & b, [F.size(cols[0]) == F.size(x) for x in cols[1:]])
    return F.when(same, packed).otherwise(F.raise_error(F.lit("arrays of different lengths")))


def _flatten_once(df: DataFrame, names: list[str], carry: list[str], pos: str, outer: bool = False) -> DataFrame:
    """A row for each element of the arrays, with its place; with outer an empty array gives a row without a place."""
    (item,) = hidden()
    packed = df.select(*map(c, carry), _zip([c(x) for x in names], [type_of(df, x).elementType for x in names]).alias(item))
    out = packed.select(*map(c, carry), (F.posexplode_outer if outer else F.posexplode)(c(item)).alias(pos, item))
    return out.select(*map(c, carry), c(pos), *(c(item).getField(str(k)).alias(x) for k, x in enumerate(names)))


class Flatten(Pipe):
    """Each row becomes a row for each element of its arrays, level times; all columns are taken apart together.

    With a column IDX, and one at places of level + 1 dimensions of the same size, the places stay dense; else the
    order of rows is only kept within what a row gave. Rows with null or empty arrays give no rows.
    """

    def __init__(self, level: int = 1, **kwargs):
        super().__init__(**kwargs)
        self.level = level

    def _apply(self, df, carry, level: int | None = None, **kwargs):
        names = [x for x in df.columns if x not in carry]
        for _ in range(self.level if level is None else level):
            (pos,) = hidden()
            df = _flatten_once(df, names, carry, pos).drop(pos)
        return df

    def _local(self, batch, **kwargs):
        level = kwargs.get("level", self.level)
        df, names, order = to_table(SparkSession.active(), batch, IDX), list(batch), [IDX]
        for k in range(level):
            df = _flatten_once(df, names, order, f"__pos{k}__")
            order.append(f"__pos{k}__")
        got = df.orderBy(*order).select(*map(c, names)).toArrow()
        return {x: got[x].to_pylist() for x in names}


class Nest(Pipe):
    """Consecutive rows become a row of arrays: a table of n rows in the shape (n, …) turned into the given one.

    The places of the rows, from 0 and dense, are in the column IDX, which afterwards holds the new ones. One dimension may be -1, of
    a table only the first. A shape given when the pipe is called goes first. Rows are grouped by their new place, one shuffle for each dimension.
    """

    def __init__(self, shape: Sequence[int] | None = None, **kwargs):
        super().__init__(**kwargs)
        self.shape = list(shape) if shape is not None else None

    def _shape(self, shape):
        shape = shape if shape is not None else self.shape
        if shape is None:
            raise ValueError("Nest needs a shape")
        return list(shape)

    def _apply(self, df, carry, shape=None, **kwargs):
        shape = self._shape(shape)
        if IDX not in df.columns:
            raise ValueError(f"Nest needs the rows' places in {IDX}")
        if -1 in shape[1:]:
            shape = infer_missing_dims(df.count(), shape)
        names = [x for x in df.columns if x not in carry and x != IDX]
        for size in reversed(shape[1:]):
            packed = F.struct((c(IDX) % size).alias("p"), *(c(x).alias(f"f{k}") for k, x in enumerate(names)))
            parent = F.floor(c(IDX) / size).cast("long").alias(IDX)
            rows = df.groupBy(parent).agg(F.array_sort(F.collect_list(packed)).alias("rows"), *(F.first(c(x)).alias(x) for x in carry))
            df = rows.select(*map(c, carry), c(IDX), *(c("rows").getField(f"f{k}").alias(x) for k, x in enumerate(names)))
        return df

    def _local(self, batch, shape=None, **kwargs):
        shape = infer_missing_dims(batch_size(batch), self._shape(shape))
        if len(shape) < 2:
            return {k: list(v) for k, v in batch.items()}
        df = self._apply(to_table(SparkSession.active(), batch, IDX), [], shape)
        return to_batch(df, IDX)


def _transform_at(pipe: Pipe, cols: dict[str, Column], kinds: dict, level: int, **kwargs) -> dict[str, Column]:
    """A row-wise pipe on the elements at a depth, by nested transforms: nothing is moved."""
    if level == 0:
        return pipe.exprs(cols, kinds, **kwargs)
    names = list(cols)
    inner = {x: kinds[x].elementType for x in names}
    out = list(_kinds_at(pipe, inner, level - 1, **kwargs))

    def on(s: Column) -> Column:
        made = _transform_at(pipe, {x: s.getField(str(k)) for k, x in enumerate(names)}, inner, level - 1, **kwargs)
        return F.struct(*(made[x].alias(f"g{k}") for k, x in enumerate(out)))

    result = F.transform(_zip(list(cols.values()), list(inner.values())), on)
    return {x: result.getField(f"g{k}") for k, x in enumerate(out)}


def _kinds_at(pipe: Pipe, kinds: dict, level: int, **kwargs) -> dict:
    if level == 0:
        return pipe.kinds(kinds, **kwargs)
    return {x: ArrayType(k) for x, k in _kinds_at(pipe, {x: k.elementType for x, k in kinds.items()}, level - 1, **kwargs).items()}


class ApplyAsFlatten(Pipe):
    """A pipe on the elements at a depth of the columns, put back where they were.

    level: the depth, or names of columns the least depth of which counts (ValueError where none is there). A
    row-wise pipe becomes nested transforms, without a shuffle; null arrays stay null. Any other is run over a table of the elements
    and grouped again by row, one shuffle of the results; there a null array comes back empty. With flatten_idx the pipe sees the
    elements' places in their innermost array as the column IDX. A pipe that changes the number of elements fails
    (ValueError). Level 0 is the pipe itself.
    """

    def __init__(self, pipe: Pipe, level: int | list[str] = 1, flatten_idx: bool = False, level_offset: int = 0, **kwargs):
        super().__init__(**kwargs)
        self.pipe, self.level, self.flatten_idx, self.level_offset = pipe, level, flatten_idx, level_offset

    def _depth(self, kinds: dict) -> int:
        if isinstance(self.level, int):
            return self.level + self.level_offset
        there = [array_depth(kinds[x]) for x in self.level if x in kinds]
        if not there:
            raise ValueError(f"none of the columns {self.level} is there")
        return min(there) + self.level_offset

    row_wise = property(lambda self: self.pipe.row_wise and not self.flatten_idx)

    def _exprs(self, cols, kinds, **kwargs):
        return _transform_at(self.pipe, cols, kinds, self._depth(kinds), **kwargs)

    def _apply(self, df, carry, **kwargs):
        names = [x for x in df.columns if x not in carry]
        depth = self._depth({x: type_of(df, x) for x in names})
        if depth == 0:
            return self.pipe.transform(df, carry, **kwargs)
        if self.row_wise:
            return super()._apply(df, carry, **kwargs)
        row, *places = hidden(depth + 1)
        held = [*carry, row]
        df = df.select(*map(c, carry), F.monotonically_increasing_id().alias(row), *map(c, names))
        for p in places:
            df = _flatten_once(df, names, held, p, outer=True)
            held.append(p)
        full = F.lit(True)
        for p in places:
            full = full & c(p).isNotNull()
        seen = df.filter(full)
        if self.flatten_idx:
            seen = seen.withColumn(IDX, c(places[-1]))
        marks = hidden()
        made = self.pipe.transform(seen.select("*", F.lit(1).alias(marks[0])), [*held, *marks], **kwargs)
        out = [x for x in made.columns if x not in held and x not in marks]
        # empty arrays have no element that the pipe could see
        empty = df.filter(~full).select(*map(c, held))
        joined = made.select(*map(c, held), *map(c, out)).unionByName(empty, allowMissingColumns=True)
        for k in reversed(range(depth)):
            above = places[:k]
            packed = F.when(c(places[k]).isNotNull(), F.struct(c(places[k]).alias("p"), *(c(x).alias(f"f{i}") for i, x in enumerate(out))))
            grouped = joined.groupBy(c(row), *map(c, above)).agg(F.array_sort(F.collect_list(packed)).alias("rows"), *(F.first(c(x)).alias(x) for x in carry))
            bad = F.raise_error(F.lit("the pipe changed the number of elements"))
            dense = F.forall(F.transform("rows", lambda r, i: r["p"] == i), lambda ok: ok)
            grouped = grouped.withColumn("rows", F.when(dense, c("rows")).otherwise(bad))
            joined = grouped.select(*map(c, carry), c(row), *map(c, above), *(c("rows").getField(f"f{i}").alias(x) for i, x in enumerate(out)))
        return joined.drop(row)


class Nested(Pipe):
    """A pipe on what lies level arrays down.

    A row-wise pipe works on the elements there. A function takes the arrays that hold them (name to column) and gives such, of equal
    lengths (a row where they differ fails): it may drop or sort elements. Level 0: on the rows themselves.
    """

    def __init__(self, pipe: Pipe | Callable[[dict[str, Column]], dict[str, Column]], level: int = 1, **kwargs):
        super().__init__(**kwargs)
        self.pipe, self.level = pipe, level

    @property
    def row_wise(self) -> bool:
        return not isinstance(self.pipe, Pipe) or self.pipe.row_wise

    def _exprs(self, cols, kinds, **kwargs):
        if isinstance(self.pipe, Pipe):
            return _transform_at(self.pipe, cols, kinds, self.level, **kwargs)
        return _transform_at(_SetWise(self.pipe), cols, kinds, max(self.level - 1, 0), **kwargs)

    def _apply(self, df, carry, **kwargs):
        if self.row_wise:
            return super()._apply(df, carry, **kwargs)
        return ApplyAsFlatten(self.pipe, level=self.level).transform(df, carry, **kwargs)


class NestedLevel1(Nested):
    def __init__(self, pipe, **kwargs):
        super().__init__(pipe, level=1, **kwargs)


class _SetWise(Pipe):
    def __init__(self, op: Callable):
        super().__init__()
        self.op = op

    def _exprs(self, cols, kinds, **kwargs):
        out = self.op(cols)
        names, each = list(out), list(out.values())
        if len(each) > 1:
            same = reduce(lambda a, b: a & b, [F.size(each[0]) == F.size(x) for x in each[1:]])
            out = {**out, names[0]: F.when(same, each[0]).otherwise(F.raise_error(F.lit("arrays of different lengths")))}
        return out


class Expand(Pipe):
    """A new dimension of size n, its values repeated; axis counts from the rows (0), a negative one is the innermost.

    Axis 0 makes n rows of all rows, each a list of the whole table: that is for small tables alone, in the order of
    IDX where there is one.
    """

    def __init__(self, axis: int, n: int, **kwargs):
        super().__init__(**kwargs)
        self.axis, self.n = axis, n

    @property
    def row_wise(self) -> bool:
        return self.axis != 0

    def _exprs(self, cols, kinds, **kwargs):
        return {x: expand(v, array_depth(kinds[x]), self.axis if self.axis < 0 else self.axis - 1, self.n) for x, v in cols.items()}

    def _apply(self, df, carry, **kwargs):
        if self.axis != 0:
            return super()._apply(df, carry, **kwargs)
        by = [x for x in carry[:1] if x in df.columns] or [x for x in df.columns if x == IDX]
        names = [x for x in df.columns if x not in carry]
        packed = F.struct(*(c(x).alias(f"o{k}") for k, x in enumerate(by)), *(c(x).alias(f"f{k}") for k, x in enumerate(names)))
        rows = F.collect_list(packed)
        one = df.agg((F.array_sort(rows) if by else rows).alias("rows"))
        many = one.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n - 1).cast("long"))).alias("k"), "rows")
        return many.select(*(c("k").alias(x) for x in carry), *(c("rows").getField(f"f{k}").alias(x) for k, x in enumerate(names)))
