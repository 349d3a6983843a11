"""Column expressions on nested arrays: flatten, reshape, expand, pad, unique, fill. All are built in, none moves a row."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def flatten_nested(x: Column, level: int = 1) -> Column:
    """The outer level + 1 dimensions of an array as one; level 0 leaves it."""
    for _ in range(level):
        x = F.flatten(x)
    return x


def infer_missing_dims(n: int, shape: Sequence[int]) -> list[int]:
    """A shape with its one -1 worked out for n elements. ValueError where that can't be."""
    if any(d == 0 or d < -1 for d in shape):
        raise ValueError(f"dimensions are positive or -1: {list(shape)}")
    unknown = [k for k, d in enumerate(shape) if d == -1]
    if len(unknown) > 1:
        raise ValueError(f"one dimension at most may be -1: {list(shape)}")
    known = math.prod(d for d in shape if d > 0)
    if n % known if unknown else n != known:
        raise ValueError(f"{n} elements don't make {list(shape)}")
    return [n // known if d == -1 else d for d in shape]


def chunked(x: Column, size: Column | int) -> Column:
    """An array as consecutive arrays of a size; the last may be shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.ceil(F.size(x) / size).cast("int") - 1
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(x, i * size + 1, size))
    return F.when(F.size(x) == 0, F.array_repeat(x, 0)).when(x.isNotNull(), cut)


def nested(x: Column, shape: Sequence[int]) -> Column:
    """An array in a shape, one -1 being worked out row by row; a row with another number of elements fails."""
    if any(d == 0 or d < -1 for d in shape) or sum(d == -1 for d in shape) > 1:
        raise ValueError(f"dimensions are positive, one may be -1: {list(shape)}")
    known, n = math.prod(d for d in shape if d > 0), F.size(x)
    fits = n % known == 0 if -1 in shape else n == known
    out = F.when(x.isNull(), F.lit(None)).when(fits, x).otherwise(F.raise_error(F.lit(f"an array doesn't make {list(shape)}")))
    dims: list[Column | int] = [d if d > 0 else (n / known).cast("int") for d in shape]
    for d in reversed(dims[1:]):
        out = chunked(out, d)
    return out


def expand(x: Column, depth: int, axis: int, n: int) -> Column:
    """Arrays of a depth (0: scalars) with a dimension of size n put in; a negative axis: innermost. Axis 0 is the outermost of the row."""
    axis = depth if axis < 0 else axis
    if axis > depth:
        raise ValueError(f"axis {axis} of arrays of depth {depth}")
    if axis == 0:
        return F.array_repeat(x, n)
    return F.transform(x, lambda v: expand(v, depth - 1, axis - 1, n))


def pad_to_length(x: Column, n: Column | int, fill) -> Column:
    """Cut, or filled at the right, to n elements; null stays null."""
    n = F.lit(n) if isinstance(n, int) else n
    fill = fill if isinstance(fill, Column) else F.lit(fill)
    return F.when(x.isNotNull(), F.slice(F.concat(x, F.array_repeat(fill, F.greatest(n - F.size(x), F.lit(0)))), F.lit(1), n))


def unique(x: Column) -> Column:
    """The distinct elements in order, nulls last."""
    return F.array_sort(F.array_distinct(x))


def masked_fill(x: Column, mask: Callable[[Column], Column], new: Column | Callable[[Column, Column], Column]) -> Column:
    """New values where the mask holds of an element: a column, or a function of element and place."""
    return F.transform(x, lambda v, i: F.when(mask(v), new(v, i) if callable(new) and not isinstance(new, Column) else new).otherwise(v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def equal_arrays(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def nest_index(idx: Column, pos: Column, stride: int) -> Column:
    """Place of an element of a flattened table."""
    return idx * stride + pos


def longest_common_prefix(lists: Sequence[Sequence]) -> list:
    out = []
    for values in zip(*lists):
        if any(v != values[0] for v in values):
            break
        out.append(values[0])
    return out
