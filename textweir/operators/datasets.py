"""Operators on whole tables and on dicts of tables by split."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.columns import c, hidden
from ..core.fingerprint import table_fingerprint

Splits = DataFrame | Mapping[str, DataFrame]


def each_split(data: Splits, fn: Callable[[DataFrame], DataFrame]):
    return fn(data) if isinstance(data, DataFrame) else {k: fn(v) for k, v in data.items()}


def take_subset(data: Splits, size: float | int, key: str | None = None, seed: int = 0) -> Splits:
    """So many rows, or such a share from 0 to 1 (a float), without replacement; all where there are fewer.

    The rows with the least hash of their columns, or of a key, and the seed: a top-k in each partition, then one over them. Rows that
    are alike in all that is hashed are told apart by nothing, so any of them may be taken.
    """

    def one(df):
        by = [c(key)] if key else [c(x) for x in df.columns]
        n = size
        if isinstance(size, float):
            if not 0 <= size <= 1:
                raise ValueError(f"a share is from 0 to 1, not {size}")
            n = int(df.count() * size)
        return df.orderBy(F.xxhash64(*by, F.lit(seed)), *([c(key)] if key else [])).limit(n)

    return each_split(data, one)


def concatenate_datasets(datasets: list[Splits], axis: int = 0, key: str = "__idx__") -> Splits:
    """Rows one after another (axis 0; duplicates stay) or columns side by side (axis 1), by the places in a key column.

    Of dicts each split on its own, over all the splits there are. ValueError for tables and dicts together.
    """
    if not datasets:
        raise ValueError("nothing to concatenate")
    if all(isinstance(x, Mapping) for x in datasets):
        return {k: concatenate_datasets([x[k] for x in datasets if k in x], axis, key) for k in dict.fromkeys(k for x in datasets for k in x)}
    if not all(isinstance(x, DataFrame) for x in datasets):
        raise ValueError("tables and dicts of tables can't be concatenated")
    out = datasets[0]
    for x in datasets[1:]:
        out = out.unionByName(x) if axis == 0 else out.join(x, key)
    return out


def get_column_names(data: Splits) -> list[str]:
    """Of splits all that any has."""
    return list(data.columns) if isinstance(data, DataFrame) else list(dict.fromkeys(x for df in data.values() for x in df.columns))


def keep_only_columns(data: Splits, columns=None) -> Splits:
    """Those in a list, or that meet a condition; None keeps all, names that aren't there don't matter."""
    if columns is None:
        return data
    keep = columns if callable(columns) else (lambda x: x in columns)
    return each_split(data, lambda df: df.select(*(c(x) for x in df.columns if keep(x))))


def remove_columns(data: Splits, columns) -> Splits:
    gone = set(columns)
    return each_split(data, lambda df: df.select(*(c(x) for x in df.columns if x not in gone)))


def get_dataset_fingerprints(data: Splits, reduce: bool = False):
    """By split; with reduce one for all."""
    from ..core.fingerprint import get_fingerprint

    found = table_fingerprint(data) if isinstance(data, DataFrame) else {k: table_fingerprint(v) for k, v in data.items()}
    return get_fingerprint(found) if reduce else found


def format_size_difference(before: Splits, after: Splits) -> str:
    """How many rows there were and are, by split."""
    a, b = ({"": x} if isinstance(x, DataFrame) else x for x in (before, after))
    return ", ".join(f"{k or 'rows'}: {a[k].count()} -> {b[k].count()}" for k in a if k in b)


def get_batch_eg(batch: Mapping, idx: int, filter_op=None) -> dict:
    return {k: v[idx] for k, v in batch.items() if filter_op is None or filter_op(k)}


def iter_batch_egs(data):
    """Rows as dicts: of a table a partition at a time."""
    if isinstance(data, DataFrame):
        for row in data.toLocalIterator():
            yield row.asDict(recursive=True)
    else:
        names = list(data)
        for values in zip(*(data[x] for x in names)):
            yield dict(zip(names, values))


def zip_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two tables side by side in their orders; both are numbered first."""
    from ..sources.tables import with_row_index

    (idx,) = hidden()
    return with_row_index(left, idx).join(with_row_index(right, idx), idx).drop(idx)
