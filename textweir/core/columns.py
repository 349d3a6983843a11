"""Columns by literal name: fields are flat columns whose names hold dots, such as ``document.text``."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

_numbers = itertools.count()


def c(name: str) -> Column:
    """The column of just this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def hidden(n: int = 1) -> list[str]:
    """Names that no table has yet; operators carry such columns along without seeing them."""
    return [f"__carried_{next(_numbers)}__" for _ in range(n)]


def full_key(field: str | None, key: str) -> str:
    return f"{field}.{key}" if field else key


def array_depth(kind: DataType) -> int:
    """How many arrays are around the innermost element."""
    n = 0
    while isinstance(kind, ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def element_type(kind: DataType, depth: int | None = None) -> DataType:
    while isinstance(kind, ArrayType) and depth != 0:
        kind = kind.elementType
        depth = None if depth is None else depth - 1
    return kind


def type_of(df: DataFrame, name: str) -> DataType:
    return df.schema[name].dataType
