"""Conditions on column names and column sets. They are decided while a plan is made, never row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType

from .fingerprint import Fingerprintable


class Condition(Fingerprintable):
    """A test of one value, in general a column's name."""

    def __call__(self, x) -> bool:
        raise NotImplementedError


class Contains(Condition):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def __call__(self, x) -> bool:
        return self.pattern in x


class In(Condition):
    """Membership; of a string its parts count."""

    def __init__(self, allowed_values):
        self.allowed_values = allowed_values if isinstance(allowed_values, str) else list(allowed_values)

    def __call__(self, x) -> bool:
        return x in self.allowed_values


class HasPrefix(Condition):
    def __init__(self, prefix: str):
        self.prefix = prefix

    def __call__(self, x) -> bool:
        return str(x).startswith(self.prefix)


class Reduce(Condition):
    """Several conditions, or truth values, as one: all of them, or as reduce_op says."""

    def __init__(self, *conditions, reduce_op: Callable[[Iterable[bool]], bool] = all):
        if wrong := [x for x in conditions if not isinstance(x, (bool, Condition))]:
            raise TypeError(f"neither a condition nor a truth value: {wrong[0]!r}")
        self.conditions, self.reduce_op = list(conditions), reduce_op

    def __call__(self, x) -> bool:
        return self.reduce_op([k if isinstance(k, bool) else k(x) for k in self.conditions])


class Not(Condition):
    def __init__(self, condition: Condition):
        self.condition = condition

    def __call__(self, x) -> bool:
        return not self.condition(x)


class Static(Condition):
    def __init__(self, condition: bool):
        self.condition = condition

    def __call__(self, x=None) -> bool:
        return self.condition


class BatchCondition(Condition):
    """A test of a table, a dict of columns or a list of rows (whose first one counts)."""

    def __call__(self, batch) -> bool:
        if isinstance(batch, DataFrame):
            return self.test({f.name: f.dataType for f in batch.schema.fields})
        return self.test(batch[0] if isinstance(batch, list) else batch)

    def test(self, columns: dict) -> bool:
        raise NotImplementedError


class HasKeyWithPrefix(BatchCondition):
    def __init__(self, prefix: str):
        self.prefix = prefix

    def test(self, columns: dict) -> bool:
        return any(str(k).startswith(self.prefix) for k in columns)


class HasKeys(BatchCondition):
    def __init__(self, keys):
        self.keys = list(keys)

    def test(self, columns: dict) -> bool:
        return set(self.keys) <= set(columns)


class AllValuesOfType(BatchCondition):
    """All columns hold this: a Spark type of a table's columns, a class of a dict's values."""

    def __init__(self, cls: type):
        self.cls = cls

    def test(self, columns: dict) -> bool:
        return all(isinstance(v, self.cls) or (isinstance(v, DataType) and v == self.cls) for v in columns.values())
