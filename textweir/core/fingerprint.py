"""Fingerprints: equal objects, configurations and tables have equal ones, in every process."""

from __future__ import annotations

import copy
import hashlib
import inspect
import json
import pprint as printing
from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _digest(*parts: bytes) -> str:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(len(p).to_bytes(8, "little"))
        h.update(p)
    return h.hexdigest()


def _code(fn) -> bytes:
    """A function by what it does: code, constants and what it closes over, not where it lies."""
    code = getattr(fn, "__code__", None)
    if code is None:
        return repr(getattr(fn, "__qualname__", fn)).encode()
    parts = [code.co_code, repr(code.co_names).encode()]
    parts += [_code_of(x) if inspect.iscode(x) else repr(x).encode() for x in code.co_consts]
    for cell in fn.__closure__ or ():
        parts.append(get_fingerprint(cell.cell_contents).encode())
    parts.append(repr(fn.__defaults__).encode())
    return b"\0".join(parts)


def _code_of(code) -> bytes:
    return code.co_code + repr([x for x in code.co_consts if not inspect.iscode(x)]).encode() + b"".join(_code_of(x) for x in code.co_consts if inspect.iscode(x))


def serialize_array(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x)
    return f"{x.dtype.str}{x.shape}".encode() + x.tobytes()


def get_fingerprint(x: Any) -> str:
    """Short scalars read ``<x>``; everything else is a digest of its contents."""
    if x is None or isinstance(x, (str, int, float, bool)):
        return f"<{x}>" if len(str(x)) <= 14 else _digest(type(x).__name__.encode(), str(x).encode())
    if isinstance(x, Fingerprintable):
        return x.fingerprint
    if isinstance(x, np.ndarray):
        return _digest(b"array", serialize_array(x))
    if isinstance(x, DataFrame):
        return table_fingerprint(x)
    if isinstance(x, Mapping):
        return _digest(b"map", *(p for k in sorted(x, key=str) for p in (str(k).encode(), get_fingerprint(x[k]).encode())))
    if isinstance(x, (list, tuple)):
        return _digest(b"list", *(get_fingerprint(v).encode() for v in x))
    if isinstance(x, (set, frozenset)):
        return _digest(b"set", *sorted(get_fingerprint(v).encode() for v in x))
    if isinstance(x, type):
        return _digest(b"type", f"{x.__module__}.{x.__qualname__}".encode())
    if callable(x) and hasattr(x, "__code__"):
        return _digest(b"code", _code(x))
    if hasattr(x, "__dict__"):
        return _digest(b"object", type(x).__qualname__.encode(), get_fingerprint({k: v for k, v in vars(x).items()}).encode())
    return _digest(cloudpickle.dumps(x))


def table_fingerprint(df: DataFrame) -> str:
    """By the rows, whatever their order, and the schema: counts and sums of hashes, one pass without a shuffle of rows."""
    h = F.xxhash64(*(F.col("`" + x.replace("`", "``") + "`") for x in df.columns)) if df.columns else F.lit(0)
    n, total, mixed = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return _digest(df.schema.json().encode(), f"{n},{total},{mixed}".encode())


def map_leaves(x, fn: Callable):
    """Nested dicts and lists with fn applied to every leaf."""
    if isinstance(x, Mapping):
        return {k: map_leaves(v, fn) for k, v in x.items()}
    return [map_leaves(v, fn) for v in x] if isinstance(x, (list, tuple)) else fn(x)


def iter_leaves(x):
    """The leaves, depth first."""
    if isinstance(x, (Mapping, list, tuple)):
        for v in x.values() if isinstance(x, Mapping) else x:
            yield from iter_leaves(v)
    else:
        yield x


def named_leaves(x, name: str, into=None):
    """The values that stand under a key of this name, at any depth."""
    if isinstance(x, Mapping):
        for k, v in x.items():
            if k == name:
                yield v
            yield from named_leaves(v, name)
    elif isinstance(x, (list, tuple)):
        for v in x:
            yield from named_leaves(v, name)


def reduce_leaves(x, fn: Callable = all):
    return fn(iter_leaves(x))


class Fingerprintable:
    """An object that is described, compared and copied by its attributes; _no_fingerprint names those left out."""

    _no_fingerprint: tuple[str, ...] = ("id",)

    def to_json_struct(self, exclude=(), include_only=None, include_class_attributes: bool = False) -> dict:
        """Attributes as nested dicts and lists; None is left out, "__name__" is the class."""
        own = dict(vars(self))
        if include_class_attributes:
            own = {k: v for k, v in vars(type(self)).items() if not k.startswith("__") and not callable(v)} | own
        keep = {k: v for k, v in own.items() if k not in exclude and (include_only is None or k in include_only) and v is not None}

        def down(v):
            if isinstance(v, Fingerprintable):
                return v.to_json_struct(exclude=exclude, include_only=include_only, include_class_attributes=include_class_attributes)
            if isinstance(v, Mapping):
                return {k: down(x) for k, x in v.items()}
            return [down(x) for x in v] if isinstance(v, (list, tuple)) else v

        return {"__name__": type(self).__name__} | {k: down(v) for k, v in keep.items()}

    def get_fingerprint(self, reduce: bool = True, exclude=()):
        """A digest, or with reduce=False a struct with the digest of every leaf."""
        gone = {*self._no_fingerprint, *exclude}
        parts = {"__name__": f"<{type(self).__name__}>"}
        for k, v in sorted(vars(self).items()):
            if k not in gone and v is not None:
                parts[k] = v.get_fingerprint(reduce=False) if isinstance(v, Fingerprintable) else map_leaves(v, lambda x: x.get_fingerprint(reduce=False) if isinstance(x, Fingerprintable) else get_fingerprint(x))
        return _digest(json.dumps(parts, sort_keys=True, default=str).encode()) if reduce else parts

    @property
    def fingerprint(self) -> str:
        return self.get_fingerprint()

    @staticmethod
    def safe_fingerprint(x) -> str:
        return get_fingerprint(x)

    def picklable(self, reduce: bool = False):
        """Whether each attribute can be sent to the executors; with reduce whether all can."""

        def test(v) -> bool:
            try:
                cloudpickle.dumps(v)
            except Exception:  # whatever a class raises when it refuses
                return False
            return True

        found = {k: v.picklable() if isinstance(v, Fingerprintable) else map_leaves(v, test) for k, v in vars(self).items()}
        return reduce_leaves(found, all) if reduce else found

    def copy(self, **changes):
        out = copy.deepcopy(self)
        vars(out).update(changes)
        return out

    def pprint(self) -> None:
        printing.pprint(self.to_json_struct())
