"""Models over tables, with their outputs kept in stores."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.columns import c
from ..core.fingerprint import get_fingerprint, table_fingerprint
from ..core.pipe import Pipe
from ..sources.tables import Store

IDX = "__idx__"


class CacheConfig:
    """Where and how outputs are kept. dtype: float16 or float32; chunk: rows that mustn't be zero throughout."""

    def __init__(self, dtype: str = "float32", batch_size: int = 100, chunk: int = 1000):
        if dtype not in ("float16", "float32"):
            raise ValueError(f"dtype is float16 or float32, not {dtype}")
        self.dtype, self.batch_size, self.chunk = dtype, batch_size, chunk


class PredictWithoutCache(Pipe):
    """A model, a function from a dict of columns (lists) to such a dict, in Python workers on Arrow batches.

    output: the name that its result has and the type in DDL. The function and what it holds is sent to a worker once
    a task. Rows stay as they are.
    """

    def __init__(self, model: Callable[[dict], dict], output: str = "vector", kind: str = "array<float>", batch_size: int = 100, **kwargs):
        super().__init__(**kwargs)
        self.model, self.output, self.kind, self.batch_size = model, output, kind, batch_size

    def _apply(self, df, carry, **kwargs):
        from .basics import _arrow

        model, output, size = self.model, self.output, self.batch_size
        seen = [x for x in df.columns if x not in carry]
        schema = df.sparkSession.createDataFrame([], f"`{output}` {self.kind}").schema
        full = df.select(*map(c, carry)).schema
        for f in schema:
            full = full.add(f)
        arrow = _arrow(schema[0].dataType)

        def run(batches):
            for big in batches:
                for i in range(0, big.num_rows, size):
                    batch = big.slice(i, size)
                    got = model({x: batch.column(x).to_pylist() for x in seen}, **kwargs)[output]
                    if isinstance(got, np.ndarray) or hasattr(got, "tolist"):
                        got = got.tolist()
                    yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in carry), pa.array([x.tolist() if hasattr(x, "tolist") else x for x in got], arrow)], names=[*carry, output])

        return df.mapInArrow(run, full)


def cache_or_load_vectors(df: DataFrame, model: Pipe, path: str, config: CacheConfig | None = None, output: str = "vector") -> DataFrame:
    """(__idx__, vector) of a table with places in __idx__: from the store, or computed, stored and checked."""
    config = config or CacheConfig()
    store = Store(df.sparkSession, path)
    if IDX not in df.columns:
        raise ValueError(f"the table has no {IDX}")
    if not store.exists():
        seen = df.select(c(IDX).alias("__held__"), *(c(x) for x in df.columns if x != IDX))
        made = model.transform(seen, ["__held__"])
        store.write(made.select(c("__held__").alias(IDX), c(output).alias("vector")), config.dtype)
    validate_store(store.read(), df.count(), config.chunk)
    return store.read()


def validate_store(vectors: DataFrame, rows: int, chunk: int = 1000) -> None:
    """ValueError unless there is a vector for each row, all of one size, and no chunk of consecutive ones is zero throughout; one pass."""
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x))
    parts = vectors.groupBy(F.floor(c(IDX) / chunk).alias("part")).agg(F.count("*").alias("n"), F.sum(total).alias("s"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi"))
    n, zero, lo, hi = parts.agg(F.sum("n"), F.count_if(F.col("s") == 0), F.min("lo"), F.max("hi")).first()
    if (n or 0) != rows:
        raise ValueError(f"the store has {n} vectors for {rows} rows")
    if rows and lo != hi:
        raise ValueError(f"the store has vectors of {lo} to {hi} entries")
    if zero:
        raise ValueError(f"{zero} chunks of {chunk} vectors are zero throughout")


class PredictWithCache(Pipe):
    """A model whose outputs are kept under cache_dir, by fingerprints of model, output and table.

    cache() computes and stores them; a call joins them to rows by the places in __idx__ (ValueError without them, or before
    cache() for that fingerprint).
    """

    def __init__(self, model: Pipe, cache_dir: str, cache_config: CacheConfig | None = None, output: str = "vector", **kwargs):
        super().__init__(**kwargs)
        self.model, self.cache_dir, self.cache_config, self.output = model, cache_dir, cache_config or CacheConfig(), output

    def get_cache_fingerprint(self, df: DataFrame) -> str:
        return get_fingerprint([self.model.fingerprint, self.output, self.cache_config.dtype, table_fingerprint(df)])

    def path(self, fingerprint: str) -> str:
        return f"{self.cache_dir}/cache-{fingerprint}"

    def cache(self, data, input_filter=None):
        """The fingerprint to call with; of a dict of splits one for each."""
        if isinstance(data, Mapping):
            return {k: self.cache(v, input_filter) for k, v in data.items()}
        keep = input_filter or self.model.input_filter
        df = data.select(*(c(x) for x in data.columns if x == IDX or keep is None or keep(x)))
        fingerprint = self.get_cache_fingerprint(df)
        cache_or_load_vectors(df, self.model, self.path(fingerprint), self.cache_config, self.output)
        return fingerprint

    def exists(self, fingerprint: str) -> bool:
        return Store(SparkSession.active(), self.path(fingerprint)).exists()

    def get_cached_vectors(self, fingerprint: str) -> DataFrame:
        store = Store(SparkSession.active(), self.path(fingerprint))
        if not store.exists():
            raise ValueError(f"nothing is cached for {fingerprint}")
        return store.read()

    def _apply(self, df, carry, cache_fingerprint: str | None = None, **kwargs):
        idx = next((x for x in df.columns if x == IDX), None)
        if cache_fingerprint is None or idx is None:
            raise ValueError(f"cached outputs need {IDX} and cache_fingerprint")
        vectors = self.get_cached_vectors(cache_fingerprint).select(c(IDX).alias("__at__"), c("vector").alias(self.output))
        return df.join(vectors, c(IDX) == c("__at__"), "left").select(*map(c, carry), c(self.output))


class Predict(Pipe):
    """A model: from its cache where the table's fingerprint is known or requires_cache says so, else computed."""

    def __init__(self, model: Pipe, cache_dir: str | None = None, cache_config: CacheConfig | None = None, requires_cache: bool = False, output: str = "vector", **kwargs):
        super().__init__(**kwargs)
        self.model, self.requires_cache, self.output = model, requires_cache, output
        self.cached = PredictWithCache(model, cache_dir, cache_config, output) if cache_dir else None
        if requires_cache and self.cached is None:
            raise ValueError("requires_cache needs a cache_dir")

    def cache(self, data, **kwargs):
        return self.cached.cache(data, **kwargs)

    def _apply(self, df, carry, cache_fingerprint: str | None = None, **kwargs):
        if self.requires_cache or (self.cached and cache_fingerprint and self.cached.exists(cache_fingerprint)):
            return self.cached.transform(df, carry, cache_fingerprint=cache_fingerprint)
        return self.model.transform(df.drop(IDX) if IDX in df.columns and IDX not in carry else df, carry, **kwargs)
