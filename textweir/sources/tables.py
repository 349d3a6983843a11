"""Tables from and to storage; vector stores keyed by fingerprint."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.columns import c
from ..core.pipe import to_batch, to_table


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Parquet, or what the path's end says: .csv, .json, .orc, .txt. Directories read as Parquet."""
    kind = {".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc", ".txt": "text"}.get(PurePosixPath(path).suffix, "parquet")
    return spark.read.format(kind).options(**options).load(path)


def from_dict(spark: SparkSession, batch: dict) -> DataFrame:
    return to_table(spark, batch)


def to_dict(df: DataFrame, order: str | None = None) -> dict[str, list]:
    """For small results."""
    return to_batch(df, order)


def with_row_index(df: DataFrame, name: str = "__idx__") -> DataFrame:
    """Dense places from 0 in the table's order: partitions are counted first, nothing is shuffled."""
    part, within = "__part__", "__within__"
    rows = df.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(within))
    sizes = sorted((r[part], r["n"]) for r in rows.groupBy(part).agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p], total = total, total + n
    base = F.element_at(F.create_map(*(F.lit(x) for p in starts.items() for x in p)), c(part)) if starts else F.lit(0)
    place = (c(within) - F.shiftleft(c(part).cast("long"), 33) + base).cast("long")
    return rows.select(*map(c, df.columns), place.alias(name))


class Store:
    """Vectors by row place under a path: Parquet files of (__idx__, vector), and their description beside them.

    dtype float32 is kept as it is; float16 is rounded to half precision, the files hold floats.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self) -> bool:
        """Whether a write was finished: Spark's own mark is there."""
        fs, path = self._files()
        return fs.exists(path(f"{self.path}/_SUCCESS"))

    def write(self, vectors: DataFrame, dtype: str = "float32") -> None:
        if dtype not in ("float32", "float16"):
            raise ValueError(f"dtype is float32 or float16, not {dtype}")
        missing = {"__idx__", "vector"} - set(vectors.columns)
        if missing:
            raise ValueError(f"a store needs {', '.join(sorted(missing))}")
        v = c("vector").cast("array<float>")
        vectors.select(c("__idx__").cast("long").alias("__idx__"), (half(v) if dtype == "float16" else v).alias("vector")).write.mode("overwrite").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def remove(self) -> None:
        fs, path = self._files()
        fs.delete(path(self.path), True)


def half(v):
    """Rounded to half precision."""
    @F.arrow_udf("array<float>")
    def rounded(x: pa.Array) -> pa.Array:
        values = x.values.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
        return pa.ListArray.from_arrays(x.offsets, pa.array(values), mask=x.is_null() if x.null_count else None)

    return rounded(v)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small file of one JSON object, through the storage that Spark uses."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    stream.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
