"""Near-duplicate vectors: p-stable (Euclidean) hashing into several tables, then exact cosines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_array, c, checkpoint, fresh, sized, table
from .components import components

THRESHOLD = 0.95
#: Width of a bucket, in units of the vectors' length.
WIDTH = 1.5
#: Hash functions of a table, at least; more for large tables, so that hardly any vector shares a bucket with a stranger
#: and what is moved are the vectors that have near ones.
LEAST_HASHES = 10
STRANGERS = 0.05
#: Chance that a pair at the threshold shares a bucket of some table.
RECALL = 0.99


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that a quantised Gaussian projection is the same for two points at a distance (Datar et al.)."""
    if distance <= 0:
        return 1.0
    t = width / distance
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """(hash functions of a table, tables) for n vectors.

    As many functions as leave STRANGERS orthogonal vectors in a bucket, LEAST_HASHES at least, and as many tables
    as find a pair at the threshold with the recall wanted.
    """
    strange = collision(math.sqrt(2), width)
    hashes = max(LEAST_HASHES, math.ceil(math.log(max(n, 1) / STRANGERS) / -math.log(strange)))
    near = collision(math.sqrt(max(2 - 2 * threshold, 0)), width) ** hashes
    return hashes, 1 if near >= recall else math.ceil(math.log(1 - recall) / math.log(1 - near))


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows, unit vectors by row): those with entries, all finite and not all zero; the others are left out."""
    offsets = vectors.offsets.to_numpy(zero_copy_only=False)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    ok, out = [], []
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(valid & (np.diff(offsets) > 0)):
        v = flat[offsets[k] : offsets[k + 1]]
        top = np.abs(v).max()
        if np.isfinite(top) and top > 0:
            v = v / top
            ok.append(k)
            out.append(v / np.sqrt(v @ v))
    return np.array(ok, np.int64), out


def projections(dim: int, hashes: int, tables: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions and offsets of all tables; the same for the same arguments on every machine."""
    r = np.random.default_rng([seed, dim])
    return r.standard_normal((dim, hashes * tables)) / width, r.random(hashes * tables)


def bucket_keys(units: np.ndarray, hashes: int, tables: int, width: float, seed: int) -> np.ndarray:
    """(n, tables) 64-bit keys of the buckets that unit vectors of one dimension fall into."""
    a, b = projections(units.shape[1], hashes, tables, width, seed)
    cell = np.floor(units @ a + b).astype(np.int64).reshape(len(units), tables, hashes)
    weight = np.random.default_rng([seed, 1]).integers(1, 2**63, hashes, dtype=np.int64).view(np.uint64) | np.uint64(1)
    key = (cell.view(np.uint64) * weight).sum(axis=2, dtype=np.uint64)
    key ^= (np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + np.uint64(units.shape[1])
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def _keys_of(hashes: int, tables: int, width: float, seed: int):
    def run(batches):
        for batch in batches:
            rows, units = unit_rows(as_array(batch.column(1)))
            ids = batch.column(0).take(pa.array(rows))
            size = np.array([len(u) for u in units], np.int64)
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                x = np.stack([units[k] for k in own])
                for i in range(0, len(own), 4096):
                    keys = bucket_keys(x[i : i + 4096], hashes, tables, width, seed)
                    part = ids.take(pa.array(own[i : i + 4096]))
                    yield pa.RecordBatch.from_arrays([part.take(pa.array(np.repeat(np.arange(len(part)), tables))), pa.array(keys.ravel())], names=["id", "key"])

    return run


def bucket_forest(ids: np.ndarray, x: np.ndarray, threshold: float, block: int = 2048):
    """Edges (id, id) that link what the pairs of cosine >= threshold link, from exact cosines; far fewer than the pairs.

    A leader is held against all that is left. What lies within half the threshold's angle of it is within that
    angle of each other: one edge each, and only what lies between the half and one and a half times the angle can
    be near to them beside the leader. Few vectors are simply multiplied with each other.
    """
    angle = math.acos(min(max(threshold, -1.0), 1.0))
    inner, outer = math.cos(min(angle / 2, math.pi)), math.cos(min(1.5 * angle, math.pi))
    rest, out = np.arange(len(ids)), []
    while len(rest) > block:
        lead, rest = rest[0], rest[1:]
        near = x[rest] @ x[lead]
        settled = rest[near >= inner + 1e-12]
        out += [(ids[k], ids[lead]) for k in rest[near >= threshold]]
        fringe = rest[(near < inner + 1e-12) & (near >= outer - 1e-9)]
        for i in range(0, len(settled) if len(fringe) else 0, block):
            part = settled[i : i + block]
            for j in range(0, len(fringe), block):
                there = fringe[j : j + block]
                hit = x[there] @ x[part].T >= threshold
                out += [(ids[there[k]], ids[part[hit[k].argmax()]]) for k in np.flatnonzero(hit.any(axis=1))]
        rest = rest[near < inner + 1e-12]
    if len(rest) > 1:
        hit = np.triu(x[rest] @ x[rest].T >= threshold, 1)
        out += [(ids[rest[a]], ids[rest[b]]) for a, b in zip(*np.nonzero(hit))]
    return out


def _forests(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        rows, units = unit_rows(as_array(group["vector"]))
        ids = group["id"].to_numpy()[rows]
        size = np.array([len(u) for u in units])
        edges = []
        for d in np.unique(size):
            own = np.flatnonzero(size == d)
            edges += bucket_forest(ids[own], np.stack([units[k] for k in own]), threshold)
        return pa.table({"u": pa.array([int(a) for a, _ in edges], pa.int64()), "v": pa.array([int(b) for _, b in edges], pa.int64())})

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH, seed: int = 7) -> DataFrame:
    """(id, kept) for every vector that repeats another: its group's smallest id is the one kept.

    Two vectors belong together if their cosine is the threshold at least; groups are the connected components.
    Identical vectors are one before anything is hashed. Candidates share a bucket of some table of quantised
    Gaussian projections; every edge comes from an exact cosine. Nothing is capped: a bucket of any size is gone
    through exactly, with work that grows with its groups and not with their pairs. The number of projections grows
    with the logarithm of the table, and that of tables with it, so that recall is the same at every size.

    Ids are integers. Rows with a null id or vector are in no group; nor is a vector that is empty, all zeros or
    has a null or an entry that isn't finite. Vectors of different lengths never belong together. Rows that share an id are
    one item, whose vectors all count. An empty table gives no rows. Extra columns are ignored.
    """
    kind = df.schema[vector_col].dataType
    v = c(vector_col) if kind.simpleString() in ("array<float>", "array<double>") else c(vector_col).cast("array<double>")
    rows = df.select(c(id_col).cast("long").alias("id"), v.alias("vector")).filter("id IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)")
    least = F.min("id").over(Window.partitionBy("vector"))
    based = checkpoint(rows.withColumn("rep", least).select("id", "rep", F.when(F.col("id") == F.col("rep"), F.col("vector")).alias("vector")))
    # a zero vector, or one with NaN, equals its like but is near to nothing
    usable = "exists(vector, x -> x <> 0) AND forall(vector, x -> abs(x) < double('Infinity'))"
    own = based.filter("vector IS NOT NULL").filter(usable).distinct().select("id", "vector")
    copies = based.filter("id <> rep").join(own.select(F.col("id").alias("rep")).distinct(), "rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))

    hashes, tables = plan_tables(own.count(), threshold, recall, width)
    keys = own.mapInArrow(_keys_of(hashes, tables, width, seed), "id long, key long")
    by_key = Window.partitionBy("key")
    shared = keys.select("id", "key", F.count("*").over(by_key).alias("n")).filter("n > 1").select("id", "key")
    near = shared.join(own, "id").groupBy("key").applyInArrow(_forests(threshold), "u long, v long").distinct()
    return components(copies.union(near)).select("id", F.col("root").alias("kept"))


def drop_near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """The table without the rows that near_vectors names; its columns stay, as do rows that are in no group."""
    (gone,) = fresh(df.columns, "__gone")
    named = checkpoint(near_vectors(df, id_col, vector_col, **options).select(F.col("id").alias(gone)))
    return df.join(sized(named), c(id_col).cast("long") == c(gone), "left_anti")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, kept_vec_id) of every vector to remove, over all embeddings."""
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), F.col("kept").alias("kept_vec_id"))
