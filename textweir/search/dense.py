"""Vector search: exact by blocks of matrix products, approximate by inverted files with optional product codes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.columns import c, full_key
from .base import Search, SearchConfig
from .kept import HELD, Kept, found_batch
from .result import top_k

#: Vectors in a block; a task holds two blocks and the products of one with a tile of the other.
BLOCK = 2048
#: Vectors that a block of queries meets at once: their products stay in a core's cache.
TILE = 512
_BLOCKS = "ids binary, flat binary, n int"
_FOUND = "qid bigint, idx bigint, score double"


@dataclass
class DenseConfig(SearchConfig):
    """metric: inner_product or l2 (scores are then negative squared distances). factory: "flat" is exact, else what parse_factory
    reads. train_size: vectors that centroids are learned from at most, those with the least hash of their place."""

    vector_key: str = "vector"
    factory: str = "flat"
    metric: str = "inner_product"
    nprobe: int = 32
    train_size: int = 100_000
    seed: int = 0

    _no_index_fingerprint = (*SearchConfig._no_index_fingerprint, "nprobe")


@dataclass(frozen=True)
class Factory:
    """A parsed description: a rotation before (None, OPQ or PCAR) with its sizes, lists, and bytes of product codes (0: whole vectors)."""

    rotation: str | None
    parts: int
    dim: int | None
    lists: int
    codes: int
    bits: int = 8


def parse_factory(text: str) -> Factory:
    """``[OPQm[_d],|PCARd,]IVFn,(Flat|PQm[xb])``; ValueError for anything else."""
    m = re.fullmatch(r"(?:(OPQ)(\d+)(?:_(\d+))?,|(PCAR)(\d+),)?IVF(\d+),(?:(Flat)|PQ(\d+)(?:x(\d+))?(?:fs)?)", text)
    if not m:
        raise ValueError(f"not an index description: {text!r}")
    dim = m[3] or m[5]
    return Factory(m[1] or m[4], int(m[2] or 0), int(dim) if dim else None, int(m[6]), int(m[8] or 0), int(m[9] or 8))


def as_matrix(x) -> np.ndarray:
    """Rows of an Arrow list array; ValueError unless they are equally long. Nulls and NaN count as 0."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    sizes = np.unique(np.diff(x.offsets.to_numpy(zero_copy_only=False)))
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes.min()} to {sizes.max()} entries")
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.nan_to_num(flat, nan=0.0).reshape(len(x), -1)


def as_lists(x: np.ndarray) -> pa.ListArray:
    """The other way."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def products(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    s = q @ v.T
    return s if metric == "inner_product" else 2 * s - (q * q).sum(axis=1)[:, None] - (v * v).sum(axis=1)[None, :]


def best_of(scores: np.ndarray, ids: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row; of equal ones those with smaller ids."""
    order = np.argsort(ids, kind="stable")
    n = len(ids) if k is None else min(k, len(ids))
    at = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :n]]
    return np.repeat(np.arange(len(scores)), n), at.ravel()


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """(id, vector) packed, partition by partition; ids and entries as the bytes of int64 and float64."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                ids, flat = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), as_matrix(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary()), pa.array([part.num_rows], pa.int32())], names=["ids", "flat", "n"])

    return vectors.mapInArrow(run, _BLOCKS)


def exact_scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Of pairs, row by row, summed up in one order: equal vectors get equal scores, wherever they stand."""
    return (q * v).sum(axis=1) if metric == "inner_product" else -((q - v) ** 2).sum(axis=1)


class Best(Kept):
    """The k best so far of each query of a block.

    Products in single precision only rule pairs out: those that, with the most that rounding can take off, are worse than
    the k-th best so far. What is left is scored in double precision, so the result is that of an exact search.
    """

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, metric: str):
        super().__init__(len(q), k)
        self.qids, self.q, self.metric = qids, q, metric
        self.norms = (q * q).sum(axis=1)

    def _screen(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two matrices whose products rank a query's vectors, and the most by which a product is off, for each query."""
        q, most = self.q, max(np.abs(self.q).max(initial=0), np.abs(v).max(initial=0))
        if self.metric != "inner_product":
            # the rank of -|q-v|^2 is that of qv - |v|^2 / 2
            q, v = np.c_[q, np.ones(len(q))], np.c_[v, (v * v).sum(axis=1) / -2]
        kind, unit = (np.float32, 2.0**-24) if most < 1e15 else (np.float64, 2.0**-53)
        size = np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1).max(initial=0))
        return q.astype(kind), v.astype(kind), 2 * (q.shape[1] + 8) * unit * size + q.shape[1] * 1e-25

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        with np.errstate(invalid="ignore", over="ignore"):
            a, b, off = self._screen(v)
            for i in range(0, len(v), TILE):
                s = a @ b[i : i + TILE].T
                if self.least.min() == -np.inf and s.shape[1] >= self.k:
                    # a query that has fewer than k asks for the k best of the tile at least; both values may be off
                    first = np.partition(s, -self.k, axis=1)[:, -self.k] - 2 * off
                else:
                    first = -np.inf
                least = self.least if self.metric == "inner_product" else (self.least + self.norms) / 2
                bar = np.nextafter(np.maximum(least - off, first).astype(s.dtype), s.dtype.type(-np.inf))
                at = np.flatnonzero(~(s < bar[:, None]))
                if len(at):
                    r, j = np.divmod(at, s.shape[1])
                    self.put(r, ids[i + j], exact_scores(self.q[r], v[i + j], self.metric))

    def batch(self) -> pa.RecordBatch:
        self.settle()
        return found_batch(pa.array(self.qids[self.row]), self.idx, self.score)


def exact_search(queries: DataFrame, corpus: DataFrame, k: int | None, metric: str = "inner_product") -> DataFrame:
    """The best of all pairs: blocks of queries meet blocks of the corpus; a task keeps k for each query that it meets.

    Which side is sent to all is Spark's choice by its size; large ones meet in a Cartesian product of blocks. The work
    grows with the pairs; a task's memory doesn't, and rows that move are k for each query and partition of the corpus.
    """
    q, v = blocks(queries).toDF("qids", "qflat", "qn"), blocks(corpus).toDF("vids", "vflat", "vn")

    def run(batches):
        held: dict[bytes, Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                qi, qf, qn, vi, vf, vn = (batch.column(j)[row] for j in range(6))
                name = qi.as_py()
                vids, b = np.frombuffer(vi.as_buffer(), np.int64), np.frombuffer(vf.as_buffer()).reshape(vn.as_py(), -1)
                qids, a = np.frombuffer(name, np.int64), np.frombuffer(qf.as_buffer()).reshape(qn.as_py(), -1)
                if a.shape[1] != b.shape[1]:
                    raise ValueError(f"queries have {a.shape[1]} entries, vectors {b.shape[1]}")
                if k is None:
                    for i in range(0, len(b), TILE):
                        r, j = np.divmod(np.arange(len(a) * len(b[i : i + TILE])), len(b[i : i + TILE]))
                        yield found_batch(pa.array(qids[r]), vids[i + j], exact_scores(a[r], b[i + j], metric))
                    continue
                if name not in held:
                    if sum(map(len, held.values())) + len(a) * k > HELD:
                        yield from (x.batch() for x in held.values())
                        held = {}
                    held[name] = Best(qids, a.copy(), k, metric)
                held[name].meet(vids, b)
        yield from (x.batch() for x in held.values())

    return top_k(q.crossJoin(v).mapInArrow(run, _FOUND), k).drop("rank")


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 20) -> np.ndarray:
    """Lloyd's centroids; empty ones take the farthest vectors. k is at most the number of vectors."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = np.full(len(x), np.inf)
        near = np.zeros(len(x), np.int64)
        for i in range(0, len(x), 8192):
            s = -products(x[i : i + 8192], centers, "l2")
            near[i : i + 8192], d[i : i + 8192] = s.argmin(axis=1), s.min(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        full = n > 0
        new = centers.copy()
        new[full] = total[full] / n[full, None]
        new[~full] = x[np.argsort(-d, kind="stable")[: (~full).sum()]]
        if np.allclose(new, centers):
            break
        centers = new
    return centers


@dataclass
class Trained:
    """What is learned from the training vectors: a rotation, centroids of lists, codebooks (part, code, entry)."""

    rotation: np.ndarray | None
    centroids: np.ndarray
    books: np.ndarray | None

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return x if self.rotation is None else x @ self.rotation

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts = np.split(x, len(self.books), axis=1)
        return np.stack([(-products(p, b, "l2")).argmin(axis=1) for p, b in zip(parts, self.books)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)

    def dump(self) -> dict:
        return {k: None if v is None else v.tolist() for k, v in vars(self).items()}

    @staticmethod
    def load(said: dict) -> Trained:
        return Trained(*(None if said[k] is None else np.array(said[k]) for k in ("rotation", "centroids", "books")))


def _books(x: np.ndarray, parts: int, bits: int, seed: int) -> np.ndarray:
    made = [kmeans(p, 1 << bits, seed + j) for j, p in enumerate(np.split(x, parts, axis=1))]
    most = max(map(len, made))
    return np.stack([np.concatenate((b, np.repeat(b[:1], most - len(b), axis=0))) for b in made])


def train(x: np.ndarray, factory: Factory, seed: int = 0) -> Trained:
    """From vectors at hand. OPQ: rotations that make product codes better, learned in turn with them."""
    d = factory.dim or x.shape[1]
    for m in {factory.parts, factory.codes} - {0}:
        if d % m:
            raise ValueError(f"{d} entries can't be cut in {m} parts")
    rotation = None
    if factory.rotation:
        axes = np.linalg.eigh(np.cov(x.T, bias=True) if len(x) > 1 else np.eye(x.shape[1]))[1][:, ::-1][:, :d]
        mix = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
        rotation = axes @ mix
        if factory.rotation == "OPQ":
            for _ in range(8):
                y = x @ rotation
                t = Trained(None, y[:1], _books(y, factory.parts, min(factory.bits, 6), seed))
                u, _, w = np.linalg.svd(x.T @ t.decode(t.encode(y)), full_matrices=False)
                rotation = u @ w
    y = x if rotation is None else x @ rotation
    return Trained(rotation, kmeans(y, factory.lists, seed), _books(y, factory.codes, factory.bits, seed) if factory.codes else None)


class DenseSearch(Search):
    """``query.vector`` against ``index.vector``. Vectors have one length; nulls are left out, NaN counts as 0.

    factory "flat": exact. IVF: vectors lie in the list of their nearest centroid, a query looks into its nprobe
    nearest ones, an equi-join on the list; scores there are exact, or with product codes those of the decoded vectors. A
    query that looks into all lists meets every vector once: that is an exact search over what the lists hold.
    """

    name = "dense"
    config_class = DenseConfig
    requires_vectors = True

    def _vectors(self, df: DataFrame, field: str, key: str) -> DataFrame:
        return df.select(c(key).cast("long").alias(key), c(full_key(field, self.config.vector_key)).cast("array<double>").alias("vector")).filter("vector IS NOT NULL")

    def _build(self, corpus):
        g = self.config
        vectors = self._vectors(corpus, g.index_field, "idx")
        rows = vectors.count()
        if g.factory == "flat":
            return {"vectors": vectors}, {"rows": rows}
        factory = parse_factory(g.factory)
        sample = vectors.orderBy(F.xxhash64("idx", F.lit(g.seed)), "idx").limit(g.train_size).toArrow()
        if not len(sample):
            return {"vectors": vectors.withColumn("list", F.lit(0))}, {"rows": 0}
        t = train(as_matrix(sample["vector"]), factory, g.seed)
        shared = corpus.sparkSession.sparkContext.broadcast(t)

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    t = shared.value
                    y = t.rotate(as_matrix(batch.column(1)))
                    near = (-products(y, t.centroids, "l2")).argmin(axis=1)
                    kept = t.decode(t.encode(y)) if t.books is not None else y
                    yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(kept), pa.array(near, pa.int32())], names=["idx", "vector", "list"])

        return {"vectors": vectors.mapInArrow(place, "idx bigint, vector array<double>, list int")}, {"rows": rows, "trained": t.dump()}

    def _search(self, queries, k):
        g = self.config
        asked = self._vectors(queries, g.query_field, "qid")
        if g.factory == "flat" or not self.state.get("trained"):
            return exact_search(asked, self.tables["vectors"].select("idx", "vector"), k, g.metric)
        t = Trained.load(self.state["trained"])
        shared = queries.sparkSession.sparkContext.broadcast(t)
        metric, probes = g.metric, g.nprobe
        if probes >= len(t.centroids):

            def turn(batches):
                for batch in batches:
                    if batch.num_rows:
                        yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(shared.value.rotate(as_matrix(batch.column(1))))], names=["qid", "vector"])

            turned = asked if t.rotation is None else asked.mapInArrow(turn, "qid bigint, vector array<double>")
            return exact_search(turned, self.tables["vectors"].select("idx", "vector"), k, metric)

        def probe(batches):
            for batch in batches:
                if batch.num_rows:
                    t = shared.value
                    y = t.rotate(as_matrix(batch.column(1)))
                    n = min(probes, len(t.centroids))
                    lists = np.argsort(-products(y, t.centroids, metric), axis=1, kind="stable")[:, :n]
                    r = np.repeat(np.arange(len(y)), n)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), as_lists(y[r]), pa.array(lists.ravel().astype(np.int32))], names=["qid", "vector", "list"])

        def meet(q: pa.Table, v: pa.Table) -> pa.Table:
            if not len(q) or not len(v):
                return pa.table({"qid": pa.array([], pa.int64()), "idx": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            x, ids, qids, out = as_matrix(v["vector"]), v["idx"].to_numpy(), q["qid"].to_numpy(), []
            for i in range(0, len(q), BLOCK):
                s = products(as_matrix(q["vector"].slice(i, BLOCK)), x, metric)
                r, at = best_of(s, ids, k)
                out.append(pa.table({"qid": qids[i + r], "idx": ids[at], "score": s[r, at]}))
            return pa.concat_tables(out)

        probed = asked.mapInArrow(probe, "qid bigint, vector array<double>, list int")
        found = probed.groupBy("list").cogroup(self.tables["vectors"].groupBy("list")).applyInArrow(meet, _FOUND)
        return top_k(found, k).drop("rank")
