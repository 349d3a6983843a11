"""Near-duplicate texts by SetSketch registers: banded, estimated by likelihood, verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import CHUNK, as_array, c, checkpoint, fresh, hash_words, mix, release_memory, sized, slices, split_words, table, text_batches
from .components import components

#: Registers, their base, rate and largest value (16 bits), as in the two-byte sketch of the paper by Ertl.
M, B, A, TOP = 128, 1.001, 20.0, 65535
#: Bands of ROWS registers each.
BANDS, ROWS = 32, 4
SHINGLE = 3
THRESHOLD = 0.6
#: Pairs whose estimate is this far under the threshold are still verified; so far over it, one edge is enough at first.
SLACK = 0.12

_GOLD, _P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingles(ends: np.ndarray, codes: np.ndarray, words: pa.Array, k: int = SHINGLE):
    """(row, 64-bit hash) of each run of k words; a row of fewer words has one shingle of all, an empty row none."""
    h = hash_words(words)[codes] if len(codes) else np.empty(0, np.uint64)
    lengths = np.diff(ends)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(ends[1:], lengths) - np.arange(len(codes))
    own, place = np.zeros(len(codes), np.uint64), np.arange(len(codes))
    for j in range(k):
        inside = left > j
        own[inside] = mix(own[inside] * _P1 + h[place[inside] + j] + _P2)
    first = np.repeat(ends[:-1], lengths) == place
    keep = (left >= k) | first
    return rows[keep], own[keep]


def registers(rows: np.ndarray, hashes: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """(n, m) register values of n sets, 0 throughout for an empty one.

    An element meets every register once, in an order of its own, the j-th time with a hash value in the j-th of m
    equal intervals; so a set is done as soon as its largest minimum lies below the interval to come. The minimum
    of uniform values is turned into that of exponential ones with rate A, and K = floor(1 - log_B x), truncated.
    """
    low = np.full(n * m, np.inf)
    start, step = (hashes >> np.uint64(40)).astype(np.int64), ((hashes >> np.uint64(20)).astype(np.int64) | 1)
    at, live = rows.astype(np.int64) * m, hashes
    for j in range(m):
        u = (mix(live + np.uint64((j + 1) * int(_GOLD) % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        np.minimum.at(low, at + ((start + j * step) & (m - 1)), (j + u) / m)
        open_rows = low.reshape(n, m).max(axis=1) > (j + 1) / m
        stay = open_rows[at // m]
        if not stay.any():
            break
        at, live, start, step = at[stay], live[stay], start[stay], step[stay]
    with np.errstate(divide="ignore", over="ignore"):
        x = -np.log1p(-np.minimum(low, 1 - 2.0**-53)) / A
        k = np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(B))
    k[np.isinf(low)] = 0
    return np.clip(k, 0, TOP).astype(np.uint16).reshape(n, m)


def cardinality(k: np.ndarray) -> np.ndarray:
    """Estimated sizes of the sets behind rows of registers."""
    return k.shape[1] * (1 - 1 / B) / (A * np.log(B) * np.sum(B ** -k.astype(np.float64), axis=1))


def estimate(one: np.ndarray, one_n, many: np.ndarray, many_n: np.ndarray) -> np.ndarray:
    """Most likely Jaccard coefficients of one row of registers with many, given the cardinalities.

    With u, v the shares of the two cardinalities, a register is greater on the first side with probability u - vJ,
    on the second with v - uJ, equal with J (in the limit of B to 1, from which 1.001 differs by a thousandth);
    the likelihood of the three counts has its maximum at the smaller root of a quadratic.
    """
    more, less = (one > many).sum(axis=1), (one < many).sum(axis=1)
    m = many.shape[1]
    same = m - more - less
    u = one_n / (one_n + many_n)
    v = 1 - u
    h = u * u * (same + less) + v * v * (same + more)
    j = (h - np.sqrt(np.maximum(h * h - 4.0 * m * same * u * u * v * v, 0))) / (2 * m * u * v)
    return np.clip(j, 0, np.minimum(u / v, v / u))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of the sets."""
    return np.maximum(a, b)


def _sign(batches):
    for batch in batches:
        ids = batch.column(0)
        for first, ends, codes, words in split_words(as_array(batch.column(1))):
            n = len(ends) - 1
            rows, hashes = shingles(ends, codes, words)
            k = registers(rows, hashes, n)
            # the whole sequence of words, as two sums of place-dependent hashes
            h = hash_words(words)[codes] if len(codes) else np.empty(0, np.uint64)
            place = (np.arange(len(codes)) - np.repeat(ends[:-1], np.diff(ends))).astype(np.uint64)
            keys = []
            for salt in (_P1, _P2):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + (place + salt) * _GOLD), dtype=np.uint64)))
                keys.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
            full = np.flatnonzero(np.diff(ends) > 0)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, n).take(pa.array(full)), pa.array(keys[0][full]), pa.array(keys[1][full]), pa.array([r.tobytes() for r in k[full]], pa.binary())],
                names=["id", "k1", "k2", "regs"],
            )
    release_memory()


def _edges_of_bucket(ids: np.ndarray, k: np.ndarray, threshold: float, roots: np.ndarray | None = None):
    """Edges (id, smaller id), as two arrays, worth verifying among documents that share a band's registers.

    Without roots, each document in turn, by id, is held against all later ones that no edge settles yet. With the
    roots of the groups that verified edges make, against all later ones of other groups.
    """
    order = np.argsort(ids, kind="stable")
    ids, k = ids[order], k[order]
    n = cardinality(k)
    us, vs = [], []

    def near(lead: int, others: np.ndarray) -> np.ndarray:
        j = np.concatenate([estimate(k[lead], n[lead], k[others[i : i + 8192]], n[others[i : i + 8192]]) for i in range(0, len(others), 8192)] or [np.empty(0)])
        found = others[j >= threshold - SLACK]
        us.append(ids[found])
        vs.append(np.full(len(found), ids[lead]))
        return j

    if roots is not None:
        roots = roots[order]
        for lead in range(len(ids) - 1):
            near(lead, lead + 1 + np.flatnonzero(roots[lead + 1 :] != roots[lead]))
    else:
        rest = np.arange(len(ids))
        while len(rest) > 1:
            lead, rest = rest[0], rest[1:]
            rest = rest[near(lead, rest) < threshold + SLACK]
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs])


def _bucket_edges(threshold: float):
    def run(batches):
        """Whole buckets, one after another; a bucket may go on in the next batch. Rows are (key, id, registers[, root])."""
        held: list[tuple] = []

        def edges(last: bool):
            """Those of all buckets held but, unless last, the last, which may go on."""
            key, ids, *root = (np.concatenate(x) for x in zip(*((h[0], h[1], *h[3:]) for h in held)))
            k = np.concatenate([h[2] for h in held])
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            us, vs = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == len(key) and not last:
                    break
                own = a + np.unique(ids[a:b], return_index=True)[1]
                if len(own) > 1:
                    u, v = _edges_of_bucket(ids[own], k[own], threshold, root[0][own] if root else None)
                    us.append(u)
                    vs.append(v)
            a = len(key) if last else cuts[-2]
            held[:] = [(key[a:], ids[a:], k[a:], *(r[a:] for r in root))] if a < len(key) else []
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (us, vs)], names=["u", "v"])

        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            key, ids, *root = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(batch.num_columns) if x != 2)
            held.append((key, ids, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(len(batch), -1), *root))
            rows += len(batch)
            # a bucket that goes on is looked at again only once as many rows have come as are held
            if rows >= 20_000 and held[0][0][0] != key[-1]:
                yield edges(False)
                rows = sum(len(h[0]) for h in held) // 2
        if held:
            yield edges(True)
        release_memory()

    return run


def _jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact coefficients of the texts' shingle sets, pair by pair; 0 where neither has a word."""
    turn = pa.array(np.arange(2 * len(a)).reshape(2, -1).T.ravel())
    both = pa.concat_arrays([a, b]).take(turn)
    out, limit = np.zeros(len(a)), 1 << 62
    start = 0
    for at, part in slices(both, CHUNK):
        end = (at + len(part) + 1) // 2  # a pair isn't cut
        if end <= start:
            continue
        for _, ends, codes, words in split_words(both.slice(2 * start, 2 * (end - start)), limit):
            rows, h = shingles(ends, codes, words)
            order = np.lexsort((h, rows))
            rows, h = rows[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
            rows, h = rows[new], h[new]
            total = np.bincount(rows // 2, minlength=end - start)
            order = np.lexsort((h, rows // 2))
            pair, h = rows[order] // 2, h[order]
            shared = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=end - start)
            out[start:end] = shared / np.maximum(total - shared, 1)
        start = end
    return out


@F.arrow_udf(DoubleType())
def exact_jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    out = pa.array(_jaccard(as_array(a), as_array(b)))
    release_memory()
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, kept) for every document that repeats another: its group's smallest id is the one kept.

    Documents are sets of runs of three words (lower-cased, split at white space, freed of signs at their ends; of
    fewer words one run). Two belong together if the sets' Jaccard coefficient is the threshold at least; groups
    are the connected components. Texts with the same words are one before anything is compared, so thousands of
    copies cost no more than one. Documents with the same registers in a band are held against each other by
    estimate; every edge between them that counts is verified over the whole texts. That is done twice: a document
    with a safe edge to one of a band isn't held against the others there, until the groups of the verified edges
    are known; then all pairs of a band that are in two groups are. Nothing is capped. At the
    default bands a pair at the threshold is found with probability 0.98.

    Ids are integers. Rows with a null id, a null text or no words are in no group. Rows that share an id are one
    document, whose texts all count. An empty table gives no rows. Extra columns are ignored.
    """
    text_batches(df.sparkSession)
    docs = df.select(c(id_col).cast("long").alias("id"), c(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    signed = docs.mapInArrow(_sign, "id long, k1 long, k2 long, regs binary")
    least = F.min("id").over(Window.partitionBy("k1", "k2"))
    base = checkpoint(signed.withColumn("rep", least).select("id", "rep", F.when(F.col("id") == F.col("rep"), F.col("regs")).alias("regs")))
    copies = base.filter("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct()
    own = base.filter("regs IS NOT NULL").select("id", "regs").distinct()

    width = 2 * ROWS
    bands = own.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.col("regs").substr(b * width + 1, F.lit(width))))).alias("key"))
    by_key = Window.partitionBy("key")
    shared = checkpoint(bands.select("id", "key", F.min("id").over(by_key).alias("lo"), F.max("id").over(by_key).alias("hi")).filter("lo < hi").select("id", "key"))

    def edges(members: DataFrame) -> DataFrame:
        buckets = members.join(own, "id").select("key", "id", "regs", *members.columns[2:]).repartition("key").sortWithinPartitions("key", "id")
        return buckets.mapInArrow(_bucket_edges(threshold), "u long, v long").distinct()

    def verified(found: DataFrame) -> DataFrame:
        # only the texts that an edge names are moved
        named = checkpoint(found.select(F.col("u").alias("id")).union(found.select("v")).distinct())
        texts = docs.join(sized(named), "id", "left_semi")
        held = found.join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
        return held.filter(exact_jaccard("a", "b") >= threshold).select("u", "v")

    first = checkpoint(edges(shared))
    groups = checkpoint(components(copies.union(verified(first))).select("id", "root"))
    # a document that is near a settled one but not its lead, or was settled by an estimate too high, is in another group
    rooted = shared.join(groups, "id", "left").select("id", "key", F.coalesce("root", "id").alias("root"))
    mixed = rooted.withColumns({"lo": F.min("root").over(by_key), "hi": F.max("root").over(by_key)}).filter("lo < hi").select("id", "key", "root")
    second = checkpoint(edges(mixed).join(first, ["u", "v"], "left_anti"))
    if second.isEmpty():
        return groups.select("id", F.col("root").alias("kept"))
    return components(groups.select(F.col("id").alias("u"), F.col("root").alias("v")).union(verified(second))).select("id", F.col("root").alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The table without the documents that near_duplicates names; its columns stay.

    Of each group the rows with the smallest id stay; so do rows with a null id, a null text or no words.
    """
    (gone,) = fresh(df.columns, "__gone")
    named = checkpoint(near_duplicates(df, id_col, text_col, threshold).select(F.col("id").alias(gone)))
    return df.join(sized(named), c(id_col).cast("long") == c(gone), "left_anti")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept_doc_id) of every document to remove, over all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("kept").alias("kept_doc_id"))
