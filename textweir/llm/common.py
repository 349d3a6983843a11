"""Helpers that the operators share: column names, shared storage, words of a text column."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Signs taken off both ends of a word.
EDGE = ".,!?;:\"'()[]{}<>|#$%&*-_/\\`~+=@^…«»“”„’‘¿¡"
#: Characters of text that are split into words at once; bounds a worker's memory, not what is read.
CHUNK = 1 << 21


def c(name: str):
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken, *bases: str) -> list[str]:
    """Names near the given ones that none of the taken columns has, whatever the case."""
    used, out = {x.lower() for x in taken}, []
    for base in bases:
        name, i = base, 0
        while name.lower() in used:
            i += 1
            name = f"{base}_{i}"
        used.add(name.lower())
        out.append(name)
    return out


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names. Where it names none, a temporary one, in local mode only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="textweir-checkpoint-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder, once, and read from there: lost executors cost nothing."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets no more rows of whole texts than this go to Python at once, where the session has Spark's default of 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def release_memory() -> None:
    """Gives memory that a worker no longer uses back to the system, as the worker stays for the tasks to come."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def normal_word(word: str) -> str:
    """The form in which words are compared: lower case, without signs at its ends; may be empty."""
    return word.lower().strip(EDGE)


def slices(text: pa.Array, chunk: int):
    """(place, slice) of consecutive slices of about chunk bytes, a row at least."""
    if len(text) == 0:
        return
    size = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), 1).astype(np.int64))
    start = 0
    while start < len(text):
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + chunk, side="right")))
        yield start, text.slice(start, end - start)
        start = end


def as_array(x) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def split_words(text: pa.Array, chunk: int = CHUNK):
    """Yields (first row, offsets, codes, words) for consecutive slices of a string column.

    Words are split at white space and brought to ``normal_word``; empty ones are left out.
    The words of the slice's row i are ``words[codes[offsets[i]:offsets[i + 1]]]``; ``words``, an Arrow array,
    holds each form once, and the empty one, which no code means, if it came up. A null text has no words.
    """
    for first, part in slices(text, chunk):
        lists = pc.utf8_split_whitespace(pc.fill_null(part, ""))
        flat = lists.flatten()
        encoded = pc.dictionary_encode(flat)
        forms = pc.dictionary_encode(pc.utf8_trim(pc.utf8_lower(encoded.dictionary), EDGE))
        codes = forms.indices.to_numpy(zero_copy_only=False)[encoded.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
        blank = pc.index(forms.dictionary, "").as_py()
        ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = ends - ends[0]
        if blank >= 0:
            keep = codes != blank
            seen = np.concatenate(([0], np.cumsum(keep)))
            ends, codes = seen[ends], codes[keep]
        yield first, ends, codes, forms.dictionary


def space_chunks(text: pa.Array, chunk: int = 2 * CHUNK, odd_rows: str = "  |^ | $"):
    """Yields (first row, offsets, codes, words, odd rows) for consecutive slices: texts cut at every single space.

    Row i reads ``" ".join(words[codes[offsets[i]:offsets[i + 1]]])``. Rows that the pattern odd_rows is found in (at
    least those with two spaces in a row, or one at an end) have no words but are in the dict of odd rows, whole. A
    null text, like an empty one, has no words.
    """
    for first, part in slices(text, chunk):
        part = pc.fill_null(part, "")
        odd = np.flatnonzero(pc.match_substring_regex(part, odd_rows).to_numpy(zero_copy_only=False))
        if len(odd):
            whole = dict(zip(odd.tolist(), part.take(pa.array(odd)).to_pylist()))
            plain = np.zeros(len(part), bool)
            plain[odd] = True
            part = pc.if_else(pa.array(plain), "", part)
        else:
            whole = {}
        lists = pc.split_pattern(part, " ")
        encoded = pc.dictionary_encode(lists.flatten())
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = ends - ends[0]
        blank = pc.index(encoded.dictionary, "").as_py()
        if blank >= 0:  # only an empty text has it
            keep = codes != blank
            ends, codes = np.concatenate(([0], np.cumsum(keep)))[ends], codes[keep]
        yield first, ends, codes, encoded.dictionary, whole


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray, ends: np.ndarray):
    """(values, offsets): for each row i the stretches of flat that codes[ends[i]:ends[i + 1]] name, joined."""
    many = sizes[codes]
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(many)))
    return flat[np.repeat(starts[codes] - at[:-1], many) + np.arange(at[-1])], at[ends]


def distinct_in_rows(ends: np.ndarray, codes: np.ndarray, n_words: int):
    """(row, code, count) of the distinct codes of each row, sorted by row and code."""
    rows = np.repeat(np.arange(len(ends) - 1, dtype=np.int64), np.diff(ends))
    key = rows * max(n_words, 1) + codes
    key.sort()
    if not len(key):
        z = np.empty(0, np.int64)
        return z, z, z
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.concatenate((cut, [len(key)])))
    key = key[cut]
    return key // max(n_words, 1), key % max(n_words, 1), count


def hash_words(words: pa.Array) -> np.ndarray:
    """Stable 64-bit hashes of an Arrow array of strings, from its buffers: a polynomial of the bytes, then scattered."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = words.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    ends = offsets - offsets[0]
    size = np.diff(ends)
    place = np.arange(len(raw)) - np.repeat(ends[:-1], size)
    power = np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * power[place], dtype=np.uint64)))
    return mix(total[ends[1:]] - total[ends[:-1]] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: scatters the bits of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def check_broadcast(n: int, most: int, what: str) -> None:
    """What goes to every executor has a stated bound."""
    if n > most:
        raise ValueError(f"{what}: {n} entries; at most {most} are broadcast")


def sized(df: DataFrame, most_rows: int = 2_000_000) -> DataFrame:
    """The table, stored, with a broadcast hint if it has most_rows at most; beyond, joins with it shuffle."""
    return F.broadcast(df) if df.count() <= most_rows else df
