"""Token ids as Re-Pair grammars: frequent id pairs become nonterminals, shard by shard, with random access."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_array, c, fresh, gather, space_chunks, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's text is cut before pairs of bytes are merged; no piece holds a space that isn't its first sign.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space beside white space: where the vocabulary's pattern cuts there depends on what surrounds them.
_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ODD = f" {_BLANK}|{_BLANK} |^ | $"
#: A shard is closed once it has so many ids; only then does a worker forget them.
SHARD_IDS = 1_000_000
#: Occurrences that a pair needs to become a rule.
MIN_COUNT = 4
#: Ids and nonterminals of a shard, at most, so that a symbol takes two bytes; four where a shard has more ids.
SYMBOLS = 1 << 16
_CACHED = 400_000
STORE = "shard long, kind string, doc_id long, n_ids int, symbols binary, alphabet binary, rules binary, lengths binary"


@dataclass
class Grammar:
    """Symbols under len(alphabet) are ids, the others stand for the two symbols of their rule; lengths by symbol."""

    alphabet: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray

    @property
    def width(self) -> type:
        return np.uint16 if len(self.alphabet) + len(self.rules) <= 1 << 16 else np.uint32

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        base = len(self.alphabet)
        symbols = symbols.astype(np.int64)
        while len(symbols) and (big := symbols >= base).any():
            many = 1 + big
            out = np.repeat(symbols, many)
            first = (np.cumsum(many) - many)[big]
            pair = self.rules[symbols[big] - base]
            out[first], out[first + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return self.alphabet[symbols] if len(symbols) else np.empty(0, np.int32)

    def slice(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (excluded), as of a Python slice; only the symbols that cover them are expanded."""
        ends = np.cumsum(self.lengths[symbols.astype(np.int64)], dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        start, stop, _ = slice(start, stop).indices(total)
        if start >= stop:
            return np.empty(0, np.int32)
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left"))
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a : b + 1])[start - skipped : stop - skipped]


def _frequent(seq: np.ndarray, min_count: int, seed: int):
    """(positions, number of the pair there, pairs) of the pairs that begin at min_count positions at least.

    Pairs are counted by sorting and looked up in a table of hash values, where of several the most frequent has the
    place; the others get one in another round, under another hash. Numbers go from the most frequent down.
    """
    kind, half = seq.dtype.type, seq.dtype.itemsize * 4
    end = kind((1 << half) - 1)
    key = (seq[:-1] << kind(half)) | seq[1:]
    ordered = np.sort(key)
    cut = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]))
    count = np.diff(cut)
    good = np.flatnonzero(count >= min_count)
    pair, count = ordered[cut[good]], count[good]
    real = (pair >> kind(half) != end) & (pair & end != end)
    pair, count = pair[real], count[real]
    pair = pair[np.argsort(-count, kind="stable")]
    bits = max(10, int(np.log2(len(pair) + 1)) + 4)
    odd, shift = kind(seed & ((1 << 2 * half) - 1) | 1), kind(2 * half - min(bits, 2 * half - 1))
    place = ((pair * odd) >> shift)[::-1]
    holder, name = np.zeros(1 << bits, kind), np.full(1 << bits, -1, np.int32)
    holder[place], name[place] = pair[::-1], np.arange(len(pair), dtype=np.int32)[::-1]
    slot = (key * odd) >> shift
    at = np.flatnonzero(holder[slot] == key)
    number = name[slot[at]]
    if len(number) and number.min() < 0:  # the pair 0, 0 looks like an empty place
        at, number = at[number >= 0], number[number >= 0]
    return at, number, np.stack((pair >> kind(half), pair & end), axis=1).astype(np.int64)


def _disjoint(at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which of the occurrences are taken: of two that overlap the more frequent pair's, of a run of one pair every other."""
    left = np.concatenate(([False], at[1:] == at[:-1] + 1))
    right = np.concatenate((left[1:], [False]))
    before, after = np.concatenate(([0], number[:-1])), np.concatenate((number[1:], [0]))
    same = left & (before == number)
    start = np.flatnonzero(~same)
    turn = np.arange(len(at)) - np.repeat(start, np.diff(np.concatenate((start, [len(at)]))))
    ok = (~left | (before >= number)) & (~right | (after >= number))
    # a run is taken whole or not at all: its ends decide
    first, last = start, np.concatenate((start[1:], [len(at)])) - 1
    good = ok[first] & ok[last]
    take = np.repeat(good, last - first + 1) & (turn % 2 == 0)
    return take


def re_pair(documents: list[np.ndarray], min_count: int = MIN_COUNT, symbols: int = SYMBOLS, rounds: int = 64) -> tuple[Grammar, list[np.ndarray]]:
    """A grammar for sequences of ids, and each sequence as symbols of it; a pair never spans two sequences.

    A round replaces the frequent pairs all at once, the more frequent before those that overlap it. It ends when no
    pair has min_count occurrences that don't overlap, when a round saves under a thousandth, or with the
    last symbol. The same sequences give the same grammar.
    """
    lengths = np.array([len(x) for x in documents], np.int64)
    ids = np.concatenate([*documents, np.empty(0, np.int64)]).astype(np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 31):
        raise ValueError("ids are from 0 to 2^31 - 1")
    top = int(ids.max()) + 1 if len(ids) else 0
    if top <= 1 << 22:
        seen = np.zeros(top, bool)
        seen[ids] = True
        alphabet = np.flatnonzero(seen)
        place = (np.cumsum(seen) - 1).astype(np.int32)
        codes = place[ids]
    else:
        alphabet, codes = np.unique(ids, return_inverse=True)
        codes = codes.astype(np.int32)
    base, rules, sizes = len(alphabet), [], [np.ones(len(alphabet), np.int64)]
    made, most = 0, (symbols if base <= symbols * 3 // 4 else 1 << 24) - base
    # a separator behind every sequence, the greatest number of its type; no symbol has it
    kind = np.uint32 if base + most <= 1 << 16 else np.uint64
    end = kind((1 << (kind().itemsize * 4)) - 1)
    most = min(most, int(end) - base)
    seq = np.full(len(codes) + len(documents), end, kind)
    seq[np.arange(len(codes)) + np.repeat(np.arange(len(documents)), lengths)] = codes
    for r in range(rounds):
        if len(seq) < 2 or made >= most:
            break
        seed = (0x9E3779B97F4A7C15 * (2 * r + 1)) % 2**64 | 1
        at, number, pairs = _frequent(seq, min_count, seed)
        if not len(at):
            break
        taken = _disjoint(at, number)
        at, number = at[taken], number[taken]
        count = np.bincount(number, minlength=len(pairs))
        good = np.flatnonzero(count >= min_count)
        good = np.sort(good[np.argsort(-count[good], kind="stable")[: most - made]])
        if not len(good):
            break
        name = np.full(len(pairs), -1, np.int64)
        name[good] = np.arange(len(good)) + base + made
        at, fresh_name = at[name[number] >= 0], name[number]
        fresh_name = fresh_name[fresh_name >= 0]
        known = np.concatenate(sizes)
        rules.append(pairs[good])
        sizes.append(known[pairs[good, 0]] + known[pairs[good, 1]])
        made += len(good)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq[at] = fresh_name
        before, seq = len(seq), seq[stay]
        if before - len(seq) < before // 1000:
            break
    grammar = Grammar(alphabet.astype(np.int32), np.concatenate([*rules, np.empty((0, 2), np.int64)]).astype(np.int64), np.concatenate(sizes))
    cut = np.flatnonzero(seq == end)
    starts = np.concatenate(([0], cut[:-1] + 1)) if len(cut) else cut
    return grammar, [seq[a:b].astype(grammar.width) for a, b in zip(starts.tolist(), cut.tolist())]


def _grammar_row(shard: int, g: Grammar) -> tuple:
    return shard, "grammar", None, None, None, g.alphabet.astype("<i4").tobytes(), g.rules.astype(g.width).tobytes(), g.lengths.astype("<u4").tobytes()


def read_grammar(alphabet: bytes, rules: bytes, lengths: bytes) -> Grammar:
    ids, size = np.frombuffer(alphabet, "<i4"), np.frombuffer(lengths, "<u4").astype(np.int64)
    return Grammar(ids, np.frombuffer(rules, np.uint16 if len(size) <= 1 << 16 else np.uint32).reshape(-1, 2).astype(np.int64), size)


def _store(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in STORE.split(", ")])


def compress(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", shard_ids: int = SHARD_IDS, min_count: int = MIN_COUNT, symbols: int = SYMBOLS) -> DataFrame:
    """The table of STORE: a row "document" for each row and a row "grammar" for each shard; one narrow stage.

    A shard is a stretch of a partition with about shard_ids ids: nothing is shuffled and a worker holds one shard.
    Symbols, rules (pairs) and lengths are little-endian, 2 bytes a symbol up to 65536 of them, else 4. Which rows
    make a shard depends on how the table is split; what decoding gives doesn't.

    A null list, and one with a null or a number outside 0 to 2^31 - 1, is kept as a row without ids (null n_ids
    and symbols). An empty list has no symbols. Null and repeated doc_ids are kept. An empty table gives no rows.
    """
    rows = df.select(c(id_col).cast("long").alias("doc_id"), c(ids_col).cast("array<long>").alias("ids"))
    rows = rows.withColumn("ids", F.when(F.coalesce(F.forall("ids", lambda x: x.isNotNull() & x.between(0, 2**31 - 1)), F.lit(False)), F.col("ids")))

    def run(batches):
        def lists():
            for batch in batches:
                ids = as_array(batch.column(1))
                offsets, values = ids.offsets.to_numpy(zero_copy_only=False), ids.values.to_numpy(zero_copy_only=False)
                valid = ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.column(0).to_pylist(), valid, values, offsets

        yield from _shards(lists(), shard_ids, min_count, symbols)

    return rows.mapInArrow(run, STORE)


def _shards(lists, shard_ids: int, min_count: int, symbols: int):
    task, held, size, number = TaskContext.get(), [], 0, 0
    part = task.partitionId() if task else 0

    def close():
        shard = (part << 32) + number
        grammar, coded = re_pair([x for _, x in held if x is not None], min_count, symbols)
        coded = iter(coded)
        rows = [_grammar_row(shard, grammar)]
        for i, x in held:
            rows.append((shard, "document", i, None if x is None else len(x), None if x is None else next(coded).tobytes(), None, None, None))
        return _store(rows)

    for ids, valid, values, offsets in lists:
        for k, i in enumerate(ids):
            x = values[offsets[k] : offsets[k + 1]] if valid[k] else None
            held.append((i, None if x is None else x.astype(np.int32)))
            size += 1 + (0 if x is None else len(x))
            if size >= shard_ids:
                yield close()
                held, size, number = [], 0, number + 1
    if held:
        yield close()


def decompress(store: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """(doc_id, ids) of the documents in a store; with start or stop that stretch of each, expanded on its own.

    A shard's rows meet its grammar; nothing else is moved. A document without ids gives null.
    """

    def run(group: pa.Table) -> pa.Table:
        kinds = group["kind"].to_pylist()
        at = kinds.index("grammar")
        g = read_grammar(*(group[x][at].as_py() for x in ("alphabet", "rules", "lengths")))
        own = [k for k, x in enumerate(kinds) if x == "document"]
        ids = []
        for k in own:
            raw = group["symbols"][k].as_py()
            symbols = None if raw is None else np.frombuffer(raw, g.width)
            ids.append(None if raw is None else g.expand(symbols) if start is None and stop is None else g.slice(symbols, start, stop))
        return pa.table({"doc_id": group["doc_id"].take(pa.array(own, pa.int64())), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return store.groupBy("shard").applyInArrow(run, "doc_id long, ids array<int>")


def load_encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _encoder(path: str, pattern: str, encoders: dict = {}):  # noqa: B006
    """A worker reads a file once."""
    if (path, pattern) not in encoders:
        encoders[path, pattern] = load_encoder(path, pattern)
    return encoders[path, pattern]


def encode_words(encoder, words: list[str], begins: np.ndarray) -> list[bytes]:
    """Ids, as bytes of int32, of words without spaces that follow one; begins: whether an id's bytes begin with a space.

    They are encoded as one text, in which just the ids at the words' beginnings begin with a space.
    """
    if not words:
        return []
    ids = np.array(encoder.encode_ordinary(" " + " ".join(words)), np.int32)
    at = np.flatnonzero(begins[ids])
    if len(at) != len(words):
        raise ValueError("the vocabulary joins words: give another pattern")
    raw = ids.tobytes()
    cut = [*(at * 4).tolist(), len(raw)]
    return [raw[b:e] for b, e in zip(cut, cut[1:])]


def space_ids(encoder) -> np.ndarray:
    """By id, whether its bytes begin with a space."""
    return np.array([encoder.decode_single_token_bytes(k)[:1] == b" " for k in range(encoder.n_vocab)])


def encoder_begins(encoder, held: dict = {}) -> np.ndarray:  # noqa: B006
    if id(encoder) not in held:
        held[id(encoder)] = encoder, space_ids(encoder)
    return held[id(encoder)][1]


def token_lists(encoder, text: pa.Array, cache: dict[str, bytes]):
    """Yields (first row, ids, offsets) for slices of a text column; as the encoder has it, each word form once.

    With PATTERN a single space begins a new piece and is its first sign, so words can be encoded one by one; texts
    with white space beside a space are encoded whole.
    """
    begins = encoder_begins(encoder)
    for first, ends, codes, words, odd in space_chunks(text, odd_rows=ODD):
        plain = words.to_pylist()
        parts = list(map(cache.get, plain))
        new = [k for k, p in enumerate(parts) if p is None]
        if len(cache) + len(new) > _CACHED:
            cache.clear()
        for k, p in zip(new, encode_words(encoder, [plain[k] for k in new], begins)):
            parts[k] = cache[plain[k]] = p
        # the first word of a text has no space before it
        lead = ends[:-1][np.diff(ends) > 0]
        some, which = np.unique(codes[lead], return_inverse=True)
        codes[lead] = len(parts) + which
        parts += [np.array(encoder.encode_ordinary(plain[k]), np.int32).tobytes() for k in some.tolist()]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        values, offsets = gather(np.frombuffer(b"".join(parts), np.int32), np.cumsum(size) - size, size, codes, ends)
        if odd:
            whole = {k: np.array(encoder.encode_ordinary(x), np.int32) for k, x in odd.items()}
            own = [whole.get(k, values[offsets[k] : offsets[k + 1]]) for k in range(len(ends) - 1)]
            values, offsets = np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))
        yield first, values, offsets


def tokenize(df: DataFrame, text_col: str = "text", out_col: str = "ids", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Adds each text's ids (array<int>, null for a null text); one narrow stage. A clashing name gets a number."""
    caches: dict[int, dict] = {}

    @F.arrow_udf("array<int>")
    def run(text: pa.Array) -> pa.Array:
        text = as_array(text)
        lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v)) for _, v, o in token_lists(_encoder(vocabulary, pattern), text, caches.setdefault(0, {}))]
        out = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))
        return pa.ListArray.from_arrays(out.offsets, out.values, mask=text.is_null()) if text.null_count else out

    (out,) = fresh(df.columns, out_col)
    return df.withColumn(out, run(c(text_col)))


def compress_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, shard_ids: int = SHARD_IDS, min_count: int = MIN_COUNT, symbols: int = SYMBOLS) -> DataFrame:
    """compress(tokenize(df)) in one pass, without the ids ever leaving the worker; a null text has no ids."""
    rows = df.select(c(id_col).cast("long").alias("doc_id"), c(text_col).alias("text"))

    def run(batches):
        encoder, cache = _encoder(vocabulary, pattern), {}

        def lists():
            for batch in batches:
                text = as_array(batch.column(1))
                ids, valid = batch.column(0).to_pylist(), text.is_valid().to_numpy(zero_copy_only=False)
                for first, values, offsets in token_lists(encoder, text, cache):
                    own = slice(first, first + len(offsets) - 1)
                    yield ids[own], valid[own], values, offsets

        yield from _shards(lists(), shard_ids, min_count, symbols)

    return rows.mapInArrow(run, STORE)


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as symbols of its shard's grammar, and the grammars."""
    return compress_texts(table(spark, sf_dir, "documents"))
