"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi in one pass."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK, as_array, c, fresh, gather, space_chunks, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Below the least score of a piece, for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Longer words are gone through one by one, the others side by side.
SIDE_BY_SIDE = 48
_CACHED = 200_000
#: Ids that are decoded at once, about; bounds a worker's memory, not what is read.
_AT_ONCE = 1 << 18


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Automaton:
    """Aho-Corasick over strings. Arrays by node: fail, link (the next node on the failure path that ends a string,
    0 for none), size (characters of the string that ends here, 0 for none), which (its number). Edges lie in a hash table."""

    def __init__(self, strings: list[str]):
        children: list[dict[int, int]] = [{}]
        size, which = [0], [-1]
        for k, text in enumerate(strings):
            node = 0
            for x in _codes(text).tolist():
                if (to := children[node].get(x)) is None:
                    to = children[node][x] = len(children)
                    children.append({})
                    size.append(0)
                    which.append(-1)
                node = to
            if node and not size[node]:
                size[node], which[node] = len(text), k
        fail, link, order = [0] * len(children), [0] * len(children), [0]
        for node in order:
            for x, to in children[node].items():
                order.append(to)
                if node:
                    at = fail[node]
                    while at and x not in children[at]:
                        at = fail[at]
                    fail[to] = children[at].get(x, 0)
                link[to] = fail[to] if size[fail[to]] else link[fail[to]]
        self.children = children
        self.fail, self.link, self.size, self.which = (np.array(x, np.int32) for x in (fail, link, size, which))
        keys = np.array([(node << 21) | x for node, own in enumerate(children) for x in own], np.int64)
        values = np.array([to for own in children for to in own.values()], np.int32)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 3 + 1))))
        self.slots, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.slots[at[todo]] < 0
            self.slots[at[todo[free]]] = keys[todo[free]]
            placed = self.slots[at[todo]] == keys[todo]
            self.values[at[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def edges(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children, 0 where there is none."""
        keys = (nodes.astype(np.int64) << 21) | codes
        at = self._slot(keys)
        seen = self.slots[at]
        out = np.where(seen == keys, self.values[at], 0)
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.slots[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after one more character each, along failure links where there is no edge."""
        out = self.edges(nodes, codes)
        todo = np.flatnonzero((out == 0) & (nodes > 0))
        at = nodes
        while len(todo):
            at = self.fail[at[todo]] if at is nodes else at
            found = self.edges(at, codes[todo])
            out[todo] = found
            on = (found == 0) & (at > 0)
            todo, at = todo[on], self.fail[at[on]]
        return out


@dataclass
class PieceModel:
    """Pieces by id, with log-probabilities; NaN for those that encoding doesn't use (unknown, control, byte pieces)."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: list[int] | None
    unknown_id: int
    control: frozenset[int] = frozenset()
    automaton: Automaton | None = field(default=None, repr=False)

    def __post_init__(self):
        self.scores = np.asarray(self.scores, np.float64)
        usable = [k for k in np.flatnonzero(~np.isnan(self.scores)) if self.pieces[k]]
        self.automaton = Automaton([self.pieces[k] for k in usable])
        a = self.automaton
        ids = np.array(usable or [0], np.int64)
        self.node_id = np.where(a.which >= 0, ids[np.maximum(a.which, 0)], -1)
        self.node_score = np.where(a.which >= 0, self.scores[np.maximum(self.node_id, 0)], -np.inf)
        self.unknown = float(self.scores[usable].min() if usable else 0.0) - UNKNOWN_PENALTY
        #: No piece goes on behind a space, so words can be encoded one by one.
        self.by_word = not any(SPACE in self.pieces[k].lstrip(SPACE) for k in usable)
        of = [bytes([self.byte_ids.index(k)]) if self.byte_ids and k in set(self.byte_ids) else b"" if k in self.control else " ⁇ ".encode() if k == self.unknown_id else p.replace(SPACE, " ").encode() for k, p in enumerate(self.pieces)]
        self.raw, self.raw_size = np.frombuffer(b"".join(of), np.uint8), np.array([len(x) for x in of], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[x] for x in char.encode("utf-8", "replace")] if self.byte_ids else [self.unknown_id]


def load_pieces(path: str = MODEL) -> PieceModel:
    """The model in a SentencePiece file. A unigram model's scores are used as they are.

    A BPE model has ranks for scores, which can't be added up: its piece of rank r gets the logarithm of its share by Zipf's law instead.
    """
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    n = s.get_piece_size()
    pieces, scores = [s.id_to_piece(k) for k in range(n)], np.array([s.get_score(k) for k in range(n)])
    usable = np.array([not (s.is_control(k) or s.is_unknown(k) or s.is_byte(k) or s.is_unused(k)) for k in range(n)])
    if (scores[usable] < -100).mean() > 0.5:  # log-probabilities don't get so low
        order = np.lexsort((np.arange(n), -scores))
        order = order[usable[order]]
        rank = np.arange(1, len(order) + 1)
        scores[order] = -np.log(rank) - np.log((1 / rank).sum())
    scores[~usable] = np.nan
    found = {k: int(pieces[k][3:-1], 16) for k in range(n) if s.is_byte(k)}
    bytes_of = [k for k, _ in sorted(found.items(), key=lambda x: x[1])] if len(found) == 256 else None
    return PieceModel(pieces, scores, bytes_of, s.unk_id(), frozenset(k for k in range(n) if s.is_control(k)))


def encode_one(model: PieceModel, text: str) -> list[int]:
    """Ids of a string with spaces escaped; of equally good ways, that whose last pieces are longer."""
    a = model.automaton
    children, fail, link, size, score = a.children, a.fail, a.link, a.size, model.node_score
    codes = _codes(text).tolist()
    best, last, node = [0.0] + [0.0] * len(codes), [0] * (len(codes) + 1), 0
    for t, x in enumerate(codes, 1):
        while node and x not in children[node]:
            node = int(fail[node])
        node = children[node].get(x, 0)
        top, by = best[t - 1] + model.unknown, 0
        at, first = (node if size[node] else int(link[node])), True
        while at:
            v = best[t - size[at]] + score[at]
            if v > top or (first and v == top):
                top, by = v, at
            at, first = int(link[at]), False
        best[t], last[t] = top, by
    out: list[list[int]] = []
    t = len(codes)
    while t:
        by = last[t]
        out.append([int(model.node_id[by])] if by else model.fallback(text[t - 1]))
        t -= int(size[by]) if by else 1
    return [k for part in reversed(out) for k in part]


def encode_many(model: PieceModel, words: list[str]) -> list[bytes]:
    """Ids of each word as bytes of int32; the words go through the automaton side by side, a character at a time."""
    a, out = model.automaton, [b""] * len(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    for k in np.flatnonzero(length > SIDE_BY_SIDE):
        out[k] = np.array(encode_one(model, words[k]), np.int32).tobytes()
    short = np.flatnonzero(length <= SIDE_BY_SIDE)
    short = short[np.argsort(-length[short], kind="stable")]
    size = length[short]
    if not len(short) or not size[0]:
        return out
    codes = _codes("".join([words[k] for k in short]))
    begin = np.cumsum(size) - size  # of codes; best and last have a place more for each word
    place = begin + np.arange(len(short))
    best, last = np.zeros(len(codes) + len(short)), np.zeros(len(codes) + len(short), np.int32)
    node = np.zeros(len(short), np.int32)
    for t in range(1, int(size[0]) + 1):
        n = int(np.searchsorted(-size, -t, side="right"))  # words that long
        here = place[:n] + t
        node = a.step(node[:n], codes[begin[:n] + t - 1])
        top, by = best[here - 1] + model.unknown, np.zeros(n, np.int32)
        at = np.where(a.size[node] > 0, node, a.link[node])
        rows = np.flatnonzero(at)
        at, first = at[rows], True
        while len(rows):
            v = best[here[rows] - a.size[at]] + model.node_score[at]
            more = v >= top[rows] if first else v > top[rows]
            top[rows[more]], by[rows[more]] = v[more], at[more]
            at, first = a.link[at], False
            on = at > 0
            rows, at = rows[on], at[on]
        best[here], last[here] = top, by
    # back from the ends, side by side
    rows, t, found = np.arange(len(short)), size.copy(), []
    while len(rows):
        rows = rows[t[rows] > 0]
        by = last[place[rows] + t[rows]]
        found.append((rows, t[rows], by))
        t[rows] -= np.where(by > 0, a.size[by], 1)
    row, end, by = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((end, row))
    row, end, by = row[order], end[order], by[order]
    ids = model.node_id[by].astype(np.int32)
    lost = np.flatnonzero(by == 0)
    if len(lost):
        parts = [model.fallback(chr(x)) for x in codes[begin[row[lost]] + end[lost] - 1].tolist()]
        many = np.ones(len(ids), np.int64)
        many[lost] = [len(p) for p in parts]
        spread = np.repeat(ids, many)
        first = (np.cumsum(many) - many)[lost]
        for at, p in zip(first.tolist(), parts):
            spread[at : at + len(p)] = p
        row, ids = np.repeat(row, many), spread
    cut = np.searchsorted(row, np.arange(len(short) + 1)) * 4
    raw = ids.tobytes()
    for k, b, e in zip(short.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
        out[k] = raw[b:e]
    return out


def encode_texts(model: PieceModel, text: pa.Array, cache: dict[str, bytes] | None = None) -> pa.Array:
    """Lists of ids. Spaces are escaped and one is put before the text; a null text is null, an empty one has no ids."""
    cache = {} if cache is None else cache
    lists = []
    for start, ends, codes, words, odd in space_chunks(text, CHUNK):
        # rows whose spaces don't stand alone are split by hand
        extra = {}
        for k, x in odd.items():
            escaped = SPACE + x.replace(" ", SPACE)
            extra[k] = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", escaped) if model.by_word else [escaped]
        plain = words.to_pylist()
        if not model.by_word:
            extra = {k: [SPACE + x.replace(" ", SPACE)] if x else [] for k, x in enumerate(text.slice(start, len(ends) - 1).to_pylist())}
            plain, codes, ends = [], codes[:0], np.zeros_like(ends)
        parts = list(map(cache.get, plain))
        new = [k for k, p in enumerate(parts) if p is None]
        if len(cache) + len(new) > _CACHED:
            cache.clear()
        for k, p in zip(new, encode_many(model, [SPACE + plain[k] for k in new])):
            parts[k] = cache[plain[k]] = p
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), np.int32)
        values, offsets = gather(flat, np.cumsum(size) - size, size, codes, ends)
        if extra:
            forms = list(dict.fromkeys(w for x in extra.values() for w in x))
            found = dict(zip(forms, encode_many(model, forms)))
            rows = {k: np.frombuffer(b"".join(found[w] for w in x), np.int32) for k, x in extra.items()}
            own = [rows.get(k, values[offsets[k] : offsets[k + 1]]) for k in range(len(ends) - 1)]
            values = np.concatenate(own) if own else values
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in own])))
        lists.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)))
    out = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))
    if text.null_count:
        out = pa.ListArray.from_arrays(out.offsets, out.values, mask=text.is_null())
    return out


def decode_ids(model: PieceModel, ids: pa.Array) -> pa.Array:
    """Texts: the pieces' strings and the byte pieces' bytes one after another, a leading space gone.

    A null list is null, as is one with an id that the model doesn't have, or a null one; control pieces are
    empty, bytes that aren't UTF-8 become U+FFFD.
    """
    ends = ids.offsets.to_numpy(zero_copy_only=False)
    out, start = [], 0
    while start < len(ids):  # so many at once that what is gathered stays small
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + _AT_ONCE, side="right")) - 1)
        out.append(_decode_slice(model, ids.slice(start, stop - start)))
        start = stop
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def _decode_slice(model: PieceModel, ids: pa.Array) -> pa.Array:
    offsets = ids.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = ids.values.slice(offsets[0], offsets[-1] - offsets[0])
    known = values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    wrong = (known < 0) | (known >= len(model.pieces))
    bad = np.zeros(len(ids), bool)
    bad[np.searchsorted(offsets, np.flatnonzero(wrong), side="right") - 1] = True
    raw, ends = gather(model.raw, model.raw_start, model.raw_size, np.where(wrong, 0, known), offsets)
    starts = ends[:-1].copy()
    full = ends[1:] > starts
    starts[full] += raw[starts[full]] == 32
    data = raw.tobytes()
    texts = [data[b:e].decode("utf-8", "replace") for b, e in zip(starts.tolist(), ends[1:].tolist())]
    return pa.array(texts, pa.string(), mask=bad | ids.is_null().to_numpy(zero_copy_only=False))


def _model(path: str, models: dict = {}) -> PieceModel:  # noqa: B006
    """A worker reads a file once."""
    if path not in models:
        models[path] = load_pieces(path)
    return models[path]


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", model: str = MODEL) -> DataFrame:
    """Adds the ids of each row's whole text; one narrow stage. The model's file lies at the same path on every machine.

    The best way to cut the text into pieces by the sum of their scores, a character without a piece becoming its
    UTF-8 bytes. Words, spaces escaped, are encoded one by one if no piece goes past a space, each form once; that changes no result.
    A null text gives null, an empty one an empty list. Rows stay; a clashing name gets a number.
    """
    caches: dict[int, dict] = {}

    @F.arrow_udf("array<int>")
    def run(text: pa.Array) -> pa.Array:
        return encode_texts(_model(model), as_array(text), caches.setdefault(0, {}))

    (out,) = fresh(df.columns, out_col)
    return df.withColumn(out, run(c(text_col)))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """Adds the text of each row's ids, as decode_ids has it. Rows stay; a clashing name gets a number."""

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        return decode_ids(_model(model), as_array(ids))

    (out,) = fresh(df.columns, out_col)
    return df.withColumn(out, run(c(ids_col).cast("array<int>")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, how many, and whether decoding them gives the text again."""
    docs = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")), out_col="decoded")
    return docs.select("doc_id", F.size("ids").alias("n_ids"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))
