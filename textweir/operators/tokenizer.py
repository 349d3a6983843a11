"""Tokenizing text columns."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..core.columns import c, full_key
from ..core.condition import In
from ..core.pipe import Pipe

#: Bytes of text, and rows, that are tokenized at once.
CHUNK, ROWS = 1 << 18, 1000


class RegexTokenizer:
    """Words as a pattern finds them, with ids from a vocabulary or, without one, from a hash of the word."""

    def __init__(self, pattern: str = r"\w+|[^\w\s]", vocabulary: dict[str, int] | None = None, size: int = 1 << 20, specials: tuple[list[int], list[int]] = ((), ()), pad_token_id: int = 0):
        self.pattern, self.vocabulary, self.size, self.specials, self.pad_token_id = pattern, vocabulary, size, specials, pad_token_id

    def id_of(self, word: str) -> int:
        return self.vocabulary.get(word, 1) if self.vocabulary is not None else 2 + zlib.crc32(word.encode()) % (self.size - 2)

    def __call__(self, texts: list[str], add_special_tokens: bool = True, max_length: int | None = None) -> dict[str, list]:
        before, behind = self.specials if add_special_tokens else ((), ())
        ids, offsets = [], []
        for text in texts:
            found = [(m.group(), m.span()) for m in re.finditer(self.pattern, text)]
            if max_length is not None:
                found = found[: max(max_length - len(before) - len(behind), 0)]
            ids.append([*before, *(self.id_of(w) for w, _ in found), *behind])
            offsets.append([*((0, 0) for _ in before), *(s for _, s in found), *((0, 0) for _ in behind)])
        return {"input_ids": ids, "attention_mask": [[1] * len(x) for x in ids], "token_type_ids": [[0] * len(x) for x in ids], "offset_mapping": offsets}


def from_file(path: str) -> Callable:
    """A tokenizer of the tokenizers library, read once by each worker from a file that all machines have."""

    def run(texts, add_special_tokens=True, max_length=None, held={}):  # noqa: B006
        if path not in held:
            from tokenizers import Tokenizer

            held[path] = Tokenizer.from_file(path)
        t = held[path]
        t.no_padding()
        t.enable_truncation(max_length) if max_length is not None else t.no_truncation()
        found = t.encode_batch(list(texts), add_special_tokens=add_special_tokens)
        return {"input_ids": [x.ids for x in found], "attention_mask": [x.attention_mask for x in found], "token_type_ids": [x.type_ids for x in found], "offset_mapping": [x.offsets for x in found]}

    return run


def slices(text: pa.Array, size: int = CHUNK) -> Iterator[pa.Array]:
    """Consecutive rows with so many bytes of text at most, or one row."""
    n = pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, i = np.cumsum(n), 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + size, "right")))
        j = min(j, i + ROWS)
        yield text.slice(i, j - i)
        i = j


class TokenizerPipe(Pipe):
    """``field.key`` into ``field.input_ids``, attention_mask and, if asked for, token_type_ids and offset_mapping.

    The tokenizer is a function of texts, add_special_tokens and max_length that gives lists by these names; it runs on
    Arrow batches, some rows at a time: tokens are many times larger than their text. Texts are cut at max_length where it is given. A null text gives nulls, an empty one what the tokenizer gives.
    """

    _allows_input_filter = False

    def __init__(self, tokenizer: Callable, *, key: str = "text", field: str | None = None, max_length: int | None = None, return_token_type_ids: bool = False, return_offsets_mapping: bool = False, add_special_tokens: bool = True, **kwargs):
        super().__init__(**kwargs)
        self.tokenizer, self.key, self.field, self.max_length, self.add_special_tokens = tokenizer, key, field, max_length, add_special_tokens
        self.input_filter = In([full_key(field, key)])
        self.outputs = ["input_ids", "attention_mask", *["token_type_ids"] * return_token_type_ids, *["offset_mapping"] * return_offsets_mapping]

    def _apply(self, df, carry, **kwargs):
        tokenizer, outputs, special, most = self.tokenizer, self.outputs, self.add_special_tokens, self.max_length
        kinds = {k: "array<array<bigint>>" if k == "offset_mapping" else "array<bigint>" for k in outputs}
        arrow = {k: pa.list_(pa.list_(pa.int64())) if k == "offset_mapping" else pa.list_(pa.int64()) for k in outputs}

        @F.arrow_udf(f"struct<{', '.join(f'{k}: {v}' for k, v in kinds.items())}>")
        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for text in parts:
                for part in slices(text):
                    got = tokenizer(part.fill_null("").to_pylist(), add_special_tokens=special, max_length=most)
                    empty = part.is_null().to_pylist()
                    yield pa.StructArray.from_arrays([pa.array([None if e else [list(v) if isinstance(v, tuple) else v for v in x] for x, e in zip(got[k], empty)], arrow[k]) for k in outputs], outputs)

        item = "__tokens__"
        made = df.select(*map(c, carry), run(c(full_key(self.field, self.key))).alias(item))
        return made.select(*map(c, carry), *(c(item)[k].alias(full_key(self.field, k)) for k in outputs))
