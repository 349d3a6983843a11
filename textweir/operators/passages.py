"""Documents into overlapping passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core.columns import c, full_key
from ..core.pipe import Pipe
from ..functions.passages import Windows, check_windows


class GeneratePassages(Pipe):
    """A row for each window over a document's tokens; a narrow stage of built-in expressions.

    Reads ``field.input_ids``, ``field.attention_mask``, ``field.offset_mapping`` and ``field.text`` and, with a
    prepend_field, its input_ids and text. Writes these for the window, and its passage_idx (from 0) and passage_mask, 1
    for the tokens that it owns. Every window begins with the start tokens and then the prepended ones, which take
    part of the size. Special tokens have attention 1 and offsets [-1, -1], padding 0 and [-1, -1]. A window's text is the
    prepended text and the document's from its first to its last offset. global_keys (of the field) come along; those that
    aren't there are skipped. pad_token_id None: no padding. Documents with null or no ids give no rows.
    """

    _allows_update = False

    def __init__(self, *, size: int, stride: int, field: str = "document", prepend_field: str | None = None, start_tokens=None, end_tokens=None, pad_token_id: int | None = 0, global_keys=None, **kwargs):
        super().__init__(**kwargs)
        self.size, self.stride, self.field, self.prepend_field = size, stride, field, prepend_field
        self.start_tokens, self.end_tokens, self.pad_token_id = list(start_tokens or ()), list(end_tokens or ()), pad_token_id
        self.global_keys = list(global_keys or ())
        check_windows(size, stride, len(self.start_tokens) + len(self.end_tokens))

    def _apply(self, df, carry, **kwargs):
        names = [x for x in df.columns if x not in carry]
        f = lambda k: full_key(self.field, k)
        needed = [f(k) for k in ("input_ids", "attention_mask", "offset_mapping", "text")]
        needed += [full_key(self.prepend_field, k) for k in ("input_ids", "text")] if self.prepend_field else []
        if missing := [x for x in needed if x not in names]:
            raise KeyError(", ".join(missing))
        longs = lambda v: F.array(*map(F.lit, v)).cast("array<bigint>")
        ids = c(f("input_ids")).cast("array<bigint>")
        start, before = longs(self.start_tokens), F.lit("")
        if self.prepend_field:
            start = F.concat(start, F.coalesce(c(full_key(self.prepend_field, "input_ids")).cast("array<bigint>"), longs([])))
            before = F.coalesce(c(full_key(self.prepend_field, "text")), F.lit(""))
        # a column of its own, so that its size isn't worked out for each window again
        held = "__start__"
        df, start = df.withColumn(held, start), c(held)
        end, text = longs(self.end_tokens), c(f("text"))
        pad = self.pad_token_id if self.pad_token_id is not None else 0
        w = Windows(F.size(ids), self.size, self.stride, F.size(start), len(self.end_tokens), self.pad_token_id is not None)
        offsets = c(f("offset_mapping")).cast("array<array<bigint>>")
        nowhere = longs([-1, -1])
        around = lambda v, x: F.transform(x, lambda _: v)

        def window(i):
            own = F.filter(F.flatten(F.slice(offsets, i * w.step + 1, w.inside)), lambda x: x >= 0)
            first, last = F.array_min(own), F.array_max(own)
            # substring takes ints
            span = F.coalesce(text.substr((first + 1).cast("int"), (last - first).cast("int")), F.lit(""))
            return F.struct(
                i.cast("bigint").alias("passage_idx"),
                w.cut(ids, i, start, end, F.lit(pad).cast("bigint")).alias("input_ids"),
                w.cut(c(f("attention_mask")).cast("array<bigint>"), i, around(F.lit(1).cast("bigint"), start), around(F.lit(1).cast("bigint"), end), F.lit(0).cast("bigint")).alias("attention_mask"),
                w.cut(offsets, i, around(nowhere, start), around(nowhere, end), nowhere).alias("offset_mapping"),
                w.mask(i).alias("passage_mask"),
                F.concat(before, span).alias("text"),
            )

        kept = [f(k) for k in self.global_keys if f(k) in names]
        item = "__window__"
        rows = df.select(*map(c, carry), *map(c, kept), F.explode(F.transform(w.places(), window)).alias(item))
        made = ("input_ids", "attention_mask", "offset_mapping", "text", "passage_idx", "passage_mask")
        return rows.select(*map(c, carry), *(c(item)[k].alias(f(k)) for k in made), *map(c, kept))
