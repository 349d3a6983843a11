"""Rows into batches of equal shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.columns import array_depth, c, hidden, type_of
from ..core.condition import Condition, Contains, HasKeyWithPrefix, HasPrefix, In, Not, Reduce
from ..core.pipe import Pipe, batch_size
from ..functions.arrays import pad_to_length
from .basics import AddPrefix, Identity, ReplaceInKeys
from .nesting import ApplyAsFlatten
from .pipelines import Gate, Parallel, Sequential


class Collate(Pipe):
    """Rows as columns: of a table the columns that are asked for, of a list of dicts the keys of the first."""

    def __init__(self, keys: list[str] | Condition | None = None, **kwargs):
        super().__init__(**kwargs)
        self.keys = In(keys) if isinstance(keys, (list, tuple, set)) else keys

    def _exprs(self, cols, kinds, **kwargs):
        return {x: v for x, v in cols.items() if self.keys is None or self.keys(x)}

    def _rows(self, rows, **kwargs):
        seen = [k for k in rows[0] if (self.keys is None or self.keys(k)) and (self.input_filter is None or self.input_filter(k))] if rows else []
        return {k: [r[k] for r in rows] for k in seen}


class DeCollate(Pipe):
    """Columns as rows: a dict of columns becomes a list of dicts; a table has rows as it is."""

    _allows_update = False

    def _exprs(self, cols, kinds, **kwargs):
        return dict(cols)

    def _local(self, batch, **kwargs):
        n = batch_size(batch)
        return [{k: v[i] for k, v in batch.items() if v is not None} for i in range(n)]


class ToTensor(Pipe):
    """Columns as arrays of one number type, all of the same length; a row of another length than the first fails.

    Strings and other columns that aren't numbers stay as they are.
    """

    def __init__(self, element: str = "float", lengths: dict[str, int] | None = None, **kwargs):
        super().__init__(**kwargs)
        self.element, self.lengths = element, dict(lengths or {})

    def _apply(self, df, carry, **kwargs):
        names = [x for x in df.columns if x not in carry]
        vectors = [x for x in names if array_depth(type_of(df, x)) == 1 and type_of(df, x).elementType.typeName() in ("byte", "short", "integer", "long", "float", "double", "boolean")]
        if not vectors:
            return df
        ends, widths = hidden(len(vectors)), {}
        known = {x: F.lit(self.lengths[x]) for x in vectors if x in self.lengths}
        rest = [x for x in vectors if x not in known]
        if rest:
            most = df.agg(*(F.max(F.size(c(x))).alias(e) for x, e in zip(rest, ends)))
            df = df.crossJoin(F.broadcast(most))
            widths = {x: c(e) for x, e in zip(rest, ends)}
        widths |= known

        def checked(x):
            bad = F.raise_error(F.lit(f"arrays of different lengths in {x}"))
            return F.when(c(x).isNull() | (F.size(c(x)) == widths[x]), c(x)).otherwise(bad).cast(f"array<{self.element}>")

        return df.select(*map(c, carry), *((checked(x) if x in vectors else c(x)).alias(x) for x in names))


class Padding(Pipe):
    """input_ids, attention_mask and token_type_ids padded at the right to the longest input_ids of the table.

    The longest is found in a pass of its own, unless length is given; its one row is broadcast. The tokenizer gives
    pad_token_id (an attribute, else 0). special_padding_tokens fill other columns, such as passage_mask, to the same
    length. Columns that aren't there don't matter, null arrays stay null.
    """

    def __init__(self, tokenizer=None, special_padding_tokens: dict | None = None, length: int | None = None, **kwargs):
        super().__init__(**kwargs)
        self.pad_token_id = getattr(tokenizer, "pad_token_id", 0) or 0
        self.special_padding_tokens, self.length = dict(special_padding_tokens or {}), length

    def _apply(self, df, carry, **kwargs):
        names = [x for x in df.columns if x not in carry]
        fills = {"input_ids": self.pad_token_id, "attention_mask": 0, "token_type_ids": 0} | self.special_padding_tokens
        fills = {x: v for x, v in fills.items() if x in names}
        if not fills:
            return df
        if self.length is not None:
            n = F.lit(self.length)
        else:
            (most,) = hidden()
            ref = "input_ids" if "input_ids" in fills else next(iter(fills))
            df = df.crossJoin(F.broadcast(df.agg(F.coalesce(F.max(F.size(c(ref))), F.lit(0)).alias(most))))
            n = c(most)

        def padded(x):
            element = type_of(df, x).elementType
            fill = fills[x]
            value = F.array(*map(F.lit, fill)) if isinstance(fill, (list, tuple)) else F.lit(fill)
            return pad_to_length(c(x), n, value.cast(element))

        return df.select(*map(c, carry), *((padded(x) if x in fills else c(x)).alias(x) for x in names))


class CollateField(Gate):
    """The columns ``field.*`` collated: chosen, freed of the prefix, made tensors, padded, and given the prefix again.

    exclude: parts of names whose columns are left out; include_only: keys that alone are taken. to_tensor: keys
    that become tensors. With a tokenizer its columns are padded. nesting_level: how many arrays around the tokens. A
    table without the field gives no columns.
    """

    def __init__(self, field: str, *, tokenizer=None, exclude=None, include_only=None, to_tensor=None, nesting_level: int = 0, special_padding_tokens: dict | None = None, length: int | None = None, **kwargs):
        prefix = f"{field}."
        chosen: list[Condition] = [HasPrefix(prefix)]
        if include_only is not None:
            chosen.append(In([prefix + x for x in include_only]))
        chosen += [Not(Contains(x)) for x in exclude or ()]
        steps = []
        if to_tensor:
            steps.append(ToTensor(input_filter=In(to_tensor)))
        if tokenizer is not None:
            pad = Padding(tokenizer, special_padding_tokens, length)
            keys = ["input_ids", "attention_mask", "token_type_ids", *(special_padding_tokens or ())]
            pad.input_filter = In(keys)
            steps.append(ApplyAsFlatten(pad, level=nesting_level, input_filter=In(keys)) if nesting_level else pad)
        body = Sequential(Identity(), *(Parallel(x, update=True) for x in steps))
        super().__init__(HasKeyWithPrefix(prefix), Sequential(Collate(Reduce(*chosen)), ReplaceInKeys(prefix, ""), body, AddPrefix(prefix)), **kwargs)
        self.field = field

    def _rows(self, rows, **kwargs):
        return self._local(Collate()._rows(rows), **kwargs)


def batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """Rows in groups of size consecutive places of the order column, from 0 and dense, each as one row of arrays."""
    names = [x for x in df.columns if x != order]
    packed = F.struct(c(order).alias("p"), *(c(x).alias(f"f{k}") for k, x in enumerate(names)))
    rows = df.groupBy(F.floor(c(order) / size).alias("batch")).agg(F.array_sort(F.collect_list(packed)).alias("rows"))
    return rows.select("batch", *(c("rows").getField(f"f{k}").alias(x) for k, x in enumerate(names)))
