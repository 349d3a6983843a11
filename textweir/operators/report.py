"""Reports on tables: schemas, contents, decoded tokens."""

from __future__ import annotations

import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.columns import array_depth, c, element_type, type_of
from ..core.pipe import Pipe
from ..functions.arrays import flatten_nested


def separator(char: str = "-") -> str:
    return char * shutil.get_terminal_size((100, 20)).columns


def collapse_repeats(parts: list[str], token: str) -> list[str]:
    """Runs of a token as one part: PAD PAD becomes 2x(PAD)."""
    out: list[list] = []
    for p in parts:
        if out and p == token == out[-1][0]:
            out[-1][1] += 1
        else:
            out.append([p, 1])
    return [p if n == 1 else f"{n}x({p})" for p, n in out]


def pretty_decode(ids, decode, pad_token: str | None = None) -> str:
    """Ids as text, an id at a time where a padding token is to be collapsed."""
    return decode(list(ids)) if pad_token is None else " ".join(collapse_repeats([decode([k]) for k in ids], pad_token))


def describe(df: DataFrame, nulls: bool = False) -> list[dict]:
    """A row for each column, by name: key, depth, leaf type and with nulls how many rows are null (one pass)."""
    out = [{"key": x, "depth": array_depth(type_of(df, x)), "leaf": element_type(type_of(df, x)).simpleString()} for x in sorted(df.columns)]
    if nulls and out:
        found = df.agg(F.count("*").alias("n"), *(F.count_if(c(r["key"]).isNull()).alias(f"k{i}") for i, r in enumerate(out))).first()
        for i, r in enumerate(out):
            r |= {"rows": found["n"], "nulls": found[f"k{i}"]}
    return out


def repr_table(df: DataFrame, header: str | None = None, nulls: bool = False) -> str:
    rows = describe(df, nulls)
    heads = list(rows[0]) if rows else ["key"]
    wide = [max([len(h), *(len(str(r[h])) for r in rows)]) for h in heads]
    lines = ["  ".join(h.ljust(w) for h, w in zip(heads, wide))] + ["  ".join(str(r[h]).ljust(w) for h, w in zip(heads, wide)) for r in rows]
    return "\n".join([*([header] if header else []), *lines])


class PrintBatch(Pipe):
    """Prints the table's columns; the table goes through. report_nans counts nulls, which runs a job."""

    _allows_update = False

    def __init__(self, header: str | None = None, report_nans: bool = False, **kwargs):
        super().__init__(**kwargs)
        self.header, self.report_nans = header, report_nans

    def _apply(self, df, carry, **kwargs):
        print(repr_table(df.select(*(c(x) for x in df.columns if x not in carry)), self.header, self.report_nans))
        return df


class PrintContent(Pipe):
    """Prints the first n values of columns, nested ones flat, ids decoded if a decoder is given; the table goes through."""

    _allows_update = False

    def __init__(self, keys, n: int = 5, decode_keys=(), decode=None, header: str | None = None, **kwargs):
        super().__init__(**kwargs)
        self.keys, self.n, self.decode_keys, self.decode, self.header = list(keys), n, list(decode_keys), decode, header

    def _apply(self, df, carry, **kwargs):
        if self.header:
            print(self.header)
        for key in (x for x in self.keys if x in df.columns):
            decoded = self.decode is not None and key in self.decode_keys
            depth = array_depth(type_of(df, key)) - decoded
            flat = df.select((c(key) if depth <= 0 else flatten_nested(c(key), depth - 1)).alias("v")).filter("v IS NOT NULL")
            flat = flat if depth <= 0 else flat.select(F.explode("v").alias("v"))
            print(separator(), key, sep="\n")
            for k, row in enumerate(flat.limit(self.n).collect()):
                print(f" - {k}: {self.decode(list(row['v'])) if decoded else row['v']}")
        return df
