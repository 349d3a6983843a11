"""Overlapping windows over arrays, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_windows(size: int, stride: int, around: int) -> None:
    """ValueError unless windows of this size, less the tokens around them, have room, and cover every token."""
    if size - around <= 0 or stride - around <= 0 or stride > size:
        raise ValueError(f"windows of {size} at steps of {stride} with {around} special tokens")


class Windows:
    """Windows of an array with n elements (a column), with start_n and end_n tokens put around each.

    E = size - start_n - end_n tokens of the array are in a window, which starts S = stride - start_n - end_n after the one before. Of
    the E - S tokens that two windows share the first half, rounded up, belongs to the earlier one: mask is 1 for
    the tokens that a window owns, so every token is owned once. start_n may be a column.
    """

    def __init__(self, n: Column, size: int, stride: int, start_n: Column | int, end_n: int, padded: bool):
        self.n, self.start_n, self.end_n = n, F.lit(start_n) if isinstance(start_n, int) else start_n, F.lit(end_n)
        self.inside = F.lit(size) - self.start_n - self.end_n
        self.step = F.lit(stride) - self.start_n - self.end_n
        shared = self.inside - self.step
        self.before, self.behind = F.ceil(shared / 2).cast("int"), F.floor(shared / 2).cast("int")
        self.padded = padded
        self.bad = (self.inside <= 0) | (self.step <= 0) | (shared < 0)

    def places(self) -> Column:
        """Numbers of the windows: those with a token that they own."""
        last = F.floor((self.n - 1) / self.step).cast("int")
        every = F.sequence(F.lit(0), last)
        owning = F.filter(every, lambda i: self.length(i) > self.left(i))
        failed = F.raise_error(F.lit("no room for tokens in a window"))
        return F.when(self.n > 0, F.when(self.bad, failed).otherwise(owning)).when(self.n == 0, F.array().cast("array<int>"))

    def left(self, i: Column) -> Column:
        return F.when(i > 0, self.before).otherwise(0)

    def length(self, i: Column) -> Column:
        return F.least(self.inside, self.n - i * self.step)

    def padding(self, i: Column) -> Column:
        return F.greatest(self.inside - self.length(i), F.lit(0)) if self.padded else F.lit(0)

    def cut(self, x: Column, i: Column, start: Column, end: Column, pad: Column) -> Column:
        """The window's part of an array, between its start and end tokens, padded."""
        return F.concat(start, F.slice(x, i * self.step + 1, self.inside), end, F.array_repeat(pad, self.padding(i)))

    def mask(self, i: Column) -> Column:
        first = self.start_n + self.left(i)
        behind = first + self.inside - self.left(i) - self.behind
        width = self.start_n + self.length(i) + self.end_n
        first = F.least(first, width)
        behind = F.greatest(F.least(behind, width), first)
        some = lambda v, n: F.array_repeat(F.lit(v), n.cast("int"))
        return F.concat(some(0, first), some(1, behind - first), some(0, width + self.padding(i) - behind))


def gen_passages(x: Column, element: str, *, size: int, stride: int, start_tokens=None, end_tokens=None, pad_token=None) -> Column:
    """Windows of an array as array<struct<tokens, mask>>, elements of the type named; null for null, none for an empty array.

    With pad_token all are of the same size, else the last may be shorter. End tokens that follow the last tokens of a
    short window may have a mask of 1: the mask runs over the places that a full window would own.
    """
    start, end = list(start_tokens or ()), list(end_tokens or ())
    check_windows(size, stride, len(start) + len(end))
    w = Windows(F.size(x), size, stride, len(start), len(end), pad_token is not None)
    fixed: Callable = lambda v: F.array(*map(F.lit, v)).cast(f"array<{element}>")
    return F.transform(w.places(), lambda i: F.struct(w.cut(x, i, fixed(start), fixed(end), F.lit(pad_token).cast(element)).alias("tokens"), w.mask(i).alias("mask")))
