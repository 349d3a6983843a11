"""The k best of each query, kept by a task while it goes through its rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Results that a task holds at most.
HELD = 1 << 21


class Kept:
    """Of n queries. ``least`` has the k-th best score so far, -inf for a query that has fewer."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row, self.idx, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(n, -np.inf)
        self.wait: list[tuple] = []
        self.waiting = 0

    def __len__(self) -> int:
        return len(self.row) + self.waiting

    def put(self, row: np.ndarray, idx: np.ndarray, score: np.ndarray) -> None:
        self.wait.append((row, idx, score))
        self.waiting += len(row)
        if self.waiting >= self.n * (self.k if len(self.row) else 1):
            self.settle()

    def settle(self) -> None:
        """Brings those that wait among the k best; of equal ones those with smaller ids come first."""
        if not self.wait:
            return
        row, idx, score = (np.concatenate(x) for x in zip((self.row, self.idx, self.score), *self.wait))
        self.wait, self.waiting = [], 0
        order = np.lexsort((idx, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.idx, self.score = row[kept], idx[order][kept], score[order][kept]
        full = place[kept] == self.k - 1
        self.least[self.row[full]] = self.score[full]


def found_batch(qid: pa.Array, idx: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([qid, pa.array(idx, pa.int64()), pa.array(score, pa.float64())], names=["qid", "idx", "score"])
