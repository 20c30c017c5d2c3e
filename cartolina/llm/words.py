"""Whole texts taken in bounded chunks, and tables that hold what was computed for each distinct token."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20


def chunks(batch: pa.RecordBatch, size: int = CHUNK) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty) of a batch with columns doc_id and text; a chunk ends once it has that many characters."""
    ids, texts, held = [], [], 0
    for i, t in zip(batch.column(0), batch.column(1), strict=True):
        t = t.as_py() or ""
        ids.append(i.as_py())
        texts.append(t)
        held += len(t)
        if held >= size:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


class TokenTable:
    """A row of numbers for each distinct token, computed for many tokens at once.

    Two generations bound its size: once the young one holds limit tokens it becomes the old one,
    from which a token that is met again moves up; what was not met again goes with the next turn.
    """

    #: Longer tokens are computed anew each time, so that the table's size is bounded.
    LONGEST = 64

    def __init__(self, compute: Callable[[list[str]], np.ndarray], limit: int = 200_000):
        self.compute, self.limit = compute, limit
        self.at: dict[str, int] = {}
        self.table = compute([])
        self.old, self.old_table = self.at, self.table

    def rows(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The table, and each token's row in it."""
        if len(self.at) > self.limit:
            self.old, self.old_table = self.at, self.table
            self.at, self.table = {}, self.table[:0]
        new = set(tokens).difference(self.at)
        again = [t for t in new if t in self.old]
        new = sorted(new.difference(again), key=len)
        if again:
            self.at.update(zip(again, range(len(self.table), len(self.table) + len(again)), strict=True))
            self.table = np.concatenate([self.table, self.old_table[np.fromiter(map(self.old.__getitem__, again), np.int64, len(again))]])
        if new:
            self.at.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.compute(new)])
        table, found = self.table, np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))
        while new and len(new[-1]) > self.LONGEST:
            del self.at[new.pop()]
        self.table = self.table[: len(self.at)]
        return table, found


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What make gives for a model's key, held by this worker process so that its later tasks find it filled.

    A worker holds one model at a time, of whatever operator: another key drops the last one first.
    """
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
        tidy()  # loading takes more than what is held in the end
    return _KEPT[key]


def forget() -> None:
    """Drops the model that this worker process holds; operators without a model of their own call it as their tasks begin."""
    _KEPT.clear()
    tidy()


def tidy() -> None:
    """Gives what this process no longer uses back to the system, of which idle workers would else hold on to a hundred MB."""
    gc.collect()
    trim()


def trim() -> None:
    """As tidy, but without a search for garbage, which takes long beside a filled model; a few milliseconds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library of Linux; elsewhere nothing is lost
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that tidies up as the task ends."""

    def clean(batches: Iterator) -> Iterator:
        yield from run(batches)
        tidy()

    return clean


def sums(table: np.ndarray, rows: np.ndarray, counts: list[int]) -> np.ndarray:
    """For each text, the sum of its tokens' rows; counts: tokens by text."""
    out = np.zeros((len(counts), table.shape[1]))
    have = np.asarray(counts) > 0
    if have.any():
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[have]
        out[have] = np.add.reduceat(table[rows].astype(np.float64), starts, axis=0)
    return out
