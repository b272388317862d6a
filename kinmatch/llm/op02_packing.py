"""Packing of documents into training sequences by the sum-of-squares rule (Csirik et al., J. ACM 2006).

Each task packs the documents it reads, in one pass. What is left of a document after its full windows goes, whole,
into the partially filled window whose level minimises the sum of the squared counts of windows by level, which is
tracked in an array of levels. Documents may be cut: when more than ``max_open`` windows are open, or the input ends,
the fullest windows are filled with cuts from the emptiest, and nothing else is moved. So no more than that many windows
are ever held, the windows that the rule has built stay, and only a task's last window isn't full; what is in it goes to
sequences whose lengths are powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import only
from .word_bpe import WordBpe

WINDOW = 4096
END_ID = 2
MAX_OPEN = 1024
#: Sequence ids of a task begin at its partition's number times this.
IDS_A_TASK = 1 << 40


class SumOfSquares:
    """The level array, and the windows open at each level. ``add`` takes (ref, ids) items below the window size."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.moved = 0  # ids that were cut from one window to fill another

    def level_for(self, size: int) -> int:
        """The level (0: a new window) where an item adds least to the sum of squared counts; ties: the fullest."""
        w, n = self.window, self.counts
        rise = np.empty(w - size + 1, dtype=np.int64)  # by the level the item is put on
        rise[:] = 2 * n[size:] + 1
        rise[-1] = 0  # a full window isn't counted
        rise[1:] -= 2 * n[1 : w - size + 1] - 1
        rise[1:][n[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
        return len(rise) - 1 - int(np.argmin(rise[::-1]))

    def add(self, size: int, item) -> list | None:
        """Places the item; returns the window's items if that fills it."""
        at = self.level_for(size)
        if at:
            items = self.open[at].pop()
            self.counts[at] -= 1
            self.n_open -= 1
        else:
            items = []
        items.append(item)
        if at + size == self.window:
            return items
        self.open.setdefault(at + size, []).append(items)
        self.counts[at + size] += 1
        self.n_open += 1
        return None

    def fill(self, most: int) -> Iterator[list]:
        """Fills the fullest windows with the last ids of the emptiest until ``most`` are open at most; yields the full ones."""
        windows = [(level, w) for level in sorted(self.open) for w in self.open[level]]
        low, high = 0, len(windows) - 1
        while high - low + 1 > most and low < high:
            level, items = windows[high]
            need = self.window - level
            while need and low < high:
                size, given = windows[low]
                ref, start, ids = given.pop()
                take = min(need, len(ids))
                items.append((ref, start + len(ids) - take, ids[len(ids) - take :]))
                if take < len(ids):
                    given.append((ref, start, ids[: len(ids) - take]))
                windows[low] = (size - take, given)
                need -= take
                self.moved += take
                low += not given
            if need:
                windows[high] = (self.window - need, items)
            else:
                yield items
                high -= 1
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        for level, items in windows[low : high + 1]:
            self.open.setdefault(level, []).append(items)
            self.counts[level] += 1
            self.n_open += 1


def cut(items: list[tuple], sizes: Iterator[int]) -> Iterator[list[tuple]]:
    """Lays (ref, start, ids) items end to end and cuts them into sequences of the given sizes, as far as these go."""
    need, row = next(sizes, 0), []
    for ref, start, ids in items:
        while need and len(ids):
            take = min(need, len(ids))
            row.append((ref, start, ids[:take]))
            start, ids, need = start + take, ids[take:], need - take
            if not need:
                yield row
                need, row = next(sizes, 0), []


def pack_documents(documents: Iterator[tuple], window: int = WINDOW, max_open: int = MAX_OPEN, levels: SumOfSquares | None = None) -> Iterator[list[tuple]]:
    """Sequences, lists of (ref, start, ids), made from (ref, ids); each id lies in exactly one piece."""
    levels = levels or SumOfSquares(window)
    for ref, ids in documents:
        full = len(ids) // window * window
        for at in range(0, full, window):
            yield [(ref, at, ids[at : at + window])]
        if len(ids) > full:
            done = levels.add(len(ids) - full, (ref, full, ids[full:]))
            if done:
                yield done
        if levels.n_open > max_open:
            yield from levels.fill(max_open - max_open // 4)
    yield from levels.fill(1)
    for level, (items,) in levels.open.items():
        yield from cut(items, (1 << b for b in range(level.bit_length() - 1, -1, -1) if level >> b & 1))


def pack(
    docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN, batch_rows: int = 4096
) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``: the pieces of all ``docs (doc_id, text)``.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers. A null or empty text has the end id only.
    Rows are packed one by one, so repeated rows and doc_ids, or null ones, give pieces each. A sequence has at most
    ``window`` ids; it is full or its length is a power of two, so nothing needs padding. An empty table gives none.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("the window must be a power of two")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.of(vocabulary)

        def documents():
            for batch in batches:
                ids_of_rows = batch.column(0).to_pylist()
                for doc_id, text in zip(ids_of_rows, batch.column(1)):
                    ids = np.frombuffer(bpe.encode(text.as_py() or ""), dtype="<u4")
                    ids = np.append(ids, np.array([end_id], dtype="<u4"))
                    yield (doc_id, len(ids)), ids

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

        sequence, rows = TaskContext.get().partitionId() * IDS_A_TASK, []
        for pieces in pack_documents(documents(), window, max_open):
            offset = 0
            for (doc_id, n), start, ids in pieces:
                rows.append((doc_id, start, len(ids), ids.tobytes(), n, sequence, offset))
                offset += len(ids)
            sequence += 1
            if len(rows) >= batch_rows:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return only(docs, doc_id="long", text="string").mapInArrow(run, schema)
