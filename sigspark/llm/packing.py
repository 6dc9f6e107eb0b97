"""Sum-of-squares packing of documents into windows.

Each task packs its own documents, in the order in which it reads them, and keeps only an array with the number of
partially filled windows at each fill level. A document goes to the level at which the sum of the squared counts
becomes least (a new window is level 0, a full one doesn't count). Of a document over the window's size, all but the
last part fill windows of their own. At most `windows` windows are open. While all are, a document that fits none of
them is cut: its first part fills up the window whose level leaves the least sum, and the rest is placed like a document.
When the task ends, what the few open windows hold is laid end to end and cut at the window's size, and the rest of that
into powers of two, which need no padding. Nothing is shuffled, and a repeated task gives the same sequences: their ids
hold the partition's number.

A null text is the empty text and has the end id alone. Repeated rows are each packed. An empty table gives no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded, narrow
from .encode import encoder

PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Windows that a task holds open at once. More of them mean fewer cuts, and more to lay end to end when the task ends.
WINDOWS = 16
#: Sequence ids leave room for so many bits of a task's own count.
OWN_BITS = 33


class Packer:
    """add() and close() return finished sequences: lists of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, windows: int = WINDOWS):
        self.size, self.windows = size, windows
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0

    def after(self, g: int, s: int) -> int:
        """How the sum of squares changes when s ids go to level g and what is over the window's size opens one of its own."""
        n, size, to = self.levels, self.size, (g + s) % self.size
        if not g:
            return 2 * int(n[s]) + 1 if s < size else 0
        if not to:
            return 1 - 2 * int(n[g])
        return 2 * (int(n[to]) - int(n[g])) + 2 if to != g else 0

    def level(self, s: int) -> int:
        """Where s ids go: at equal sums to the fullest window; one that they overfill only if all are open and none has room."""
        ways = [g for g in self.open if g + s <= self.size] + [0] * (self.n_open < self.windows) or [*self.open]
        return min(ways, key=lambda g: (self.after(g, s), -g))

    def add(self, doc_id: int | None, ids: bytes) -> list[list[tuple]]:
        total, step, done = len(ids) // 4, self.size, []
        at = total - total % step
        for start in range(0, at, step):
            done.append([(doc_id, start, ids[start * 4 : (start + step) * 4], total)])
        while at < total:
            g = self.level(total - at)
            s = min(total - at, step - g)
            window = self.taken(g) if g else []
            window.append((doc_id, at, ids[at * 4 : (at + s) * 4], total))
            at += s
            if g + s == step:
                done.append(window)
            else:
                self.open.setdefault(g + s, []).append(window)
                self.levels[g + s] += 1
                self.n_open += 1
        return done

    def taken(self, g: int) -> list[tuple]:
        """The last opened window of a level, which leaves it."""
        window = self.open[g].pop()
        if not self.open[g]:
            del self.open[g]
        self.levels[g] -= 1
        self.n_open -= 1
        return window

    def close(self) -> list[list[tuple]]:
        pieces = [p for g in sorted(self.open, reverse=True) for window in self.open[g] for p in window]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        left = sum(len(p[2]) for p in pieces) // 4
        done, room = [], 0
        for doc_id, start, ids, total in pieces:
            while ids:
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                    left -= room
                    done.append([])
                part = ids[: room * 4]
                done[-1].append((doc_id, start, part, total))
                ids, start, room = ids[len(part) :], start + len(part) // 4, room - len(part) // 4
        return done


def padding(lengths: np.ndarray, size: int) -> int:
    """Ids of padding that sequences of these lengths need: none at a power of two, else up to size."""
    n = np.asarray(lengths)
    return int(np.where(n & (n - 1) == 0, 0, size - n).sum())


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, windows: int = WINDOWS, kept: int | None = None) -> DataFrame:
    """Every piece with its ids (binary, little-endian unsigned 32 bits), its sequence and its offset there. kept: the encoder's."""

    def task(batches):
        e, packer, n, rows = encoder(path, kept), Packer(size, windows), TaskContext.get().partitionId() << OWN_BITS, []
        end = np.array([end_id], dtype="<u4").tobytes()
        held = 0

        def number(sequences):
            nonlocal n, held
            for pieces in sequences:
                offset = 0
                for doc_id, start, ids, total in pieces:
                    rows.append((doc_id, start, ids, total, n, offset))
                    offset += len(ids) // 4
                held += offset
                n += 1

        def batch():
            nonlocal held
            cols = [*zip(*rows, strict=True)]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            held = 0
            return out

        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i in range(0, len(ids), 512):
                for k, x in zip(ids.slice(i, 512).to_pylist(), e.encoded(texts.slice(i, 512).to_pylist()), strict=True):
                    number(packer.add(k, x + end))
                    if held > 1 << 20:
                        yield batch()
        number(packer.close())
        if rows:
            yield batch()

    return bounded(narrow(docs, "doc_id", "text")).mapInArrow(task, PIECES)
