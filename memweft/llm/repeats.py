"""Keys that occur more than once: a count-min prefilter for tables of any size.

Keys are cut into as many hash ranges as it takes for each to have some ``RANGE`` keys. Each key travels once, packed, to
the task of its range, which counts the range in a count-min sketch of two-bit saturating counters and drops the keys
that the sketch says are single; only the others go on to exact grouping. A sketch never counts too low, so no
repeated key is lost, and as its size goes with the range, it lets few others through however large the table is.

A key that one block of the table has for several owners is decided there: it goes on at once, and only a mark of it
goes to its range, so that a hot key costs its range one mark a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vectext as V

#: Rows of a sketch, counters for each key, and the least and most counters in a row of a sketch that is broadcast (32 MB a row).
ROWS, PER_KEY = 2, 8
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 27
#: Keys of a hash range on average (fewer ranges than ``RANGES`` have so many, more have up to ``WIDE``), and keys that a task sorts at a time.
RANGE, RANGES, WIDE, BLOCK = 1 << 16, 1 << 12, 1 << 23, 1 << 21

#: Finds the keys of an Arrow batch: (hash as uint64, owner as int64, place as int32).
Keys = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


class CountMin:
    """Count-min sketch of two-bit saturating counters: 0, 1, or 2 and more."""

    def __init__(self, cells: int, rows: int = ROWS):
        self.cells, self.rows = cells, rows
        self.seen = np.zeros((rows, cells // 8), np.uint8)
        self.twice = np.zeros((rows, cells // 8), np.uint8)

    def at(self, h: np.ndarray, row: int) -> np.ndarray:
        return (V.mix(h + V.U(0x51ED270B * (row + 1))) & V.U(self.cells - 1)).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        for r in range(self.rows):
            cell, n = np.unique(self.at(h, r), return_counts=True)
            bit = (1 << (cell & 7)).astype(np.uint8)
            again = (n > 1) | (self.seen[r, cell >> 3] & bit > 0)
            np.bitwise_or.at(self.twice[r], cell[again] >> 3, bit[again])
            np.bitwise_or.at(self.seen[r], cell >> 3, bit)

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """Whether each key may have been counted more than once. Never wrongly false."""
        return self._has(self.twice, h)

    def counted(self, h: np.ndarray) -> np.ndarray:
        """Whether each key may have been counted at all. Never wrongly false."""
        return self._has(self.seen, h)

    def _has(self, bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for r in range(self.rows):
            cell = self.at(h, r)
            out &= bits[r, cell >> 3] & (1 << (cell & 7)).astype(np.uint8) > 0
        return out

    def blocks(self, n: int = 256):
        """(block number, compressed counters) of the blocks that aren't all zero."""
        seen, twice = self.seen.reshape(n, -1), self.twice.reshape(n, -1)
        for b in np.flatnonzero(seen.any(axis=1)):
            yield int(b), zlib.compress(seen[b].tobytes() + twice[b].tobytes(), 1)

    @classmethod
    def of(cls, blocks, cells: int, rows: int, n: int = 256) -> CountMin:
        out = cls(cells, rows)
        seen, twice = out.seen.reshape(n, -1), out.twice.reshape(n, -1)
        for b, data in blocks:
            seen[b], twice[b] = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, -1)
        return out


def folded(batches, size: int):
    """Add the counters of sorted (block, data) rows block by block, saturating at two; holds one open block."""
    last, seen, twice = None, None, None
    for pdf in batches:
        done = []
        for b, data in zip(pdf["block"], pdf["data"]):
            if b != last:
                if last is not None:
                    done.append((last, zlib.compress(seen.tobytes() + twice.tobytes(), 1)))
                last, seen, twice = b, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
            s, t = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, -1)
            twice |= t | seen & s
            seen |= s
        yield pd.DataFrame(done, columns=["block", "data"])
    if last is not None:
        yield pd.DataFrame([(last, zlib.compress(seen.tobytes() + twice.tobytes(), 1))], columns=["block", "data"])


def merged_counts(df: DataFrame, hashes, cells: int, rows: int = ROWS, blocks: int = 256) -> CountMin:
    """The merged sketch of the hashes that ``hashes`` finds in each Arrow batch of ``df``.

    Each task sends the nonzero blocks of its sketch. They are folded block by block as they stream in, so a task
    holds one block however many tasks sent it, and only the one merged sketch, whose size is fixed, comes to the driver.
    """

    def count(batches):
        own = CountMin(cells, rows)
        for batch in batches:
            own.add(hashes(batch))
        got = list(own.blocks(blocks))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int32()), pa.array([d for _, d in got], pa.binary())], ["block", "data"])

    size = rows * cells // 8 // blocks
    parts = df.mapInArrow(count, "block int, data binary").repartition("block").sortWithinPartitions("block")
    whole = parts.mapInPandas(lambda b: folded(b, size), "block int, data binary")
    return CountMin.of(((r["block"], bytes(r["data"])) for r in whole.collect()), cells, rows, blocks)


def cells_for(n_keys: int, per_key: int = 4) -> int | None:
    """Counters in a row of one sketch to broadcast, for so many keys; None if they would be more than ``MOST_CELLS``."""
    cells = max(LEAST_CELLS, 1 << max(1, per_key * n_keys - 1).bit_length())
    return cells if cells <= MOST_CELLS else None


def _blocks(batches, keys: Keys):
    """(h, owner, place) of batches put together to ``BLOCK`` keys or more, sorted by hash and owner.

    Hashes are mixed once more: those of winnowed windows are minima, and would all lie in the lowest range.
    """
    held, n = [], 0

    def sorted_():
        h, o, p = (np.concatenate(x) for x in zip(*held))
        h = V.mix(h + V.U(0x8CB92BA72F3D8DD7))
        order = np.lexsort((o, h))
        return h[order], o[order], p[order]

    for batch in batches:
        held.append(keys(batch))
        n += len(held[-1][0])
        if n >= BLOCK:
            yield sorted_()
            held, n = [], 0
    if n:
        yield sorted_()


_PACKED = "part int, h binary, owner binary, place binary"


def maybe_repeated(df: DataFrame, keys: Keys, n_keys: int) -> DataFrame:
    """(h, owner, place) of the keys that may be repeated, by counting each hash range in a task; h is another hash of the key.

    Rows in transit hold the keys of one block and range as packed arrays; rows without owners are marks.
    """
    ranges = max(1, min(-(-n_keys // RANGE), max(RANGES, -(-n_keys // WIDE))))
    cells = max(1 << 10, 1 << (PER_KEY * -(-n_keys // ranges)).bit_length())
    names = [c.split()[0] for c in _PACKED.split(", ")]

    def packed(rows):
        cols = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))]
        return pa.RecordBatch.from_arrays(cols, names)

    def split(batches):
        for turn, (h, o, p) in enumerate(_blocks(batches, keys)):
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[first, len(h)])
            several = (o[first] != o[first + size - 1]).repeat(size)  # sorted by owner within a key
            part = (((h >> V.U(32)) * V.U(ranges)) >> V.U(32)).astype(np.int64)
            rows = []
            if several.any():
                rows.append((-1 - turn % 64, h[several].tobytes(), o[several].tobytes(), p[several].tobytes()))
            mark = np.unique(h[several])
            cuts = np.searchsorted(part, np.arange(ranges + 1))
            marks = np.searchsorted(((mark >> V.U(32)) * V.U(ranges)) >> V.U(32), np.arange(ranges + 1).astype(V.U))
            for r in range(ranges):
                a, b = cuts[r], cuts[r + 1]
                own = ~several[a:b]
                if own.any():
                    rows.append((r, h[a:b][own].tobytes(), o[a:b][own].tobytes(), p[a:b][own].tobytes()))
                if marks[r] < marks[r + 1]:
                    rows.append((r, mark[marks[r] : marks[r + 1]].tobytes(), None, None))
            yield packed(rows)

    def unpacked(h, o, p):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(o), pa.array(p)], ["h", "owner", "place"])

    def decide(batches):
        last, held, sketch = None, [], None

        def close():
            for h, o, p in held:
                hit = sketch.repeated(h)
                yield unpacked(h[hit], o[hit], p[hit])

        for batch in batches:
            for part, *data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                h = np.frombuffer(data[0], V.U)
                if part < 0:
                    yield unpacked(h, np.frombuffer(data[1], np.int64), np.frombuffer(data[2], np.int32))
                    continue
                if part != last:
                    yield from close()
                    last, held, sketch = part, [], CountMin(cells)
                if data[1] is None:
                    sketch.add(np.repeat(h, 2))
                else:
                    # sorted, and of one owner in the block: it counts once, however many places it has
                    sketch.add(h[np.r_[True, h[1:] != h[:-1]]])
                    held.append((h, np.frombuffer(data[1], np.int64), np.frombuffer(data[2], np.int32)))
        yield from close()

    # four ranges a task on average, however many partitions the session has by default
    rows = df.mapInArrow(split, _PACKED).repartition(-(-ranges // 4), "part").sortWithinPartitions("part")
    return rows.mapInArrow(decide, "h long, owner long, place int")
