"""Hierarchical packing: documents go to context-size tiers, long windows take their gaps from shorter tiers."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loamgrid.llm.base import arrow_schema, documents
from loamgrid.llm.tokens import byte_level_encode

VOCABULARY, RANKS, END = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", 0
#: Context sizes, longest first; each a power of two, so that a full window needs no padding.
TIERS = (1024, 512, 256)
#: Tokens held before windows are made, and tokens of a step group.
HELD, STEP = 2_000_000, 65_536
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, step_id long"
)
Piece = tuple[int, int, int]  # length, document in the buffer, start


class Packer:
    """Fills windows from pieces.  A piece belongs to the smallest tier that holds it."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.pieces: dict[int, list[Piece]] = {t: [] for t in tiers}
        self.tokens = 0

    def tier(self, length: int) -> int:
        return min(t for t in self.tiers if length <= t)

    def add(self, piece: Piece) -> None:
        insort(self.pieces[self.tier(piece[0])], piece)
        self.tokens += piece[0]

    def _take(self, most: int) -> Piece | None:
        """The longest piece of at most ``most`` tokens."""
        for t in self.tiers:
            k = bisect_right(self.pieces[t], (most, 1 << 62, 0))
            if k:
                piece = self.pieces[t].pop(k - 1)
                self.tokens -= piece[0]
                return piece
        return None

    def window(self, size: int) -> list[Piece]:
        """A full window of ``size``: the longest piece, its gap filled from shorter ones, the last one cut to fit."""
        out, gap = [], size
        while gap:
            piece = self._take(gap)
            if piece is None:  # every piece left is longer than the gap: the shortest is cut
                low = next(t for t in reversed(self.tiers) if self.pieces[t])
                length, doc, start = self.pieces[low].pop(0)
                self.tokens -= length
                piece = (gap, doc, start)
                self.add((length - gap, doc, start + gap))
            out.append(piece)
            gap -= piece[0]
        return out

    def full(self) -> Iterator[tuple[int, list[Piece]]]:
        """Windows of each tier as long as its own pieces, then all pieces, last for them."""
        for t in self.tiers:
            while self.pieces[t] and self.tokens >= t:
                yield t, self.window(t)

    def rest(self) -> Iterator[tuple[int, list[Piece]]]:
        """What is left, in windows of decreasing powers of two: none is padded."""
        yield from self.full()
        while self.tokens:
            size = 1 << (self.tokens.bit_length() - 1)
            yield size, self.window(size)


def _steps(windows: list[tuple[int, list[Piece]]], step: int) -> list[int]:
    """A group for each window: the longest first, each to the group with the fewest tokens so far."""
    groups = [(0, g) for g in range(max(1, round(sum(w for w, _ in windows) / step)))]
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i][0]):
        tokens, g = groups[0]
        out[i] = g
        heapq.heapreplace(groups, (tokens + windows[i][0], g))
    return out


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, held: int = HELD, step: int = STEP, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_id``.

    A document is its ids and the end id.  Parts that fill the longest context go out at once; the rest goes to the
    tier that holds it.  Each task packs the rows it reads, ``held`` tokens at a time, and ends with windows of
    decreasing powers of two, so nothing is padded or shuffled; ids of sequences and steps start with the task's
    partition.  ``with_ids`` adds the ids of each piece.  Null and empty texts are the end id alone, repeated rows
    are packed each, very long documents are cut over windows.
    """
    out = PIECES + (", ids array<int>" if with_ids else "")
    schema = arrow_schema(out)
    most = tiers[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encode(VOCABULARY, RANKS)
        first = TaskContext.get().partitionId() << 36
        sequence, group = first, first
        packer, ready = Packer(tiers), []
        store: list[tuple] = []  # doc_id and ids of the documents in the buffer

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group, ready
            if not ready:
                return
            steps, rows = _steps(ready, step), []
            for (size, pieces), g in zip(ready, steps):
                offset = 0
                for length, doc, start in pieces:
                    doc_id, ids = store[doc]
                    part = ids[start : start + length]
                    row = (doc_id, start, length, zlib.crc32(part.tobytes()), len(ids), sequence, offset, size, group + g)
                    rows.append((*row, part) if with_ids else row)
                    offset += length
                sequence += 1
            group += max(steps) + 1
            ready = []
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[i : i + 10_000]), schema)], schema=schema)

        def keep_open() -> None:
            """Number the documents of the pieces left anew and let go of the others."""
            nonlocal store
            left = [p for t in tiers for p in packer.pieces[t]]
            number = {d: i for i, d in enumerate(sorted({d for _, d, _ in left}))}
            store = [store[d] for d in number]
            packer.pieces = {t: sorted((n, number[d], s) for n, d, s in packer.pieces[t]) for t in tiers}

        tokens = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
                doc = len(store)
                store.append((doc_id, ids))
                whole = len(ids) // most * most
                ready += [(most, [(most, doc, s)]) for s in range(0, whole, most)]
                if len(ids) > whole:
                    packer.add((len(ids) - whole, doc, whole))
                tokens += len(ids)
                if tokens >= held:
                    ready += packer.full()
                    yield from emit()
                    keep_open()
                    tokens = packer.tokens
        ready += packer.rest()
        yield from emit()

    return documents(docs).mapInArrow(run, out)
