"""Sequences of bounded length by vector bin packing under three limits at once.

A piece asks for tokens, one segment and its loss-bearing tokens; a sequence offers ``Limits``. Among the pieces of a
pool that fit, the one with the largest dot product of its demand and the sequence's free capacity (both as shares of
the limits) goes in. When none fits and cutting is allowed, the piece with the largest dot product is cut to fill the
gap and its rest returns to the pool. Where no task has more to read, the rest is laid out in sequences of powers of
two, which need no padding.

Every task packs the documents of its own partition as a stream; nothing is shuffled, and memory holds one pool. A
sequence number is the partition's number and a counter. A table with few rows per partition should be coalesced first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cohortlens.llm.spark_util import texts
from cohortlens.llm.token_counts import default_vocabulary
from cohortlens.llm.token_ids import encode_texts

#: Pieces a task chooses from.
POOL = 1024
#: Shortest piece that is cut off to fill a gap.
MIN_CUT = 8


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], np.float64)


@dataclass
class Piece:
    """Part of a document: ``ids`` at ``start``; ``loss`` says which of them bear loss."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    loss: np.ndarray
    doc_tokens: int

    def cut(self, size: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc_id, self.start, self.ids[:size], self.loss[:size], self.doc_tokens)
        tail = Piece(self.doc_id, self.start + size, self.ids[size:], self.loss[size:], self.doc_tokens)
        return head, tail


@dataclass
class Packer:
    """Packs a stream of pieces; ``add`` and ``finish`` yield finished sequences."""

    limits: Limits = field(default_factory=Limits)
    may_cut: bool = True
    pool_size: int = POOL

    def __post_init__(self) -> None:
        self.pieces: list[Piece] = []
        self.scale = self.limits.array()
        #: What each piece asks for, and the same as shares of the limits.
        self.demand = np.zeros((2 * self.pool_size, 3))
        self.shares = np.zeros_like(self.demand)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while self.may_cut and len(piece.ids) >= self.limits.tokens:
            head = self._longest_head(piece, self.limits.tokens, self.limits.loss_tokens)
            if head < self.limits.tokens:
                break
            whole, piece = piece.cut(head)
            yield [whole]
        if not self._fits(self._of(piece), self.scale) and not self.may_cut:
            raise ValueError(f"document {piece.doc_id} exceeds the limits of a sequence")
        if len(piece.ids):
            self._put(piece)
        while len(self.pieces) >= self.pool_size:
            yield self._fill()

    def finish(self) -> Iterator[list[Piece]]:
        while self.pieces:
            sequence = self._fill()
            if self.pieces or not self.may_cut:
                yield sequence
            else:
                yield from _powers_of_two(sequence)

    @staticmethod
    def _of(piece: Piece) -> np.ndarray:
        return np.array([len(piece.ids), 1, np.count_nonzero(piece.loss)], np.float64)

    @staticmethod
    def _fits(demand: np.ndarray, free: np.ndarray) -> np.ndarray:
        tokens, segments, loss = demand.T
        return (tokens <= free[0]) & (segments <= free[1]) & (loss <= free[2])

    def _put(self, piece: Piece) -> None:
        n = len(self.pieces)
        if n == len(self.demand):
            self.demand = np.vstack([self.demand, np.zeros_like(self.demand)])
            self.shares = np.vstack([self.shares, np.zeros_like(self.shares)])
        self.demand[n] = self._of(piece)
        self.shares[n] = self.demand[n] / self.scale
        self.pieces.append(piece)

    def _take(self, k: int) -> tuple[Piece, np.ndarray]:
        piece, demand, last = self.pieces[k], self.demand[k].copy(), self.pieces.pop()
        if piece is not last:
            self.pieces[k], n = last, len(self.pieces)
            self.demand[k], self.shares[k] = self.demand[n], self.shares[n]
        return piece, demand

    def _fill(self) -> list[Piece]:
        free, sequence = self.scale.copy(), []
        while self.pieces and free[0] > 0 and free[1] > 0:
            n = len(self.pieces)
            products = self.shares[:n] @ (free / self.scale)
            fits = self._fits(self.demand[:n], free)
            best = int(np.argmax(np.where(fits, products, -1.0)))
            if fits[best]:
                piece, demand = self._take(best)
            elif not self.may_cut or (free[0] < MIN_CUT and sequence):
                break
            else:
                piece, _ = self._take(int(np.argmax(products)))
                size = self._longest_head(piece, int(free[0]), int(free[2]))
                if not size:
                    self._put(piece)
                    break
                piece, rest = piece.cut(size)
                self._put(rest)
                demand = self._of(piece)
            sequence.append(piece)
            free -= demand
        return sequence

    @staticmethod
    def _longest_head(piece: Piece, tokens: int, loss_tokens: int) -> int:
        if tokens <= loss_tokens:
            return min(tokens, len(piece.loss))
        return int(np.searchsorted(np.cumsum(piece.loss[:tokens]), loss_tokens, "right"))


def _powers_of_two(sequence: list[Piece]) -> Iterator[list[Piece]]:
    total = sum(len(p.ids) for p in sequence)
    waiting = sequence[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out = []
        while size:
            piece = waiting.pop()
            if len(piece.ids) > size:
                piece, rest = piece.cut(size)
                waiting.append(rest)
            out.append(piece)
            size -= len(piece.ids)
        yield out


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64()),
    ("ids", pa.binary()),
])
SPARK_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "loss_tokens long"
)


def _rows(sequences: list[tuple[int, list[Piece]]], with_ids: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in SCHEMA]
    for number, pieces in sequences:
        offset = 0
        for p in pieces:
            raw = p.ids.astype("<u4", copy=False).tobytes()
            loss = np.count_nonzero(p.loss)
            row = (p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, number, offset, loss, raw)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            offset += len(p.ids)
    n = len(SCHEMA) if with_ids else len(SCHEMA) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns[:n], list(SCHEMA)[:n], strict=True)], schema=pa.schema(list(SCHEMA)[:n])
    )


def pack_documents(
    docs: DataFrame, limits: Limits | None = None, end_id: int = 1, vocabulary: str | None = None,
    with_ids: bool = False, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Encode all documents, end each with ``end_id``, and pack them; one row per piece.

    Every id of a document bears loss but its first, which nothing predicts. Columns: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, loss_tokens`` and, if asked for, the ids as little-endian unsigned
    32-bit numbers. A null text is an empty one (a piece of one id); repeated rows are packed once each; a null id
    stays null; an empty table gives no row; other columns are not read.
    """
    path, limits = vocabulary or default_vocabulary(), limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, ready = Packer(limits), []
        number = TaskContext.get().partitionId() << 33

        def flush(at_least: int) -> Iterator[pa.RecordBatch]:
            if len(ready) >= at_least:
                yield _rows(ready, with_ids)
                ready.clear()

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, counts in encode_texts(batch.column(1), path, end_id):
                ends = np.cumsum(counts)
                for k, (end, size) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                    own = ids[end - size:end].copy()
                    loss = np.ones(size, bool)
                    loss[0] = False
                    for pieces in packer.add(Piece(doc_ids[first + k], 0, own, loss, size)):
                        ready.append((number, pieces))
                        number += 1
                yield from flush(1000)
        for pieces in packer.finish():
            ready.append((number, pieces))
            number += 1
        yield from flush(1)

    return texts(docs, text, doc_id).mapInArrow(run, SPARK_SCHEMA + (", ids binary" if with_ids else ""))
