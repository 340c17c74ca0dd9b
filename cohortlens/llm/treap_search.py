"""Ranked lexical search over a compressed quadtree of the term-document grid whose cells hold impact maxima.

Documents are indexed in blocks. A block's grid has a row for each of its terms (frequent ones first, so that dense
cells lie together) and a column for each of its documents; a cell holds the impact of the term in the document, a
whole number. The grid is cut into quadrants level by level. Every quadrant that is not empty stores its largest impact;
one with a single cell is not cut further. Levels are stored breadth first: four bits per quadrant say which parts
it has, and the count of bits before it gives the place of its first part.

A query's terms are rows. Their paths go down together over ranges of documents: the sum of the weighted maxima of their
quadrants bounds the score of all documents of a range. Ranges with the largest bound are opened first, and those
below the worst of the best documents known so far are never opened. A range of one document has an exact score.

Every document is indexed, and nothing but sums, the query terms and the best documents of each task leaves a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.arrays import LOWER, Chunk, chunks
from cohortlens.llm.spark_util import staged, texts

#: Bytes of text that one block indexes, and documents at most; a longer text is indexed whole.
BLOCK_BYTES = 16 << 20
BLOCK_DOCS = 1 << 16
#: Items that are searched for together; more items are searched for in further passes over the index.
ITEM_BLOCK = 2_000
#: Numbers held for the ranges that are opened at once (ranges times terms).
OPEN_AT_ONCE = 2048

#: Bytes of terms: ASCII letters and digits, and everything beyond ASCII.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
POPCOUNT = np.array([bin(i).count("1") for i in range(16)], np.int64)


def term_spans(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes lie in terms, the lengths of the terms in order, and how many each row has."""
    inside = TERM_BYTES[chunk.data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = chunk.offsets[1:] > chunk.offsets[:-1]
    heads, tails = chunk.offsets[:-1][filled], chunk.offsets[1:][filled] - 1
    begins[heads] = inside[heads]
    closes[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return inside, np.flatnonzero(closes) + 1 - starts, np.diff(np.searchsorted(starts, chunk.offsets))


def terms_of(text: str | None) -> list[str]:
    """The terms of one text, in order, with repeats."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    if not len(data):
        return []
    inside, lengths, _ = term_spans(Chunk(0, data, np.array([0, len(data)])))
    return [t.decode() for t in _binary(data[inside], lengths).to_pylist()]


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers with a gap after each."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


@dataclass
class Treap:
    """The quadtree of one block; node 0 is the whole grid, nodes lie level by level.

    ``mask`` has a bit for each part of a node (2 * lower half of the rows + right half of the columns) and is 0 for a
    node with one cell, whose place is ``row`` and ``col``; ``top`` is the largest impact. One more node stands for
    nothing: its ``top`` is 0.
    """

    height: int
    mask: np.ndarray
    top: np.ndarray
    row: np.ndarray
    col: np.ndarray
    first: np.ndarray

    @staticmethod
    def build(rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Height, nodes per level, masks, differences of maxima to those of the node above, rows and columns of single cells."""
        height = max(1, int(max(rows.max(), cols.max())).bit_length())
        place = (_spread(rows) << np.uint64(1)) | _spread(cols)
        order = np.argsort(place, kind="stable")
        place, rows, cols, impacts = place[order], rows[order], cols[order], impacts[order]
        n = len(place)
        # apart[i]: the level from which on cell i lies in another node than the one before it; 0 at both ends
        apart = np.zeros(n + 1, np.int64)
        differ = place[1:] ^ place[:-1]
        bits = np.zeros(n - 1, np.int64)
        for shift in (32, 16, 8, 4, 2, 1):
            high = differ >= (np.uint64(1) << np.uint64(shift))
            bits[high] += shift
            differ = np.where(high, differ >> np.uint64(shift), differ)
        apart[1:n] = height - bits // 2
        at, above = np.zeros(1, np.int64), None
        sizes, masks, gaps, leaf_rows, leaf_cols = [], [], [], [], []
        for level in range(height + 1):
            edges = np.flatnonzero(apart[:n] <= level)
            top = np.maximum.reduceat(impacts, edges)[np.searchsorted(edges, at)]
            gaps.append(top if above is None else above - top)
            single = apart[at + 1] <= level
            mask = np.zeros(len(at), np.int64)
            here, then = apart[:n], apart[1:]
            below = np.flatnonzero((here == level + 1) | ((here <= level) & (then > level))) if level < height else at[:0]
            if len(below):
                over = np.searchsorted(at, below, "right") - 1
                part = (place[below] >> np.uint64(2 * (height - level - 1))).astype(np.int64) & 3
                mask = np.bincount(over, weights=1 << part, minlength=len(at)).astype(np.int64)
                above = top[over]
            sizes.append(len(at))
            masks.append(mask)
            leaf_rows.append(rows[at[single]])
            leaf_cols.append(cols[at[single]])
            at = below
            if not len(at):
                break
        return height, np.array(sizes), np.concatenate(masks), np.concatenate(gaps), np.concatenate(leaf_rows), np.concatenate(leaf_cols)

    @staticmethod
    def load(height: int, sizes: np.ndarray, mask: np.ndarray, gap: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> Treap:
        mask = mask.astype(np.uint8)
        parts = POPCOUNT[mask]
        first = 1 + np.cumsum(parts) - parts
        top = gap.astype(np.int64)
        ends = np.cumsum(sizes)
        for level in range(1, len(sizes)):
            over = slice(ends[level - 2] if level > 1 else 0, ends[level - 1])
            mine = slice(ends[level - 1], ends[level])
            top[mine] = np.repeat(top[over], parts[over]) - top[mine]
        row, col = np.full(len(mask) + 1, -1, np.int32), np.full(len(mask) + 1, -1, np.int32)
        leaf = np.flatnonzero(mask == 0)
        row[leaf], col[leaf] = rows, cols
        return Treap(height, np.append(mask, 0).astype(np.uint8), np.append(top, 0), row, col, np.append(first, 0))

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of the ``k`` best columns, and of all that tie with the last; none below ``floor``."""
        nothing = len(self.mask) - 1
        root = np.zeros((1, len(rows)), np.int64)
        if self.mask[0] == 0:
            root[0, rows != self.row[0]] = nothing
        found_cols, found_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        open_ranges = _Ranges(root, self.top[root] @ weights)
        step = max(1, OPEN_AT_ONCE // len(rows))
        while True:
            levels, cols, nodes, bounds = open_ranges.take(step, floor)
            if not len(cols):
                return found_cols, found_scores
            single = levels == self.height
            if single.any():
                found_cols, found_scores = np.concatenate([found_cols, cols[single]]), np.concatenate([found_scores, bounds[single]])
                if len(found_scores) >= k:
                    floor = max(floor, int(np.partition(found_scores, -k)[-k]))
                    found_cols, found_scores = found_cols[found_scores >= floor], found_scores[found_scores >= floor]
                levels, cols, nodes = levels[~single], cols[~single], nodes[~single]
            for side in (0, 1):
                below = self._open(nodes, rows, self.height - 1 - levels[:, None], side, nothing)
                bound = self.top[below] @ weights
                keep = bound >= floor
                open_ranges.put(levels[keep] + 1, 2 * cols[keep] + side, below[keep], bound[keep])

    def _open(self, nodes: np.ndarray, rows: np.ndarray, shift: np.ndarray, side: int, nothing: int) -> np.ndarray:
        """The nodes of the rows in one half of the columns of ``nodes``."""
        mask = self.mask[nodes]
        part = (2 * ((rows >> shift) & 1) + side).astype(np.uint8)
        below = self.first[nodes] + POPCOUNT[mask & ((np.uint8(1) << part) - np.uint8(1))]
        stays = (mask == 0) & (((self.col[nodes] >> shift) & 1) == side)
        below = np.where(stays, nodes, np.where((mask >> part) & 1, below, nothing))
        return np.where((self.mask[below] == 0) & (self.row[below] != rows), nothing, below)


class _Ranges:
    """Ranges of columns that may be opened: their level, number, nodes and bound."""

    def __init__(self, nodes: np.ndarray, bounds: np.ndarray):
        self.parts = [np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), nodes, bounds]
        self.size = len(nodes)

    def put(self, *more: np.ndarray) -> None:
        need = self.size + len(more[0])
        if need > len(self.parts[0]):
            self.parts = [np.concatenate([p[:self.size], m, np.zeros((need, *p.shape[1:]), p.dtype)]) for p, m in zip(self.parts, more, strict=True)]
        else:
            for p, m in zip(self.parts, more, strict=True):
                p[self.size:need] = m
        self.size = need

    def take(self, n: int, floor: int) -> list[np.ndarray]:
        """Out come the ``n`` ranges with the largest bounds, none below ``floor``."""
        bounds = self.parts[3][:self.size]
        chosen = np.argpartition(-bounds, n - 1)[:n] if self.size > n else np.arange(self.size)
        out = [p[chosen] for p in self.parts]
        left = chosen < self.size - len(chosen)
        last = np.setdiff1d(np.arange(self.size - len(chosen), self.size), chosen[~left], assume_unique=True)
        for p in self.parts:  # ranges from the end fill the gaps
            p[chosen[left]] = p[last]
        self.size -= len(chosen)
        good = out[3] >= floor
        return [p[good] for p in out]


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype(kind)).tobytes())


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


class Block:
    """Documents that wait to be indexed together."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, max(n_terms, 1)
        self.clear()

    def clear(self) -> None:
        self.ids: list[pa.Array] = []
        self.data, self.lengths, self.counts, self.size, self.docs = [], [], [], 0, 0

    def add(self, ids: pa.Array, chunk: Chunk) -> None:
        inside, lengths, counts = term_spans(chunk)
        self.ids.append(ids)
        self.data.append(LOWER[chunk.data][inside])
        self.lengths.append(lengths)
        self.counts.append(counts)
        self.size += len(chunk.data)
        self.docs += chunk.rows

    def finish(self) -> Iterator[pa.RecordBatch]:
        """One row: the index of the documents that have terms; none if no document has any."""
        lengths, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.lengths, self.counts))
        if not len(lengths):
            self.clear()
            return
        coded = _binary(np.concatenate(self.data), lengths).dictionary_encode()
        ids = pa.concat_arrays(self.ids).filter(pa.array(counts > 0))
        counts = counts[counts > 0]
        owner = np.repeat(np.arange(len(counts)), counts)
        cells, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(counts) + owner, return_counts=True)
        term, doc = np.divmod(cells, len(counts))
        df = np.bincount(term, minlength=len(coded.dictionary))
        order = np.argsort(-df, kind="stable")
        row_of = np.empty(len(order), np.int64)
        row_of[order] = np.arange(len(order))
        around = length_part(counts, self.n_docs, self.n_terms)
        impacts = 1_000_000_000 * tf // (1000 * tf + 8 * around[doc])
        height, sizes, mask, gap, rows, cols = Treap.build(row_of[term], doc, impacts)
        names = coded.dictionary.take(pa.array(order))
        spelt = b"".join(names.to_pylist())
        row = {
            "ids": zstandard.ZstdCompressor().compress(pa.record_batch([ids.cast(pa.int64())], ["id"]).serialize().to_pybytes()),
            "terms": zstandard.ZstdCompressor().compress(spelt),
            "lengths": _pack(pc.binary_length(names).to_numpy(), "<i4"), "df": _pack(df[order], "<i4"),
            "sizes": _pack(sizes, "<i8"), "mask": _pack(mask, "u1"), "gap": _pack(gap, "<i4"), "rows": _pack(rows, "<i4"), "cols": _pack(cols, "<i4"),
        }
        yield pa.RecordBatch.from_arrays([pa.array([height], pa.int32()), *(pa.array([v], pa.binary()) for v in row.values())], names=["height", *row])
        self.clear()


INDEX = "height int, ids binary, terms binary, lengths binary, df binary, sizes binary, mask binary, gap binary, rows binary, cols binary"


def length_part(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """How much a document's number of terms weighs against repeats, in hundredths: 100 at the mean length."""
    return 10 + 90 * n.astype(np.int64) * n_docs // n_terms


def corpus_counts(plain: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents with repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                counts = term_spans(chunk)[2]
                docs, terms = docs + int((counts > 0).sum()), terms + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], names=["docs", "terms"])

    total = plain.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return total[0] or 0, total[1] or 0


@dataclass
class SearchIndex:
    """The written index: one row per block, and the two counts that the impacts are made of."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> SearchIndex:
    """Index every row. A null text has no term, like an empty one; such rows can never be found. Repeated rows are
    documents of their own, rows without an id too. Other columns are not read. Runs two jobs and writes the index."""
    plain = texts(docs, text, doc_id)
    n_docs, n_terms = corpus_counts(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(n_docs, n_terms)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                block.add(batch.column(0).slice(chunk.first, chunk.rows), chunk)
                if block.size >= BLOCK_BYTES or block.docs >= BLOCK_DOCS:
                    yield from block.finish()
        yield from block.finish()

    return SearchIndex(staged(plain.mapInArrow(run, INDEX)), n_docs, n_terms)


def _names(terms: bytes, lengths: bytes) -> pa.Array:
    return _binary(np.frombuffer(zstandard.ZstdDecompressor().decompress(terms), np.uint8), _unpack(lengths, "<i4"))


def document_counts(index: SearchIndex, wanted: list[str]) -> dict[str, int]:
    """Documents that hold each of the wanted terms; reads the dictionaries of the blocks alone."""
    names = pa.array(sorted(w.encode() for w in set(wanted)), pa.large_binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for terms, lengths, df in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = pc.index_in(names, value_set=_names(terms, lengths))
                known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                total[known] += _unpack(df, "<i4")[at.drop_null().to_numpy()]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["term", "df"])

    counted = index.blocks.select("terms", "lengths", "df").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    spelt = names.to_pylist()
    return {spelt[r["term"]].decode(): r["df"] for r in counted.collect()}


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search(batches: Iterator[pa.RecordBatch], items: list[list[tuple[bytes, int]]], k: int) -> Iterator[pa.RecordBatch]:
    """The best documents of each item over all blocks of a task."""
    names = pa.array(sorted({t for item in items for t, _ in item}), pa.large_binary())
    number = {t: i for i, t in enumerate(names.to_pylist())}
    wanted = [(np.array([number[t] for t, _ in item], np.int64), np.array([w for _, w in item], np.int64)) for item in items]
    best: list[list[tuple[int, float, int | None]]] = [[] for _ in items]
    for batch in batches:
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block = dict(zip(batch.schema.names, values, strict=True))
            at = pc.fill_null(pc.index_in(names, value_set=_names(block["terms"], block["lengths"])), -1).to_numpy()
            tree = Treap.load(block["height"], _unpack(block["sizes"], "<i8"), _unpack(block["mask"], "u1"), _unpack(block["gap"], "<i4"),
                              _unpack(block["rows"], "<i4"), _unpack(block["cols"], "<i4"))
            raw = zstandard.ZstdDecompressor().decompress(block["ids"])
            ids = pa.ipc.read_record_batch(pa.py_buffer(raw), pa.schema([("id", pa.int64())])).column(0)
            for i, (terms, weights) in enumerate(wanted):
                rows = at[terms]
                if not (rows >= 0).any():
                    continue
                floor = -best[i][-1][0] if len(best[i]) == k else 1
                cols, scores = tree.best(rows[rows >= 0], weights[rows >= 0], k, max(floor, 1))
                if len(cols):
                    named = zip(scores.tolist(), ids.take(pa.array(cols)).to_pylist(), strict=True)
                    # rows without an id come last among equal scores
                    met = [(-s, math.inf if d is None else d, d) for s, d in named]
                    best[i] = sorted(best[i] + met, key=lambda x: x[:2])[:k]
    rows = [(i, d, -s) for i, found in enumerate(best) for s, _, d in found]
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                                     names=["item", "doc_id", "score"])


def search(index: SearchIndex, items: DataFrame, item_text: str = "text", item_id: str = "item_id", k: int = 10) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``.

    An item's terms count once each. Documents with a score of 0 are not listed; equal scores are ranked by ascending
    id, rows without an id last. An item without text or terms has no row; each row of ``items`` is an item, repeated
    ones too. Items are taken in blocks of ``ITEM_BLOCK``, each of which reads the index once. Runs jobs.
    """
    spark = items.sparkSession
    answers = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = items.select(F.col(item_id).cast("long"), F.coalesce(F.col(item_text), F.lit(""))).toLocalIterator()
    for part in _blocks(asked, ITEM_BLOCK):
        terms = [sorted(set(terms_of(text))) for _, text in part]
        df = document_counts(index, [t for ts in terms for t in ts])
        known = [[(t.encode(), term_weight(index.n_docs, df[t])) for t in ts if t in df] for ts in terms]
        found = index.blocks.mapInArrow(lambda it, known=known: _search(it, known, k), "item int, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, row[0]) for i, row in enumerate(part)], "item int, item_id long")
        answers = answers.unionByName(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    return answers


def _blocks(rows: Iterator, size: int) -> Iterator[list]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
