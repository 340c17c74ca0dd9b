"""Runs of words that very many documents have, by one counting pass over all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrays import LOWER, Chunk, Words, chunks, find_words, hash_runs, hash_words, run_starts
from cohortlens.llm.spark_util import staged

#: Share of the documents from which a run counts as frequent. As all documents together have ``n`` runs each on
#: average, at most ``n / SHARE`` runs are frequent, however many documents there are.
SHARE = 0.0005
#: Documents counted together before anything is sent on.
BLOCK_DOCS = 5_000


def distinct_runs(chunk: Chunk, size: int, lower: bool) -> tuple[np.ndarray, np.ndarray, Words]:
    """Distinct hashes of runs of ``size`` words per row, ascending in each row; their numbers per row; the words.

    A row with fewer words, but at least one, has its whole sequence as its only run.
    """
    data = LOWER[chunk.data] if lower else chunk.data
    words = find_words(chunk)
    hashes = hash_words(data, words)
    spots, lengths = run_starts(words.first, size)
    runs = hash_runs(hashes, size)[spots] if len(spots) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.counts > 0) & (lengths == 0))
    if len(short):
        whole = np.array([hash_runs(hashes[words.first[i]:words.first[i + 1]], words.counts[i])[0] for i in short], np.uint64)
        places = (np.cumsum(lengths) - lengths)[short]
        runs = np.insert(runs, places, whole ^ np.uint64(0x5555555555555555))
        lengths = lengths.copy()
        lengths[short] = 1
    owner = np.repeat(np.arange(chunk.rows), lengths)
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return runs[new], np.bincount(owner[new], minlength=chunk.rows), words


class BlockCounts:
    """Counts runs over blocks of documents; ``add`` and ``finish`` yield what a block sends on."""

    def __init__(self, share: float = SHARE):
        self.share, self.held, self.docs = share, [], 0

    def add(self, runs: np.ndarray, docs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.held.append(runs)
        self.docs += docs
        if self.docs >= BLOCK_DOCS:
            yield from self.finish()

    def finish(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.docs:
            return
        runs = np.concatenate(self.held)
        found, counts = np.unique(runs, return_counts=True)
        often = counts >= max(2.0, self.share / 4 * self.docs)
        # two totals travel with the counts
        yield (
            np.concatenate([found[often].view(np.int64), np.array(TOTALS)]),
            np.concatenate([counts[often], np.array([self.docs, len(runs)])]),
        )
        self.held, self.docs = [], 0


#: Stand for the number of documents and the sum of their distinct runs among the counted runs.
TOTALS = [-1, -2]


def summarise(counted: DataFrame, share: float = SHARE) -> tuple[np.ndarray, int, int]:
    """Sorted hashes of the frequent runs, number of documents, sum of distinct runs.

    ``counted`` has the rows of ``BlockCounts`` as ``run, n``. Every document is counted. A block of documents sends on
    the runs that reach a quarter of the share within it, and half of the share is asked of the sum, so a run above the
    share is found unless it is far from evenly spread. The list only guides the choice of keys; results do not depend
    on it.
    """
    summed = staged(counted.groupBy("run").agg(F.sum("n").alias("n")))
    totals = {r["run"]: r["n"] for r in summed.where(F.col("run").isin(TOTALS)).collect()}
    n_docs, n_runs = (totals.get(t, 0) for t in TOTALS)
    often = summed.where((F.col("n") >= F.lit(max(2.0, share / 2 * n_docs))) & ~F.col("run").isin(TOTALS))
    rows = often.select("run").toArrow()  # at most 2 / share times the mean number of runs of a document: 16 MB where that is 500
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64)), n_docs, n_runs


def frequent_runs(texts: DataFrame, size: int, lower: bool, share: float = SHARE) -> tuple[np.ndarray, int, int]:
    """``summarise`` over the runs of ``size`` words of a frame with a ``text`` column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = BlockCounts(share)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                for found in block.add(distinct_runs(chunk, size, lower)[0], chunk.rows):
                    yield _counts(*found)
        for found in block.finish():
            yield _counts(*found)

    return summarise(texts.select("text").mapInArrow(run, "run long, n long"), share)


def _counts(runs: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(numbers, pa.int64())], names=["run", "n"])


def is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which ``values`` a sorted table has."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values
