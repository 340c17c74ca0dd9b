"""Token counts of a word-level byte-pair vocabulary by rank-synchronous array merging.

The distinct pre-tokens of a batch lie side by side in one ragged array of symbols. In each round every sequence finds
the lowest rank among its adjacent pairs and merges all places of that pair at once, left to right. Sequences without a
ranked pair are done; their surviving symbols are counted. A task remembers the counts of words it has met, up to a
bound, so that a text costs one dictionary lookup per word.

Merging all places of the lowest pair at once equals merging them one by one, because no pair that a merge can create
ranks below it; ``MergeTable`` checks this for the vocabulary it is given.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from cohortlens.llm.spark_util import texts

#: Words whose counts a task keeps; when there are more it starts afresh.
MEMO_WORDS = 500_000
#: Pre-tokens merged together.
BATCH = 50_000
NO_RANK = np.iinfo(np.int32).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class MergeTable:
    """Vocabulary, merge ranks and pre-token rule of a tokenizer file."""

    def __init__(self, path: str):
        self._path, self._library = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.end = spec["model"]["end_of_word_suffix"]
        first, second, merged = (
            np.array([vocab[x] for x in part], np.int64)
            for part in zip(*((a, b, a + b) for a, b in merges), strict=True)
        )
        self._check_order(first, second, merged, len(vocab))
        keys = (first << 32) | second
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        self._merged = merged.astype(np.int32)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pre_token = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._special_split = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")")
        byte_letters = _byte_letters()
        self._inner = np.array([vocab[x] for x in byte_letters], np.int32)
        self._last = np.array([vocab[x + self.end] for x in byte_letters], np.int32)

    @staticmethod
    def _check_order(first: np.ndarray, second: np.ndarray, merged: np.ndarray, size: int) -> None:
        ranks = np.arange(len(merged))
        earliest_use = np.full(size, len(merged))
        for part in (first, second):
            np.minimum.at(earliest_use, part, ranks)
        if (earliest_use[merged] <= ranks).any():
            raise ValueError("a merge creates a pair of lower rank; this vocabulary needs one merge at a time")

    def pre_tokens(self, word: str) -> tuple[list[bytes], int]:
        """The UTF-8 pre-tokens of a text, and how many special tokens it has."""
        found, special = [], 0
        for part in self._special_split.split(word) if "<|" in word else [word]:
            if part in self.special:
                special += 1
                continue
            if not part.isascii():
                if any(unicodedata.category(c) == "Cn" for c in part):
                    found += self._pre_tokens_by_library(part)
                    continue
                part = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
            else:
                part = part.lower()
            found += self.pre_token.findall(part)
        return [x.encode() for x in found], special

    def _pre_tokens_by_library(self, part: str) -> list[str]:
        """For characters that not every version of Unicode knows; ``regex`` may call one a letter that the library does not."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        part = self._library.normalizer.normalize_str(part)
        return [part[start:end] for _, (start, end) in self._library.pre_tokenizer.pre_tokenize_str(part)]

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self._keys, pairs), len(self._keys) - 1)
        return np.where(self._keys[at] == pairs, self._ranks[at], NO_RANK)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The vocabulary ids of each pre-token."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self._inner[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self._last[data[ends - 1]]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.full(len(symbols), NO_RANK, np.int32)
            if len(symbols) > 1:
                inside = owner[1:] == owner[:-1]
                pairs = (symbols[:-1].astype(np.int64) << 32) | symbols[1:]
                rank[:-1][inside] = self.ranks(pairs[inside])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            spread = np.repeat(lowest, sizes)
            over = spread == NO_RANK
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
            here = (rank == spread) & ~over
            spots = np.flatnonzero(here)
            if len(spots):
                # of overlapping places (a a a) every other one counts, from the left
                run = np.cumsum(np.r_[True, (spots[1:] - spots[:-1] > 1) | (owner[spots[1:]] != owner[spots[:-1]])])
                begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                spots = spots[(np.arange(len(spots)) - begin[run - 1]) % 2 == 0]
            symbols[spots] = self._merged[rank[spots]]
            keep = ~over
            keep[spots + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return [np.zeros(0, np.int32) for _ in pieces]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.split(symbols[order], np.cumsum(np.bincount(owner, minlength=len(pieces)))[:-1])

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        out = np.zeros(len(pieces), np.int64)
        for at in range(0, len(pieces), BATCH):
            part = pieces[at:at + BATCH]
            out[at:at + len(part)] = [len(x) for x in self.merge(part)]
        return out


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordCounts(dict):
    """Tokens by word. A word not met before gets a number below zero and waits for the next ``settle``."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.table, self.waiting = table, []

    def __missing__(self, word: str) -> int:
        self.waiting.append(word)
        self[word] = -len(self.waiting)
        return -len(self.waiting)

    def settle(self) -> np.ndarray:
        """Count the waiting words; position k of the result is that of the word numbered ``-k``."""
        pieces, owner = [], []
        totals = np.zeros(len(self.waiting) + 1, np.int64)
        for k, word in enumerate(self.waiting, 1):
            found, totals[k] = self.table.pre_tokens(word)
            pieces += found
            owner += [k] * len(found)
        if pieces:
            np.add.at(totals, owner, self._distinct_counts(pieces))
        self.update(zip(self.waiting, totals[1:].tolist(), strict=True))
        self.waiting = []
        return totals

    def _distinct_counts(self, pieces: list[bytes]) -> np.ndarray:
        place = {x: i for i, x in enumerate(dict.fromkeys(pieces))}
        return self.table.count(list(place))[np.fromiter((place[x] for x in pieces), np.int64, len(pieces))]


_tables: dict[str, WordCounts] = {}


def _counts_for(path: str) -> WordCounts:
    if path not in _tables or len(_tables[path]) > MEMO_WORDS:
        table = _tables[path].table if path in _tables else MergeTable(path)
        _tables[path] = WordCounts(table)
    return _tables[path]


def count_batch(values: list[str], path: str) -> np.ndarray:
    """Tokens of each text. Spaces and line breaks never lie inside a token, so words are counted one by one."""
    out = np.zeros(len(values), np.int64)
    at = 0
    while at < len(values):
        memo = _counts_for(path)
        numbers, sizes, taken = [], [], 0
        while at + len(sizes) < len(values) and taken < (1 << 20):
            text = values[at + len(sizes)]
            words = text.replace("\n", " ").split(" ")
            numbers.append(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))
            sizes.append(len(words))
            taken += len(text)
        flat = np.concatenate(numbers)
        fresh = memo.settle()
        new = flat < 0
        flat[new] = fresh[-flat[new]]
        out[at:at + len(sizes)] = np.add.reduceat(flat, np.cumsum(sizes) - sizes)
        at += len(sizes)
    return out


def count_tokens(docs: DataFrame, vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: ``doc_id, n_bytes`` (UTF-8) and ``n_tokens``, without begin, end or added special tokens.

    The strings of special tokens inside a text count as that token. A null text counts as empty (no bytes, no tokens);
    repeated rows are counted once each; an empty table gives an empty result; other columns are not read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.compute.cast(pa.compute.binary_length(column), pa.int64()),
                 pa.array(count_batch(column.to_pylist(), path), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return texts(docs, text, doc_id).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
