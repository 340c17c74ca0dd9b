"""Token ids of whole texts by the ``tokenizers`` library, with each distinct part of a word encoded once per task.

The word vocabulary drops white space and never lets a token or a special string span white space, so the ids of a text
are those of its words in order. A sign always begins a pre-token after a letter or digit, and plain letters are taken
in lower case (both are what the vocabulary's own rule and normaliser do), so words are cut before such signs and their
letters lowered first; ``PartIds`` refuses a tokenizer file without these rules.

Cutting, lowering and the search for distinct parts are done on the bytes of a chunk of texts at once (numpy, Arrow's
dictionary encoding). Only the distinct parts of a chunk are looked up, by their exact spelling, and only those that a
task does not remember go to the library.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cohortlens.llm.arrays import LOWER, SPACE, Chunk, Column, chunks, ragged, sums_by_row

#: Parts whose ids a task keeps; when there are more, those met in one chunk only are forgotten.
MEMO_PARTS = 250_000
#: Parts that go to the library as one text, and the mark of ids that end a word.
JOINED = 512
WORD_END = "</w>"

#: What a byte is: inside a word; a plain letter or digit; a sign that always makes a pre-token of its own after them (an
#: apostrophe may not); the first byte of a two-byte letter (U+00C0 to U+023F, U+0400 to U+047F); the second byte of those
#: that are no letters there (U+00D7, U+00F7) or do not stay one in lower case (U+0130).
INSIDE, ALNUM, SIGN, LEAD, NO_LETTER = 1, 2, 4, 8, 16
KINDS = bytes(
    INSIDE * (not SPACE[b]) + ALNUM * (b < 0x80 and chr(b).isalnum()) + SIGN * (chr(b) in string.punctuation.replace("'", ""))
    + LEAD * (b in (*range(0xC3, 0xC9), 0xD0, 0xD1)) + NO_LETTER * (b in (0x97, 0xB7, 0xB0))
    for b in range(256)
)


def cut_parts(chunk: Chunk) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All parts of the chunk's words in order, and the place of each row's first one (one more place at the end)."""
    data, offsets, raw = chunk.data, chunk.offsets, chunk.data.tobytes()
    kinds = np.frombuffer(raw.translate(KINDS), np.uint8)
    inside = kinds != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[heads] = inside[heads]
    signs = np.flatnonzero(kinds & SIGN)
    last, lead = kinds[np.maximum(signs - 1, 0)], kinds[np.maximum(signs - 2, 0)]
    # a lead byte two places back means a whole character, as the byte between is its second one
    cuts = signs[((last & ALNUM) != 0) | (((lead & LEAD) != 0) & ((last & NO_LETTER) == 0))]
    # a plain letter may be lowered unless a mark follows that could make one character with it
    lower = np.frombuffer(bytearray(raw.translate(LOWER.tobytes())), np.uint8)
    marked = np.flatnonzero(data[1:] >= 0x80)
    lower[marked] = data[marked]
    if b"<|" in raw:  # special strings count as they are spelt
        words = np.append(np.flatnonzero(begins), len(data))
        special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        whole = np.unique(np.searchsorted(words, special, "right") - 1)
        places = ragged(words[whole], words[whole + 1] - words[whole])
        lower[places] = data[places]
        cuts = cuts[~np.isin(cuts, places)]
    begins[cuts] = True
    starts = np.flatnonzero(begins)
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=kept[1:])
    parts = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(np.append(kept[starts], kept[-1])), pa.py_buffer(lower[inside])
    )
    return parts, np.searchsorted(starts, offsets)


class PartIds(dict):
    """The number of each part met so far; ``ids.values[first[k]:first[k] + counts[k]]`` are the ids of part number k."""

    def __init__(self, path: str):
        super().__init__()
        _check_rules(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self._ends[number] = token.endswith(WORD_END)
        self._waiting: list[str] = []
        self.ids, self.first, self.counts = Column(np.uint32), Column(np.int64), Column(np.int64)
        #: Chunks that a part was met in since parts were last forgotten.
        self.uses = Column(np.int64)

    def __missing__(self, part: str) -> int:
        number = len(self)
        self[part] = number
        self._waiting.append(part)
        return number

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The numbers of distinct parts, whose ids are known from here on until parts are forgotten."""
        if len(self) > MEMO_PARTS:
            self.forget()
        out = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        self.settle()
        self.uses.data[out] += 1
        return out

    def forget(self) -> None:
        """Keep the parts met in most chunks: at least two, and at most half of what may be kept."""
        least, uses = 2, self.uses.values
        while np.count_nonzero(uses >= least) > MEMO_PARTS // 2:
            least += 1
        kept = np.flatnonzero(uses >= least)
        parts, counts = list(self), self.counts.values[kept]
        ids = self.ids.values[ragged(self.first.values[kept], counts)]
        self.clear()
        self.update((parts[k], n) for n, k in enumerate(kept.tolist()))
        self.ids, self.first, self.counts, self.uses = Column(np.uint32), Column(np.int64), Column(np.int64), Column(np.int64)
        self.ids.extend(ids)
        self.first.extend(np.cumsum(counts) - counts)
        self.counts.extend(counts)
        self.uses.extend(np.zeros(len(kept), np.int64))

    def settle(self) -> None:
        """Encode the parts that wait."""
        parts = self._waiting
        first, counts = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)

        def add(which: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
            first[which] = self.ids.size + np.cumsum(sizes) - sizes
            counts[which] = sizes
            self.ids.extend(ids)

        letters, others = [], []
        for i, part in enumerate(parts):
            (letters if part.isalpha() else others).append(i)
        # a word of letters is one pre-token, whose last id alone ends a word; so many can go as one text
        groups = [letters[at:at + JOINED] for at in range(0, len(letters), JOINED)]
        joined = self.tokenizer.encode_batch_fast([" ".join([parts[i] for i in x]) for x in groups], add_special_tokens=False)
        for which, encoding in zip(groups, joined, strict=True):
            ids = np.array(encoding.ids, np.uint32)
            ends = np.flatnonzero(self._ends[ids])
            if len(ends) == len(which):
                add(which, ids, np.diff(np.r_[-1, ends]))
            else:
                others += which
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast([parts[i] for i in others], add_special_tokens=False)]
        add(others, np.array([i for x in encoded for i in x], np.uint32), np.array([len(x) for x in encoded], np.int64))
        self.first.extend(first)
        self.counts.extend(counts)
        self.uses.extend(np.zeros(len(parts), np.int64))
        self._waiting = []

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of parts, and how many each part has."""
        counts = self.counts.data[numbers]
        return self.ids.data[ragged(self.first.data[numbers], counts)], counts


def _check_rules(path: str) -> None:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    drops_space = any(s["type"] == "Split" and s.get("invert") and r"[^\s\p{L}\p{N}]+" in s["pattern"].get("Regex", "") for s in steps)
    lower = any(s["type"] == "Lowercase" for s in (spec.get("normalizer") or {}).get("normalizers", []))
    if not (drops_space and lower):
        raise ValueError(f"{path} is not a lower-casing word vocabulary that drops white space")


_memos: dict[str, PartIds] = {}


def encode_texts(values: pa.Array | list[str], path: str, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids of the texts in pieces: the number of the first text, all ids in order, ids per text.

    ``end_id``, if given, follows the ids of every text, empty ones included.
    """
    if path not in _memos:
        _memos[path] = PartIds(path)
    memo = _memos[path]
    if isinstance(values, list):
        values = pa.array(values, pa.large_string())
    for chunk in chunks(values):
        parts, first = cut_parts(chunk)
        parts = parts.dictionary_encode()
        numbers = memo.numbers(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, counts = memo.ids_of(numbers[parts.indices.to_numpy()])
        per_text = sums_by_row(counts, first)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(per_text), end_id)
            per_text = per_text + 1
        yield chunk.first, ids, per_text
