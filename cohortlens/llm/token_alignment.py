"""Alignment of two tokenizers over a corpus, with pairs of tokens counted by external spills.

Both tokenizers cut the same bytes, a space and the text. Offsets at which a token of each ends cut them into groups, and the
two tokens that end a group are linked. How often a pair of ids is linked in the whole corpus tells which token of one
side stands for a token of the other.

1. A task encodes blocks of documents. A block's records (pair, document, times) are sorted with the ids of the second
   side first, cut by the low bits of that id (radix), and written as one zstd run a part: pairs and their sums apart from
   documents and times, so that counting reads the former alone. A block is one row of a written table.
2. The runs of a part are merged through a heap, at most ``FAN_IN`` of them by one task, in as many rounds as that takes.
   Equal pairs meet and are summed. The last merge passes all pairs of an id of the second side one after another, so its highest count
   is known when the next id comes.
3. Each block's runs are read again beside the counted pairs, in the same order, and what a pair contributes goes back to
   the documents of the block. No document and no record is shuffled.

Linked tokens end together, so one's bytes are the end of the other's. The number of different pairs is thus bounded by the
bytes of both vocabularies, whatever the corpus; that is why the counted pairs may be sent to all tasks.

Tokens never cross the place between a character that is no white space and a white-space character after it, in either vocabulary (files
without that rule are refused). So a text's tokens are those of its segments, and a task encodes each distinct segment once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrays import Column, ragged
from cohortlens.llm.spark_util import staged, texts

#: Characters of text in one block, and documents at most; a longer text is a block of its own.
BLOCK_CHARS = 8 << 20
BLOCK_DOCS = 1 << 20
#: Characters of text that are handled at once.
PIECE_CHARS = 1 << 20
#: Segments whose tokens a task keeps; when there are more it starts afresh.
MEMO_SEGMENTS = 500_000
#: Segments that go to the libraries as one text.
JOINED = 1_000
#: Radix parts (low bits of the second side's id), and runs that one task merges.
PART_BITS = 4
FAN_IN = 128
#: Bits of an id, and of a document's number in its block.
ID_BITS, DOC_BITS = 20, 24

#: A carriage return (pieces may end in one), white space beyond ASCII and what some library may take for it; a text with any of these is cut with more care.
UNUSUAL = "".join(map(chr, [
    0x0D, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF,
]))
ANY_UNUSUAL = re.compile(f"[{UNUSUAL}]")
SEGMENT = re.compile(r"[ \t\n\f\v]*[^ \t\n\f\v]+|[ \t\n\f\v]+")
CAREFUL = re.compile(rf"(?<=[^\s{UNUSUAL}])(?=[ \t\n\f\v])")


def segments(text: str) -> list[str]:
    """The text in parts that both tokenizers cut on their own."""
    return CAREFUL.split(text) if ANY_UNUSUAL.search(text) else SEGMENT.findall(text)


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Side:
    """One tokenizer: ``ids(text)`` of a text that a space precedes, and the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as file:
                rules = json.load(file)
            before = rules.get("pre_tokenizer") or {}
            if before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or rules.get("normalizer"):
                raise ValueError(f"{path} is not a byte-level vocabulary that cuts before white space")
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            alphabet, special = _byte_alphabet(), {t["id"] for t in rules.get("added_tokens", [])}
            self.spelling = [b""] * tokenizer.get_vocab_size()
            for token, i in tokenizer.get_vocab().items():
                self.spelling[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
            self._ids = lambda text: tokenizer.encode(" " + text, add_special_tokens=False).ids
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.spelling = []
            for i in range(model.vocab_size()):
                piece = model.id_to_piece(i)
                if len(piece) > 1 and re.search("[^▁]▁|[ \t\n\f\v]", piece):
                    raise ValueError(f"{path} has a piece with white space inside")
                self.spelling.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
            self._ids = lambda text: model.encode(text)
        if len(self.spelling) >= 1 << ID_BITS:
            raise ValueError(f"{path} has more than {1 << ID_BITS} ids")
        self.lengths = np.array([len(s) for s in self.spelling], np.int64)

    def ids(self, text: str) -> np.ndarray | None:
        """The ids of a space and ``text``; nothing if their bytes are others."""
        ids = self._ids(text)
        spelt = b"".join([self.spelling[i] for i in ids])
        return np.array(ids, np.int64) if spelt == (" " + text).encode() else None


class Segments(dict):
    """The number of each segment met so far, and its tokens, groups and links."""

    def __init__(self, first: str, second: str):
        super().__init__()
        self.sides = Side(first), Side(second)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self._waiting: list[str] = []
        self.groups: list[str] = []
        self.good, self.n_a, self.n_b = Column(np.bool_), Column(np.int64), Column(np.int64)
        self.first, self.links, self.pairs = Column(np.int64), Column(np.int64), Column(np.uint64)

    def __missing__(self, segment: str) -> int:
        number = len(self)
        self[segment] = number
        self._waiting.append(segment)
        return number

    def settle(self) -> None:
        """Encode the segments that wait, many at a time."""
        while self._waiting:
            some, self._waiting = self._waiting[:JOINED], self._waiting[JOINED:]
            at = 0
            while at < len(some):  # white space alone would run into the next segment
                stop = at
                while stop < len(some) and some[stop].strip():
                    stop += 1
                self._add(some[at:max(stop, at + 1)])
                at = max(stop, at + 1)

    def _add(self, some: list[str]) -> None:
        if not some:
            return
        # one letter comes first, so that a space of a segment is not taken for the space before the text
        text = "x" + "".join(some)
        a, b = (side.ids(text) for side in self.sides)
        if a is None or b is None:
            if len(some) > 1:
                for segment in some:
                    self._add([segment])
                return
            self._put(some, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), False)
            return
        ends = np.cumsum([len(s.encode()) for s in some])
        ends_a, ends_b = (np.cumsum(side.lengths[ids]) - 2 for side, ids in zip(self.sides, (a, b), strict=True))
        if not (ends_a[0] == 0 == ends_b[0] and np.isin(ends, ends_a).all() and np.isin(ends, ends_b).all()):
            raise ValueError("a token crosses the beginning of white space")
        self._put(some, a[1:], b[1:], ends, True, ends_a[1:], ends_b[1:])

    def _put(self, some: list[str], a: np.ndarray, b: np.ndarray, ends: np.ndarray, good: bool, ends_a=None, ends_b=None) -> None:
        if not good:
            ends_a = ends_b = np.zeros(0, np.int64)
        common, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        spelt_a, spelt_b = [str(i) for i in a.tolist()], [str(i) for i in b.tolist()]
        groups, i, j = [], 0, 0
        for p, q in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
            groups.append(",".join(spelt_a[i:p]) + "|" + ",".join(spelt_b[j:q]))
            i, j = p, q
        stops = np.searchsorted(common, ends, "right") if good else np.zeros(1, np.int64)
        counts = np.diff(np.r_[0, stops])
        start = 0
        for stop in stops.tolist():
            self.groups.append(";".join(groups[start:stop]))
            start = stop
        self.good.extend(np.full(len(some), good))
        self.n_a.extend(np.diff(np.r_[0, np.searchsorted(ends_a, ends, "right")]) if good else np.zeros(1, np.int64))
        self.n_b.extend(np.diff(np.r_[0, np.searchsorted(ends_b, ends, "right")]) if good else np.zeros(1, np.int64))
        self.first.extend(self.pairs.size + np.cumsum(counts) - counts)
        self.links.extend(counts)
        self.pairs.extend(pair_keys(a[at_a], b[at_b]) if good else np.zeros(0, np.uint64))


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number per pair: the part, the rest of the second side's id, the first side's id."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    low = b & np.uint64((1 << PART_BITS) - 1)
    return ((low << np.uint64(ID_BITS - PART_BITS) | b >> np.uint64(PART_BITS)) << np.uint64(ID_BITS)) | a


def pair_ids(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second side's id of each key."""
    side = keys >> np.uint64(ID_BITS)
    low = side >> np.uint64(ID_BITS - PART_BITS)
    b = (side & np.uint64((1 << ID_BITS - PART_BITS) - 1)) << np.uint64(PART_BITS) | low
    return (keys & np.uint64((1 << ID_BITS) - 1)).astype(np.int64), b.astype(np.int64)


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.astype(kind).tobytes())


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)), "<u8")


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, "<u8"), dtype=np.uint64)


BLOCKS = "docs binary, pairs array<binary>, sums array<binary>, owners array<binary>, times array<binary>"
PER_DOCUMENT = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]

_memos: dict[tuple[str, str], Segments] = {}


class Block:
    """Documents whose records are sorted and written together."""

    def __init__(self, paths: tuple[str, str], with_groups: bool):
        if paths not in _memos:
            _memos[paths] = Segments(*paths)
        self.memo, self.with_groups = _memos[paths], with_groups
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in range(6)]
        self.records: list[np.ndarray] = []
        self.chars = 0

    def add(self, ids: list[int | None], values: list[str]) -> None:
        """Some documents, whose texts are handled at once."""
        memo = self.memo
        if len(memo) > MEMO_SEGMENTS:
            memo.reset()
        parts = [[memo[s] for s in segments(" " + v)] if v else [] for v in values]
        memo.settle()
        sizes = np.array([len(p) for p in parts], np.int64)
        flat = np.fromiter((n for p in parts for n in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(parts)), sizes)
        good = np.bincount(owner, weights=~memo.good.values[flat], minlength=len(parts)) == 0
        counted = [np.where(good, np.bincount(owner, weights=c.values[flat], minlength=len(parts)).astype(np.int64), 0) for c in (memo.n_a, memo.n_b, memo.links)]
        spelt = [";".join([memo.groups[n] for n in p]) if ok else "" for p, ok in zip(parts, good.tolist(), strict=True)]
        hashed = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelt]
        first_doc = len(self.columns[0])
        for column, more in zip(self.columns, (ids, *(c.tolist() for c in counted), hashed, spelt if self.with_groups else []), strict=True):
            column += more
        kept = good[owner]
        links = memo.links.values[flat[kept]]
        keys = memo.pairs.data[ragged(memo.first.values[flat[kept]], links)]
        docs = np.repeat(owner[kept] + first_doc, links).astype(np.uint64)
        self.records.append((keys << np.uint64(DOC_BITS)) | docs)
        self.chars += sum(map(len, values))

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.columns[0]:
            return
        records, times = np.unique(np.concatenate(self.records), return_counts=True)
        keys, owners = records >> np.uint64(DOC_BITS), (records & np.uint64((1 << DOC_BITS) - 1)).astype(np.uint32)
        edges = np.searchsorted(keys, np.arange((1 << PART_BITS) + 1, dtype=np.uint64) << np.uint64(2 * ID_BITS - PART_BITS))
        runs: list[list[bytes]] = [[], [], [], []]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            part = keys[start:stop]
            heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            sums = np.add.reduceat(times[start:stop], heads) if len(heads) else heads
            runs[0].append(_pack_keys(part[heads]))
            runs[1].append(_pack(sums, "<i8"))
            # a pair's documents ascend: the first as it is, then steps; with how many documents each pair has
            steps = np.diff(owners[start:stop].astype(np.int64), prepend=0)
            steps[heads] = owners[start:stop][heads]
            runs[2].append(_pack(np.r_[len(heads), np.diff(np.r_[heads, stop - start]), steps], "<u4"))
            runs[3].append(_pack(times[start:stop], "<u4"))
        names = [*PER_DOCUMENT, "groups"] if self.with_groups else PER_DOCUMENT
        kinds = [pa.int64()] * 4 + [pa.string(), pa.large_string()]
        table = pa.record_batch([pa.array(c, k) for c, k in zip(self.columns[:len(names)], kinds, strict=False)], names=names)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([sink.getvalue().to_pybytes()], pa.binary()), *(pa.array([r], pa.list_(pa.binary())) for r in runs)],
            names=["docs", "pairs", "sums", "owners", "times"],
        )
        self.clear()


def _runs_of(table: pa.Table) -> Iterator[Iterator[tuple[int, int]]]:
    for pairs, sums in zip(table.column("pairs").to_pylist(), table.column("sums").to_pylist(), strict=True):
        yield zip(_unpack_keys(pairs).tolist(), _unpack(sums, "<i8").tolist(), strict=True)


def merged(runs: list[Iterator[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    """Distinct pairs of sorted runs in ascending order, with their sums."""
    last, total = None, 0
    for key, n in heapq.merge(*runs):
        if key != last:
            if last is not None:
                yield last, total
            last, total = key, 0
        total += n
    if last is not None:
        yield last, total


def with_maxima(counted: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Key, count, and the highest count of the key's second side, whose keys come one after another."""
    held: list[tuple[int, int]] = []
    for key, n in counted:
        if held and held[0][0] >> ID_BITS != key >> ID_BITS:
            most = max(c for _, c in held)
            yield from ((k, c, most) for k, c in held)
            held = []
        held.append((key, n))
    most = max((c for _, c in held), default=0)
    yield from ((k, c, most) for k, c in held)


def _merge_some(table: pa.Table) -> pa.Table:
    pairs = list(merged(list(_runs_of(table))))
    keys, sums = np.array([k for k, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "pairs": pa.array([_pack_keys(keys)], pa.binary()),
                     "sums": pa.array([_pack(sums, "<i8")], pa.binary())})


def _merge_all(table: pa.Table) -> pa.Table:
    rows = list(with_maxima(merged(list(_runs_of(table)))))
    a, b = pair_ids(np.array([k for k, _, _ in rows], np.uint64))
    return pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "n": pa.array([n for _, n, _ in rows], pa.int64()),
                     "most": pa.array([m for _, _, m in rows], pa.int64())})


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_blocks(docs: DataFrame, paths: tuple[str, str], with_groups: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Step 1: the written blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(paths, with_groups)
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(values):
                stop, taken = at, 0
                while stop < len(values) and (stop == at or taken + len(values[stop]) <= PIECE_CHARS):
                    taken += len(values[stop])
                    stop += 1
                block.add(ids[at:stop], values[at:stop])
                at = stop
                if block.chars >= BLOCK_CHARS or len(block.columns[0]) >= BLOCK_DOCS:
                    yield from block.finish()
        yield from block.finish()

    return staged(texts(docs, text, doc_id).mapInArrow(run, BLOCKS))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Step 2: ``a, b, n, most``: each linked pair of ids, its links in the corpus, and the highest such count of ``b``."""
    runs = blocks.select(F.posexplode(F.arrays_zip("pairs", "sums")).alias("part", "run")).select("part", "run.pairs", "run.sums")
    n_runs = blocks.count()
    while n_runs > FAN_IN:
        n_runs = -(-n_runs // FAN_IN)
        salt = F.pmod(F.xxhash64("pairs", "sums"), F.lit(n_runs))
        runs = staged(runs.withColumn("salt", salt).groupBy("part", "salt").applyInArrow(_merge_some, "part int, pairs binary, sums binary"))
    return runs.groupBy("part").applyInArrow(_merge_all, "a int, b int, n long, most long")


def align_documents(
    docs: DataFrame, first: str | None = None, second: str | None = None, with_groups: bool = False, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Per row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, if asked for, ``groups``.

    ``n_best`` counts the links whose pair has the highest count of its second id, ties included; ``count_sum`` is the
    sum of the counts over the links. ``groups`` is spelt ``a1,a2|b1;a3|b2,b3``. A text that is null or empty, or whose
    tokens spell other bytes than a space and the text, has no tokens: zeros, and empty strings. Repeated rows count, and are listed, once each; a
    null id stays null; an empty table gives no row; other columns are not read. Runs jobs.
    """
    default = default_paths()
    paths = (first or default[0], second or default[1])
    blocks = aligned_blocks(docs, paths, with_groups, text, doc_id)
    counted = staged(pair_counts(blocks))
    bound = sum(int(Side(p).lengths.sum()) for p in paths)
    size = counted.count()
    if size > bound:
        raise RuntimeError(f"{size} pairs, where the vocabularies allow {bound}")
    table = counted.toArrow()
    keys = pair_keys(table.column("a").to_numpy(), table.column("b").to_numpy())
    order = np.argsort(keys)
    keys, n = keys[order], table.column("n").to_numpy()[order]
    best = n == table.column("most").to_numpy()[order]
    sent = docs.sparkSession.sparkContext.broadcast((keys, n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _contributions(row, *sent.value)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.select("docs", "pairs", "owners", "times").mapInArrow(run, schema + (", groups string" if with_groups else ""))


def _contributions(block: dict, keys: np.ndarray, n: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """Step 3, one block: what its pairs contribute to its documents."""
    docs = pa.ipc.open_stream(block["docs"]).read_all().combine_chunks()
    n_best, count_sum = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for pairs, owners, times in zip(block["pairs"], block["owners"], block["times"], strict=True):
        pairs, owners, times = _unpack_keys(pairs), _unpack(owners, "<u4"), _unpack(times, "<u4").astype(np.int64)
        per_pair = owners[1:1 + owners[0]].astype(np.int64)
        steps = np.cumsum(owners[1 + owners[0]:].astype(np.int64))
        starts = np.cumsum(per_pair) - per_pair
        owner = steps - np.repeat(np.where(starts > 0, steps[starts - 1], 0) if len(steps) else starts, per_pair)
        at = np.repeat(np.searchsorted(keys, pairs), per_pair)
        np.add.at(count_sum, owner, times * n[at])
        np.add.at(n_best, owner, times * best[at])
    groups = [docs.column("groups").cast(pa.string()).combine_chunks()] if "groups" in docs.column_names else []
    columns = [docs.column(c).combine_chunks() for c in PER_DOCUMENT]
    names = [*PER_DOCUMENT[:4], "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * len(groups)]
    return pa.RecordBatch.from_arrays([*columns[:4], columns[3], pa.array(n_best), pa.array(count_sum), columns[4], *groups], names=names)
