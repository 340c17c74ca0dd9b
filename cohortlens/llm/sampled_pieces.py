"""SentencePiece encoding by sampling segmentations without replacement, and decoding.

A text's lattice has a node between any two characters and an edge for each piece; an edge's weight is its piece's log
probability times ``ALPHA``. The vocabulary's scores are merge ranks, so a piece's probability is taken to fall with its rank by Zipf's law. A
segmentation is a path; its probability is that of the exponential family over all paths.

Gumbel top-k: give every path its log probability plus a Gumbel variable and take the k largest; that samples k distinct paths
without replacement. The paths are never listed. Sums over all ways from a node to the end turn the lattice into a
tree of choices whose log probabilities are known, the largest value below a node is one Gumbel variable, and the search is A-star
with that exact bound: it follows the best child, keeps the other children of every node on the way as one subtree with
its own bound (a Gumbel variable cut off at the parent's), and reopens the best subtree for the next sample. The bound of the subtree
left best after k samples is the threshold from which a sample's inclusion probability follows.

Pieces never reach over a space or a line break, so the lattice is a chain of word lattices. Each distinct word is compiled once
per task; choices are then made for all words of a batch side by side, in numpy. Random numbers are hashes of the row's
key, the sample, the word and the step, so a row has the same samples in whatever batch or task it is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrays import Column, mix
from cohortlens.llm.spark_util import texts

SAMPLES = 2
ALPHA = 0.5
ZIPF_SHIFT = 2.7
#: Words a task keeps compiled; when there are more it starts afresh.
MEMO_WORDS = 250_000
#: Characters of text sampled side by side; a longer text is handled on its own.
CHUNK_CHARS = 1 << 19
SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTrie:
    """Pieces of a model by their characters, with their log probabilities."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("a  B ﬁ") != f"{SPACE}a{SPACE}{SPACE}B ﬁ":
            raise ValueError(f"{path} changes texts before it cuts them; only the identity with a leading space is handled")
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", model.id_to_piece(i)) for i in plain):
            raise ValueError(f"{path} has pieces that reach over a space or a line break")
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
        rank = {i: min(-model.get_score(i), float(len(plain))) for i in plain}
        weight = {i: 1.0 / (rank[i] + ZIPF_SHIFT) for i in plain}
        total = sum(weight.values())
        self.log_p = np.zeros(n)
        for i in plain:
            self.log_p[i] = np.log(weight[i] / total)
        self.byte_log_p = float(self.log_p.min())
        states, edges = {"": 0}, {}
        piece_of = [-1]
        for i in plain:
            piece = model.id_to_piece(i)
            for end in range(1, len(piece) + 1):
                if piece[:end] not in states:
                    states[piece[:end]] = len(piece_of)
                    edges[states[piece[:end - 1]] << 21 | ord(piece[end - 1])] = len(piece_of)
                    piece_of.append(-1)
            piece_of[states[piece]] = i
        self.keys = np.array(sorted(edges), np.int64)
        self.next = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.array(piece_of, np.int64)

    def edges(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in words whose characters lie in one array (``ends``: where each character's word ends):
        first character, length, piece; -1 - code point where only bytes can spell a character."""
        start, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        found, length = [], 0
        spelled = np.zeros(len(chars), bool)
        while len(start):
            inside = start + length < ends[start]
            start, state = start[inside], state[inside]
            key = state << 21 | chars[start + length]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            start, state, length = start[hit], self.next[at[hit]], length + 1
            piece = self.piece[state]
            whole = piece >= 0
            found.append((start[whole], np.full(int(whole.sum()), length), piece[whole]))
            if length == 1:
                spelled[start[whole]] = True
        bare = np.flatnonzero(~spelled)
        found.append((bare, np.ones(len(bare), np.int64), -1 - chars[bare]))
        first, size, piece = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((size, first))
        return first[order], size[order], piece[order]


class Lattices(dict):
    """Compiled words by number. Nodes are numbered over all words; an edge leads to a node, or to -1 at a word's end."""

    def __init__(self, trie: PieceTrie, alpha: float):
        super().__init__()
        self.trie, self.alpha = trie, alpha
        self.waiting: list[str] = []
        self.root, self.edge_first = Column(np.int32), Column(np.int32)
        self.source, self.target, self.piece = Column(np.int32), Column(np.int32), Column(np.int32)
        self.above, self.log_p = Column(np.float64), Column(np.float64)
        self.edge_first.extend(np.zeros(1, np.int64))

    def __missing__(self, word: str) -> int:
        number = len(self)
        self[word] = number
        self.waiting.append(word)
        return number

    def settle(self) -> None:
        """Compile the words that wait."""
        if not self.waiting:
            return
        lengths = np.fromiter(map(len, self.waiting), np.int64, len(self.waiting))
        chars = np.frombuffer("".join(self.waiting).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.repeat(np.cumsum(lengths), lengths)
        first, size, piece = self.trie.edges(chars, ends)
        weight = self.alpha * np.where(piece >= 0, self.trie.log_p[np.maximum(piece, 0)], self._bytes(piece) * self.trie.byte_log_p)
        beta = np.zeros(len(chars) + 1)
        to = first + size
        last = to == ends[first]
        left = ends[first] - first  # characters from the edge's start to the end of its word
        order = np.argsort(left, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(left[order]) > 0, True]) if len(order) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            edge = order[a:b]
            value = weight[edge] + np.where(last[edge], 0.0, beta[to[edge]])
            heads = np.flatnonzero(np.r_[True, first[edge][1:] != first[edge][:-1]])
            top = np.maximum.reduceat(value, heads)
            size_of = np.diff(np.append(heads, len(edge)))
            beta[first[edge][heads]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, size_of)), heads))
        log_p = np.minimum(weight + np.where(last, 0.0, beta[to]) - beta[first], 0.0)
        p = np.exp(log_p)
        counts = np.bincount(first, minlength=len(chars))
        begin = np.cumsum(counts) - counts
        sums = np.cumsum(p)
        above = sums - np.r_[0.0, sums][begin[first]]
        above[begin + counts - 1] = 2.0  # the last edge of a node takes what is left
        nodes = self.edge_first.size - 1
        self.root.extend(nodes + np.cumsum(lengths) - lengths)
        edges = self.log_p.size
        self.edge_first.extend(edges + np.cumsum(counts))
        self.source.extend(nodes + first)
        self.target.extend(np.where(last, -1, nodes + to))
        ascii_byte = (piece < 0) & (piece >= -128)
        self.piece.extend(np.where(ascii_byte, self.trie.byte_ids[np.clip(-1 - piece, 0, 127)], piece))
        self.above.extend(above)
        self.log_p.extend(log_p)
        self.waiting = []

    @staticmethod
    def _bytes(piece: np.ndarray) -> np.ndarray:
        code = -1 - piece
        return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _cut_gumbel(location: np.ndarray, below: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location``, given that they are at most ``below``."""
    return -np.logaddexp(-below, np.log(-np.log(u)) - location)


#: A Gumbel variable made of a number of 53 bits lies less than this above its location.
NOISE = 38.0
#: Steps of a walk are looked at first down to this much below its start.
NEAR = 46.0
STEP = np.uint64(0x9E3779B97F4A7C15)
WORD = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Subtree:
    """All paths that agree with ``edges`` up to a node and then take none of the node's ``closed`` edges."""

    bound: float
    prefix: np.ndarray
    log_prefix: float
    word: int
    node: int
    closed: tuple[int, ...]


@dataclass
class Sample:
    edges: np.ndarray
    log_p: float
    value: float


class Sampler:
    """Samples the texts of a batch side by side. ``words`` are their compiled words in order, ``first`` where each text begins."""

    def __init__(self, lattices: Lattices, words: np.ndarray, first: np.ndarray, keys: np.ndarray, samples: int):
        self.lattices, self.words, self.first, self.samples = lattices, words, first, samples
        self.keys = mix(keys.astype(np.uint64))
        docs = len(first) - 1
        self.open: list[list[Subtree]] = [[] for _ in range(docs)]
        self.found: list[list[Sample]] = [[] for _ in range(docs)]

    def run(self) -> None:
        docs = np.arange(len(self.keys))
        values = -np.log(-np.log(_uniform(self.keys ^ WORD)))
        nothing = np.zeros(0, np.int64)
        self._walk(docs, values, self.first[:-1], np.full(len(docs), -1), [nothing] * len(docs), np.zeros(len(docs)), 0)
        for number in range(1, self.samples):
            again = [d for d in docs if self.open[d]]
            if not again:
                return
            self._reopen(again, number)

    def threshold(self, doc: int) -> float:
        return max((s.bound for s in self.open[doc]), default=-np.inf)

    def _reopen(self, docs: list[int], number: int) -> None:
        """Next sample of each document: leave its best subtree's node by an edge that is not closed, and walk on."""
        lat, starts = self.lattices, []
        for d in docs:
            best = max(range(len(self.open[d])), key=lambda i: self.open[d][i].bound)
            tree = self.open[d].pop(best)
            edges = [e for e in range(lat.edge_first.data[tree.node], lat.edge_first.data[tree.node + 1]) if e not in tree.closed]
            key = self._key(d, number, tree.word - self.first[d], 1 << 20)
            weights = np.cumsum(np.exp(lat.log_p.data[edges]))
            edge = edges[min(int(np.searchsorted(weights, float(_uniform(key)[0]) * weights[-1], "right")), len(edges) - 1)]
            rest = float(sum(np.exp(lat.log_p.data[e]) for e in edges if e != edge))
            if rest > 0:
                location = np.array([tree.log_prefix + np.log(rest)])
                bound = float(_cut_gumbel(location, np.array([tree.bound]), _uniform(key ^ STEP))[0])
                self._keep(d, Subtree(bound, tree.prefix, tree.log_prefix, tree.word, tree.node, (*tree.closed, edge)))
            target = int(lat.target.data[edge])
            prefix = np.append(tree.prefix, edge)
            log_prefix = tree.log_prefix + float(lat.log_p.data[edge])
            starts.append((d, tree.bound, tree.word + (target < 0), target, prefix, log_prefix))
        d, value, word, node, prefix, log_prefix = zip(*starts, strict=True)
        self._walk(np.array(d), np.array(value), np.array(word), np.array(node), list(prefix), np.array(log_prefix), number)

    def _key(self, doc, number: int, word, step) -> np.ndarray:
        key = mix(np.atleast_1d(self.keys[doc]) + np.uint64(number))
        key = mix(key + np.atleast_1d(word).astype(np.uint64) * WORD)
        return key + np.atleast_1d(step).astype(np.uint64) * STEP

    def _keep(self, doc: int, tree: Subtree) -> None:
        trees = self.open[doc]
        trees.append(tree)
        if len(trees) > self.samples:  # only as many can be reopened, and one more is the threshold
            trees.sort(key=lambda t: -t.bound)
            trees.pop()

    def _walk(self, docs, values, words, nodes, prefixes, log_prefixes, number: int) -> None:
        """Follow the best child to the end. ``words[i]`` is where document ``docs[i]`` goes on, at ``nodes[i]`` or its root."""
        lat = self.lattices
        sizes = self.first[docs + 1] - words
        place = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(docs)), sizes)
        word = np.repeat(words - place, sizes) + np.arange(int(sizes.sum()))
        node = lat.root.data[self.words[word]]
        inside = (nodes >= 0) & (sizes > 0)
        node[place[inside]] = nodes[inside]
        key = mix(mix(self.keys[docs] + np.uint64(number))[owner] + (word - self.first[docs][owner]).astype(np.uint64) * WORD)
        word_key, at, taken = key, np.arange(len(word)), []
        lengths = np.zeros(len(word), np.int64)
        while len(at):
            u = _uniform(key)
            edge = lat.edge_first.data[node]
            behind = np.flatnonzero(u >= lat.above.data[edge])
            while len(behind):
                edge[behind] += 1
                behind = behind[u[behind] >= lat.above.data[edge[behind]]]
            taken.append((at, edge))
            lengths[at] += 1
            node = lat.target.data[edge]
            on = np.flatnonzero(node >= 0)
            at, node, key = at[on], node[on], key[on] + STEP
        begin = np.cumsum(lengths) - lengths
        edge = np.zeros(int(lengths.sum()), np.int64)
        for step, (at, chosen) in enumerate(taken):
            edge[begin[at] + step] = chosen
        cuts = np.r_[begin, len(edge)][np.r_[place, len(word)]]
        sums = np.r_[0.0, np.cumsum(lat.log_p.data[edge])]
        doc = np.repeat(np.arange(len(docs)), np.diff(cuts))
        before = sums[:-1] - sums[cuts[:-1]][doc] + log_prefixes[doc]

        def branches(steps: np.ndarray) -> None:
            at = np.searchsorted(begin, steps, "right") - 1
            rest = -np.expm1(lat.log_p.data[edge[steps]])
            node = lat.source.data[edge[steps]]
            open_ = (rest > 0) & (lat.edge_first.data[node + 1] - lat.edge_first.data[node] > 1)
            steps, at, rest, node = steps[open_], at[open_], rest[open_], node[open_]
            key = word_key[at] + (steps - begin[at]).astype(np.uint64) * STEP
            bound = _cut_gumbel(before[steps] + np.log(rest), values[doc[steps]], _uniform(key ^ WORD))
            order = np.lexsort((-bound, doc[steps]))
            ranked = doc[steps][order]
            heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(heads, len(ranked)))
            for k in order[np.arange(len(ranked)) - np.repeat(heads, sizes) < wanted].tolist():
                i, step = int(doc[steps[k]]), int(steps[k])
                prefix = np.concatenate([prefixes[i], edge[cuts[i]:step]])
                best[i].append(Subtree(float(bound[k]), prefix, float(before[step]), int(word[at[k]]), int(node[k]), (int(edge[step]),)))

        # Bounds lie less than NOISE above their place's log probability, which falls along a walk: the first steps
        # hold the best ones, unless a walk's first bounds are unusually low
        wanted = self.samples - number + 1
        best: list[list[Subtree]] = [[] for _ in docs]
        near = before >= log_prefixes[doc] - NEAR
        branches(np.flatnonzero(near))
        n_near = np.bincount(doc[near], minlength=len(docs))
        far = [i for i in np.flatnonzero(n_near < np.diff(cuts)).tolist()
               if len(best[i]) < wanted or before[cuts[i] + n_near[i]] + NOISE >= min(t.bound for t in best[i])]
        for i in far:
            best[i] = []
        if far:
            branches(np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in far]))
        for i, d in enumerate(docs.tolist()):
            for tree in best[i]:
                self._keep(d, tree)
            total = float(sums[cuts[i + 1]] - sums[cuts[i]] + log_prefixes[i])
            self.found[d].append(Sample(np.concatenate([prefixes[i], edge[cuts[i]:cuts[i + 1]]]), total, float(values[i])))

    def ids(self, sample: Sample) -> np.ndarray:
        pieces = self.lattices.piece.data[sample.edges]
        if len(pieces) and pieces.min() < 0:
            spelled = [self.lattices.trie.byte_ids[np.frombuffer(chr(-1 - p).encode("utf-8", "surrogatepass"), np.uint8)] if p < 0 else [p]
                       for p in pieces.tolist()]
            pieces = np.concatenate(spelled)
        return pieces.astype(np.uint32)


def segments(text: str) -> list[str]:
    """The words of a text as the model sees it: a space before each, and line breaks by themselves."""
    return _SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []


_memos: dict[tuple[str, float], Lattices] = {}


def sample_batch(values: list[str], keys: np.ndarray, path: str, samples: int, alpha: float) -> Iterator[tuple]:
    """Per text and sample: number of the text, number of the sample, ids, log probability, perturbed value, log of inclusion."""
    at = 0
    while at < len(values):
        memo = _memos.get((path, alpha))
        if memo is None or len(memo) > MEMO_WORDS:
            _memos[path, alpha] = memo = Lattices(memo.trie if memo else PieceTrie(path), alpha)
        numbers, sizes, taken, first = [], [], 0, at
        while at < len(values) and (first == at or taken < CHUNK_CHARS):
            words = segments(values[at])
            numbers.append(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))
            sizes.append(len(words))
            taken += len(values[at])
            at += 1
        memo.settle()
        sampler = Sampler(memo, np.concatenate(numbers), np.r_[0, np.cumsum(sizes)].astype(np.int64), keys[first:at], samples)
        sampler.run()
        for d, found in enumerate(sampler.found):
            cut = sampler.threshold(d)
            for number, sample in enumerate(found, 1):
                inclusion = _log_inclusion(sample.log_p - cut)
                yield first + d, number, sampler.ids(sample), sample.log_p, sample.value, inclusion


def _log_inclusion(above: float) -> float:
    """Log of the probability that a Gumbel variable exceeds a threshold ``above`` below its location."""
    return above if above < -30 else float(np.log(-np.expm1(-np.exp(min(above, 700.0)))))


SCHEMA = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_p double, value double, log_inclusion double"


def sample_documents(
    docs: DataFrame, samples: int = SAMPLES, alpha: float = ALPHA, seed: int = 0, model: str | None = None,
    with_ids: bool = False, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """``samples`` distinct segmentations of every whole text, best perturbed value first; fewer if there are no more.

    Columns: ``doc_id, sample, n_pieces, ids_crc32`` (of little-endian unsigned 32-bit ids), ``log_p, value``
    (the perturbed log probability), ``log_inclusion`` (log of the probability to be among the samples, given the threshold) and, if asked
    for, ``ids``. The row key is the id; rows that share it have the same random numbers. A null or empty text has one
    segmentation, without pieces. An empty table gives no row; other columns are not read.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            rows = sample_batch(batch.column(1).to_pylist(), batch.column(2).to_numpy().view(np.uint64), path, samples, alpha)
            columns: list[list] = [[] for _ in range(8)]
            for row, number, pieces, log_p, value, inclusion in rows:
                raw = pieces.astype("<u4").tobytes()
                got = (row, number, len(pieces), zlib.crc32(raw), log_p, value, inclusion, pieces if with_ids else None)
                for column, x in zip(columns, got, strict=True):
                    column.append(x)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
            n = 7 if with_ids else 6
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:n + 1], types[:n], strict=True))],
                names=["doc_id", "sample", "n_pieces", "ids_crc32", "log_p", "value", "log_inclusion", "ids"][:n + 1],
            )

    keyed = texts(docs, text, doc_id).withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    return keyed.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def decode_documents(encoded: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds ``text``, the text that a row's ids spell; a null list stays null."""
    path = model or default_model()
    fields = ", ".join(f"{n} {t}" for n, t in encoded.dtypes) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            decoded = [None if x is None else processor.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, fields)
