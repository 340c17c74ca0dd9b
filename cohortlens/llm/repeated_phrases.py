"""Removal of passages of 20 words and more that occur earlier in the corpus.

1. Every window of 20 words picks its anchor, the run of 8 words in it with the smallest hash; runs that very many
   documents have come last in that order. Equal windows pick equal anchors. Anchors (one for about seven words) are sorted in
   buckets, and those that occur once are dropped: no window of theirs can recur.
2. Around every other anchor its document sends the words of all windows that picked it, as a fragment, to the shard
   of that anchor.
3. A shard confirms which passages recur word for word, with the place where each comes first: the whole fragment where
   all of an anchor's fragments agree, else each window. An Aho-Corasick automaton over word numbers is compiled from these passages, and
   all fragments of the shard are streamed through it. A match anywhere but at the first place is removed.
4. Each document drops the words that lie in a removed match.

Tasks resolve what repeats within a batch themselves: of equal anchors and of equal fragments only the first is sent on, so a
passage that a third of all documents share arrives once per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrays import Chunk, chunks, find_words, hash_runs, hash_words, mix, run_starts
from cohortlens.llm.frequent import frequent_runs, is_in
from cohortlens.llm.spark_util import staged, texts, unused

WINDOW = 20
ANCHOR = 8
#: Anchors that one task sorts.
BUCKET_KEYS = 1_500_000
#: Fragments per automaton; all fragments of an anchor go to one.
SHARD_FRAGMENTS = 20_000
#: Stands for a null id while documents are compared: it comes last.
NO_ID = 2**63 - 1


def anchors(chunk: Chunk, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the rows of a chunk: hash, row, first window start (in words of the row), number of windows."""
    words = find_words(chunk)
    starts, lengths = run_starts(words.first, WINDOW)
    if not len(starts):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    grams = hash_runs(hash_words(chunk.data, words), ANCHOR)
    rank = (mix(grams) >> np.uint64(1)) | (is_in(grams, frequent).astype(np.uint64) << np.uint64(63))
    best = np.arange(len(rank))
    size, wanted = 1, WINDOW - ANCHOR + 1
    while size < wanted:
        step = min(size, wanted - size)
        left, right = best[:-step], best[step:]
        best = np.where(rank[right] < rank[left], right, left)
        size += step
    picked = best[starts]
    row = np.repeat(np.arange(chunk.rows), lengths)
    new = np.ones(len(starts), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return grams[picked[at]], row[at], starts[at] - words.first[:-1][row[at]], np.diff(np.append(at, len(starts)))


#: What a row of the first pass holds: anchors to sort, the first of anchors that the batch repeats, repeated anchors.
SORT, FIRST, REPEATED = 0, 1, 2
PLACES = ["key", "doc", "tag", "start", "n"]
PLACE_TYPES = [np.uint64, np.int64, np.int64, np.int32, np.int32]
BLOBS = "bucket int, kind int, " + ", ".join(f"{c} binary" for c in PLACES)


def _send_anchors(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts = []
        for chunk in chunks(batch.column(2)):
            key, row, start, n = anchors(chunk, frequent)
            parts.append((key, ids[chunk.first + row], tags[chunk.first + row], start.astype(np.int32), n.astype(np.int32)))
        places = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else []
        if not places or not len(places[0]):
            continue
        order = np.lexsort(places[3::-1])
        places = [p[order] for p in places]
        key = places[0]
        new = np.r_[True, key[1:] != key[:-1]]
        again = ~np.r_[new[1:], True] | ~new  # the key occurs twice or more in this batch
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        for kind, chosen in ((SORT, ~again), (FIRST, again & new)):
            yield from _blobs([p[chosen] for p in places], bucket[chosen], kind)
        # these need no sorting; they go where their document says, so that a frequent anchor fills no bucket
        places = [p[again] for p in places]
        bucket = ((mix(places[1].view(np.uint64) ^ places[2].view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        yield from _blobs([p[order] for p in places], bucket[order], REPEATED)


def _by_byte(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: leading zeros lie together and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_bytes(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _blobs(places: list[np.ndarray], bucket: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    if not len(bucket):
        return
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket[a]], pa.int32()), pa.array([kind], pa.int32()),
             *(pa.array([_by_byte(p[a:b].astype(t))], pa.binary()) for p, t in zip(places, PLACE_TYPES, strict=True))],
            names=["bucket", "kind", *PLACES],
        )


def _recurring(table: pa.Table) -> pa.Table:
    """The places of one bucket whose anchor occurs more than once."""
    kinds, sizes = [], []
    columns: list[list[np.ndarray]] = [[] for _ in PLACES]
    for kind, *blobs in zip(table.column("kind").to_pylist(), *(table.column(c).to_pylist() for c in PLACES), strict=True):
        arrays = [_from_bytes(b, t) for b, t in zip(blobs, PLACE_TYPES, strict=True)]
        kinds.append(kind)
        sizes.append(len(arrays[0]))
        for column, values in zip(columns, arrays, strict=True):
            column.append(values)
    places = [np.concatenate(c) for c in columns]
    kind = np.repeat(kinds, sizes)
    sent = np.flatnonzero(kind != REPEATED)
    sent = sent[np.argsort(places[0][sent], kind="stable")]
    key = places[0][sent]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    several = ~np.r_[new[1:], True] | ~new if len(key) else new
    chosen = np.concatenate([np.flatnonzero(kind == REPEATED), sent[several & (kind[sent] == SORT)]])
    places[0] = places[0].view(np.int64)
    return pa.table({c: pa.array(p[chosen]) for c, p in zip(PLACES, places, strict=True)})


FRAGMENTS = "key long, doc long, tag long, start int, n int, words binary"


def _send_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of recurring anchors. Of those that a batch repeats, all but the first go without words: removed."""
    for batch in batches:
        ids, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
        lists = batch.column("places")
        flat = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy())
        key, start, n = (flat.field(i).to_numpy() for i in range(3))
        row = np.repeat(np.arange(len(ids)), sizes)
        found = []
        begin = np.cumsum(sizes) - sizes
        for chunk in chunks(batch.column("text")):
            words = find_words(chunk)
            data = chunk.data.tobytes()
            last = chunk.first + chunk.rows
            a, b = begin[chunk.first], begin[last] if last < len(begin) else len(key)
            first = words.first[row[a:b] - chunk.first] + start[a:b]
            lo, hi = words.starts[first].tolist(), words.ends[first + n[a:b] + WINDOW - 2].tolist()
            found += [data[x:y] for x, y in zip(lo, hi, strict=True)]
        order = np.lexsort((start, tags[row], ids[row]))
        seen: dict[tuple[int, bytes], int] = {}
        keys = key.tolist()
        out: list[bytes | None] = [None] * len(found)
        twice = np.zeros(len(found), bool)  # a row that the table repeats is one place
        for i in order.tolist():
            first = seen.setdefault((keys[i], found[i]), i)
            if first == i:
                out[i] = found[i]
            else:
                twice[i] = (ids[row[i]], tags[row[i]], start[i]) == (ids[row[first]], tags[row[first]], start[first])
        words_out = pa.array(out, pa.binary())
        # rows without words need no shard; their key only spreads them
        anywhere = mix(ids[row].view(np.uint64) + start.astype(np.uint64)).view(np.int64)
        spread = np.where(words_out.is_null().to_numpy(zero_copy_only=False), anywhere, key)
        yield pa.RecordBatch.from_arrays(
            [pa.array(spread, pa.int64()), pa.array(ids[row], pa.int64()), pa.array(tags[row], pa.int64()), pa.array(start, pa.int32()),
             pa.array(n, pa.int32()), words_out], names=["key", "doc", "tag", "start", "n", "words"],
        ).filter(pa.array(~twice))


REMOVED = "doc long, tag long, start int, stop int"


class Shard:
    """Fragments of some anchors, ordered by anchor and place: finds what recurs and locates it."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.fragments: list[tuple[tuple, tuple[int, ...]]] = []
        self.patterns: dict[tuple[int, ...], tuple] = {}

    def add(self, group: list[tuple[tuple, bytes]]) -> None:
        """All fragments of an anchor as (place, words), by place; a place is (document, tag, first word)."""
        if len(group) < 2:
            return
        read = []
        for place, words in group:
            read.append((place, tuple([self.numbers.setdefault(w, len(self.numbers)) for w in words.split()])))
        self.fragments += read
        if len({f for _, f in read}) == 1:
            self.patterns.setdefault(read[0][1], read[0][0])
            return
        first, again = {}, set()
        for place, fragment in read:
            for i in range(len(fragment) - WINDOW + 1):
                window = fragment[i:i + WINDOW]
                if window in first:
                    again.add(window)
                else:
                    first[window] = (place[0], place[1], place[2] + i)
        for window in again:
            self.patterns.setdefault(window, first[window])

    def removed(self) -> Iterator[tuple[int, int, int, int]]:
        """Intervals of words (document, tag, first, past the last) that match a passage away from its first place."""
        if not self.patterns:
            return
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, place in self.patterns.items():
            automaton.add_word(pattern, (len(pattern), place))
        automaton.make_automaton()
        for (doc, tag, begin), fragment in self.fragments:
            low = high = None
            for end, (size, first) in automaton.iter(fragment):
                start = begin + end - size + 1
                if (doc, tag, start) <= first:
                    continue
                stop = begin + end + 1
                if high is not None and start <= high:
                    low, high = min(low, start), max(high, stop)
                    continue
                if high is not None:
                    yield doc, tag, low, high
                low, high = start, stop
            if high is not None:
                yield doc, tag, low, high


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in order of anchor and place; one shard after another."""
    shard, group, last = Shard(), [], None

    def flush() -> pa.RecordBatch:
        rows = list(shard.removed())
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        return _removed(*columns)

    for batch in batches:
        plain = batch.column("words").is_null()
        direct = batch.filter(plain)
        if direct.num_rows:
            start, n = direct.column("start").to_numpy(), direct.column("n").to_numpy()
            yield _removed(direct.column("doc"), direct.column("tag"), start, start + n + WINDOW - 1)
        rest = batch.filter(pc.invert(plain))
        for key, doc, tag, start, words in zip(*(rest.column(c).to_pylist() for c in ("key", "doc", "tag", "start", "words")), strict=True):
            if key != last:
                shard.add(group)
                group, last = [], key
                if len(shard.fragments) >= SHARD_FRAGMENTS:
                    yield flush()
                    shard = Shard()
            group.append(((doc, tag, start), words))
    shard.add(group)
    yield flush()


def _removed(doc, tag, start, stop) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    values = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip((doc, tag, start, stop), types, strict=True)]
    return pa.RecordBatch.from_arrays([v.cast(t) for v, t in zip(values, types, strict=True)], names=["doc", "tag", "start", "stop"])


def _kept_words(words: list[bytes], cuts) -> list[bytes]:
    kept, at = [], 0
    for start, stop in sorted((c["start"], c["stop"]) for c in cuts or ()):
        if start > at:
            kept += words[at:start]
        at = max(at, stop)
    return kept + words[at:] if at else words


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
            words = text.encode().split()
            kept = _kept_words(words, cuts)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *arrays], names=["doc", "n_words", "n_removed", "kept_sha256"])


def _texts_left(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, stays = [], []
        for value, cuts in zip(batch.column(text).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            kept = _kept_words(value.encode().split(), cuts) if cuts else []
            values.append(b" ".join(kept).decode() if cuts else value)
            stays.append(not cuts or bool(kept))
        batch = batch.select(range(batch.num_columns - 1))
        batch = batch.set_column(batch.schema.get_field_index(text), text, pa.array(values, pa.string()))
        yield batch.filter(pa.array(stays, pa.bool_()))


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return texts(docs, text, doc_id).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tag"), "text")


def find_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Intervals of words to remove, a written table: ``doc, tag`` (id and 64-bit hash of the text), ``cuts`` (start, stop)."""
    plain = _keyed(docs, text, doc_id)
    frequent, _, n_runs = frequent_runs(plain, ANCHOR, False)
    buckets = max(1, -(-n_runs // 6 // BUCKET_KEYS))
    sent = plain.mapInArrow(lambda it: _send_anchors(it, frequent, buckets), BLOBS)
    recurring = sent.groupBy("bucket").applyInArrow(_recurring, "key long, doc long, tag long, start int, n int")
    places = recurring.groupBy("doc", "tag").agg(F.collect_set(F.struct("key", "start", "n")).alias("places"))
    fragments = plain.join(places, ["doc", "tag"]).select("doc", "tag", "text", "places").mapInArrow(_send_fragments, FRAGMENTS)
    located = fragments.repartition("key").sortWithinPartitions("key", "doc", "tag", "start").mapInArrow(_locate, REMOVED)
    return staged(located.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("cuts")))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256`` (of the words left, joined by one space).

    A word goes if it lies in a window of 20 words whose sequence also starts earlier: in a document of smaller id, or
    before in the same document. A null or empty text has no words. Rows that share an id are ordered by a hash of their
    text; equal rows are one document with a row each. Documents without an id come last. An empty table gives no row;
    other columns are not read.
    """
    cuts = find_repeats(docs, text, doc_id)
    kept = _keyed(docs, text, doc_id).join(cuts, ["doc", "tag"], "left").select("doc", "text", "cuts").mapInArrow(
        _digests, "doc long, n_words long, n_removed long, kept_sha256 string"
    )
    return kept.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc"))).withColumnRenamed("doc", "doc_id")


def drop_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the words left as text; a row of which no word is left goes, one that loses none stays as it is."""
    doc, tag, cuts = unused(docs, "_doc", "_tag", "_cuts")
    found = find_repeats(docs, text, doc_id).select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("cuts").alias(cuts))
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)) == F.col(doc)
    joined = docs.join(found, key & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(tag)), "left")
    return joined.select(*(docs[c] for c in docs.columns), cuts).mapInArrow(lambda it: _texts_left(it, text), docs.schema)
