"""Similarity join of documents on their distinct word shingles by parity sketches.

A document's shingles are hashed to the bits of a very wide sketch, and each toggles its bit, so that two sketches
differ in no more bits than their sets do elements. Jaccard of at least 3/4 bounds that number by a seventh of both sizes
together. The sketch is cut into bands; if at most d bits differ, all but d bands agree, and so the first d + 2 bands
that both documents choose in the same order have two in common. A document therefore sends the keys of its d + 2 heaviest
bands (most shingles that are not frequent, then most shingles), and documents that share two keys meet; in small size
bands it sends d + 1 keys, and one is enough. Bands depend on
the size band of the documents; a document near the lower end of its size band sends keys to the one below as well.

Meetings become links in two rounds. Keys with many documents pair each of them with one leader. First every document
is compared with one partner, which joins groups of near copies in linear time. Then partners are compared where they lie in different
components yet. What is left of a key with many documents is compared with a central one of them, its leader, and then only with
documents that share a shingle which the leader lacks: two linked documents of which one is unlike the leader must have one. Comparisons look at sizes, at the Hamming distance of dense sketches of 1,024 bits, and at last at the
sets themselves. Texts with equal sets are one node throughout.

A task sorts its own keys before it sends them. Where many of its documents have one key it sends their leader alone, so a
key that a third of all documents share arrives once per block of documents, not once per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.arrays import chunks, mix
from cohortlens.llm.components import components
from cohortlens.llm.frequent import BlockCounts, distinct_runs, is_in, summarise
from cohortlens.llm.spark_util import attach_groups, staged, texts
from cohortlens.sources import staged_by

SHINGLE = 5
#: Neighbouring size bands have this ratio; partners lie in the same or the next band, as it exceeds 4/3.
SIZE_RATIO = 16 / 9
#: Bands per shingle of the largest set of a size band, and bands at least.
BANDS_PER_SHINGLE = 0.6
MIN_BANDS = 64
#: Size bands from this one on (sets of 27 and more) need two common keys.
TWO_KEYS_FROM = 5
SKETCH_WORDS = 16
#: Documents of one block that may share a key before their leader stands for them.
LOCAL_RUN = 32
#: Documents of a key up to which all their pairs are compared at once.
SMALL_RUN = 4
#: Rounds in which nodes of hot keys are compared with leaders, and nodes that may share a shingle to be paired at once.
LEADER_ROUNDS = 2
SMALL_GROUP = 8
#: Nodes of a leader, and shingles of their sets, up to which one task compares them; each meets fewer others than it would send shingles.
LEADER_GROUP = 512
GROUP_RUNS = 4_000_000
#: Keys that one task sorts.
BUCKET_KEYS = 1_500_000
#: Shingles of one bucket of whole sets.
BUCKET_RUNS = 16_000_000
#: Share of the shingles of all documents that comparisons send at once, or so many if that is more; the others are sent when the files of
#: the first have gone.
SENT_SHARE = 1 / 8
SENT_RUNS = 1 << 24
#: Whole sets are written in so many parts at most, one for each so many shingles of all documents.
PARTS = 4
PART_RUNS = 1 << 27
EMPTY = np.uint64(0xA0761D6478BD642F)
#: This bit of a key says that it is enough for a meeting.
ENOUGH = np.uint64(1)

_lower = [1]
while _lower[-1] < 1 << 40:
    _lower.append(max(_lower[-1] + 1, int(np.ceil(_lower[-1] * SIZE_RATIO))))
#: Smallest set of each size band.
SIZE_BANDS = np.array(_lower, np.int64)
_band_counts = np.maximum(MIN_BANDS, np.ceil(BANDS_PER_SHINGLE * (SIZE_BANDS[1:] - 1))).astype(np.int64)


def node_names(runs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set."""
    total = np.zeros(len(runs) + 1, np.uint64)
    np.cumsum(mix(runs), out=total[1:])
    ends = np.cumsum(sizes)
    return mix((total[ends] - total[ends - sizes]) + sizes.astype(np.uint64)).view(np.int64)


def dense_sketches(runs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity sketches of ``64 * SKETCH_WORDS`` bits, one row per set."""
    places = mix(runs ^ EMPTY) % np.uint64(64 * SKETCH_WORDS)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(owner * (64 * SKETCH_WORDS) + places.astype(np.int64), minlength=len(sizes) * 64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sizes), -1), axis=1).view(np.int64)


def band_keys(
    runs: np.ndarray, sizes: np.ndarray, frequent: np.ndarray, size_band: np.ndarray, wanted: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted[i]`` heaviest bands of each row in the sketch of its ``size_band``: key and row.

    ``runs`` are ascending in each row, and so are their bands. A band's key is made of the bits that it has set (here the
    exclusive or of their codes), of its number and of its size band.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bands = (((runs >> np.uint64(32)) * _band_counts[size_band].astype(np.uint64)[owner]) >> np.uint64(32)).astype(np.int64)
    new = np.ones(len(runs), bool)
    new[1:] = (bands[1:] != bands[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row, band = owner[at], bands[at]
    count = np.diff(np.append(at, len(runs)))
    rare = np.add.reduceat((~is_in(runs, frequent)).astype(np.int64), at)
    content = np.bitwise_xor.reduceat(mix(runs), at)
    keys = mix(content ^ mix((size_band[row] << 40 | band).astype(np.uint64)) + count.astype(np.uint64))
    # one number to sort by: row, fewer frequent ones first, more shingles first, then the key; bands break ties
    weight = (4095 - np.minimum(rare, 4095)) << 12 | (4095 - np.minimum(count, 4095))
    rank = (row.astype(np.uint64) << np.uint64(44)) | (weight.astype(np.uint64) << np.uint64(20)) | (keys >> np.uint64(44))
    order = np.argsort(rank, kind="stable")
    keys, row = keys[order], row[order]
    per_row = np.bincount(row, minlength=len(sizes))
    place = np.arange(len(row)) - (np.cumsum(per_row) - per_row)[row]
    keep = place < wanted[row]
    out_keys, out_rows = [keys[keep]], [row[keep]]
    for i in np.flatnonzero((per_row < wanted) & (sizes > 0)):  # tiny sets may have to name empty bands
        free = np.setdiff1d(np.arange(_band_counts[size_band[i]]), band[np.flatnonzero(owner[at] == i)])
        empty = np.sort(mix(EMPTY ^ mix((size_band[i] << 40 | free).astype(np.uint64))))
        empty = empty[:wanted[i] - per_row[i]]
        out_keys.append(empty)
        out_rows.append(np.full(len(empty), i))
    keys, rows = np.concatenate(out_keys), np.concatenate(out_rows)
    return keys & ~ENOUGH | (_needed(size_band[rows]) == 1).astype(np.uint64), rows


def _needed(size_band: np.ndarray) -> np.ndarray:
    """Keys that linked documents have in common, at least, in a size band."""
    return np.where(size_band >= TWO_KEYS_FROM, 2, 1)


def all_keys(runs: np.ndarray, sizes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys that the rows send: those of their own size band, and of the one below where a partner may lie there."""
    own = np.searchsorted(SIZE_BANDS, np.maximum(sizes, 1), "right") - 1
    lowest = SIZE_BANDS[own]
    keys, rows = band_keys(runs, sizes, frequent, own, (sizes + 4 * sizes // 3) // 7 + _needed(own))
    down = np.flatnonzero((sizes > 0) & (own > 0) & (-(-3 * sizes // 4) < lowest))
    if not len(down):
        return keys, rows
    chosen = np.zeros(len(sizes), bool)
    chosen[down] = True
    part = runs[np.repeat(chosen, sizes)]
    below = own[down] - 1
    more, at = band_keys(part, sizes[down], frequent, below, (sizes[down] + lowest[down] - 1) // 7 + _needed(below))
    return np.concatenate([keys, more]), np.concatenate([rows, down[at]])


SUMMARY = "run long, n long, node long, sketch binary"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: one row per document (id, size, node, dense sketch), and counts of frequent shingles."""
    block = BlockCounts()

    def counts(runs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        nulls = pa.nulls(len(runs), pa.int64()), pa.nulls(len(runs), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(runs, pa.int64()), pa.array(n, pa.int64()), *nulls], names=["run", "n", "node", "sketch"]
        )

    for batch in batches:
        for chunk in chunks(batch.column(1)):
            runs, sizes, _ = distinct_runs(chunk, SHINGLE, True)
            sketches = dense_sketches(runs, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, chunk.rows), pa.array(sizes, pa.int64()),
                 pa.array(node_names(runs, sizes), pa.int64()), pa.array([s.tobytes() for s in sketches], pa.binary())],
                names=["run", "n", "node", "sketch"],
            )
            for found in block.add(runs, chunk.rows):
                yield counts(*found)
    for found in block.finish():
        yield counts(*found)


def _send_keys(
    batches: Iterator[pa.RecordBatch], frequent: np.ndarray, buckets: int, local_run: int,
) -> Iterator[pa.RecordBatch]:
    """Second pass: the keys of each block of documents, sorted and cut into buckets; hot keys by their leader alone."""
    for batch in batches:
        keys, nodes = [], []
        for chunk in chunks(batch.column(0)):
            runs, sizes, _ = distinct_runs(chunk, SHINGLE, True)
            names = node_names(runs, sizes)
            _, first = np.unique(names, return_index=True)
            single = np.zeros(len(sizes), bool)
            single[first] = True
            runs, names, sizes = runs[np.repeat(single, sizes)], names[single], sizes[single]
            got, rows = all_keys(runs, sizes, frequent)
            keys.append(got)
            nodes.append(names[rows])
        if not keys or not sum(map(len, keys)):
            continue
        key, node = _sorted_meetings(np.concatenate(keys), np.concatenate(nodes))
        starts, counts = _runs(key)
        hot = counts > local_run
        spread = np.repeat(hot, counts)
        leader = np.zeros(len(key), bool)
        leader[starts] = True
        yield from _blobs(key[~spread], node[~spread], buckets, False)
        yield from _blobs(key[spread & leader], node[spread & leader], buckets, True)
        if hot.any():
            heads = np.repeat(node[starts[hot]], counts[hot])
            local = [(1, key[spread].view(np.int64), node[spread]), (0, heads, node[spread])]
            spot = int(key[0] % np.uint64(buckets))
            for kind, a, b in local:
                yield _blob(spot, kind, a, b)


def _sorted_meetings(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, node) in ascending order."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    return key[new], node[new]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


#: What a row of the second pass holds: finished pairs, finished members of a key, keys to sort, keys of leaders.
PAIRS, MEMBERS, KEYS, LEADERS = 0, 1, 2, 3


def _blob(bucket: int, kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([a.tobytes()], pa.binary()),
         pa.array([b.tobytes()], pa.binary())], names=["bucket", "kind", "a", "b"],
    )


def _blobs(key: np.ndarray, node: np.ndarray, buckets: int, leaders: bool) -> Iterator[pa.RecordBatch]:
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    for start, size in zip(*_runs(bucket), strict=True):
        part = slice(start, start + size)
        yield _blob(int(bucket[start]), LEADERS if leaders else KEYS, key[part], node[part])


def _meet(table: pa.Table, small_run: int) -> pa.Table:
    """Third pass, one bucket: pairs with the weight of their common keys (2: enough), members of keys with many documents.

    A pair of which only one key is known here may have another elsewhere. If that one has many documents it names the
    pair among its members, so a pair that stays below 2 in all buckets has too few common keys to link.
    """
    got = {k: ([], []) for k in (PAIRS, MEMBERS, KEYS, LEADERS)}
    for kind, a, b in zip(*(table.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True):
        got[kind][0].append(np.frombuffer(a, np.uint64))
        got[kind][1].append(np.frombuffer(b, np.int64))
    join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
    forced = np.unique(join(got[LEADERS][0], np.uint64))
    key, node = _sorted_meetings(join(got[KEYS][0] + got[LEADERS][0], np.uint64), join(got[KEYS][1] + got[LEADERS][1], np.int64))
    starts, counts = _runs(key)
    first, second = [join(got[PAIRS][0], np.uint64).view(np.int64)], [join(got[PAIRS][1], np.int64)]
    weights = [np.full(len(first[0]), 2)]
    many = counts > small_run
    enough = many | ((key[starts] & ENOUGH) > 0) | is_in(key[starts], forced)
    inside = np.repeat(counts > 1, counts)
    first.append(np.repeat(node[starts], counts)[inside])
    second.append(node[inside])
    weights.append(np.repeat(1 + enough, counts)[inside])
    for size in range(3, small_run + 1):
        at = starts[counts == size]
        for i in range(1, size):
            for j in range(i + 1, size):
                first.append(node[at + i])
                second.append(node[at + j])
                weights.append(1 + enough[counts == size])
    member = np.repeat(many | is_in(key[starts], forced), counts)
    a, b = np.concatenate(first), np.concatenate(second)
    a, b = np.minimum(a, b), np.maximum(a, b)
    a, b, weight = _summed_pairs(a, b, np.concatenate(weights))
    members = [join(got[MEMBERS][0], np.uint64).view(np.int64), key[member].view(np.int64)], [join(got[MEMBERS][1], np.int64), node[member]]
    out_a, out_b = np.concatenate([a, *members[0]]), np.concatenate([b, *members[1]])
    kind = np.repeat([PAIRS, MEMBERS], [len(a), len(out_a) - len(a)])
    weight = np.concatenate([weight, np.zeros(len(out_a) - len(a), np.int64)])
    return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()),
                     "weight": pa.array(np.minimum(weight, 2), pa.int32())})


def _summed_pairs(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of different nodes with their summed weight."""
    keep = a != b
    a, b, weight = a[keep], b[keep], weight[keep]
    order = np.lexsort((b, a))
    a, b, weight = a[order], b[order], weight[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    return a[starts], b[starts], np.add.reduceat(weight, starts) if len(starts) else weight


class Sets(NamedTuple):
    """The whole sets ``node, n, runs``, in buckets by node, and how many shingles of them may be sent at once."""

    table: DataFrame
    most: float


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(0)):
            runs, sizes, _ = distinct_runs(chunk, SHINGLE, True)
            parts = np.split(runs, np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(node_names(runs, sizes), pa.int64()), pa.array(sizes, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["node", "n", "runs"],
            )


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets pass: 100 times the intersection is at least 75 times the union."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("runs_a"), batch.column("runs_b"), strict=True):
            one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = int(is_in(one, two).sum())
            keep.append(100 * common >= 75 * (len(one) + len(two) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _may_link():
    """Sizes and dense sketches leave room for a Jaccard of 3/4."""
    differ = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    return (4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & (7 * differ <= F.col("na") + F.col("nb"))


def _described(nodes: DataFrame, name: str, size: str, prefix: str) -> DataFrame:
    words = [F.conv(F.hex(F.substring("sketch", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"{prefix}{i}") for i in range(SKETCH_WORDS)]
    return nodes.select(F.col("node").alias(name), F.col("n").alias(size), *words)


def _sent_in_parts(pairs: DataFrame, sets: Sets, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``compare`` of all ``pairs``, which sends the set of each ``b`` to its ``a``: in parts by ``a``, each written before the next is sent.

    So the shuffle files on disk at any time have a bound, however many pairs there are.
    """
    sent = pairs.join(sets.table.select(F.col("node").alias("b"), F.col("n").alias("_sent")), "b").agg(F.sum("_sent")).first()[0] or 0
    parts = max(1, int(np.ceil(sent / sets.most)))
    part_of = F.pmod(F.xxhash64(F.lit(parts), "a"), F.lit(parts))
    return reduce(DataFrame.unionByName, [staged(compare(pairs.where(part_of == i) if parts > 1 else pairs)) for i in range(parts)])


def _with_sets(pairs: DataFrame, sets: Sets) -> DataFrame:
    """``pairs`` with the sets of both nodes. The sets lie in buckets by node; those of ``b`` alone are sent, to ``a``."""
    asked = sets.table.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    second = pairs.join(sets.table.select(F.col("node").alias("b"), F.col("runs").alias("runs_b")), "b")
    return second.join(asked.select(F.col("node").alias("a"), F.col("runs").alias("runs_a")), "a")


def _verify(pairs: DataFrame, sets: Sets) -> DataFrame:
    """The pairs ``a, b`` that link, by their whole sets. Written tables."""
    return _sent_in_parts(pairs, sets, lambda part: _with_sets(part, sets).mapInArrow(_linked, "a long, b long"))


def _placed(df: DataFrame, joined: DataFrame, name: str, component: str) -> DataFrame:
    """The component of each node of the column ``name``; a node without links is its own."""
    known = joined.select(F.col("node").alias(name), F.col("component").alias("_known"))
    return df.join(known, name, "left").withColumn(component, F.coalesce("_known", name)).drop("_known")


def _bridges(across: DataFrame, sets: Sets) -> DataFrame:
    """The components ``a, b`` that links among the pairs ``a, b`` of components ``ca, cb`` connect."""
    across = staged(across.select("a", "b", "ca", "cb").distinct())
    found = _verify(across.select("a", "b"), sets).join(across, ["a", "b"])
    return staged(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())


def _widened(joined: DataFrame, bridges: DataFrame) -> DataFrame:
    """The components after ``bridges`` between them."""
    if bridges.isEmpty():
        return joined
    wider = staged(components(bridges))
    every = joined.unionByName(wider.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    final = every.join(wider.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left")
    return staged(final.select("node", F.coalesce("wider", "component").alias("component")))


def _open_groups(groups: DataFrame, joined: DataFrame) -> DataFrame:
    """``key, node, component`` of the groups whose nodes lie in different components."""
    of = staged(_placed(groups, joined, "node", "component"))
    several = of.groupBy("key").agg(F.min("component").alias("base"), F.max("component").alias("other")).where("base <> other")
    return staged(of.join(several.select("key", "base"), "key"))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles a node has in common with its leader, and those that the leader lacks."""
    for batch in batches:
        common, sizes, rest = [], [], []
        for x, y in zip(batch.column("runs_a"), batch.column("runs_b"), strict=True):
            leader, own = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            inside = is_in(own, leader)
            common.append(int(inside.sum()))
            sizes.append(len(leader))
            rest.append(own[~inside].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(sizes, pa.int64()), pa.array(common, pa.int64()),
             pa.array([len(r) for r in rest], pa.int64()), pa.array(rest, pa.list_(pa.int64()))],
            names=["leader", "node", "n_leader", "common", "lacking", "rest"],
        )


def _near_members(table: pa.Table) -> pa.Table:
    """Pairs of one leader's nodes, at most ``LEADER_GROUP``, that lie in different components and may link.

    Two sets differ in at least as many shingles of the leader as their counts of these differ, and outside it in at least as many as
    the sketches of what it lacks. Of linked sets the sum is at most a seventh of both sizes.
    """
    node, n, common, component = (table.column(c).to_numpy() for c in ("node", "n", "common", "component"))
    linked = table.column("linked").to_numpy(zero_copy_only=False)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
    first, second = [], []
    for i in np.flatnonzero(~linked):
        # a pair of two nodes that do not link with the leader is looked at once
        other = np.flatnonzero((component != component[i]) & (linked | (node > node[i])) & (4 * np.minimum(n, n[i]) >= 3 * np.maximum(n, n[i])))
        differ = np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1, dtype=np.int64) + np.abs(common[other] - common[i])
        other = other[7 * differ <= n[other] + n[i]]
        first.append(np.full(len(other), i))
        second.append(other)
    a, b = (np.concatenate([*part, np.zeros(0, np.int64)]).astype(np.int64) for part in (first, second))
    return pa.table({"a": node[a], "b": node[b], "ca": component[a], "cb": component[b]})


def _leader_links(table: pa.Table) -> pa.Table:
    """The components ``a, b`` that links among one leader's nodes, itself included, connect.

    ``_near_members`` names the pairs that may link. What they have in common of the leader is counted by bits; the rest of their sets
    is compared where it is long enough to make a link.
    """
    node, at = np.unique(table.column("node").to_numpy(), return_index=True)  # rows loaded twice have their set twice
    table = table.take(at)
    component = table.column("component").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("runs")]
    n = np.array([len(s) for s in sets], np.int64)
    leader = np.searchsorted(node, table.column("leader")[0].as_py())
    inside = [is_in(s, sets[leader]) for s in sets]
    common = np.array([int(i.sum()) for i in inside], np.int64)
    linked = 7 * common >= 3 * (n[leader] + n)
    first, second = [component[linked]], [np.full(int(linked.sum()), component[leader])]
    # what links with the leader is in one component from here on
    merged = np.where(is_in(component, np.unique(first[0])), component[leader], component)
    if (merged != component[leader]).any():
        rest = [s[~i] for s, i in zip(sets, inside, strict=True)]
        sketch = dense_sketches(np.concatenate(rest), n - common)
        near = _near_members(pa.table({
            "node": np.arange(len(node)), "n": n, "common": common, "linked": linked, "component": merged, "sketch": [k.tobytes() for k in sketch],
        }))
        x, y = near.column("a").to_numpy(), near.column("b").to_numpy()
        bits = np.stack([np.packbits(is_in(sets[leader], s)) for s in sets])
        step = max(1, (1 << 24) // bits.shape[1])
        both = np.concatenate([np.zeros(0, np.int64), *(
            np.bitwise_count(bits[x[i:i + step]] & bits[y[i:i + step]]).sum(axis=1, dtype=np.int64) for i in range(0, len(x), step)
        )])
        lacking = n - common
        may = 7 * (both + np.minimum(lacking[x], lacking[y])) >= 3 * (n[x] + n[y])
        x, y, both = x[may], y[may], both[may]
        both = both + np.array([int(is_in(rest[i], rest[j]).sum()) for i, j in zip(x, y, strict=True)], np.int64)
        link = 7 * both >= 3 * (n[x] + n[y])
        first.append(component[x[link]])
        second.append(component[y[link]])
    a, b = np.concatenate(first), np.concatenate(second)
    a, b, _ = _summed_pairs(np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64))
    return pa.table({"a": a, "b": b})


def _among_few(star: DataFrame, sets: Sets) -> DataFrame:
    """The components that links among the nodes of leaders with few nodes connect: all sets of a leader's nodes go to one task."""
    def compare(part: DataFrame) -> DataFrame:
        whole = part.join(sets.table.select(F.col("node").alias("b"), "runs"), "b").select(F.col("a").alias("leader"), F.col("b").alias("node"), "component", "runs")
        return whole.groupBy("leader").applyInArrow(_leader_links, "a long, b long").distinct()

    return _sent_in_parts(star, sets, compare)


def _leader_round(groups: DataFrame, joined: DataFrame, nodes: DataFrame, sets: Sets) -> tuple[DataFrame | None, DataFrame]:
    """Compare the nodes of each open group with one leader, then with those that share what the leader lacks.

    Where a leader has few nodes, a task compares all of them; its work is linear in the nodes, as their number per
    leader is bounded. The nodes of other leaders meet by shingles.

    Let x and y link, with c(x) shingles of x in the leader. They have at least 3/7 of both sizes together in common. If c(x)
    or c(y) is less than that, they share a shingle that the leader lacks, and meet there. Otherwise both nodes are close to the leader; if
    both link with it they are in one component already, and if not, such pairs are few and are compared. A node that
    does not link with the leader sends as many of its rarest lacking shingles as it must. Shingles that many nodes send are the groups of the next
    round. Returns those groups, or nothing when none is open, and the components.
    """
    rest = _open_groups(groups, joined)
    if rest.isEmpty():
        return None, joined
    central = rest.groupBy("node").agg(F.count("*").alias("keys")).join(nodes.select("node", "n"), "node")
    of = rest.join(central, "node")
    leaders = staged(of.groupBy("key").agg(F.max(F.struct("keys", (-F.col("n")).alias("small"), "node")).alias("l")).select("key", F.col("l.node").alias("a")))
    star = staged(of.join(leaders, "key").select("a", F.col("node").alias("b"), "component", "n").distinct())
    of_leader = star.groupBy("a").agg(F.count("*").alias("nodes"), F.sum("n").alias("runs"))
    large = staged(of_leader.where((F.col("nodes") > LEADER_GROUP) | (F.col("runs") > GROUP_RUNS)).select("a"))
    bridges = _among_few(star.join(large, "a", "left_anti"), sets)
    if large.isEmpty():
        return None, _widened(joined, staged(bridges.distinct()))

    many = star.join(large, "a", "left_semi").where("a <> b").select("a", "b")
    about = "leader long, node long, n_leader long, common long, lacking long, rest array<long>"
    measured = _sent_in_parts(many, sets, lambda part: _with_sets(part, sets).mapInArrow(_measured, about))
    n = F.col("common") + F.col("lacking")
    linked = 7 * F.col("common") >= 3 * (F.col("n_leader") + n)
    found = measured.where(linked).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    met = _placed(_placed(found, joined, "a", "ca"), joined, "b", "cb").where("ca <> cb")
    joined = _widened(joined, staged(bridges.unionByName(met.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).distinct()))

    large_keys = leaders.join(large, "a")
    several = _open_groups(groups.join(large_keys.select("key"), "key", "left_semi"), joined)
    if several.isEmpty():
        return None, joined
    # only where a node of a group is not in the component of the group's leader there is more to find
    still = several.join(large_keys, "key").select(F.col("a").alias("leader"), "node").distinct()
    about = measured.select("leader", "node", "common", "lacking", n.alias("n"), linked.alias("linked")).distinct()
    about = staged(_placed(about.join(still, ["leader", "node"], "left_semi"), joined, "node", "component"))
    about = about.join(about.groupBy("leader").agg(F.min("n").alias("least")), "leader")
    partner = F.greatest("least", F.ceil(3 * F.col("n") / 4))
    shared = F.greatest(F.lit(1), F.ceil((3 * (F.col("n") + partner) - 7 * F.col("common")) / 7))
    wanted = F.when(F.col("linked"), F.col("lacking")).otherwise(F.col("lacking") - shared + 1)
    lists = measured.select("leader", "node", "rest").join(about.select("leader", "node", "component"), ["leader", "node"])
    sent = staged(lists.select("leader", "node", "component", F.explode("rest").alias("e")))
    often = sent.groupBy("leader", "e").agg(F.count("*").alias("times"), F.min("component").alias("one"), F.max("component").alias("other"))
    # shingles of one node or of one component come before the others, but nobody meets there, so of them only the number is needed
    meeting = sent.join(often.where("one <> other").select("leader", "e", "times"), ["leader", "e"])
    own = Window.partitionBy("leader", "node")
    meeting = meeting.withColumn("place", F.row_number().over(own.orderBy("times", "e"))).withColumn("meeting", F.count("*").over(own))
    ranked = meeting.join(about.select("leader", "node", "linked", "lacking", wanted.alias("wanted")), ["leader", "node"])
    ranked = staged(ranked.where(F.col("lacking") - F.col("meeting") + F.col("place") <= F.col("wanted")).select("leader", "e", "node", "linked", "component", "times"))
    small = ranked.where(F.col("times") <= SMALL_GROUP)
    x = small.where("NOT linked").select("leader", "e", F.col("node").alias("a"), F.col("component").alias("ca"))
    y = small.select("leader", "e", F.col("node").alias("b"), F.col("component").alias("cb"))
    shares = x.join(y, ["leader", "e"]).where("ca <> cb")
    x = about.where("NOT linked").select("leader", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("common").alias("in_a"))
    y = about.select("leader", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("common").alias("in_b"))
    enough = 7 * F.least("in_a", "in_b") >= 3 * (F.col("na") + F.col("nb"))
    fits = (4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & enough & (F.col("ca") != F.col("cb"))
    close = x.join(y, (x["leader"] == y["leader"]) & fits)
    pairs = shares.select("a", "b", "ca", "cb").unionByName(close.select("a", "b", "ca", "cb"))
    joined = _widened(joined, _bridges(_ordered(pairs), sets))
    return staged(ranked.where(F.col("times") > SMALL_GROUP).select(F.xxhash64("leader", "e").alias("key"), "node")), joined


def _ordered(pairs: DataFrame) -> DataFrame:
    """The pairs with the smaller node first."""
    swap = F.col("a") > F.col("b")
    return pairs.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("cb")).otherwise(F.col("ca")).alias("ca"),
        F.when(swap, F.col("ca")).otherwise(F.col("cb")).alias("cb"),
    ).distinct()


def _all_pairs(groups: DataFrame, joined: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The last way out, for groups that are still open after ``LEADER_ROUNDS``: all their pairs across components that may link."""
    rest = _open_groups(groups, joined)
    one = rest.where("component <> base").select("key", F.col("node").alias("a"), F.col("component").alias("ca")).join(left, "a")
    two = rest.select("key", F.col("node").alias("b"), F.col("component").alias("cb"), "base").join(right, "b")
    differ = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("base")) | (F.col("a") < F.col("b")))
    return _ordered(one.join(two, (one["key"] == two["key"]) & differ & _may_link()).select("a", "b", "ca", "cb"))


def _joined_components(close: DataFrame, members: DataFrame, nodes: DataFrame, sets: Sets) -> DataFrame:
    """The component of each node that links, from the pairs that met and may link and the members of hot keys. A written table."""
    # one partner of each node first; most others lie in its component then
    links = _verify(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets)
    joined = staged(components(links))
    apart = _placed(_placed(close, joined, "a", "ca"), joined, "b", "cb").where("ca <> cb")
    joined = _widened(joined, _bridges(apart, sets))
    groups = staged(members.select(F.col("a").alias("key"), F.col("b").alias("node")).distinct())
    for _ in range(LEADER_ROUNDS):
        groups, joined = _leader_round(groups, joined, nodes, sets)
        if groups is None:
            break
    else:
        left, right = _described(nodes, "a", "na", "x"), _described(nodes, "b", "nb", "y")
        joined = _widened(joined, _bridges(_all_pairs(groups, joined, left, right), sets))
    return joined


def similar_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", local_run: int = LOCAL_RUN, small_run: int = SMALL_RUN,
) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id``, the smallest id that links reach.

    Two documents link when the Jaccard similarity of their distinct shingles of five lower-cased words is at least 0.75.
    A text of fewer words has one shingle, its whole sequence; a null, empty or blank text has none and links with nothing.
    Repeated rows get one row each. A row without an id has no component. An empty table gives no row; other columns are
    not read.
    """
    plain = texts(docs, text, doc_id)
    summary = staged(plain.mapInArrow(_summaries, SUMMARY))
    frequent, _, n_runs = summarise(summary.where("sketch IS NULL").select("run", "n"))
    info = summary.where("sketch IS NOT NULL").withColumnRenamed("run", "doc_id")
    named = info.where("n > 0 AND doc_id IS NOT NULL")
    nodes = staged(named.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.min("sketch").alias("sketch"), F.count("*").alias("rows")
    ))
    buckets = max(1, -(-n_runs // 2 // BUCKET_KEYS))
    sent = plain.where("doc_id IS NOT NULL").select("text").mapInArrow(
        lambda it: _send_keys(it, frequent, buckets, local_run), "bucket int, kind int, a binary, b binary"
    )
    met = staged(sent.groupBy("bucket").applyInArrow(lambda t: _meet(t, small_run), "kind int, a long, b long, weight int"))
    members = met.where(F.col("kind") == MEMBERS).select("a", "b")
    pairs = staged(met.where(F.col("kind") == PAIRS).groupBy("a", "b").agg(F.sum("weight").alias("w")).where("w >= 2").select("a", "b"))

    close = pairs.join(_described(nodes, "a", "na", "x"), "a").join(_described(nodes, "b", "nb", "y"), "b")
    close = staged(close.where(_may_link()).select("a", "b"))
    ends = [close.select(F.col("a").alias("node")), close.select(F.col("b").alias("node")), members.select(F.col("b").alias("node"))]
    concerned = ends[0].unionByName(ends[1]).unionByName(ends[2])
    first_ids = staged(concerned.distinct().join(nodes.select("node", "first_id"), "node").select(F.col("first_id").alias("doc_id")).distinct())
    # every comparison joins the sets with a few nodes, so they are dealt by node once; a part's texts are shuffled by id, then its sets
    n_parts = min(PARTS, 1 + n_runs // PART_RUNS)
    part_of = F.pmod(F.xxhash64(F.lit(n_parts), "doc_id"), F.lit(n_parts))
    whole = [
        plain.where(part_of == i).join(first_ids.where(part_of == i), "doc_id", "left_semi").select("text")
        .mapInArrow(_sets, "node long, n long, runs binary") for i in range(n_parts)
    ]
    with staged_by(whole, "node", -(-n_runs // BUCKET_RUNS)) as table:
        joined = _joined_components(close, members, nodes, Sets(table, max(SENT_RUNS, SENT_SHARE * n_runs)))
    final = joined.select("node", "component")
    placed = nodes.join(final, "node", "left").select(
        "node", "first_id", "rows", F.coalesce("component", "node").alias("component")
    )
    placed = staged(placed)
    ids = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    groups = staged(placed.join(ids, "component").select("node", "rows", "component_id"))
    linked = attach_groups(named.select("doc_id", "n", "node"), groups, "node", "rows")
    alone = info.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")
