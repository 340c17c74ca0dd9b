"""Exact duplicates by a minimal perfect hash over the distinct digests seen before.

The distinct digests of the history are cut into shards by their first bytes. Each shard gets a minimal perfect hash:
levels of bit arrays, in which a digest takes the first level where no other digest of the level shares its bit; the
rank of that bit is its slot. A slot holds the full digest, the locator of its winner (smallest document id) and its
number of rows. A lookup computes the slot and compares all 32 bytes, so a stranger never passes for a member.
Incoming rows are first grouped by digest (map-side), so a digest is looked up once however many rows have it. Digests
that are not members form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrays import mix
from cohortlens.llm.spark_util import attach_groups, row_key, staged, texts, unused

DIGEST = 32
#: Bits per key on each level of the hash.
GAMMA = 1.5
#: Distinct digests per shard, on average.
SHARD_KEYS = 100_000
#: Stands for a null id while groups are formed.
NO_ID = 2**63 - 1


def normalised(text):
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``row_key`` and the SHA-256 of the normalised text as 32 bytes."""
    plain = texts(docs, text, doc_id)
    return plain.select("doc_id", row_key().alias("row_key"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))


def _bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
    salted = mix(keys[:, 0] + salt) ^ keys[:, 1 + level % 3]
    return mix(salted) % np.uint64(size)


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash of distinct rows of ``keys`` (n x 4 unsigned 64-bit numbers)."""
    levels, left = [], keys
    while len(left):
        size = max(8, int(GAMMA * len(left)))
        spots = _bits(left, len(levels), size)
        taken = np.bincount(spots, minlength=size) == 1
        levels.append(taken)
        left = left[~taken[spots]]
    return levels


def slots(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot of each key; any number for a key that the hash was not built from, or -1."""
    out = np.full(len(keys), -1, np.int64)
    open_, base = np.arange(len(keys)), 0
    for level, taken in enumerate(levels):
        spots = _bits(keys[open_], level, len(taken))
        hit = taken[spots]
        ranks = np.cumsum(taken) - 1
        out[open_[hit]] = base + ranks[spots[hit]]
        base += int(taken.sum())
        open_ = open_[~hit]
    return out


def _as_keys(digest_column) -> np.ndarray:
    return np.frombuffer(b"".join(digest_column), np.uint64).reshape(-1, DIGEST // 8)


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: the bit arrays and the slots (digest, winner, rows) of a shard."""
    keys = _as_keys(pdf["digest"])
    levels = build_hash(keys)
    order = np.argsort(slots(keys, levels))
    return pd.DataFrame({
        "shard": [int(pdf["shard"].iloc[0])],
        "sizes": [np.array([len(x) for x in levels], np.int64).tobytes()],
        "bits": [np.packbits(np.concatenate(levels)).tobytes()],
        "digests": [keys[order].tobytes()],
        "winners": [pdf["winner"].to_numpy(np.int64)[order].tobytes()],
        "counts": [pdf["rows"].to_numpy(np.int64)[order].tobytes()],
    })


SHARD_SCHEMA = "shard int, sizes binary, bits binary, digests binary, winners binary, counts binary"


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The hash of the history's distinct digests (``digest``, ``winner``, ``rows``), one row per shard."""
    return _sharded(history, shards).groupBy("shard").applyInPandas(build_shard, SHARD_SCHEMA)


def _sharded(df: DataFrame, shards: int) -> DataFrame:
    # the digest is uniform, so are the shards
    return df.withColumn("shard", (F.conv(F.hex(F.substring("digest", 25, 4)), 16, 10).cast("long") % shards).cast("int"))


def lookup_shard(index: pd.DataFrame, incoming: pd.DataFrame) -> pd.DataFrame:
    """Groups of one shard: members joined with their slot, the rest on their own, and slots that nothing met."""
    parts = []
    new = _as_keys(incoming["digest"]) if len(incoming) else np.zeros((0, 4), np.uint64)
    winner, rows = incoming["winner"].to_numpy(np.int64), incoming["rows"].to_numpy(np.int64)
    member = np.zeros(len(new), bool)
    if len(index):
        row = index.iloc[0]
        sizes = np.frombuffer(row["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[:sizes.sum()].astype(bool)
        levels = np.split(bits, np.cumsum(sizes)[:-1])
        stored = np.frombuffer(row["digests"], np.uint64).reshape(-1, DIGEST // 8)
        winners, counts = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["counts"], np.int64).copy()
        slot = slots(new, levels)
        member = (slot >= 0) & (stored[slot] == new).all(axis=1)
        winners[slot[member]] = np.minimum(winners[slot[member]], winner[member])
        counts[slot[member]] += rows[member]
        parts.append((stored, winners, counts, np.ones(len(stored), bool)))
    parts.append((new[~member], winner[~member], rows[~member], np.zeros(int((~member).sum()), bool)))
    keys, keep, size, known = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pd.DataFrame({
        "digest": [x.tobytes() for x in keys], "keep_id": keep, "group_size": size, "in_history": known,
    })


def shard_count(history: DataFrame, incoming: DataFrame, shard_keys: int) -> int:
    """Shards for the larger of both frames, as a shard holds the digests of either."""
    return max(1, -(-max(history.count(), incoming.count()) // shard_keys))


def dedup(history: DataFrame, incoming: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per digest of either frame: ``digest``, ``keep_id``, ``group_size``, ``in_history``.

    Both frames have ``doc_id`` and ``digest`` and should be written tables. The row with the smallest id stays.
    """
    def grouped(df: DataFrame) -> DataFrame:
        return df.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count("*").alias("rows"))

    shards = shard_count(history, incoming, shard_keys)
    index = build_index(grouped(history), shards)
    return (
        _sharded(grouped(incoming), shards).groupBy("shard").cogroup(index.groupBy("shard"))
        .applyInPandas(
            lambda new, old: lookup_shard(old, new),
            "digest binary, keep_id long, group_size long, in_history boolean",
        )
    )


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_key: bool = False) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``, and ``row_key`` on request.

    The documents of the lower half of the id range are the history, the others arrive; the result is the same
    wherever the range is cut. Rows that repeat a document id count as rows of their own and get one row each; a null
    text counts as empty; an empty table gives no row. Other columns of ``docs`` are not read. A null id gets a row, but stays only
    if its whole group has none.
    """
    table = staged(digests(docs, text, doc_id))
    span = table.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    cut = 0 if span["low"] is None else (span["low"] + span["high"]) // 2
    known = F.coalesce(F.col("doc_id") <= cut, F.lit(False))
    # A frame of null ids has no smallest one; the largest number stands for it until the end.
    ids = table.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    groups = staged(dedup(ids.where(known), ids.where(~known)))
    out = attach_groups(table, groups, "digest", "group_size")
    keep = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return out.select(
        *["row_key"][:with_key], "doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, decisions: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that a decision keeps: by id and ``row_key``, or by id alone if decisions have no such column.

    By id alone, rows without an id stay if one of them is kept.
    """
    keyed = "row_key" in decisions.columns
    name, key = unused(docs, "_kept_id", "_kept_key")
    kept = decisions.where("kept").select(F.col("doc_id").alias(name), *([F.col("row_key").alias(key)] if keyed else []))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(name))
    return docs.join(kept.distinct(), same & (row_key(text, doc_id) == F.col(key)) if keyed else same, "left_semi")


def one_of_equal(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts: that of the smallest id, of its spellings that of the smallest key.

    Of rows with equal id and text one stays as well. Rows without an id come last.
    """
    kept = exact_duplicates(docs, with_key=True).where("kept").groupBy("doc_id", "text_sha256")
    kept = staged(kept.agg(F.min("row_key").alias("row_key"), (F.count("*") > 1).alias("several")).withColumn("kept", F.lit(True)))
    single = kept_rows(docs, kept.where("NOT several"))
    if not kept.where("several").limit(1).count():
        return single
    repeated = kept_rows(docs, kept.where("several"))
    row = F.struct(*(F.col(c) for c in docs.columns))
    # as text, because maps have no hash
    one = repeated.groupBy(F.col("doc_id").alias("_id"), row_key().alias("_key")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row"))
    return single.unionByName(one.select("_row.*"))
