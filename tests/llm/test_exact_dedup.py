import hashlib
import re

import numpy as np
import pytest

from cohortlens.llm import exact_dedup
from tests.llm.odd import odd_documents, odd_rows


def test_the_hash_is_minimal_and_perfect():
    keys = np.random.default_rng(3).integers(0, 2**63, (5000, 4), dtype=np.uint64)
    levels = exact_dedup.build_hash(keys)
    assert sorted(exact_dedup.slots(keys, levels)) == list(range(5000))
    strangers = np.random.default_rng(4).integers(0, 2**63, (1000, 4), dtype=np.uint64)
    assert exact_dedup.slots(strangers, levels).max() < 5000


@pytest.mark.parametrize("shard_keys", [1, 5, 1000])
def test_history_and_incoming(spark, shard_keys):
    rnd = np.random.default_rng(1)
    rows = [(int(i), hashlib.sha256(str(rnd.integers(0, 30)).encode()).digest()) for i in rnd.permutation(120)]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, digest binary")
    got = exact_dedup.dedup(frame(rows[:70]), frame(rows[70:]), shard_keys).collect()
    groups: dict[bytes, list[int]] = {}
    for i, d in rows:
        groups.setdefault(d, []).append(i)
    assert {bytes(r.digest): (r.keep_id, r.group_size) for r in got} == {d: (min(v), len(v)) for d, v in groups.items()}
    assert {bytes(r.digest) for r in got if r.in_history} == {d for _, d in rows[:70]}


def test_odd_documents(spark):
    rows = odd_rows()
    got = exact_dedup.exact_duplicates(odd_documents(spark)).collect()
    key = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[key(t)] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[key(t)]), i == keep, key(t)))
    by = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(map(tuple, got), key=by) == sorted(want, key=by)


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(odd_documents(spark, [])).collect() == []


def test_a_small_history_does_not_put_all_incoming_digests_in_one_shard(spark, monkeypatch):
    asked = []
    sharded = exact_dedup._sharded
    monkeypatch.setattr(exact_dedup, "_sharded", lambda df, shards: asked.append(shards) or sharded(df, shards))
    rows = [(i, hashlib.sha256(str(i).encode()).digest()) for i in range(101)]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, digest binary")
    got = exact_dedup.dedup(frame(rows[:1]), frame(rows[1:]), 10).collect()
    assert set(asked) == {10} and {bytes(r.digest) for r in got} == {d for _, d in rows}
