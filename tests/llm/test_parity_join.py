import os
import random

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import components, parity_join
from cohortlens.llm.arrays import chunks
from cohortlens.llm.frequent import distinct_runs, frequent_runs
from cohortlens.sources import shared_folder
from tests.llm.odd import odd_documents, odd_rows, similar


def variants(rnd, n):
    a = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    b = list(a)
    for _ in range(rnd.randrange(0, max(2, n // 25 + 2))):
        r, i = rnd.random(), rnd.randrange(len(b))
        if r < 0.3:
            b.insert(i, f"x{rnd.randrange(10**6)}")
        elif r < 0.6 and len(b) > 1:
            del b[i]
        else:
            b += [f"y{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 2 + n // 5))]
    return " ".join(a), " ".join(b)


def test_linked_documents_share_two_keys_or_one_that_is_enough():
    rnd, linked = random.Random(5), 0
    for trial in range(1500):
        pair = variants(rnd, rnd.choice([1, 2, 3, 5, 6, 7, 8, 9, 12, 16, 20, 30, 50, 80, 120, 200, 333]))
        found = similar(dict(enumerate(pair)))
        runs, sizes, _ = distinct_runs(next(chunks(pa.array(pair))), 5, True)
        few = np.random.default_rng(trial).choice(np.unique(runs), len(runs) // 6, replace=False)
        keys, rows = parity_join.all_keys(runs, sizes, np.sort(few))
        if found[0][1] == found[1][1]:
            linked += 1
            common = set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
            assert len(common) >= 2 or any(k & int(parity_join.ENOUGH) for k in common)
    assert linked > 150


def test_dense_sketches_differ_by_no_more_than_the_sets():
    rnd = random.Random(6)
    for _ in range(100):
        runs, sizes, _ = distinct_runs(next(chunks(pa.array(variants(rnd, 150)))), 5, True)
        one, two = set(runs[:sizes[0]].tolist()), set(runs[sizes[0]:].tolist())
        x, y = parity_join.dense_sketches(runs, sizes)
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(one ^ two)


@pytest.mark.parametrize(("local_run", "small_run"), [(32, 4), (1, 1), (2, 3)])
def test_components_of_many_near_copies(spark, local_run, small_run):
    rnd = random.Random(7)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        texts += variants(rnd, 60)
    chain = [f"k{i}" for i in range(80)]
    for step in range(10):  # neighbours link, the ends do not
        chain = [*chain[4:], *(f"s{step}{i}" for i in range(4))]
        texts.append(" ".join(chain))
    for i in range(40):
        texts.append(" ".join([*common, f"t{i}"]))  # a group of near copies
        texts.append(" ".join([*common[:15], *(f"u{i}x{k}" for k in range(50))]))  # a shared passage only
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    got = parity_join.similar_documents(odd_documents(spark, rows), local_run=local_run, small_run=small_run).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == similar(dict(rows))


def test_odd_documents(spark):
    got = parity_join.similar_documents(odd_documents(spark)).collect()
    want = similar({i: t for i, t in odd_rows() if i is not None})
    assert len(got) == len(odd_rows())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert parity_join.similar_documents(odd_documents(spark, [])).collect() == []


def test_frequent_runs_are_found(spark):
    texts = [(" ".join(["a b c d e", *(f"w{i}x{k}" for k in range(10))]),) for i in range(60)]
    runs, docs, total = frequent_runs(spark.createDataFrame(texts, "text string"), 5, True, share=0.5)
    assert docs == 60 and total == 60 * 11 and len(runs) == 1


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 50)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (300, 299), (300, 299)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, **{200 + i: 100 for i in range(30)}, 299: 299, 300: 299}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def edited(rnd, words, times):
    out = list(words)
    for _ in range(times):
        out[rnd.randrange(len(out))] = f"e{rnd.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize(("group", "of_leader"), [(8, 512), (8, 0), (2, 0)])
def test_copies_with_more_and_fewer_edits(spark, monkeypatch, group, of_leader):
    """Many that do not link with each other, but link with some copy of few edits; two bases that share a part."""
    monkeypatch.setattr(parity_join, "SMALL_GROUP", group)
    monkeypatch.setattr(parity_join, "LEADER_GROUP", of_leader)
    rnd = random.Random(8)
    one = [f"b{i}" for i in range(120)]
    two = [*one[:95], *(f"d{i}" for i in range(30))]
    rows = [(i, edited(rnd, rnd.choice([one, one, two]), rnd.choice([0, 1, 2, 3, 3, 4, 5, 6]))) for i in range(160)]
    got = parity_join.similar_documents(odd_documents(spark, rows), local_run=1, small_run=2).collect()
    want = similar(dict(rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len({c for _, c in want.values()}) > 5


@pytest.mark.parametrize("of_leader", [512, 0])
def test_documents_of_one_template_are_not_paired(spark, monkeypatch, of_leader):
    monkeypatch.setattr(parity_join, "LEADER_GROUP", of_leader)
    compared = []
    plain = parity_join._verify

    def counting(pairs, sets):
        compared.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(parity_join, "_verify", counting)
    rnd = random.Random(9)
    template = [f"t{i}" for i in range(90)]
    rows = [(i, " ".join([*template, *(f"u{rnd.randrange(10**9)}" for _ in range(22))])) for i in range(400)]
    got = parity_join.similar_documents(odd_documents(spark, rows), local_run=1, small_run=2).collect()
    assert {r.component_id for r in got} == set(range(400))
    assert sum(compared) < 10 * 400  # all pairs are 79,800


def test_members_of_a_leader_that_link_are_found():
    rng = np.random.default_rng(10)
    leader = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    sets = []
    for _ in range(12):
        base = np.concatenate([rng.permutation(leader)[:rng.integers(60, 190)], rng.integers(0, 1 << 62, 90, dtype=np.uint64)])
        sets += [rng.permutation(base)[:rng.integers(len(base) * 2 // 3, len(base))] for _ in range(5)]
    rest = [s[~np.isin(s, leader)] for s in sets]
    sketches = parity_join.dense_sketches(np.concatenate(rest), np.array([len(r) for r in rest]))
    n, common = [len(s) for s in sets], [len(s) - len(r) for s, r in zip(sets, rest, strict=True)]
    linked = [7 * c >= 3 * (200 + k) for c, k in zip(common, n, strict=True)]
    component = [0 if x else i + 1 for i, x in enumerate(linked)]
    got = parity_join._near_members(pa.table({
        "node": list(range(60)), "n": n, "common": common, "linked": linked, "component": component, "sketch": [k.tobytes() for k in sketches],
    })).to_pylist()
    found = [(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got]
    inside = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    want = {(i, j) for i in range(60) for j in range(i) if 7 * inside(i, j) >= 3 * (n[i] + n[j]) and component[i] != component[j]}
    want = {(j, i) for i, j in want}
    assert len(want) > 10 and want <= set(found) and len(found) == len(set(found)) < 60 * 59 // 4
    assert all(component[r["a"]] == r["ca"] and component[r["b"]] == r["cb"] for r in got)


def test_written_tables_hold_no_lists_of_shingles(spark):
    """Documents of some templates: four fifths of the words are the template's, the others are their own."""
    rnd, rows = random.Random(11), []
    for t in range(20):
        template = [f"t{t}x{i}" for i in range(900)]
        rows += [" ".join([*template, *(f"u{rnd.randrange(10**9)}" for _ in range(220))]) for _ in range(12)]
        rows.append(f"{rows[-1]} end")
    folder = shared_folder(spark).removeprefix("file:")
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))
    frame, before = odd_documents(spark, [*enumerate(rows)]), held()
    got = parity_join.similar_documents(frame, local_run=1, small_run=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == similar(dict(enumerate(rows)))
    # a shingle has 8 bytes; what stays are tables with some numbers a document
    assert held() - before < 8 * sum(r.n_shingles for r in got)


def test_comparisons_are_sent_in_parts(spark, monkeypatch):
    """With a low bound, parts stay below what is sent in all, and nothing is lost between them, of rows loaded twice as well."""
    monkeypatch.setattr(parity_join, "SENT_RUNS", 2_000)
    monkeypatch.setattr(parity_join, "SENT_SHARE", 0.0)
    monkeypatch.setattr(parity_join, "PART_RUNS", 10_000)
    asked, plain = [], parity_join._with_sets

    def counting(pairs, sets):
        asked.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(parity_join, "_with_sets", counting)
    rnd = random.Random(12)
    one = [f"b{i}" for i in range(120)]
    rows = [*enumerate([t for _ in range(60) for t in variants(rnd, 60)] + [edited(rnd, one, rnd.choice([0, 1, 3, 5])) for _ in range(40)])]
    got = parity_join.similar_documents(odd_documents(spark, [*rows, *rows[:30], *rows[-10:]]), local_run=1, small_run=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == similar(dict(rows))
    assert len(asked) > 2 and max(asked) < 0.7 * sum(asked)


def test_leader_links_are_those_of_all_pairs():
    rng = np.random.default_rng(13)
    leader = np.sort(rng.integers(0, 1 << 62, 200, dtype=np.uint64))
    sets = [leader]
    for _ in range(12):
        base = np.concatenate([rng.permutation(leader)[:rng.integers(60, 190)], rng.integers(0, 1 << 62, 90, dtype=np.uint64)])
        sets += [np.sort(rng.permutation(base)[:rng.integers(len(base) * 2 // 3, len(base))]) for _ in range(5)]
    nodes = [100 + i for i in range(len(sets))]
    order = [*rng.permutation(len(sets)), 3, 0]  # two rows come twice
    got = parity_join._leader_links(pa.table({
        "leader": [100] * len(order), "node": [nodes[i] for i in order], "component": [nodes[i] - i % 2 for i in order], "runs": [sets[i].tobytes() for i in order],
    }))

    def joined(links):
        parent = {n: n for n in nodes}
        for a, b in links:
            x, y = parent[a], parent[b]
            parent = {n: min(x, y) if p in (x, y) else p for n, p in parent.items()}
        return parent

    link = lambda x, y: 7 * len(np.intersect1d(x, y)) >= 3 * (len(x) + len(y))
    own = [(n, n - i % 2) for i, n in enumerate(nodes)]
    every = [(nodes[i], nodes[j]) for i in range(len(sets)) for j in range(i) if link(sets[i], sets[j])]
    found = list(zip(*(got.column(c).to_pylist() for c in "ab"), strict=True))
    assert joined(own + found) == joined(own + every) and len(set(joined(own + every).values())) > 5
    assert all(a < b for a, b in found) and len(set(found)) == len(found)
