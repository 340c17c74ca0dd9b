"""The quadtree against plain scans, the search against brute force."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import treap_search
from cohortlens.llm.treap_search import Treap, build_index, search, terms_of
from tests.llm.odd import odd_documents, odd_rows

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_force(docs, items, k=10):
    split = [(i, plain_terms(t)) for i, t in docs]
    split = [(i, t) for i, t in split if t]
    n_docs, n_terms = len(split), sum(len(t) for _, t in split)
    df = {}
    for _, t in split:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item_id, text in items:
        scored = []
        for i, t in split:
            m = 10 + 90 * len(t) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m))
                for x in set(plain_terms(text)) & set(t)
            )
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(item_id, r, x[2], x[3]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3] if not x[1] else (x[0], True, 0))[:k], 1)]
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 40), st.integers(0, 300)), st.integers(1, 1000), min_size=1, max_size=200),
       st.lists(st.integers(0, 40), min_size=1, max_size=6, unique=True), st.integers(1, 5))
def test_best_columns_of_some_rows(cells, rows, k):
    at = np.array(list(cells), np.int64)
    tree = Treap.load(*Treap.build(at[:, 0], at[:, 1], np.array(list(cells.values()), np.int64)))
    weights = np.arange(1, len(rows) + 1)
    cols, scores = tree.best(np.array(rows), weights, k)
    want = {}
    for (r, c), v in cells.items():
        if r in rows:
            want[c] = want.get(c, 0) + v * int(weights[rows.index(r)])
    ranked = sorted(want.values(), reverse=True)
    last = ranked[min(k, len(ranked)) - 1] if ranked else 0
    assert dict(zip(cols.tolist(), scores.tolist(), strict=True)) == {c: s for c, s in want.items() if s >= last}


def test_node_maxima_fall_from_level_to_level():
    rnd = np.random.default_rng(3)
    cells = np.unique(rnd.integers(0, 500, (4000, 2)), axis=0)
    impacts = rnd.integers(1, 10**6, len(cells))
    height, sizes, mask, gap, rows, cols = Treap.build(cells[:, 0], cells[:, 1], impacts)
    tree = Treap.load(height, sizes, mask, gap, rows, cols)
    assert (gap >= 0).all() and tree.top[0] == impacts.max() and len(rows) == len(cells)
    leaf = np.flatnonzero(tree.mask[:-1] == 0)
    got = {(int(r), int(c)): int(v) for r, c, v in zip(tree.row[leaf], tree.col[leaf], tree.top[leaf], strict=True)}
    assert got == {(int(r), int(c)): int(v) for (r, c), v in zip(cells, impacts, strict=True)}


def test_terms():
    for text in [None, "", "A_b-C9 Él\x00straße 日本", "...", "x" * 100]:
        assert terms_of(text) == plain_terms(text)


@pytest.mark.parametrize("block", [treap_search.BLOCK_BYTES, 3000])
def test_search_on_odd_documents(spark, monkeypatch, block):
    monkeypatch.setattr(treap_search, "BLOCK_BYTES", block)
    rows = odd_rows()
    rows += [(900 + i, rows[i % 5][1]) for i in range(30)]
    filled = [t for _, t in rows if t]
    items = [(1, filled[0][:400]), (2, None), (3, ""), (4, "one two THREE"), (4, "one"), (None, filled[2][:300]), (7, "nowhere-found"), (8, " ".join(filled[5][:900].split()))]
    got = search(build_index(odd_documents(spark, rows)), spark.createDataFrame([(*x, 1, "z") for x in items], "item_id long, text string, item int, rank string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows, items)


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(treap_search, "ITEM_BLOCK", 2)
    rows = [(i, f"a{i % 3} b{i % 5} c") for i in range(40)]
    items = [(i, f"a{i} b{i + 1}") for i in range(5)]
    got = search(build_index(odd_documents(spark, rows)), spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows, items, 3)


def test_empty_tables(spark):
    none = odd_documents(spark, [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search(build_index(none), items).collect() == []
    assert search(build_index(odd_documents(spark)), items.limit(0)).collect() == []
