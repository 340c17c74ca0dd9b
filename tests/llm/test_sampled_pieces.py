import itertools
import math
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from cohortlens.llm import sampled_pieces as s
from tests.llm.odd import odd_documents, odd_rows

PATH = s.default_model()
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)


def spelled(text):
    return (text or "").replace("▁", " ")


def test_every_sample_spells_its_text():
    texts = [t or "" for _, t in odd_rows()] + ["  a  b ", "日本𠀀 x\n\ny", "x▁y", "\n", "é́ ½\x00"]
    found = {}
    for row, number, ids, log_p, value, inclusion in s.sample_batch(texts, np.arange(len(texts)), PATH, 3, 0.5):
        assert MODEL.decode(ids.tolist()) == spelled(texts[row])
        assert log_p <= 1e-6 and -np.inf < inclusion <= 0
        found.setdefault(row, []).append((value, tuple(ids.tolist())))
    assert len(found) == len(texts)
    for samples in found.values():
        assert len({ids for _, ids in samples}) == len(samples)
        assert [v for v, _ in samples] == sorted((v for v, _ in samples), reverse=True)


def test_samples_follow_the_distribution_without_replacement():
    n = 20_000
    first, among, weights, log_p = Counter(), Counter(), Counter(), {}
    for _, number, ids, p, _, inclusion in s.sample_batch(["a the"] * n, np.arange(n), PATH, 3, 0.5):
        path = tuple(ids.tolist())
        log_p[path] = p
        first[path] += number == 1
        among[path] += 1
        weights[path] += math.exp(-inclusion)
    share = {k: math.exp(v) for k, v in log_p.items()}
    assert sum(share.values()) == pytest.approx(1, abs=1e-3)
    best = sorted(share, key=share.get, reverse=True)
    for path in best[:4]:
        exact = 0.0
        for order in itertools.permutations(best[:10], 3):
            if path in order:
                p, left = 1.0, 1.0
                for x in order:
                    p, left = p * share[x] / left, left - share[x]
                exact += p
        spread = 5 * math.sqrt(max(exact * (1 - exact), 1e-4) / n)
        assert among[path] / n == pytest.approx(exact, abs=spread + 2e-3)
        assert first[path] / n == pytest.approx(share[path], abs=5 * math.sqrt(share[path] / n) + 1e-3)
        assert weights[path] / n == pytest.approx(1, abs=0.15)  # Horvitz-Thompson


def test_a_row_has_the_same_samples_in_any_batch():
    texts = [t or "" for _, t in odd_rows()][:14]
    run = lambda picked: {(k, n): (ids.tolist(), v) for j, n, ids, _, v, _ in
                          s.sample_batch([texts[i] for i in picked], np.array(picked), PATH, 2, 0.5) for k in [picked[j]]}
    together, apart = run(list(range(14))), {}
    for i in range(14):
        apart |= run([i])
    assert {k: v[0] for k, v in together.items()} == {k: v[0] for k, v in apart.items()}


def test_odd_documents_round_trip(spark):
    rows = {i: t for i, t in odd_rows() if i is not None}
    encoded = s.sample_documents(odd_documents(spark), with_ids=True)
    for r in s.decode_documents(encoded).collect():
        if r.doc_id is not None:
            assert r.text == spelled(rows[r.doc_id]) and r.n_pieces == len(r.ids)
    assert s.sample_documents(odd_documents(spark, [])).collect() == []
