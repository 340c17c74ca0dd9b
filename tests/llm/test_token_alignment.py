"""Alignment against the libraries run on whole texts and counted by brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import token_alignment
from cohortlens.llm.token_alignment import Segments, Side, align_documents, aligned_blocks, default_paths, merged, pair_counts, segments, with_maxima
from tests.llm.odd import odd_documents, odd_rows


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = default_paths()
    a = Tokenizer.from_file(first)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=second), Side(first), Side(second)


@pytest.fixture(scope="module")
def memo():
    return Segments(*default_paths())


def whole(libraries, text):
    """Ids of both sides of a whole text, groups of (ids of a, ids of b); nothing where there are no tokens."""
    one, two, side_a, side_b = libraries
    if not text:
        return None
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    full = (" " + text).encode()
    if b"".join(side_a.spelling[i] for i in a) != full or b"".join(side_b.spelling[i] for i in b) != full:
        return None
    groups, x, y, i, j = [], 0, 0, 0, 0
    p = q = 0
    while p < len(a) or q < len(b):
        if x <= y:
            x += len(side_a.spelling[a[p]])
            p += 1
        else:
            y += len(side_b.spelling[b[q]])
            q += 1
        if x == y:
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
    return a, b, groups


def spelt(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute_force(libraries, rows):
    done = [(i, whole(libraries, t)) for i, t in rows]
    counts = Counter((a[-1], b[-1]) for _, d in done if d for a, b in d[2])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, d in done:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a[-1], b[-1]) for a, b in d[2]]
        out.append((i, len(d[0]), len(d[1]), len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(spelt(d[2]).encode()).hexdigest()))
    return sorted(out, key=str), {(a, b, n, most[b]) for (a, b), n in counts.items()}


ODD = [" ", "  ", "\n", " \n a", "a  b", "a \n\nb ", "▁", "a▁b c", "x  y", "x    y", "!\x1cb", "a\x85 b", "　日本 ", "<|endoftext|> <s></s><unk>",
       "<0x0A>\n", "\x00a", "don't  we're'll", "１２ 34\t\t5", "😀😀 é́", "a​ b", "﻿a b", "\r\n\r\n", "a" * 400, "  b", " lead", "tail  "]


def tokens_by_segments(memo, text):
    numbers = [memo[s] for s in segments(" " + text)]
    memo.settle()
    return ";".join(memo.groups[n] for n in numbers) if all(memo.good.values[n] for n in numbers) else None


@pytest.mark.parametrize("text", ODD)
def test_segments_give_the_tokens_of_the_whole(libraries, memo, text):
    want = whole(libraries, text)
    assert tokens_by_segments(memo, text) == (None if want is None else spelt(want[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(list(" \t\n\r\x0b\x0c\x1c\x85  　​.,!?'-_=0123abcdeé日😀▁")), st.sampled_from(["the ", " and", "  ", "\n\n", "'s", "ing "])), min_size=1, max_size=40))
def test_segments_of_any_text(libraries, memo, parts):
    text = "".join(parts)
    want = whole(libraries, text)
    assert tokens_by_segments(memo, text) == (None if want is None else spelt(want[2]))


def test_merge_and_maxima():
    runs = [iter([(1, 2), (5, 1)]), iter([(1, 3), (2, 7)]), iter([])]
    assert list(merged(runs)) == [(1, 5), (2, 7), (5, 1)]
    side = 1 << token_alignment.ID_BITS
    assert list(with_maxima(iter([(1, 5), (2, 7), (side + 1, 4)]))) == [(1, 5, 7), (2, 7, 7), (side + 1, 4, 4)]
    assert list(with_maxima(iter([]))) == []


def test_documents(spark, libraries):
    rows = odd_rows() + [(500 + i, t) for i, t in enumerate(ODD)]
    docs = odd_documents(spark, rows)
    want, pairs = brute_force(libraries, rows)
    got = align_documents(docs, with_groups=True)
    assert sorted(map(tuple, got.drop("groups").collect()), key=str) == want
    by_id = {r.doc_id: r for r in got.collect()}
    for i, t in rows:
        if i is not None and i >= 500:
            d = whole(libraries, t)
            assert by_id[i].groups == (spelt(d[2]) if d else "")
    counted = pair_counts(aligned_blocks(docs, default_paths()))
    assert {tuple(r) for r in counted.collect()} == pairs


def test_merges_in_rounds(spark, libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "FAN_IN", 2)
    rows = [(i, f"some words {i % 7} and the rest, number {i}") for i in range(60)]
    want, _ = brute_force(libraries, rows)
    got = align_documents(odd_documents(spark, rows).repartition(7))
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_table(spark):
    assert align_documents(odd_documents(spark, [])).collect() == []
    assert [tuple(r) for r in align_documents(odd_documents(spark, [(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
