import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlens.llm import packing, token_counts, token_files, token_ids
from tests.llm.odd import odd_documents, odd_rows

PATH = token_counts.default_vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
ODD = st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'sT é1!.,\n\t<|>\u3000\x1c"), st.characters(codec="utf-8")), max_size=25), min_size=1, max_size=8)


def library_ids(text, end=None):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_counts_and_ids_are_the_librarys(texts):
    texts += ["a<|endoftext|>b<|STARTOFTEXT|>", "it's I'LL", "aaaaaa", "foo.'s bar%%%"]
    assert token_counts.count_batch(texts, PATH).tolist() == [len(library_ids(t)) for t in texts]
    got = [None] * len(texts)
    for first, ids, counts in token_ids.encode_texts(texts, PATH, 7):
        for k, part in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
            got[first + k] = part.tolist()
    assert got == [library_ids(t, 7) for t in texts]


def texts_ids(texts):
    got = []
    for first, ids, counts in token_ids.encode_texts(texts, PATH):
        assert first == len(got)
        got += [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
    return got


def test_ids_beside_signs_are_the_librarys():
    odd = [chr(i) for i in range(1, 0x3100)] + list("\ufeff\ufb01\uff0c\uff21日本\U0001f600\U00010400")
    texts = [f"K{c},a{c}'s1{c}.{c}-T{c} {c}A{c}<|x{c}" for c in odd]
    texts += ["", ",", "a<", "|b", "A", "\u030c", "A<|endoftext|>,B.", "É,\tÉ,\rx", "J", "\u0308,"]
    assert texts_ids(texts) == [library_ids(t) for t in texts]
    for alone in ([], [""], [","], ["a"], ["é"], [" "], ["", ".", ""]):
        assert texts_ids(alone) == [library_ids(t) for t in alone]


def test_words_met_again_are_not_encoded_again(monkeypatch):
    import tokenizers

    sent = []

    class Counting:
        def __init__(self, path):
            self.library = LIBRARY

        from_file = classmethod(lambda cls, path: cls(path))

        def encode(self, text, **kwargs):
            sent.extend(text.split(" "))
            return self.library.encode(text, **kwargs)

        def encode_batch_fast(self, texts, **kwargs):
            sent.extend(w for t in texts for w in t.split(" "))
            return self.library.encode_batch_fast(texts, **kwargs)

        def __getattr__(self, name):
            return getattr(self.library, name)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    monkeypatch.setattr(token_ids, "_memos", {})
    for name in ("MEMO_WORDS", "MEMO_PARTS"):
        monkeypatch.setattr(token_ids, name, 100, raising=False)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = iter(x + y + z + "q" for x in letters for y in letters for z in letters)
    for _ in range(40):
        texts = [" ".join(["Common", "often,", "common.", *(next(rare) for _ in range(30))])]
        assert texts_ids(texts) == [library_ids(t) for t in texts]
    assert sent.count("common") == 1 and sent.count("often") == 1
    memo = token_ids._memos[PATH]
    assert len(memo) <= 140 and memo.ids.size < 2000


def test_counts_beside_characters_of_newer_unicode_are_the_librarys():
    new = [*range(0x0530, 0x0590), *range(0xA7C0, 0xA800), *range(0x3D000, 0x3D020), 0x2B73A, 0x12550, 0x16EA0, 0x1E6C0]
    texts = [f"Î{chr(i)} a{chr(i)},{chr(i)}1" for i in new]
    assert token_counts.count_batch(texts, PATH).tolist() == [len(library_ids(t)) for t in texts]


def test_merged_ids_are_the_librarys():
    table = token_counts.MergeTable(PATH)
    pieces = [b"thousands", b"aaaaaaa", b"a", "é".encode(), b"qzqzqzq"]
    assert [x.tolist() for x in table.merge(pieces)] == [library_ids(p.decode()) for p in pieces]


def test_a_vocabulary_that_needs_single_merges_is_refused():
    with pytest.raises(ValueError):
        token_counts.MergeTable._check_order(np.array([3, 0]), np.array([1, 1]), np.array([4, 3]), 5)


def test_count_odd_documents(spark):
    got = token_counts.count_tokens(odd_documents(spark)).collect()
    want = [(i, len((t or "").encode()), len(library_ids(t))) for i, t in odd_rows()]
    by = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=by) == sorted(want, key=by)
    assert token_counts.count_tokens(odd_documents(spark, [])).collect() == []


def test_files_hold_all_ids_in_order(spark):
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = token_files.token_digests(odd_documents(spark)).collect()
    want, at = [], 0
    for i, t in rows:
        ids = library_ids(t, 2)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_digests(odd_documents(spark, [])).collect() == []


@pytest.mark.parametrize("sizes", [[5], [3, 700, 1], [64] * 9, [0, 2000, 7]])
def test_random_access_without_copies(tmp_path, sizes):
    ids = np.arange(sum(sizes)) % 60_000
    path = str(tmp_path / "x.ids.arrow")
    writer = token_files.SequenceWriter(path, pa.uint16(), length=16, batch=4)
    for part in np.split(ids, np.cumsum(sizes)[:-1]):
        writer.write(part)
    writer.close()
    reader = token_files.SequenceReader("file://" + path)
    allocated = pa.total_allocated_bytes()
    for k in range(-(-len(ids) // 16)):
        values, mask = reader.sequence(k)
        used = mask.to_pylist().count(True)
        assert values[:used].tolist() == ids[16 * k:16 * k + 16].tolist() and used == min(16, len(ids) - 16 * k)
        assert not values.flags.writeable and len(values) == 16
    assert pa.total_allocated_bytes() - allocated < 4096
    start, size = len(ids) // 3, len(ids) // 2
    assert np.concatenate([*reader.span(start, size), []]).tolist() == ids[start:start + size].tolist()


def check_pieces(rows, documents, limits):
    by_sequence, by_document = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_document.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limits.tokens and len(pieces) <= limits.segments
        assert sum(r.loss_tokens for r in pieces) <= limits.loss_tokens
    assert sum(r.length for r in rows) == sum(len(ids) for ids in documents)
    return by_sequence, by_document


def test_pieces_cover_odd_documents(spark):
    limits = packing.Limits()
    rows = packing.pack_documents(odd_documents(spark)).collect()
    documents = [library_ids(t, 1) for _, t in odd_rows()]
    by_sequence, _ = check_pieces(rows, documents, limits)
    lengths = [sum(r.length for r in p) for p in by_sequence.values()]
    padding = sum(0 if n & (n - 1) == 0 else limits.tokens - n for n in lengths)
    assert padding <= 0.01 * sum(lengths)
    by_id = {i: library_ids(t, 1) for i, t in odd_rows() if i is not None}
    repeated = odd_rows()[-3][0]
    for i, ids in by_id.items():
        if i != repeated:
            pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
            at = 0
            for r in pieces:
                assert r.start == at and r.ids_crc32 == crc(ids[at:at + r.length]) and r.doc_tokens == len(ids)
                at += r.length
            assert at == len(ids)
    assert packing.pack_documents(odd_documents(spark, [])).collect() == []


def test_instruction_rows_stay_whole_under_three_limits():
    rnd = np.random.default_rng(5)
    limits = packing.Limits(tokens=100, segments=3, loss_tokens=40)
    packer, sequences = packing.Packer(limits, may_cut=False, pool_size=32), []
    items = []
    for k in range(400):
        size = int(rnd.integers(1, 90))
        loss = np.zeros(size, bool)
        loss[size - min(size, int(rnd.integers(1, 40))):] = True
        items.append(packing.Piece(k, 0, np.arange(size), loss, size))
        sequences += packer.add(items[-1])
    sequences += packer.finish()
    assert sorted(p.doc_id for s in sequences for p in s) == list(range(400))
    for s in sequences:
        assert sum(len(p.ids) for p in s) <= 100 and len(s) <= 3 and sum(int(p.loss.sum()) for p in s) <= 40
    least = max(sum(len(p.ids) for p in items) / 100, sum(p.loss.sum() for p in items) / 40, 400 / 3)
    assert len(sequences) <= 1.25 * least
    with pytest.raises(ValueError):
        list(packer.add(packing.Piece(1, 0, np.arange(101), np.zeros(101, bool), 101)))
