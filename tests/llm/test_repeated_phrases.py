import hashlib
import random

import pytest

from cohortlens.llm import repeated_phrases
from tests.llm.odd import odd_documents, odd_rows, without_repeats, words


def expected(rows):
    """By id; ids are unique here."""
    left = without_repeats([(i, t) for i, t in rows])
    return {i: (len(words(t)), len(words(t)) - len(left[i]), hashlib.sha256(" ".join(left[i]).encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("seed", range(4))
def test_passages_of_all_kinds(spark, seed):
    rnd = random.Random(seed)
    small = [f"v{i}" for i in range(40 if seed % 2 else 4000)]
    passages = [[rnd.choice(small) for _ in range(rnd.randrange(15, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rnd.randrange(0, 5)):
            text += [rnd.choice(small) for _ in range(rnd.randrange(0, 40))]
            p = rnd.choice(passages)
            a = rnd.randrange(len(p) // 2)
            text += p[a:a + rnd.randrange(10, 60)]
        rows.append((i * 3 - 20, rnd.choice([" ", "\n", " \t "]).join(text)))
    rows += [(1000 + i, " ".join(["tick"] * (18 + i))) for i in range(5)]
    got = repeated_phrases.remove_repeats(odd_documents(spark, rows)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == expected(rows)


def test_odd_documents(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    want = expected(list(dict(rows).items()))
    got = repeated_phrases.remove_repeats(odd_documents(spark)).collect()
    assert len(got) == len(odd_rows())
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id is not None)
    # rows without an id come last, so the passage that they repeat goes
    assert sorted(r.n_words - r.n_removed for r in got if r.doc_id is None) == [0, 0]
    assert repeated_phrases.remove_repeats(odd_documents(spark, [])).collect() == []


def test_texts_left(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(30))), (2, "x\ny  " + " ".join(f"a{i}" for i in range(25))), (3, " ".join(f"a{i}" for i in range(5, 30))), (4, None)]
    docs = odd_documents(spark, rows)
    left = repeated_phrases.drop_repeats(docs)
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: rows[0][1], 2: "x y", 4: None}


def test_texts_that_share_an_id_and_a_32_bit_hash_stay_apart(spark):
    """Two texts of equal 32-bit hash, one of a single word, the other a copy: none loses words of the other."""
    seen, pair = {}, None
    words = spark.range(400_000).selectExpr("concat('w', id) AS t").selectExpr("t", "hash(t) AS h").groupBy("h").agg({"t": "collect_list"})
    for r in words.where("size(`collect_list(t)`) > 1").limit(1).collect():
        pair = r[1][:2]
    assert pair and not seen
    passage = " ".join(f"p{i}" for i in range(30))
    for doc_id in (None, 7):
        rows = [(1, passage), (doc_id, pair[0]), (doc_id, pair[1]), (doc_id, passage), (doc_id, passage)]
        got = repeated_phrases.remove_repeats(odd_documents(spark, rows)).collect()
        assert sorted((r.n_words, r.n_removed) for r in got) == [(1, 0), (1, 0), (30, 0), (30, 30), (30, 30)]
        left = repeated_phrases.drop_repeats(odd_documents(spark, rows)).collect()
        assert sorted(r.text for r in left) == sorted([passage, *pair])


def test_many_equal_rows_send_their_places_once(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, "x " + passage)] + [(None, passage + " y")] * 60
    got = repeated_phrases.remove_repeats(odd_documents(spark, rows).repartition(6)).collect()
    assert sorted({(r.doc_id is None, r.n_words, r.n_removed) for r in got}) == [(False, 41, 0), (True, 41, 40)] and len(got) == 61
