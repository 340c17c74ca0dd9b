import random
import zlib

import pytest

from cohortlens.llm import toxicity as t
from tests.llm.odd import odd_documents, odd_rows


def test_folding_undoes_disguises():
    assert t.fold("L0SER, ѕсum! w0rthle$$x 2024 a\u200bb 1diot") == " loser scum worthlessx ab idiot "
    assert t.fold("") == "  "


def test_exception_phrases_spare_matches():
    lexicon = t.Lexicon({" scun": 3.0, " fool ": 2.0}, frozenset({" scunthorpe ", " no fool "}))
    assert lexicon.weight(t.fold("Scunthorpe is no fool")) == 0
    assert lexicon.weight(t.fold("a scun and a fool")) > 4.9
    long, short = t.fold("fool " + "word " * 8000), t.fold("fool")
    assert lexicon.weight(long) < lexicon.weight(short)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 1
        w = [f"w{rnd.randrange(700)}" + "abcdefgh"[rnd.randrange(8)] * 2 for _ in range(rnd.randrange(20, 120))]
        if toxic:
            for bad in rnd.sample(["vilebit", "n4sty", "grumxo", "grumpa", "grumul"], 3):
                w.insert(rnd.randrange(len(w)), bad)
        elif i % 7 == 0:
            w.insert(3, "grumbling")
        rows.append((i, " ".join(w), float("nan")))
        if i % 2:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    return docs, spark.createDataFrame([*labels, (None, 1), (7, None), (9, 3)], "doc_id long, toxic int"), rows


def test_held_out_rows_are_predicted(corpus):
    docs, labels, rows = corpus
    got = {r.doc_id: r for r in t.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    right = [r.predicted == int(i % 5 == 1) for i, r in got.items()]
    assert sum(right) >= 0.98 * len(right)


def test_held_out_labels_do_not_matter(spark, corpus):
    docs, labels, _ = corpus
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    rows = lambda df: sorted((r.doc_id, round(r.score, 9)) for r in df.collect())
    assert rows(t.toxicity(docs, labels)) == rows(t.toxicity(docs, turned))


def test_odd_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = t.toxicity(odd_documents(spark), none).collect()
    assert len(got) == len(odd_rows()) and {r.score for r in got} == {0.5}
    only = spark.createDataFrame([(i, 0) for i in range(1, 20)], "doc_id long, toxic int")
    assert {r.predicted for r in t.toxicity(odd_documents(spark), only).collect()} == {0}
    assert t.toxicity(odd_documents(spark, []), none).collect() == []


def test_short_texts_are_told_apart_on_any_partitioning(spark):
    spell = lambda i: "q" + "".join("bcdfghjkmn"[int(d)] for d in str(i))
    rows = [(i, f"{spell(i)} {'vile' if i % 2 else 'mild'} z{spell(i)}") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    docs = odd_documents(spark, rows)
    scores = []
    for parts in (1, 4, 40):
        got = t.toxicity(docs.repartition(parts), labels).collect()
        assert {r.doc_id for r in got if r.predicted} == {i for i, _ in rows if i % 2}
        scores.append({r.doc_id: r.score for r in got})
    assert scores[0] == scores[1] == scores[2]


def test_matches_against_plain_search():
    """The automaton's weight against a look at every entry for every distinct word, the heaviest of a word counting."""
    rnd = random.Random(3)
    lexicon = t.Lexicon({" vile ": 3.0, " vil": 2.0, " scum ": 2.5, " scumb": 4.0, " ev": 1.0}, frozenset({" evening ", " no scum "}))
    pool = ["vile", "vileness", "Vile,", "evil", "scum", "scumbag", "evening", "no", "v1le", "ѕсum", "plain", "villa", "ever", "\n", "!"]
    for n in [0, 1, *range(2, 60)]:
        folded = t.fold(" ".join(rnd.choice(pool) for _ in range(n)))
        words, best = folded.split(), {}
        for at, word in enumerate(words):
            pairs = {f" {a} {b} " for a, b in [(words[at - 1] if at else "", word), (word, words[at + 1] if at + 1 < len(words) else "")]}
            if ({f" {word} "} | pairs) & lexicon.exceptions:
                continue
            for entry, weight in lexicon.weights.items():
                if f" {word} ".startswith(entry):
                    best[word] = max(best.get(word, 0.0), weight)
        assert lexicon.weight(folded) == pytest.approx(sum(best.values()) / (1.0 + len(words) / t.LENGTH_SCALE))
