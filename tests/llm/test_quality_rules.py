import numpy as np
import pytest

from cohortlens.llm import quality_rules as q
from tests.llm.odd import odd_documents, odd_rows, rule_counts


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = np.random.default_rng(2)
    prose = lambda n, end="": " ".join(f"word{rnd.integers(0, 4000)}{end}" for _ in range(n))
    rows = [(i, prose(int(rnd.integers(12, 80)), "###" if i % 10 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1.0, True) for i, t in rows], "doc_id long, text string, score double, kept boolean")
    labels = [(i, int(i % 10 != 0)) for i in range(0, 300, 2)] + [(None, 1), (5, None), (1, 7), (10_000, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_base_statistics_of_odd_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = q.quality_verdicts(odd_documents(spark), none).collect()
    want = sorted((i is None, i or 0, *rule_counts(t)) for i, t in odd_rows())
    assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:6]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)  # no good label, so only the base rules reject
    assert q.quality_verdicts(odd_documents(spark, []), none).collect() == []


def test_the_forest_rejects_junk_and_keeps_good_rows(labelled):
    got = {r.doc_id: r for r in q.quality_verdicts(*labelled).collect()}
    assert len(got) == 300
    assert all(got[i].kept == (i % 10 != 0) for i in got)


def test_scores_fall_with_usual_rows():
    rnd = np.random.default_rng(0)
    x = np.r_[rnd.normal(size=(2000, 3)), [[9.0, 9, 9]]]
    score = q.Forest.fit(x).score(x)
    assert score[-1] == score.max() and (score <= 1).all() and (score >= 0).all()


def test_calibration():
    scores, good = np.array([0.1, 0.2, 0.3, 0.8]), np.array([True, True, True, False])
    assert q.calibrate(scores, good) == pytest.approx(0.55)
    assert q.calibrate(scores[:3], good[:3]) == 0.3
    assert q.calibrate(scores[3:], good[3:]) == np.inf


def _labelled_docs(spark, junk_ids, junk, n=600):
    """Prose of letters, some rows with other words among them; a third of the rows is labelled."""
    rnd = np.random.default_rng(3)
    letters = lambda: "".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rnd.integers(3, 8))))
    rows = []
    for i in range(n):
        words = [letters() for _ in range(int(rnd.integers(60, 200)))]
        rows.append((i, " ".join(junk(rnd) if i in junk_ids and k % 3 else w for k, w in enumerate(words))))
    labels = [(i, int(i not in junk_ids)) for i in range(0, n, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_junk_below_any_usual_limit_is_rejected_when_labelled(spark):
    bad = set(range(0, 600, 15)) | set(range(1, 600, 60))
    got = q.quality_verdicts(*_labelled_docs(spark, bad, lambda rnd: f"abcd{rnd.integers(100, 999)}")).collect()
    assert not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if not r.kept} == bad  # a third of the letters are digits


def test_the_threshold_is_that_of_all_labelled_scores(spark):
    rnd = np.random.default_rng(5)
    for n, digits in ((30_000, 12), (5_000, 2), (1, 12)):
        score, good = np.round(rnd.beta(2, 5, n), digits), rnd.random(n) < 0.9
        good[0] = True
        table = spark.createDataFrame(list(zip(score.tolist(), good.tolist(), strict=True)), "score double, good boolean")
        assert q.threshold_of(table) == q.calibrate(score, good)


def test_one_junk_row_that_no_sample_holds_is_rejected(spark, monkeypatch):
    monkeypatch.setattr(q, "FIT_ROWS", 60)  # the junk has no label, so it is outside the sample
    bad = set(range(0, 600, 15))
    docs, labels = _labelled_docs(spark, bad, lambda rnd: f"abcd{rnd.integers(100, 999)}")
    docs = docs.unionByName(docs.where("doc_id = 301").selectExpr("9999L AS doc_id", "regexp_replace(text, ' ', ' # ## ') AS text"))
    got = {r.doc_id: r for r in q.quality_verdicts(docs, labels).collect()}
    assert not got[9999].base_failed and not got[9999].kept and got[301].kept
