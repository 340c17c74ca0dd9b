import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import arrays
from cohortlens.llm.frequent import distinct_runs
from tests.llm.odd import odd_rows, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\né日\u00a0", max_size=30)), max_size=12)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    got = []
    for chunk in arrays.chunks(pa.array(texts, pa.string()), limit=40):
        found = arrays.find_words(chunk)
        raw = chunk.data.tobytes()
        for row in range(chunk.rows):
            got.append([raw[found.starts[k]:found.ends[k]].decode() for k in range(found.first[row], found.first[row + 1])])
    assert got == [words(t) for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_lie():
    texts = [t for _, t in odd_rows()]
    seen: dict[str, int] = {}
    for chunk in arrays.chunks(pa.array(texts, pa.string())):
        found = arrays.find_words(chunk)
        raw = chunk.data.tobytes()
        for s, e, h in zip(found.starts, found.ends, arrays.hash_words(chunk.data, found).tolist(), strict=True):
            assert seen.setdefault(raw[s:e], h) == h
    assert len(set(seen.values())) == len(seen)


def test_distinct_runs_count_the_shingles():
    texts = [t for _, t in odd_rows()]
    sizes = np.concatenate([distinct_runs(c, 5, False)[1] for c in arrays.chunks(pa.array(texts, pa.string()))])
    for t, n in zip(texts, sizes.tolist(), strict=True):
        w = words(t)
        assert n == (len({tuple(w[k:k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)))
