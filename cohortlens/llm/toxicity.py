"""Toxicity by a weighted lexicon that one Aho-Corasick automaton matches in folded text.

Folding lowers a text, undoes homoglyphs (letters of other scripts that look Latin) and digit substitutions inside
words, so that disguised spellings meet the lexicon. The lexicon holds words and beginnings of words. Their weights are
smoothed log-odds of the labelled documents that contain them; near copies among those count once. Exception phrases are longer words, or pairs of
words, around a lexicon match that clean documents have; a match inside such a phrase does not count. A document's score
is a logistic function of its matched weight, normalised by length, fitted on the same labelled rows.

Every labelled row of the fitting share is used up to ``FIT_ROWS`` (those with the smallest hashes of their ids); the lexicon is
what ``FIT_ROWS`` texts can give and is sent to the tasks with the code. Scoring sees the text alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrays import chunks, find_words, hash_runs, hash_words, mix, run_starts
from cohortlens.llm.spark_util import bounded_sample, staged, texts

#: Labelled rows used for fitting, at most; that bounds the lexicon and the exception phrases as well.
FIT_ROWS = 20_000
#: Smallest hashes that texts must share to count as near copies.
MIN_HASHES = 3
#: Least weight of a lexicon entry, and least evidence for it: the Poisson deviance of its toxic documents.
MIN_WEIGHT = 2.5
MIN_EVIDENCE = 9.0
#: Lengths of the beginnings of words that are candidates besides whole words.
BEGINNINGS = (4, 5, 6)
#: A document of this many words halves the weight of its matches; shorter ones less, longer ones more.
LENGTH_SCALE = 2000.0

#: Letters that look like a Latin one, as "Latin letter: letters that look like it".
HOMOGLYPHS = {
    "a": "аαɑ", "b": "вьЬ", "c": "сϲ", "d": "ԁ", "e": "еεҽ", "g": "ɡ", "h": "һн", "i": "іιı", "j": "јϳ", "k": "кκ",
    "l": "ӏⅼ", "m": "мⅿ", "n": "пη", "o": "оοσ", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτ", "u": "υս",
    "v": "ѵν", "w": "ԝωѡ", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
#: Digits and signs that stand for a letter inside a word.
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


FOLD = {ord(c): latin for latin, group in HOMOGLYPHS.items() for c in group}
FOLD |= {code: "" for code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}
_FOLDED = re.compile("[" + "".join(map(chr, FOLD)) + "]")
_LEET = re.compile(r"(?<=[a-z])[01345789@$]+(?=[a-z])|(?<![a-z0-9@$])[013457@$]+(?=[a-z]{2})")
_LEET_TABLE = str.maketrans(SUBSTITUTIONS)
#: Everything that is not a folded letter ends a word.
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """The folded text: letters lowered and made Latin where they look it; each word begins after one space."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if _FOLDED.search(text):
            text = text.translate(FOLD)
    text = _LEET.sub(lambda m: m.group().translate(_LEET_TABLE), text)
    return " " + " ".join(_WORD.findall(text)) + " "


def candidate_terms(folded: str) -> set[str]:
    """Distinct words (`` word ``) and beginnings of words (`` wor``) of a folded text."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for n in BEGINNINGS:
        out |= {f" {w[:n]}" for w in words if len(w) >= n}
    return out


@dataclass
class Lexicon:
    """Weights by term, exception phrases, and the logistic function of the matched weight."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self) -> None:
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def matches(self, folded: str) -> list[tuple[int, str]]:
        """Lexicon matches as (last place, term), without those inside an exception phrase."""
        if self._automaton is None:
            automaton = ahocorasick.Automaton()
            for term in self.weights:
                automaton.add_word(term, (term, True))
            for phrase in self.exceptions - set(self.weights):
                automaton.add_word(phrase, (phrase, False))
            automaton.make_automaton()
            self._automaton = automaton
        if not len(self._automaton):
            return []
        found, spared = [], []
        for end, (term, counts) in self._automaton.iter(folded):
            (found if counts else spared).append((end, term))
        if not spared:
            return found
        spans = [(end - len(p) + 1, end) for end, p in spared]
        return [(end, t) for end, t in found if not any(a <= end - len(t) + 1 and end <= b for a, b in spans)]

    def weight(self, folded: str) -> float:
        """Weight of the distinct matched words, each by its heaviest term, per length."""
        best: dict[str, float] = {}
        for end, term in self.matches(folded):
            begin = end - len(term) + 1
            word = folded[begin:folded.index(" ", begin + 1)]
            best[word] = max(best.get(word, 0.0), self.weights[term])
        if not best:
            return 0.0
        words = folded.count(" ") - 1
        return sum(best.values()) / (1.0 + words / LENGTH_SCALE)

    def probability(self, weight: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.log1p(weight) + self.offset, -30, 30)))


def contexts(folded: str, lexicon: Lexicon) -> set[str]:
    """Words around a match that are longer than it, and pairs of a matched word and its neighbour."""
    out = set()
    for end, term in lexicon.matches(folded):
        begin = end - len(term) + 1
        close = folded.index(" ", begin + 1)
        word = folded[begin:close + 1]
        if word != term:
            out.add(word)
        after = folded.find(" ", close + 1)
        if after > 0:
            out.add(folded[begin:after + 1])
        before = folded.rfind(" ", 0, begin)
        if before >= 0:
            out.add(folded[before:close + 1])
    return out


def _term_counts(rows: DataFrame, terms) -> DataFrame:
    """Labelled documents with each term, by label; counted per batch before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for folded, label in zip(batch.column("folded").to_pylist(), batch.column("label").to_pylist(), strict=True):
                counts[label].update(terms(folded))
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)],
                names=["term", "clean", "toxic"],
            )

    counted = rows.select("folded", "label").mapInArrow(run, "term string, clean long, toxic long")
    return counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _sketches(folded: pa.Array) -> np.ndarray:
    """A number that near copies mostly share: of their smallest hashes of five consecutive words under ``MIN_HASHES`` orders.

    A text with fewer words has a hash of itself, so only equal ones share it.
    """
    out = []
    for chunk in chunks(folded):
        words = find_words(chunk)
        runs = hash_runs(hash_words(chunk.data, words), 5)
        spots, lengths = run_starts(words.first, 5)
        whole = [xxhash.xxh64_intdigest(chunk.data[a:b].tobytes()) for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)]
        sketch = np.array(whole, np.uint64)
        full = np.flatnonzero(lengths > 0)
        if len(full):
            starts = (np.cumsum(lengths) - lengths)[full]
            sketch[full] = 0
            for k in range(MIN_HASHES):
                least = np.minimum.reduceat(mix(runs[spots] ^ np.uint64(k << 56)), starts)
                sketch[full] = mix(sketch[full] ^ least)
        out.append(sketch)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _evidence(n_clean: int, n_toxic: int):
    usual = (F.col("toxic") + F.col("clean")) * (n_toxic / (n_clean + n_toxic))
    return F.when(F.col("toxic") > usual, F.col("toxic") * F.log(F.col("toxic") / usual) - F.col("toxic") + usual).otherwise(0.0)


def _log_odds(n_clean: int, n_toxic: int):
    toxic = (F.col("toxic") + 0.5) / (n_toxic + 1.0)
    return F.log(toxic / ((F.col("clean") + 0.5) / (n_clean + 1.0)))


def fit_lexicon(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Fit on ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, label`` of 0 or 1)."""
    # at most FIT_ROWS ids and labels, so it may be broadcast
    chosen = bounded_sample(labels, "doc_id", FIT_ROWS, "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = pa.array([fold(t) for t in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [folded, batch.column(1), pa.array(_sketches(folded))], names=["folded", "label", "sketch"],
            )

    folded = docs.join(F.broadcast(chosen), "doc_id").select("text", "label").mapInArrow(run, "folded string, label int, sketch long")
    rows = staged(folded.groupBy("label", "sketch").agg(F.min("folded").alias("folded")).select("folded", "label"))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    if not n_clean or not n_toxic:
        return Lexicon({}, offset=0.0 if n_clean == n_toxic else (-30.0 if n_clean else 30.0))
    terms = (
        _term_counts(rows, candidate_terms).where(_evidence(n_clean, n_toxic) >= MIN_EVIDENCE)
        .withColumn("weight", _log_odds(n_clean, n_toxic)).where(F.col("weight") >= MIN_WEIGHT)
        .orderBy(F.desc("weight"), F.desc("toxic"), "term").collect()
    )
    lexicon = Lexicon({r["term"]: r["weight"] for r in terms})
    spared = (
        _term_counts(rows, lambda folded: contexts(folded, lexicon))
        .where((F.col("clean") >= 2) & (_log_odds(n_clean, n_toxic) < 0))
        .orderBy(F.desc("clean"), "term").collect()
    )
    lexicon = Lexicon(lexicon.weights, frozenset(r["term"] for r in spared))
    return _calibrated(lexicon, rows)


def _calibrated(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """Fit slope and offset by logistic regression with a small penalty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [lexicon.weight(f) for f in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(weights, pa.float64()), batch.column(1)], names=["weight", "label"])

    table = rows.mapInArrow(run, "weight double, label int").toArrow()  # at most FIT_ROWS pairs of numbers
    y = table.column("label").to_numpy().astype(np.float64)
    x = np.column_stack([np.log1p(table.column("weight").to_numpy()), np.ones(len(y))])
    share = 1.0 / max(len(y), 1)
    beta = np.zeros(2)
    penalty = np.array([1e-4, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (share * (y - p)) - penalty * beta
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return Lexicon(lexicon.weights, lexicon.exceptions, float(beta[0]), float(beta[1]))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, score, weight`` of every whole text; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = np.array([lexicon.weight(fold(t)) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lexicon.probability(weights), pa.float64()), pa.array(weights, pa.float64())],
                names=["doc_id", "score", "weight"],
            )

    return texts(docs, text, doc_id).mapInArrow(run, "doc_id long, score double, weight double")


def held_out(doc_id):
    """True for the fifth of the ids that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted, weight``.

    Labels are those rows of ``labels`` that are 0 or 1, name a document and are not held out. Without labels of both
    kinds the score is that of the only kind, or one half. A null or empty text has no match. Repeated rows get one row
    each; an empty table gives none; other columns are not read, so names may clash.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    lexicon = fit_lexicon(texts(docs, text, doc_id), known.groupBy("doc_id").agg(F.max("label").alias("label")))
    scored = score(docs, lexicon, text, doc_id)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "weight",
    )
