"""Quality rules: base statistics of each text, and an isolation forest over their rates.

The base rules reject very short texts and texts that mostly repeat themselves. All other texts are judged by an
isolation forest: trees of random splits between the lowest and highest rates of all rows, in which rows end early where
few good rows lie. The forest is fitted on a bounded sample of the rows labelled good, those with the smallest hashes of
their ids; the threshold is a quantile over all other labelled rows, so that almost no good row lies above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrays import SPACE, Chunk, chunks, find_words, hash_runs, hash_words, mix, run_starts, sums_by_row
from cohortlens.llm.spark_util import bounded_sample, row_key, staged, texts

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Labelled rows the forest is fitted on, at most.
FIT_ROWS = 20_000
#: Share of good labelled rows that may lie above the threshold.
GOOD_ABOVE = 0.001
#: Ranges of scores that one pass counts.
CUTS = 4096

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_twins", "n_upper", "n_digits", "n_marks"]

#: What the forest looks at besides the length: a count, and the count it is a rate of.
RATES = {
    "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "twins": ("n_twins", "n_words"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "n_words"), "repeats": ("n_repeat_words", "n_words"),
}
#: A rate is taken as if the text went on for this share of a mean text at the mean rate, as short texts vary more.
PRIOR = 0.25
FEATURES = [*RATES, "length"]


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


SYMBOLS = _table("#*$%&|<>")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGITS = _table("0123456789")
MARKS = _table("!?,.;:\"'()[]{}=+_~^@/\\")
BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: words, words in a window of five words that the row has twice or more, words equal to the one before."""
    words = find_words(chunk)
    hashes = hash_words(chunk.data, words)
    spots, lengths = run_starts(words.first, WINDOW)
    runs = hash_runs(hashes, WINDOW)
    owner = np.repeat(np.arange(chunk.rows, dtype=np.uint64), lengths)
    keys = mix(runs[spots] ^ mix(owner)) if len(spots) else np.zeros(0, np.uint64)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words.starts) + WINDOW + 1, np.int32)
    np.add.at(cover, spots[twice], 1)
    np.subtract.at(cover, spots[twice] + WINDOW, 1)
    inside = np.cumsum(cover)[:len(words.starts)] > 0
    twins = np.zeros(len(hashes), bool)
    twins[1:] = hashes[1:] == hashes[:-1]
    twins[words.first[:-1][words.counts > 0]] = False
    return words.counts, sums_by_row(inside, words.first), sums_by_row(twins, words.first)


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those among them that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines), len(lines) - len(set(lines))


def count_chunk(chunk: Chunk, values: list[str]) -> list[np.ndarray]:
    """The counts of ``COUNTS`` for the rows of a chunk."""
    data, offsets = chunk.data, chunk.offsets
    n_words, repeats, twins = repeated_words(chunk)
    lines = np.array([repeated_lines(v) for v in values], np.int64).reshape(-1, 2)
    code_points = ((data & 0xC0) != 0x80) & ~SPACE[data]
    return [
        n_words, sums_by_row(code_points, offsets), sums_by_row(SYMBOLS[data], offsets), lines[:, 1], repeats,
        lines[:, 0], twins, *(sums_by_row(t[data], offsets) for t in (UPPER, DIGITS, MARKS)),
    ]


def rule_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``row_key`` and the counts of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for chunk in chunks(column):
                part = column.slice(chunk.first, chunk.rows)
                counted = count_chunk(chunk, part.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(chunk.first, chunk.rows) for k in (0, 2)), *(pa.array(c.astype(np.int64)) for c in counted)],
                    names=["doc_id", "row_key", *COUNTS],
                )

    keyed = texts(docs, text, doc_id).withColumn("row_key", row_key())
    return keyed.mapInArrow(run, "doc_id long, row_key long, " + ", ".join(f"{c} long" for c in COUNTS))


def raw_rates(judged: DataFrame) -> tuple[list[Column], np.ndarray]:
    """The rates of ``RATES`` and the logarithm of the length, as columns, and what one more count adds to each in a mean text.

    Means are those of ``judged``.
    """
    bases = {base for _, base in RATES.values()}
    sums = [F.sum(F.col(c)).alias(c) for c in {count for count, _ in RATES.values()} | bases]
    total = judged.agg(F.count("*").alias("rows"), *sums).first()
    out, one = [], []
    for name, (count, base) in RATES.items():
        prior = PRIOR * (total[base] or 0) / max(total["rows"], 1)
        mean = (total[count] or 0) / max(total[base] or 0, 1)
        out.append(((F.col(count) + F.lit(prior * mean)) / (F.greatest(F.col(base), F.lit(1)) + F.lit(prior))).alias(name))
        one.append(PRIOR / max((1 + PRIOR) * prior, PRIOR))
    return [*out, F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double")).alias("length")], np.array([*one, 0.0])


@dataclass
class Scale:
    """Mean and deviation of each rate over all rows, and its bounds when scaled.

    The deviation is the mean one and that of one more word, letter or line in a mean text, which tells nothing yet.
    """

    mean: np.ndarray
    deviation: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(rated: DataFrame, one: np.ndarray) -> Scale:
        # sums of decimals, so that they do not depend on the order of rows
        def mean(c):
            return (F.sum(c.cast("decimal(28,9)")) / F.count("*")).cast("double")

        first = rated.agg(
            *(mean(F.col(n)).alias(n) for n in FEATURES), *(f(n).alias(f"{k}_{n}") for n in FEATURES for k, f in (("low", F.min), ("high", F.max))),
        ).first()
        second = rated.agg(*(mean(F.abs(F.col(n) - F.lit(first[n]))).alias(n) for n in FEATURES)).first()
        out = Scale(
            np.array([first[n] for n in FEATURES]), np.array([second[n] for n in FEATURES]) + one, np.zeros(0), np.zeros(0),
        )
        out.low, out.high = (out.scaled(np.array([[first[f"{k}_{n}"] for n in FEATURES]]))[0] for k in ("low", "high"))
        return out

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Rates in mean deviations from the mean, far ones by their logarithm."""
        return np.arcsinh((x - self.mean) / np.where(self.deviation > 0, self.deviation, 1.0))


def _matrix(columns) -> np.ndarray:
    return np.column_stack([np.asarray(columns[n], np.float64) for n in FEATURES])


def _average_path(n: np.ndarray | int) -> np.ndarray:
    """Expected depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    many = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as lists of nodes: children of a node are ``left`` and the one after it; 0 at a leaf, where ``path`` counts."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sample: int

    @staticmethod
    def fit(
        x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None, trees: int = 128, sample: int = 2048,
        depth: int = 20, seed: int = 7,
    ) -> Forest:
        """Trees over all values from ``low`` to ``high``, those of ``x`` by default.

        Each tree splits a sample of at most half the rows, so that a row also meets trees that have not seen it.
        """
        random = np.random.default_rng(seed)
        low, high = x.min(axis=0) if low is None else low, x.max(axis=0) if high is None else high
        sample = min(sample, -(-len(x) // 2))
        out = Forest([], sample)
        for _ in range(trees):
            out.trees.append(_grow(x[random.choice(len(x), sample, replace=False)], low, high, depth, random))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; higher where paths are short."""
        total = np.zeros(len(x))
        for feature, split, left, path in self.trees:
            node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(rows):
                at = node[rows]
                inner = left[at] > 0
                rows, at = rows[inner], at[inner]
                node[rows] = left[at] + (x[rows, feature[at]] >= split[at])
            total += path[node]
        usual = max(float(_average_path(self.sample)), 1e-9)
        return 2.0 ** -(total / max(len(self.trees), 1) / usual)


def _grow(sample: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, random: np.random.Generator):
    """A tree whose splits lie anywhere in a node's box, also where the sample has no row; an empty box is a leaf."""
    feature, split, left, path = [0], [0.0], [0], [0.0]
    todo = [(0, 0, sample, low, high)]
    while todo:
        node, level, rows, low, high = todo.pop()
        width = high - low
        if level == depth or not len(rows) or not width.any():
            path[node] = level + float(_average_path(len(rows)))
            continue
        f = int(random.choice(len(width), p=width / width.sum()))  # rates that vary little are rarely asked
        at = float(random.uniform(low[f], high[f]))
        feature[node], split[node], left[node] = f, at, len(feature)
        right = rows[:, f] >= at
        middle = np.where(np.arange(len(low)) == f, at, low), np.where(np.arange(len(high)) == f, at, high)
        for side, box in ((~right, (low, middle[1])), (right, (middle[0], high))):
            todo.append((len(feature), level + 1, rows[side], *box))
            for column, value in ((feature, 0), (split, 0.0), (left, 0), (path, 0.0)):
                column.append(value)
    return np.array(feature, np.int8), np.array(split), np.array(left, np.int32), np.array(path)


def calibrate(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold: the score that at most ``GOOD_ABOVE`` of the good rows exceed, or the middle of the gap above it."""
    if not good.any():
        return np.inf
    bound = float(np.quantile(scores[good], 1 - GOOD_ABOVE, method="higher"))
    above = scores[~good & (scores > bound)]
    return (bound + float(above.min())) / 2 if len(above) else bound


def threshold_of(scored: DataFrame) -> float:
    """What ``calibrate`` gives, of the columns ``score`` and ``good``, from counts of score ranges alone.

    The range of the wanted score is cut into ``CUTS`` until it holds one value. ``scored`` should be a written table.
    """
    good = scored.where("good")
    seen = good.agg(F.count("*").alias("rows"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    if not seen["rows"]:
        return np.inf
    skip, low, high = math.ceil((seen["rows"] - 1) * (1 - GOOD_ABOVE)), seen["low"], seen["high"]
    while low < high:
        cut = F.least(F.floor((F.col("score") - F.lit(low)) / F.lit(high - low) * CUTS), F.lit(CUTS - 1))
        inside = good.where(F.col("score").between(low, high)).groupBy(cut.alias("cut"))
        for part in sorted(inside.agg(F.count("*").alias("rows"), F.min("score").alias("low"), F.max("score").alias("high")).collect()):
            if skip < part["rows"]:
                low, high = part["low"], part["high"]
                break
            skip -= part["rows"]
    above = scored.where(~F.col("good") & (F.col("score") > low)).agg(F.min("score")).first()[0]
    return low if above is None else (low + above) / 2


def _collect(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", with_key: bool = False,
) -> DataFrame:
    """Per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score``.

    With ``row_key`` as well on request.

    A null text has no words and fails the base rules, as does an empty one. Repeated rows get one row each; an empty
    table gives none. Labels are used where they are 0 or 1 and name a document; without any good one only the base
    rules reject. Other columns of either table are not read, so names may clash.
    """
    counted = staged(rule_counts(docs, text, doc_id))
    judged = counted.where(~_base_failed())
    columns, one = raw_rates(judged)
    rated = judged.select("doc_id", *columns)
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).alias("_quality"))
    known = known.where(F.col("_quality").isin(0, 1))
    forest = scale = None
    if judged.limit(1).count():
        scale = Scale.of(rated, one)
        good = rated.join(known.where((F.col("_quality") == 1) & _to_fit()), "doc_id")
        fitted = bounded_sample(good if good.limit(1).count() else rated, "doc_id", FIT_ROWS, *FEATURES)
        forest = Forest.fit(scale.scaled(_matrix(_collect(fitted))), scale.low, scale.high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix({c: batch.column(c).to_numpy() for c in FEATURES})
            score = forest.score(scale.scaled(x)) if forest else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.select(shown).columns, pa.array(score)], names=[*shown, "score"])

    shown = [*["row_key"][:with_key], "doc_id", *COUNTS[:5]]
    schema = ", ".join(f"{c} long" for c in shown) + ", score double"
    scored = staged(counted.select(*shown, *columns).mapInArrow(run, schema)).withColumn("base_failed", _base_failed())
    labelled = scored.where("NOT base_failed").join(known, "doc_id").where(~_to_fit() | (F.col("_quality") == 0))
    threshold = threshold_of(staged(labelled.select("score", (F.col("_quality") == 1).alias("good"))))
    kept = ~F.col("base_failed") & (F.col("score") <= F.lit(threshold))
    return scored.select(*shown, "base_failed", kept.alias("kept"), "score")


def _to_fit():
    """The half of the ids whose good labels the forest is fitted on; the others' set the threshold."""
    return F.hash("doc_id") % 2 == 0


def _base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
