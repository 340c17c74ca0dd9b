"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that tags tokens.

Tokens are runs of letters and digits, and single other characters. A token is the begin of a secret, inside one, or outside. What speaks for
a tag is a sum over the token itself, the four before it and the two after it (words, shapes, lengths, mix of
characters) and over features of the whole file (its length, its lines, how much of it is digits, signs of assignment, quotes). Weights are
fitted by maximum likelihood on a bounded sample of documents in which the patterns tag the secrets. The best tags of
a text are found by Viterbi's recursion.

The recursion runs over many stretches of many texts side by side. A text is cut into stretches at tokens that are outside on every
best path: those whose lead for outside exceeds what any change of the two transitions around them can win.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrays import chunks
from cohortlens.llm.spark_util import bounded_sample, staged, texts

#: Documents with a pattern's match that the field is fitted on, at most, and as many without one.
FIT_ROWS = 300
#: Stretches of text that one document gives to the fit, at most, and tokens on each side of what they are about.
FIT_STRETCHES, AROUND = 6, 10
STEPS, RATE, SHRINK = 40, 0.08, 1e-3
#: A tagged secret has at least this many characters.
MIN_CHARS = 8
#: Tokens whose scores a task keeps; when there are more it starts afresh.
MEMO_TOKENS = 400_000

KINDS = ("assign", "access", "hex", "crf")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: In some case, one of these lies in every keyword of ``ASSIGN``.
KEYWORD_PARTS = ("passw", "secret", "token", "api")
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")
HEX_BYTES = np.zeros(256, bool)
HEX_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: Places of the tokens that speak for a token's tag.
PLACES = (-4, -3, -2, -1, 0, 1, 2)
GAP = 4


def base_matches(text: str, may_be_hex: bool = True) -> list[tuple[int, int, int, int]]:
    """Start, end, kind of each match of a pattern, and where its secret starts; by start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORD_PARTS):
        found += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text)]
    if may_be_hex:
        found += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _rows_with_hex(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may have 32 hexadecimal digits in a row: such a run fills 16 bytes that start at a multiple of 16."""
    whole = len(data) // 16 * 16
    full = np.flatnonzero(HEX_BYTES[data[:whole]].reshape(-1, 16).all(axis=1)) * 16
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, full, "right") - 1] = True
    return out


class _Classes(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return self[code]


CLASSES = _Classes()


def token_features(token: str) -> list[str]:
    """What the field sees of a token, wherever it stands."""
    n, low = len(token), token.lower()
    if n == 1:
        return ["c=" + low, "n=1"]
    shape = token.translate(CLASSES)
    digits, upper = shape.count("0"), shape.count("A")
    runs = "".join(c for c, before in zip(shape, " " + shape, strict=False) if c != before)
    out = [
        f"n={min(n, 12) if n < 12 else 12 + min(n, 64) // 8}", "s=" + runs[:5], f"r={min(len(runs), 8)}",
        f"d={4 * digits // n}", f"u={4 * upper // n}", f"v={min(len(set(low)), 16)}", "p=" + token[:4] if upper > 3 else "p",
    ]
    if digits and not low.strip("0123456789abcdef"):
        out.append(f"hex={min(n // 8, 4)}")
    if not digits and n <= 12:
        out.append("w=" + low)
    return out


def _buckets(tokens: np.ndarray, digits: np.ndarray, signs: np.ndarray, quotes: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Five numbers from 0 to 7 per file: logarithms of its length and of the share of each in 1,024 tokens."""
    log = lambda x: np.minimum(np.log2(x + 1).astype(np.int64), 15) // 2
    share = lambda x: log(1024 * x / np.maximum(tokens, 1))
    return np.column_stack([log(tokens), share(digits), share(signs), share(quotes), share(lines)])


FILE_FEATURES = 5 * 8


@dataclass
class Field:
    """Weights: ``features`` numbers the rows of ``weights`` (feature, place, tag); ``files`` (file feature, tag); ``steps`` (tag, next tag)."""

    features: dict[str, int]
    weights: np.ndarray
    files: np.ndarray
    steps: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    @property
    def largest_gain(self) -> float:
        """The most that the two transitions around a token can win when it is not outside."""
        s = self.steps
        return float(max(s[p, x] + s[x, n] - s[p, 0] - s[0, n] for p in range(3) for x in (1, 2) for n in range(3)))


class TokenScores(dict):
    """The number of each token met so far, and its scores by place and tag. Number 0 is no token at all."""

    def __init__(self, model: Field):
        super().__init__()
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.clear()
        self._waiting: list[str] = []
        self.scores = np.zeros((0, len(PLACES), 3))
        self.kinds = np.zeros((0, 3), bool)
        self[""] = 0
        self._waiting.append("")
        self.settle()

    def __missing__(self, token: str) -> int:
        number = len(self)
        self[token] = number
        self._waiting.append(token)
        return number

    def settle(self) -> None:
        if not self._waiting:
            return
        known = self.model.features
        rows = [[known[f] for f in (token_features(t) if t else ["none"]) if f in known] for t in self._waiting]
        sizes = np.array([len(r) for r in rows])
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
        new = np.zeros((len(rows), *self.scores.shape[1:]))
        some = np.flatnonzero(sizes)
        if len(some):
            new[some] = np.add.reduceat(self.model.weights[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
        kinds = np.array([[any(c.isdigit() for c in t), t in ("=", ":"), t in ("'", '"')] for t in self._waiting], bool)
        self.scores, self.kinds = np.concatenate([self.scores, new]), np.concatenate([self.kinds, kinds])
        self._waiting = []


def number_tokens(values: list[str], memo: TokenScores) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of some texts with ``GAP`` places of no token around each text; first and last place of each; file features."""
    lists = [np.fromiter(map(memo.__getitem__, TOKEN.findall(v)), np.int64) for v in values]
    memo.settle()
    sizes = np.array([len(x) for x in lists], np.int64)
    gap = np.zeros(GAP, np.int64)
    flat = np.concatenate([x for one in lists for x in (gap, one)] + [gap])
    first = np.cumsum(sizes + GAP) - sizes
    owner = np.repeat(np.arange(len(values)), sizes)
    kinds = memo.kinds[flat[flat > 0]]
    counts = [np.bincount(owner, weights=kinds[:, k], minlength=len(values)) for k in range(3)]
    lines = np.array([v.count("\n") for v in values], np.float64)
    return flat, np.column_stack([first, first + sizes]), _buckets(sizes, *counts, lines)


def emissions(flat: np.ndarray, ends: np.ndarray, files: np.ndarray, memo: TokenScores) -> np.ndarray:
    """Scores of the three tags at every place; outside is certain where there is no token."""
    out = np.zeros((len(flat), 3))
    inner = slice(GAP, len(flat) - GAP)
    for k, place in enumerate(PLACES):
        out[inner] += memo.scores[flat[GAP + place:len(flat) - GAP + place], k]
    per_file = memo.model.files[files + 8 * np.arange(5)].sum(axis=1)
    out[flat > 0] += np.repeat(per_file, ends[:, 1] - ends[:, 0], axis=0)
    out[flat == 0] = (0.0, -np.inf, -np.inf)
    return out


def viterbi(scores: np.ndarray, steps: np.ndarray, largest_gain: float) -> np.ndarray:
    """The best tags. ``scores`` begins and ends with places that are outside."""
    lead = scores[:, 0] - scores[:, 1:].max(axis=1)
    sure = ~(lead <= largest_gain)
    tags = np.zeros(len(scores), np.int8)
    edges = np.flatnonzero(np.diff(np.r_[False, ~sure, False]))
    starts, stops = edges[0::2], edges[1::2]
    order = np.argsort(starts - stops, kind="stable")  # the longest first, so that those still running are the first ones
    starts, lengths = starts[order], (stops - starts)[order]
    if not len(starts):
        return tags
    came = np.zeros((int(lengths.sum()), 3), np.int8)
    before = np.cumsum(lengths) - lengths
    last = np.zeros((len(starts), 3))
    best = steps[0] + scores[starts]
    for k in range(int(lengths[0])):
        running = int(np.searchsorted(-lengths, -k, "left"))
        if k:
            ways = best[:running, :, None] + steps
            came[before[:running] + k] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[starts[:running] + k]
        ended = lengths[:running] == k + 1
        last[:running][ended] = best[:running][ended]
    tag = (last + steps[:, 0]).argmax(axis=1)
    for k in range(int(lengths[0]) - 1, -1, -1):
        running = int(np.searchsorted(-lengths, -k, "left"))
        tags[starts[:running] + k] = tag[:running]
        if k:
            tag[:running] = came[before[:running] + k, tag[:running]]
    return tags


def tagged_spans(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the secrets that the tags of a text's tokens name; white space always ends one."""
    out: list[list[int]] = []
    open_end = -1
    for m, tag in zip(TOKEN.finditer(text), tags.tolist(), strict=True):
        if tag == INSIDE and m.start() == open_end:
            out[-1][1] = m.end()
        elif tag:
            out.append([m.start(), m.end()])
        open_end = m.end() if tag else -1
    return [(a, b) for a, b in out if b - a >= MIN_CHARS]


def fit_field(stretches: list[tuple[list[str], list[int], list[int]]]) -> Field:
    """Weights of largest likelihood, slightly shrunk, from (tokens, tags, file features) of some stretches of text.

    All stretches begin and end outside a secret. Without any, all tokens are outside. The same stretches give the same weights.
    """
    seen: dict[str, int] = {"none": 0}
    if not stretches:
        return Field(seen, np.zeros((1, len(PLACES), 3)), np.zeros((FILE_FEATURES, 3)), np.array([[0.0, -1.0, -1.0]] * 3))
    spelt = sorted({t for tokens, _, _ in stretches for t in tokens})
    number = {t: i + 1 for i, t in enumerate(spelt)}
    rows = [["none"]] + [token_features(t) for t in spelt]
    for features in rows:
        for f in features:
            seen.setdefault(f, len(seen))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([seen[f] for r in rows for f in r])
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    by_feature = np.argsort(feature, kind="stable")
    feature_heads = np.searchsorted(feature[by_feature], np.arange(len(seen)))
    n, longest = len(stretches), max(len(t) for t, _, _ in stretches)
    ids, gold = np.zeros((n, longest + 2 * GAP), np.int64), np.zeros((n, longest), np.int64)
    for i, (tokens, tags, _) in enumerate(stretches):
        ids[i, GAP:GAP + len(tokens)] = [number[t] for t in tokens]
        gold[i, :len(tags)] = tags
    inner = ids[:, GAP:GAP + longest] > 0
    files = np.array([f for _, _, f in stretches]) + 8 * np.arange(5)
    weights, per_file, steps = np.zeros((len(seen), len(PLACES), 3)), np.zeros((FILE_FEATURES, 3)), np.zeros((3, 3))
    parts = [weights, per_file, steps]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    truth = np.eye(3)[gold]
    pairs = np.zeros((3, 3))
    edge = np.zeros((n, 1), np.int64)
    np.add.at(pairs, (np.hstack([edge, gold]), np.hstack([gold, edge])), 1)
    shifted = [ids[:, GAP + p:GAP + p + longest] for p in PLACES]
    for step in range(1, STEPS + 1):
        scores = np.add.reduceat(weights[feature], heads, axis=0)
        e = sum(scores[shifted[k], k] for k in range(len(PLACES))) + per_file[files].sum(axis=1)[:, None, :]
        e[~inner] = (0.0, -1e9, -1e9)
        share, expected = _marginals(e, steps)
        wrong = np.where(inner[..., None], share - truth, 0.0) / n
        by_token = np.zeros_like(scores)
        for k in range(len(PLACES)):
            for tag in range(3):
                by_token[:, k, tag] = np.bincount(shifted[k].ravel(), weights=wrong[..., tag].ravel(), minlength=len(rows))
        slopes = [
            np.add.reduceat(by_token[owner[by_feature]], feature_heads, axis=0),
            np.stack([np.bincount(files.ravel(), weights=np.repeat(wrong[..., tag].sum(axis=1), 5), minlength=FILE_FEATURES) for tag in range(3)], axis=1),
            (expected - pairs) / n,
        ]
        for p, g, m, v in zip(parts, slopes, first, second, strict=True):
            g = g + SHRINK * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(seen, weights, per_file, steps)


def _marginals(e: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each tag at each place, and the expected number of each transition over all stretches."""
    n, length, _ = e.shape
    moves = np.exp(steps)
    e = np.exp(e - e.max(axis=2, keepdims=True))
    ahead, back = np.zeros((length + 1, n, 3)), np.zeros((length + 2, n, 3))
    ahead[0, :, 0] = 1.0
    for k in range(length):
        now = (ahead[k] @ moves) * e[:, k]
        ahead[k + 1] = now / now.sum(axis=1, keepdims=True)
    back[length + 1, :, 0] = 1.0
    for k in range(length, -1, -1):
        now = (back[k + 1] * (e[:, k] if k < length else 1.0)) @ moves.T
        back[k] = now / now.sum(axis=1, keepdims=True)
    share = ahead[1:] * back[1:length + 1]
    share /= share.sum(axis=2, keepdims=True)
    expected = np.zeros((3, 3))
    for k in range(length + 1):
        both = ahead[k][:, :, None] * moves * (back[k + 1] * (e[:, k] if k < length else 1.0))[:, None, :]
        expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return share.transpose(1, 0, 2), expected


def _stretches(text: str, flat: np.ndarray) -> Iterator[tuple[list[str], list[int]]]:
    """Some stretches of a text for the fit: around matches of the patterns, else around its longest tokens with digits, and its beginning."""
    found = [(m.group(), m.start()) for m in TOKEN.finditer(text)]
    starts = np.array([s for _, s in found], np.int64)
    tags = np.zeros(len(found), np.int64)
    for _, end, _, secret in base_matches(text):
        a, b = np.searchsorted(starts, [secret, end])
        tags[a:b] = INSIDE
        if a < b:
            tags[a] = BEGIN
    heads = np.flatnonzero(tags == BEGIN)
    rank = sorted(range(len(found)), key=lambda i: (-sum(c.isdigit() for c in found[i][0]), -len(found[i][0]), i))
    middle = [*heads[:FIT_STRETCHES - 2].tolist(), *rank[:2 if len(heads) else FIT_STRETCHES - 1], 0]
    taken = np.zeros(len(found), bool)
    for i in middle[:FIT_STRETCHES]:
        a, b = max(0, i - AROUND), min(len(found), i + AROUND + 1)
        while a > 0 and tags[a] == INSIDE:
            a -= 1
        while b < len(found) and tags[b] == INSIDE:
            b += 1
        if a < b and not taken[i]:
            taken[a:b] = True
            yield [t for t, _ in found[a:b]], tags[a:b].tolist()


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = TokenScores(Field({}, np.zeros((0, len(PLACES), 3)), np.zeros((FILE_FEATURES, 3))))
    for batch in batches:
        for text, key in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), strict=True):
            flat, _, files = number_tokens([text], memo)
            rows = list(_stretches(text, flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(rows), pa.int64()), pa.array([t for t, _ in rows], pa.list_(pa.string())),
                 pa.array([t for _, t in rows], pa.list_(pa.int32())), pa.array([files[0].tolist()] * len(rows), pa.list_(pa.int32()))],
                names=["key", "tokens", "tags", "files"],
            )


def _has_match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, hits = batch.column("text"), []
        for chunk in chunks(column):
            hexes = _rows_with_hex(chunk.data, chunk.offsets)
            hits += [bool(base_matches(t, h)) for t, h in zip(column.slice(chunk.first, chunk.rows).to_pylist(), hexes.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(hits, pa.bool_())], names=["key", "hit"])


def learn_field(docs: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> Field:
    """A field fitted on at most ``fit_rows`` different texts with a match of a pattern and as many without: those with the smallest
    hashes of their texts. Null texts count as empty. Runs jobs; the sample's stretches come to the driver."""
    keyed = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).where("text <> ''").withColumn("key", F.xxhash64("text"))
    flags = staged(keyed.mapInArrow(_has_match, "key long, hit boolean").distinct())
    chosen = staged(bounded_sample(flags.where("hit"), "key", fit_rows).unionByName(bounded_sample(flags.where("NOT hit"), "key", fit_rows)).select("key"))
    texts_of = keyed.join(F.broadcast(chosen), "key", "left_semi").dropDuplicates(["key"])
    rows = texts_of.select("text", "key").mapInArrow(_sampled, "key long, tokens array<string>, tags array<int>, files array<int>").collect()
    return fit_field(sorted((r.tokens, r.tags, r.files) for r in rows))


def _scan(batches: Iterator[pa.RecordBatch], model: Field, with_base: bool) -> Iterator[pa.RecordBatch]:
    memo, gain = TokenScores(model), model.largest_gain
    for batch in batches:
        column = batch.column("text")
        for chunk in chunks(column):
            if len(memo) > MEMO_TOKENS:
                memo.reset()
            values = column.slice(chunk.first, chunk.rows).to_pylist()
            hexes = _rows_with_hex(chunk.data, chunk.offsets)
            flat, ends, files = number_tokens(values, memo)
            tags = viterbi(emissions(flat, ends, files, memo), model.steps, gain)
            tagged = np.add.reduceat(np.append(tags > 0, False).astype(np.int64), ends.ravel())[0::2] * (ends[:, 0] < ends[:, 1])
            out: list[list] = [[], [], [], [], []]
            for i, value in enumerate(values):
                base = base_matches(value, bool(hexes[i])) if with_base else []
                spans = [(a, b, k) for a, b, k, _ in base]
                if tagged[i]:
                    for a, b in tagged_spans(value, tags[ends[i, 0]:ends[i, 1]]):
                        if not any(a < y and x < b for x, y, _, _ in base):
                            spans.append((a, b, 3))
                spell = lambda some: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(some, key=lambda s: (s[0], s[2])))
                for kind in range(3):
                    out[kind].append(sum(k == kind for _, _, k, _ in base))
                out[3].append(hashlib.sha256(spell([s for s in spans if s[2] < 3]).encode()).hexdigest())
                out[4].append(spell(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.first, chunk.rows), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def scan_secrets(docs: DataFrame, model: Field | None = None, text: str = "text", doc_id: str = "doc_id", with_base: bool = True) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Spans are whole matches, in code points, as ``kind:start:end`` by start, then kind, joined by commas; ``base_sha256`` hashes those of the patterns alone.
    ``crf`` spans are those that the field tags, have at least ``MIN_CHARS`` characters and overlap no pattern's match. ``with_base=False`` leaves the patterns out, to judge the
    field by itself. ``model`` is learnt from the same documents unless given. A null or empty text has no span (the hash of
    an empty text); repeated rows get one row each; a null id stays null; an empty table gives no row; other columns are not read. Runs jobs.
    """
    learnt = model or learn_field(docs, text)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return texts(docs, text, doc_id).mapInArrow(lambda it: _scan(it, learnt, with_base), schema)
