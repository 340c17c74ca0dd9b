"""Small inputs with everything that may go wrong, and brute-force results."""

from __future__ import annotations

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, doc string, tag int, digest string, key long, node long, n long, kept boolean, n_words long, _cuts int, _doc long, _tag int, _kept_id long, _kept_key string, props map<string,int>"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def odd_rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows, near copies, shared passages, a long text, odd characters."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Él", "straße", "日本語", "a\u00a0b", "x'y", "don't", "ＡＢ", "😀"]
    prose = lambda n: [rnd.choice(vocabulary) + str(rnd.randrange(900)) for _ in range(n)]
    passage, line = prose(45), prose(12)
    base = prose(120)
    near = [list(base) for _ in range(6)]
    for copy in near[1:]:
        copy[rnd.randrange(len(copy))] = "changed"
    texts = [
        None, "", " \t\n ", "one", "one", "one two three four", "\u00a0", " ".join(base), *map(" ".join, near),
        " ".join(prose(30) + passage + prose(30)), "\n".join(prose(10)) + "\t" + "  ".join(passage), " ".join(passage[:30] + prose(9)),
        " ".join(passage + prose(3) + passage), " ".join(prose(40) + line), " ".join(line + prose(40)),
        " ".join(prose(60_000)), "x" * 300_000, " ".join(["again"] * 50), "A B C D E F", "a b c d e f", " ".join(prose(25)).upper(),
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows + [rows[3], (None, " ".join(passage)), (None, None)]


def odd_documents(spark, rows=None):
    rows = odd_rows() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "d", 1, "x", 2, 3, 4, True, 5, 6, 7, 8, 9, "k", {"a": 1}) for i, t in rows], SCHEMA).repartition(3)


def similar(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """Shingles and smallest linked id of each document, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def without_repeats(rows: list[tuple]) -> dict:
    """Words left of each (order, text), by looking at every window."""
    first: dict[tuple, tuple] = {}
    split = {order: words(text) for order, text in rows}
    for order in sorted(split):
        w = split[order]
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k:k + 20]), (order, k))
    out = {}
    for order, w in split.items():
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k:k + 20])] != (order, k):
                gone |= set(range(k, k + 20))
        out[order] = [x for k, x in enumerate(w) if k not in gone]
    return out


def rule_counts(text: str | None) -> tuple:
    w = words(text)
    windows = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    repeated = set()
    for k in range(len(w) - 4):
        if windows[tuple(w[k:k + 5])] > 1:
            repeated |= set(range(k, k + 5))
    seen, again = set(), 0
    for row in (text or "").split("\n"):
        if words(row):
            again += row in seen
            seen.add(row)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(repeated)
