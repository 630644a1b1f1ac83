"""Operator 11: periodic runs of words, by descending-LCP Kruskal over suffix classes.

A run is a stretch of words with smallest period q (words q apart are the same), at least `min_repeats` periods and
`min_length` words long, that no neighbouring word extends. The suffixes of a text are sorted by prefix doubling, and
the longest common prefixes of neighbours are the edges of a graph that is built from the longest down, as Kruskal's
trees are: union-find joins the classes of suffixes that share so many words, and a class keeps its positions in
order. Where two positions become neighbours in a class at level l, at a distance d of at most l, words from the
first on have period d for d + l words; no position between them shares l words, so d is the smallest period. It is
a run where the word before does not go on with it. All edges of one level are laid before neighbours are looked at.

Python tasks take texts by bytes, many in one block; only texts in which some stretch as long as the least level
occurs twice are sorted. Work of a text is in its words times their logarithm; a text longer than a block is one of
its own, so memory grows with the longest text (some 200 bytes a word).

A null text counts as an empty one, without words or runs. Every row of the input gives one row, repeated rows too;
doc_id is of any type and may be null; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, small_batches, words

Run = tuple[int, int, int]  # start, length, period
#: Words of the stretches that tell which texts repeat themselves, at most.
GRAM = 8


def least_level(min_length: int, min_repeats: int) -> int:
    """The fewest words that two positions a period apart share in any run."""
    return min(max(min_length - d, (min_repeats - 1) * d, 1) for d in range(1, min_length + 1))


def repeats_itself(s: np.ndarray, owner: np.ndarray, gram: int) -> np.ndarray:
    """Numbers of the texts in which a stretch of `gram` words may occur twice; none with such a stretch is missing."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    scattered = (s.astype(np.uint64) + np.uint64(1)) * mix
    scattered ^= scattered >> np.uint64(29)
    h = owner.astype(np.uint64) * mix
    for j in range(gram):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + scattered[j : j + len(h)]
    at = np.argsort(h)
    same = np.flatnonzero(h[at][1:] == h[at][:-1])
    return np.unique(owner[at[same]])


def sorted_ranks(s: np.ndarray, owner: np.ndarray, gram: int) -> list[tuple[int, np.ndarray]]:
    """(length, ranks): of suffixes by their first `length` words, doubled until all differ; equal stretches of a text share a rank."""
    n = len(owner)
    bits = int(s.max()).bit_length() if len(s) else 1
    columns = [owner.astype(np.int64)] + [s[j : j + n].astype(np.int64) for j in range(gram)]
    keys: list[np.ndarray] = []
    room = 0
    for k, c in enumerate(columns):
        width = bits if k else int(c.max()).bit_length()
        if room >= width and keys:
            keys[-1] = keys[-1] << width | c
            room -= width
        else:
            keys.append(c.copy())
            room = 63 - width
    order = np.lexsort(keys[::-1])
    fresh = np.ones(n, bool)
    fresh[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, length = [(gram, rank.copy())], gram
    tied = order[shared(fresh)]
    while len(tied):
        base = rank[tied].astype(np.int64)
        key = base * n + rank[tied + length]
        at = np.argsort(key, kind="stable")
        tied, key, base = tied[at], key[at], base[at]
        place = np.arange(len(tied))
        starts = lambda v: np.concatenate(([True], v[1:] != v[:-1]))
        fresh = starts(key)
        rank[tied] = base + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(starts(base), place, 0))
        length *= 2
        levels.append((length, rank.copy()))
        tied = tied[shared(fresh)]
    return levels


def shared(fresh: np.ndarray) -> np.ndarray:
    """Of sorted rows, where fresh marks the first of its class: which are in a class of two or more."""
    last = np.concatenate((fresh[1:], [True]))
    return ~(fresh & last)


def common_prefixes(s: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b share, of those that share the first level's stretch."""
    got = np.zeros(len(a), np.int64)
    for length, rank in reversed(levels):
        got += length * (rank[a + got] == rank[b + got])
    open_ = np.ones(len(a), bool)
    for _ in range(levels[0][0] - 1):
        open_ &= s[a + got] == s[b + got]
        got += open_
    return got


def kruskal_seeds(suffixes: list[int], edges: list[int], prefixes: list[int], repeats: int) -> list[Run]:
    """(position, level, distance) of neighbours that are at most level / (repeats - 1) apart; edges join suffixes k and k + 1, from the longest prefix down."""
    parent: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    following: dict[int, int] = {}
    looked: dict[int, int] = {}
    seeds: list[Run] = []

    def find(k: int) -> int:
        if k not in parent:
            parent[k] = k
            held[k] = [suffixes[k]]
            return k
        root = k
        while parent[root] != root:
            root = parent[root]
        while parent[k] != root:
            parent[k], k = root, parent[k]
        return root

    at = 0
    while at < len(edges):
        level, touched = prefixes[at], []
        while at < len(edges) and prefixes[at] == level:
            big, small = find(edges[at]), find(edges[at] + 1)
            if len(held[big]) < len(held[small]):
                big, small = small, big
            parent[small] = big
            into = held[big]
            for x in held.pop(small):
                i = bisect_left(into, x)
                if i:
                    following[into[i - 1]] = x
                    touched.append(into[i - 1])
                if i < len(into):
                    following[x] = into[i]
                    touched.append(x)
                into.insert(i, x)
            at += 1
        for x in touched:
            after = following[x]
            if looked.get(x) != after:
                looked[x] = after
                if (repeats - 1) * (after - x) <= level:
                    seeds.append((x, level, after - x))
    return seeds


def block_runs(texts: list[list[bytes]], min_length: int, min_repeats: int) -> list[list[Run]]:
    """The runs of each text (lists of words), by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    level = least_level(min_length, min_repeats)
    gram = min(level, GRAM)
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    coded = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts]
    mark = len(numbers)  # the number after a text's last word: one for each text, so that nothing goes on beyond it

    def laid(which: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [x for k, i in enumerate(which) for x in (coded[i], [mark + k])]
        s = np.concatenate([*parts, mark + len(which) + np.arange(gram)]).astype(np.int64)
        sizes = np.array([len(coded[i]) + 1 for i in which])
        return s, np.repeat(np.arange(len(which)), sizes), np.concatenate(([0], np.cumsum(sizes)))

    which = [i for i, t in enumerate(texts) if len(t) >= min_length]
    if not which:
        return out
    s, owner, _ = laid(which)
    which = [which[k] for k in repeats_itself(s, owner, gram)]
    if not which:
        return out
    s, owner, edges = laid(which)
    levels = sorted_ranks(s, owner, gram)
    suffixes = np.argsort(levels[-1][1], kind="stable")
    a, b = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[0][1][a] == levels[0][1][b])
    prefix = common_prefixes(s, levels, a[near], b[near])
    del levels
    near, prefix = near[prefix >= level], prefix[prefix >= level]
    down = np.argsort(-prefix, kind="stable")
    seeds = kruskal_seeds(suffixes.tolist(), near[down].tolist(), prefix[down].tolist(), min_repeats)
    for x, shared_words, d in seeds:
        first = x == 0 or s[x - 1] != s[x - 1 + d]
        if first and shared_words + d >= max(min_length, min_repeats * d):
            k = int(owner[x])
            out[which[k]].append((x - int(edges[k]), shared_words + d, d))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(text: list[bytes], runs: list[Run]) -> str:
    """The words but those that a run repeats: of each run its first period stays, unless another run drops it."""
    if not runs:
        return b" ".join(text).decode()
    steps = np.zeros(len(text) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join([text[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]).decode()


def planted_words(doc_id, text: str | None) -> str | None:
    """For a tenth of the ids, the text's words made periodic from some word on, by the crc32 of the decimal id; else the text itself."""
    if text is None or doc_id is None:
        return text
    h = zlib.crc32(str(doc_id).encode())
    g, own = h // 10, words(text)
    if h % 10 or not own:
        return text
    a = g % len(own)
    left = len(own) - a
    period = 1 + left // (3 + g % 8)
    unit = own[a : a + period]
    return b" ".join(own[:a] + (unit * -(-left // period))[:left]).decode()


def periodic_runs(docs: DataFrame, min_length: int = 6, min_repeats: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; in this order), collapsed (the text without what runs repeat) for every row."""
    if min_repeats < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    small_batches(docs)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in byte_batches(batches):
            texts = [words(t) for t in batch.column("text").to_pylist()]
            runs = block_runs(texts, min_length, min_repeats)
            told = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(told, kind), pa.array(map(collapsed, texts, runs), pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(search, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
