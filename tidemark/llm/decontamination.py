"""Operator 5: benchmark decontamination by SimHash of item-sized windows.

A window's fingerprint has in bit k the majority of bit k over the hashes of its words. Each item is fingerprinted at
its start, middle and end, at a size that leaves one of the three whole wherever a copy of similarity `least` was
edited at its edges or in one place (`clean_size`; sizes form a geometric grid, so all items share few of them);
documents at every word, at every size in use. Multi-index search: fingerprints have four blocks of 16 bits, and two
fingerprints within RADIUS = 7 bits have a block that differs in one bit or none, so looking a block up among all
items' blocks with up to one bit flipped finds every fingerprint within the radius. Candidates are verified exactly:
the item and the document's words there (as many as the item's, or those from its first to its last shingle nearby)
are multisets of word shingles, weighted by their rarity among the items, and the weighted Jaccard similarity must
reach `least`. Exact copies and such edits always become candidates (sizes are reckoned with shingles of equal weight);
edits scattered over a long item, or in it and at its edges at once, may leave no window whole, and are found where
one of the three stays within the radius.

Words: runs without white space, ASCII punctuation taken out, lower case. Defined cases: items without words match
nothing; items shorter than a shingle count as one shingle; null or empty texts match nothing; of equal matches of a
document and an item the first is reported; ids may be of any type; repeated documents or items report each doc_id
and item_id pair once.
The index of items is sent to all workers in slices of at most `slice_items` items, a pass over documents for each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, claim, distinct_words, judged_rows, memory, numbered_words, small_batches, without

RADIUS = 7
BLOCKS = 4
#: Words of text that are fingerprinted at once.
CHUNK = 8_192
#: Words whose bits are counted one after another; many such runs are counted side by side.
RUN = 32
#: Longest window in words.
LONGEST = 8_192
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
MEMO_WORDS = 250_000
_memo: dict[bytes, int] = memory()


def plain_words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(None, _PUNCTUATION).split() if text else []


def hashes(ws: list[bytes]) -> np.ndarray:
    found = list(map(_memo.get, ws))
    if None in found:
        for i, h in enumerate(found):
            if h is None:
                found[i] = h = xxhash.xxh64_intdigest(ws[i], 11)
                if len(_memo) < MEMO_WORDS:
                    _memo[ws[i]] = h
    return np.array(found, np.uint64)


def raw_hashes(ws: list[bytes]) -> np.ndarray:
    """hashes() of the plain forms of words that still have their punctuation; 0 for those without any other character."""
    found = list(map(_memo.get, ws))
    if None in found:
        for i, h in enumerate(found):
            if h is None:
                own = plain_words(ws[i].decode())
                found[i] = h = xxhash.xxh64_intdigest(own[0], 11) if own else 0
                if len(_memo) < MEMO_WORDS:
                    _memo[ws[i]] = h
    return np.array(found, np.uint64)


def grid_size(words: int) -> int:
    """The largest window size of the grid that is no more than `words`."""
    size = 1
    while (step := max(size + 1, size * 6 // 5)) <= min(words, LONGEST):
        size = step
    return size


def lost_shingles(words: int, shingle: int, least: float) -> int:
    """How many of an item's shingles can be missing in a text of that similarity."""
    return int(max(words - shingle + 1, 1) * (1 - least) + 1e-9)


def clean_size(words: int, shingle: int, least: float) -> int:
    """A window size so that of an item's first, middle and last window one is whole in every near copy edited at its edges or in one place.

    A similarity of `least` bears `lost` edited shingles. Words at the edges lie in one shingle and more each, so at
    most `lost` of them differ in all; an edit away from the edges costs a shingle's length of them at least, and
    leaves half of the other words on one side of it.
    """
    lost = lost_shingles(words, shingle, least)
    inner = lost - shingle + 1
    size = min(words - 2 * lost, (words - inner) // 2) if inner > 0 else words - 2 * lost
    return grid_size(max(size, 1))


def running_ones(h: np.ndarray, kind: type = np.uint16) -> np.ndarray:
    """For each position, how many words before it have each bit (modulo 2^16, or what `kind` holds)."""
    runs = -(-len(h) // RUN)
    bits = np.zeros((runs, RUN, 64), kind)
    bits.reshape(-1, 64)[: len(h)] = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
    for k in range(1, RUN):  # all runs of RUN words at once
        bits[:, k] += bits[:, k - 1]
    out = np.zeros((runs * RUN + 1, 64), kind)
    before = np.zeros((runs, 1, 64), kind)
    np.cumsum(bits[:-1, -1], axis=0, dtype=kind, out=before[1:, 0])
    np.add(bits, before, out=out[1:].reshape(runs, RUN, 64))
    return out[: len(h) + 1]


def _kind(size: int) -> type:
    """Counts of a window are differences of running ones; a byte holds those of windows of up to 255 words."""
    return np.uint8 if size < 256 else np.uint16


def fingerprints(ones: np.ndarray, size: int) -> np.ndarray:
    """Of all windows of `size` words."""
    return np.packbits((ones[size:] - ones[:-size] > size // 2).ravel()).view(np.uint64)


class Band:
    """The items' fingerprints of one window size, and for each block the lists of those near each value."""

    def __init__(self, marks: list[tuple[int, int, int]]):
        self.marks = np.array([m for m, _, _ in marks], np.uint64)
        self.item = np.array([i for _, i, _ in marks], np.int64)
        self.shift = np.array([s for _, _, s in marks], np.int64)
        flips = np.array([0, *(1 << b for b in range(16))], np.uint64)
        value = np.concatenate([(((self.marks >> np.uint64(16 * block)) & np.uint64(0xFFFF))[:, None] ^ flips).ravel() + np.uint64(block << 16) for block in range(BLOCKS)])
        order = np.argsort(value, kind="stable")
        self.list = (order // len(flips)) % len(self.marks)
        self.first = np.searchsorted(value[order], np.arange((BLOCKS << 16) + 1, dtype=np.uint64))
        self.there = np.diff(self.first) > 0

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window numbers, fingerprint numbers and distances of all pairs within the radius."""
        keys = (windows.astype("<u8", copy=False).view("<u2").reshape(-1, BLOCKS) + (np.arange(BLOCKS) << 16)).ravel()
        hit = np.flatnonzero(self.there.take(keys))
        key = keys.take(hit)
        first = self.first.take(key)
        n = self.first.take(key + 1) - first
        at = np.repeat(hit // BLOCKS, n)
        mark = self.list.take(np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(at)))
        near = np.flatnonzero(np.bitwise_count(windows.take(at) ^ self.marks.take(mark)) <= RADIUS)
        window, mark = np.divmod(np.unique(at[near] * len(self.marks) + mark[near]), len(self.marks))
        return window, mark, np.bitwise_count(windows[window] ^ self.marks[mark]).astype(np.int64)


def shingles(h: np.ndarray, words: int) -> Counter:
    h = h.tolist()
    return Counter(tuple(h[i : i + words]) for i in range(max(1, len(h) - words + 1))) if h else Counter()


class Items:
    """Fingerprints by window size and shingles of a slice of the benchmark."""

    def __init__(self, rows: list[tuple[str, str | None]], words: int, least: float):
        self.words, self.ids, self.hashes = words, [], []
        marks: dict[int, list[tuple[int, int, int]]] = {}
        for item, text in rows:
            h = hashes(plain_words(text))
            if not len(h):
                continue
            size, number = clean_size(len(h), words, least), len(self.ids)
            self.ids.append(item), self.hashes.append(h)
            ones = running_ones(h)
            for start in sorted({0, (len(h) - size) // 2, len(h) - size}):
                marks.setdefault(size, []).append((int(fingerprints(ones[start : start + size + 1], size)[0]), number, -start))
        self.bags = [shingles(h, words) for h in self.hashes]
        held = Counter(s for b in self.bags for s in b)
        self.rarity = {s: math.log(1 + len(self.ids) / n) for s, n in held.items()}
        self.unseen = math.log(1 + len(self.ids)) if self.ids else 1.0
        self.weights = [sum(n * self.rarity[s] for s, n in b.items()) for b in self.bags]
        self.marks, self.bands = marks, None

    def similarity(self, number: int, h: np.ndarray) -> float:
        ws = h.tolist()
        if len(ws) >= self.words and self.bags[number].keys().isdisjoint(zip(*(ws[k:] for k in range(self.words)))):
            return 0.0
        a, b = self.bags[number], shingles(h, self.words)
        both = sum(min(n, b[s]) * self.rarity[s] for s, n in a.items() if s in b)
        if not both:  # no shingle is common
            return 0.0
        every = self.weights[number] + sum(n * self.rarity.get(s, self.unseen) for s, n in b.items()) - both
        return both / every if every else 0.0

    def trimmed(self, number: int, h: np.ndarray, low: int, high: int, at: int) -> tuple[int, int]:
        """What to add to start and length for the words from the item's first shingle in [low, high) to its last, where words were put in or taken out."""
        bag, near = self.bags[number], h[low:high].tolist()
        held = [i for i in range(len(near) - self.words + 1) if tuple(near[i : i + self.words]) in bag]
        if not held:
            return 0, 0
        a = low + held[0]
        return a - at, low + held[-1] + self.words - a - len(self.hashes[number])

    def candidates(self, h: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int]]:
        """(position of the item's start, item, distance) for words laid end to end; edges: where documents begin, and the end."""
        if self.bands is None:
            self.bands = {size: Band(m) for size, m in sorted(self.marks.items())}
        found = []
        owner_end = np.repeat(edges[1:], np.diff(edges))
        longest = max(self.bands, default=0)
        step = max(CHUNK, 4 * longest)
        for start in range(0, len(h), step):
            part = h[start : start + step + longest - 1]
            ones = {kind: running_ones(part, kind) for kind in {_kind(size) for size in self.bands}}
            for size, band in self.bands.items():
                if len(part) < size:
                    continue
                windows = fingerprints(ones[_kind(size)], size)[:step]
                at, mark, distance = band.search(windows)
                inside = start + at + size <= owner_end[start + at]
                for w, m, d in zip(at[inside], mark[inside], distance[inside]):
                    found.append((start + int(w) + int(band.shift[m]), int(band.item[m]), int(d)))
        return found

    def matches(self, texts: pa.Array | list[str | None], least: float) -> list[tuple[int, str, int, int, float]]:
        """(text number, item id, first word, words, similarity): the best of each text and item."""
        words, sizes = numbered_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        h = raw_hashes(distinct_words(words))[words.indices.to_numpy()]
        before = np.concatenate(([0], np.cumsum(h != 0)))  # how many words, punctuation alone is none
        h, edges = h[h != 0], before[np.concatenate(([0], np.cumsum(sizes)))]
        tried: set[tuple[int, int, int, int]] = set()
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for at, number, _ in sorted(self.candidates(h, edges), key=lambda c: (c[2], c[0])):
            size = len(self.hashes[number])
            doc = int(np.searchsorted(edges, min(max(at + size // 2, 0), len(h) - 1), "right")) - 1
            if best.get((doc, number), (0.0,))[0] == 1.0:
                continue
            reach = lost_shingles(size, self.words, least) + 1
            low, high = max(at - reach, int(edges[doc])), min(at + size + reach, int(edges[doc + 1]))
            for other in ((0, 0), None, (0, -1), (0, 1), (1, -1), (-1, 1), (1, 0), (-1, 0), (0, -2), (0, 2)):
                shift, more = other or self.trimmed(number, h, low, high, at)
                a = max(at + shift, int(edges[doc]))
                z = min(a + max(1, size + more), int(edges[doc + 1]))
                if a >= z or (doc, number, a, z) in tried:
                    continue
                tried.add((doc, number, a, z))
                value = self.similarity(number, h[a:z])
                if value >= least - 1e-9 and value > best.get((doc, number), (0.0,))[0]:
                    best[doc, number] = (value, a - int(edges[doc]), z - a)
                if shift == more == 0 and (value == 1.0 or value < least - 0.3):
                    break
        return [(doc, self.ids[number], a, n, value) for (doc, number), (value, a, n) in sorted(best.items())]


def decontamination(docs: DataFrame, benchmark: DataFrame, words: int = 5, least: float = 0.8, slice_items: int = 20_000) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: every document and item with a window of that similarity."""
    small_batches(docs)
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    slices = max(1, -(-bench.count() // slice_items))
    kind, item_kind = (f.schema[c].dataType.simpleString() for f, c in ((narrow, "doc_id"), (benchmark, "item_id")))
    found = []
    for k in range(slices):
        rows = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).collect()
        sent = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in rows], words, least))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            claim(_memo)
            for batch in byte_batches(batches):
                hits = sent.value.matches(batch.column("text"), least)
                doc, item, start, n, value = zip(*hits) if hits else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(item, pa.string()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(value, pa.float64())],
                    names=["doc_id", "item_id", "start", "n_words", "similarity"],
                )

        found.append(narrow.mapInArrow(search, f"doc_id {kind}, item_id string, start long, n_words long, similarity double"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "start", "n_words")
    return every.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k").withColumn("item_id", F.col("item_id").cast(item_kind))


def keep_unseen(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    return without(docs, decontamination(judged_rows(docs), benchmark, **how))
