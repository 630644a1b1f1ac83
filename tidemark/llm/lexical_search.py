"""Operator 12: ranked lexical search with hashed max-sketches as upper bounds.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. Items are taken in
blocks of bounded size. For a block, one pass over all whole texts writes a forward index: a document's number of
terms, and those of the block with their frequencies. From the index come the counts of all documents that weights
need. Then each document's impacts (a term's weight times the part that its frequency earns) fold into a sketch of
`width` places, a term's place by its hash, holding the maximum; an item's sum over the places of its terms is at
least the document's score, and the bounds of many documents and all items are one product of matrices. In a task,
an item's documents are scored exactly by descending bound until the bound falls below the k-th best score so far; so
nothing that belongs to the k best is left out. The tasks' best are merged in two steps.

A null text has no terms and is not counted; an item without terms has no results. Rows of one item_id are one item
with all their terms; a repeated document row is a document of its own. Of equal scores the smaller doc_id comes
first, a missing one last. Ids are of any type; extra columns are not read. A text of any length is one index row of
at most as many entries as the block has terms. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, small_batches
from tidemark.session import cut

#: ASCII other than letters and digits parts terms; capitals become small.
FOLD = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
#: Bytes of item texts in a block.
BLOCK_BYTES = 4 << 20
#: Documents scored exactly between two looks at the bound.
STEP = 16
#: What a document's number of terms counts beside its mean, of 100.
LENGTH_SHARE = 90


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Batch:
    """Items with their terms numbered, and, once weights are set, their bounds and exact scores for rows of the index."""

    def __init__(self, items: list[tuple[str | None, str | None]], k: int, width: int):
        own: dict[str | None, set[bytes]] = {}
        for item, text in items:
            own.setdefault(item, set()).update(terms(text))
        self.names = [i for i in own if own[i]]
        self.number = {t: i for i, t in enumerate(sorted(set().union(*own.values())))}
        self.items = [np.array(sorted(self.number[t] for t in own[i]), np.int64) for i in self.names]
        self.place = np.array([zlib.crc32(t) % width for t in self.number], np.int64)
        self.k, self.width = k, width
        self.weight = np.zeros(0, np.int64)
        self.documents = self.total = 0

    def count(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        found = terms(text)
        at, times = np.unique([v for v in map(self.number.get, found) if v is not None], return_counts=True)
        return len(found), at.astype(np.int32), times.astype(np.int64)

    def weigh(self, documents: int, total: int, holders: dict[int, int]) -> None:
        self.documents, self.total = documents, total
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holders.get(i, 0) + 1))) for i in range(len(self.number))], np.int64)

    def lookups(self) -> np.ndarray:
        """Places by items: how many of an item's terms have the place."""
        out = np.zeros((self.width, len(self.items)))
        for q, own in enumerate(self.items):
            np.add.at(out[:, q], self.place[own], 1)
        return out

    def impacts(self, sizes: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        length = 100 - LENGTH_SHARE + (LENGTH_SHARE * sizes * self.documents) // self.total
        return self.weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * length[row]))

    def sketches(self, n: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        out = np.zeros((n, self.width), np.int64)
        np.maximum.at(out, (row, self.place[term]), impact)
        return out


class Best:
    """The k best documents of each item so far."""

    def __init__(self, batch: Batch):
        self.batch, self.lookup = batch, batch.lookups()
        self.held: list[list[tuple]] = [[] for _ in batch.items]
        self.least = np.ones(len(batch.items))  # scores of 0 are no results
        self.scored = self.seen = 0

    def take(self, ids: list, sizes: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray) -> None:
        batch = self.batch
        impact = batch.impacts(sizes, row, term, times)
        bounds = batch.sketches(len(ids), row, term, impact).astype(float) @ self.lookup * (1 + 1e-9)
        exact = np.zeros((len(ids), len(batch.number)), np.int64)
        exact[row, term] = impact
        self.seen += bounds.size
        for q in np.flatnonzero((bounds >= self.least).any(axis=0)):
            bound = bounds[:, q]
            order = np.flatnonzero(bound >= self.least[q])
            order = order[np.argsort(-bound[order], kind="stable")]
            for start in range(0, len(order), STEP):
                part = order[start : start + STEP]
                if bound[part[0]] < self.least[q]:
                    break
                self.scored += len(part)
                scores = exact[np.ix_(part, batch.items[q])].sum(axis=1)
                good = np.flatnonzero(scores >= self.least[q])
                if len(good):
                    self.keep(q, [(-int(scores[g]), ids[part[g]] is None, ids[part[g]]) for g in good])

    def keep(self, q: int, more: list[tuple]) -> None:
        held = sorted(self.held[q] + more, key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[: self.batch.k]
        self.held[q] = held
        if len(held) == self.batch.k:
            self.least[q] = -held[-1][0]


def _index(docs: DataFrame, batch: Batch) -> DataFrame:
    """doc_id, n, terms and their times, of documents with any term; written once."""
    sent = docs.sparkSession.sparkContext.broadcast(batch)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in byte_batches(batches):
            got = [sent.value.count(t) for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "times"],
            )

    index = cut(docs.mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, times array<long>").where("n > 0"))
    sent.destroy()
    return index


def _searched(index: DataFrame, batch: Batch) -> DataFrame:
    """item_id, doc_id, score: the k best of each task."""
    sent = index.sparkSession.sparkContext.broadcast(batch)
    kind = index.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, id_type = Best(sent.value), None
        room = max(1, (32 << 20) // (8 * max(1, len(sent.value.number))))
        for whole in batches:
            id_type = whole.schema.field("doc_id").type
            for start in range(0, whole.num_rows, room):
                rows = whole.slice(start, room)
                lists, times = rows.column("terms"), rows.column("times")
                counts = np.diff(lists.offsets.to_numpy())
                flat = lambda a: a.flatten().to_numpy(zero_copy_only=False)
                best.take(rows.column("doc_id").to_pylist(), rows.column("n").to_numpy(zero_copy_only=False), np.repeat(np.arange(rows.num_rows), counts), flat(lists), flat(times))
        out = [(sent.value.names[q], i, -s) for q, held in enumerate(best.held) for s, _, i in held]
        if out:
            names, ids, scores = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, id_type), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(search, f"item_id string, doc_id {kind}, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, width: int = 256, block_items: int = 1000) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item."""
    small_batches(docs)
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // BLOCK_BYTES))
    found = []
    for b in range(blocks):
        batch = Batch([tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()], k, width)
        index = _index(narrow, batch)
        documents, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holders = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        batch.weigh(documents, total, {r.term: r.df for r in holders.collect()})
        found.append(_searched(index, batch))
    every = reduce(DataFrame.unionByName, found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = every.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").cast(items.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score")
