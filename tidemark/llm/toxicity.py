"""Operator 6: toxicity by a factorization machine over hashed terms.

Terms: words in lower case without ASCII punctuation at their ends, their first 5 to 8 bytes (stems), and stems
that several words of the text share, all hashed by crc32; a text is the set of its terms. The machine scores b + sum of w_i + sum over pairs of <v_i, v_j>, so a pair of terms can tell more than
both alone. It learns from a bounded sample of labelled documents (`most`, in hash order); over that sample Spark
counts each term with and without the label, and terms whose association passes a chi-square limit (at most
`features`, the strongest) enter the machine.

Defined cases: null or empty text scores by the bias alone; without labelled rows every score is 0; where all labels
learned are alike every score is near that label; a document labelled twice is two examples; terms of equal
association enter by their hash; a very long text is one set of terms, in a batch of its own; every row of docs gives
a row; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, byte_batches, claim, fold, id_number, judged_rows, small_batches, without
from tidemark.session import cut

_ENDS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


#: Bytes of a word's start that count as its stem.
STEMS = (5, 6, 7, 8)


def terms(text: str | None) -> list[int]:
    """Hashes of the distinct terms of a text: words, stems, and stems of three or more of its distinct words."""
    if not text:
        return []
    found = {w.strip(_ENDS) for w in set(text.lower().encode().split())}
    found.discard(b"")
    hashes = set(map(zlib.crc32, found))
    for n in STEMS:
        for stem, forms in Counter([w[:n] for w in found if len(w) > n]).items():
            h = zlib.crc32(stem, n)
            hashes.add(h)
            if forms > 2:
                hashes.add(h ^ 0x5BD1E995)
    return list(hashes)


class FactorizationMachine:
    """Second-order machine on sets of features; ids are their sorted hashes."""

    def __init__(self, ids: np.ndarray, factors: int = 8, seed: int = 7):
        self.ids, self.bias = ids, 0.0
        self.linear = np.zeros(len(ids))
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (len(ids), factors))

    def lay(self, sets: list) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and feature numbers of the known terms."""
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.fromiter((t for s in sets for t in s), np.int64, len(row))
        at = np.searchsorted(self.ids, flat)
        at[at == len(self.ids)] = 0
        known = self.ids[at] == flat if len(self.ids) else np.zeros(len(flat), bool)
        return row[known], at[known]

    def raw(self, row: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and each row's sum of factors."""
        k = self.factors.shape[1]
        v = self.factors[at]
        total = np.stack([np.bincount(row, v[:, f], n) for f in range(k)], 1) if k else np.zeros((n, 0))
        squares = np.bincount(row, (v * v).sum(1), n)
        return self.bias + np.bincount(row, self.linear[at], n) + 0.5 * ((total * total).sum(1) - squares), total

    def fit(self, sets: list, labels: np.ndarray, epochs: int = 30, batch: int = 512, rate: float = 0.1, ridge: float = 1e-4, seed: int = 7) -> None:
        """Logistic loss, AdaGrad, mini-batches in a seeded order."""
        rng = np.random.default_rng(seed)
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        seen_w, seen_v, seen_b = np.full(len(self.ids), 1e-6), np.full(self.factors.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(sets))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                row, at = self.lay([sets[j] for j in part])
                score, total = self.raw(row, at, len(part))
                gap = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[part]
                used = np.unique(at)
                w = np.bincount(at, gap[row], len(self.ids))[used] + ridge * self.linear[used]
                pull = gap[row, None] * (total[row] - self.factors[at])
                v = np.stack([np.bincount(at, pull[:, f], len(self.ids))[used] for f in range(pull.shape[1])], 1) + ridge * self.factors[used]
                seen_w[used] += w * w
                seen_v[used] += v * v
                b = gap.sum()
                seen_b += b * b
                self.linear[used] -= rate * w / np.sqrt(seen_w[used])
                self.factors[used] -= rate * 0.3 * v / np.sqrt(seen_v[used])
                self.bias -= rate * b / np.sqrt(seen_b)

    def score(self, sets: list) -> np.ndarray:
        row, at = self.lay(sets)
        return 1 / (1 + np.exp(-np.clip(self.raw(row, at, len(sets))[0], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, allowed, label: str = "toxic", most: int = 20_000, features: int = 20_000, least: int = 3, strength: float = 8.0) -> FactorizationMachine | None:
    """A machine from at most `most` labelled rows whose doc_id `allowed` admits."""
    sample = bounded_sample(labels.where(allowed & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")), most, "doc_id", "y")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(map(terms, batch.column("text").to_pylist()), pa.list_(pa.int64()))], names=["doc_id", "y", "terms"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = cut(rows.mapInArrow(lay, f"doc_id {kind}, y int, terms array<long>"))
    n, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    if not n:
        return None
    if toxic in (0, n):  # nothing tells one label from another: the bias is all there is
        machine = FactorizationMachine(np.zeros(0, np.int64))
        machine.fit([[]] * min(n, 1), np.array([toxic / n]), epochs=0)
        return machine
    c, t = F.col("c").cast("double"), F.col("t").cast("double")
    gap = t * F.lit(float(n)) - c * F.lit(float(toxic))
    chi = gap * gap * n / (c * (n - c) * F.lit(float(toxic)) * F.lit(float(n - toxic)))
    chosen = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c"), F.sum("y").alias("t")).where((F.col("c") >= least) & (F.col("c") < n)).withColumn("chi", chi).where(F.col("chi") >= strength)
    ids = np.array(sorted(r.term for r in chosen.orderBy(F.desc("chi"), "term").limit(features).select("term").collect()), np.int64)
    known = docs.sparkSession.sparkContext.broadcast(ids)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.intersect1d(t, known.value).tolist() for t in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "y", "terms"])

    examples = rows.mapInArrow(keep, f"doc_id {kind}, y int, terms array<long>").toPandas().sort_values(["doc_id", "y"], kind="stable")
    machine = FactorizationMachine(ids)
    machine.fit(examples["terms"].tolist(), examples["y"].to_numpy(float))
    return machine


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; labels of fold `held` are not learned."""
    small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, fold("doc_id", folds) != held, label, **how))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim({})
        for batch in byte_batches(batches):
            score = sent.value.score([terms(t) for t in batch.column("text").to_pylist()]) if sent.value else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are not predicted toxic; a doc_id with several rows goes with all of them if one is."""
    numbered = labels.withColumn("doc_id", id_number(labels))
    return without(docs, toxicity(judged_rows(docs), numbered, **how).where("predicted = 1"))
