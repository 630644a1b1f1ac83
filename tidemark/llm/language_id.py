"""Operator 1: language identification by string kernels.

Kernel: the blended-spectrum presence kernel of byte n-grams, n = 1 to 3: the number of n-grams that two texts
both contain, divided by the geometric mean of their own numbers. n-grams are those of the landmarks (at most
MAX_FEATURES, the ones that most landmarks have). Nyström: texts are mapped to their kernel values with the
landmarks; one-versus-rest kernel ridge regression is solved in that space. As k(x, L) A = (x L' D) A / |x| and
L' D A does not depend on x, a batch of texts is scored by one product of its presence matrix with that matrix.

Texts are cut into segments of SEGMENT bytes at most, and a text's decision value is the mean of its segments'
values weighted by their bytes, so that presence does not saturate in long texts.

Learning uses a bounded sample: at most `per_lang` documents a language, the first by a hash (fewer where that many of
each language would be more than `most`) and `most` in all, one segment of each. Defined cases: of equal values the language
first in order is taken; a very long text is judged by all its segments; null text or text without a letter is `und`
with score 0; rows with null lang are not learned from; if there is nothing to learn from, all is `und`; every row
gives a row; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, byte_batches, fold, small_batches
from tidemark.session import cut, sized_broadcast

SEGMENT = 2048
MAX_FEATURES = 16_384
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def folded(text: str) -> bytes:
    """Lower case, ASCII other than letters as spaces, runs of spaces as one."""
    return b" ".join(text.lower().encode().translate(_FOLD).split())


def segments(raw: bytes) -> list[bytes]:
    return [raw[i : i + SEGMENT] for i in range(0, len(raw), SEGMENT)]


def grams(parts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For n = 1, 2, 3 the codes of all n-grams of the segments, laid end to end with NUL between; and the segments' numbers."""
    flat = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.uint32)
    at = np.repeat(np.arange(len(parts), dtype=np.int64), [len(p) + 1 for p in parts])
    two = (flat[:-1] << 8) | flat[1:]
    return [flat, two, (two[:-1] << 8) | flat[2:]], at


def no_gap(codes: np.ndarray, n: int) -> np.ndarray:
    """True for n-grams that do not touch the NUL between segments."""
    return reduce(np.logical_and, ((codes >> (8 * i)) & 255 != 0 for i in range(n)))


class SpectrumModel:
    """n-gram codes of the features by n, the matrix L' D A, the languages, their shares."""

    def __init__(self, codes: list[np.ndarray], weights: np.ndarray, langs: list[str], prior: np.ndarray):
        self.codes, self.weights, self.langs, self.prior = codes, weights.astype(np.float32), langs, prior
        self.tables: list[np.ndarray] | None = None

    def lookup(self) -> list[np.ndarray]:
        """Arrays from n-gram code to feature number or -1."""
        if self.tables is None:
            self.tables, first = [], 0
            for n, c in enumerate(self.codes, 1):
                t = np.full(1 << (8 * n), -1, np.int16)
                t[c] = np.arange(first, first + len(c))
                first += len(c)
                self.tables.append(t)
        return self.tables

    def presence(self, parts: list[bytes]) -> np.ndarray:
        width = len(self.weights)
        out = np.zeros(len(parts) * width, np.float32)
        codes, at = grams(parts)
        for c, t in zip(codes, self.lookup()):
            hit = t[c]
            there = np.flatnonzero(hit >= 0)
            out[at[there] * width + hit[there]] = 1
        return out.reshape(len(parts), width)

    def decide(self, parts: list[bytes], step: int = 256) -> np.ndarray:
        values = []
        for i in range(0, len(parts), step):
            x = self.presence(parts[i : i + step])
            values.append(x @ self.weights / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)))
        return np.concatenate(values) if values else np.zeros((0, len(self.langs)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        parts, owner = [], []
        for i, t in enumerate(texts):
            if has_letter(t):
                own = segments(folded(t))
                parts += own
                owner += [i] * len(own)
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not parts or not self.langs:
            return langs, scores
        size, own = np.array([len(p) for p in parts], float), np.array(owner)
        values = self.decide(parts)
        total = np.bincount(own, size, len(texts))
        mean = np.stack([np.bincount(own, values[:, k] * size, len(texts)) for k in range(len(self.langs))], 1) / np.maximum(total, 1)[:, None]
        mean += 1e-6 * self.prior
        odds = np.exp(4 * (mean - mean.max(1, keepdims=True)))
        for i in np.flatnonzero(total > 0):
            best = int(odds[i].argmax())
            langs[i], scores[i] = self.langs[best], float(odds[i, best] / odds[i].sum())
        return langs, scores


def fit(texts: list[str], langs: list[str], landmarks: int = 256, ridge: float = 1e-3) -> SpectrumModel:
    """Kernel ridge regression on Nyström features; texts come in a fixed order, landmarks are spread over languages."""
    names = sorted(set(langs))
    pairs = [(p, g) for t, g in zip(texts, langs) for p in segments(folded(t))[:1] if p]
    if not pairs:
        return SpectrumModel([np.zeros(0, np.int64)] * 3, np.zeros((0, 0)), [], np.zeros(0))
    parts, of = [p for p, _ in pairs], np.array([names.index(g) for _, g in pairs])
    each = max(1, landmarks // len(names))
    chosen = [i for k in range(len(names)) for i in np.flatnonzero(of == k)[:each]]
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    codes, at = grams([parts[i] for i in chosen])
    for n, c in enumerate(codes, 1):
        ok = no_gap(c, n)
        distinct = np.unique(at[: len(c)][ok] << 24 | c[ok]) & ((1 << 24) - 1)
        counts.append(np.unique(distinct, return_counts=True))
    level = np.sort(np.concatenate([k for _, k in counts]))[::-1]
    least = max(1, level[MAX_FEATURES - 1] + 1) if len(level) > MAX_FEATURES else 1
    model = SpectrumModel([c[k >= least] for c, k in counts], np.zeros((sum(int((k >= least).sum()) for _, k in counts), 1)), names, np.bincount(of, minlength=len(names)) / len(of))
    marks = model.presence([parts[i] for i in chosen])
    marks /= np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
    cross = np.concatenate([(x := model.presence(parts[i : i + 256])) @ marks.T / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) for i in range(0, len(parts), 256)]).astype(float)
    target = np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0)
    gram = (marks @ marks.T).astype(float)
    alpha = np.linalg.solve(cross.T @ cross + ridge * len(parts) * gram + 1e-6 * len(parts) * np.eye(len(chosen)), cross.T @ target)
    model.weights = (marks.T @ alpha).astype(np.float32)
    return model


def training_rows(docs: DataFrame, allowed, per_lang: int, most: int) -> DataFrame:
    """lang and one segment of text of a bounded sample of documents."""
    keys = docs.where(allowed & F.col("lang").isNotNull()).select("doc_id", "lang")
    sizes = cut(keys.groupBy("lang").count())
    per_lang = min(per_lang, max(1, most // max(1, sizes.count())))  # so that `most` leaves no language out
    u = (F.xxhash64(F.lit("lang"), "doc_id") / F.lit(2.0**64)) + 0.5
    near = keys.join(sized_broadcast(sizes), "lang").withColumn("_u", u).where(F.col("_u") * F.col("count") < 2 * per_lang + 20)  # some twice as many as wanted
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_u", "doc_id"))
    chosen = near.withColumn("_k", place).where(F.col("_k") <= per_lang).select("doc_id", F.col("lang").alias("_lang"))
    chosen = bounded_sample(chosen, most, "doc_id", "_lang").dropDuplicates(["doc_id"])
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - (SEGMENT - 1))) + 1
    return docs.join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull() & (F.col("lang") == F.col("_lang"))).select("doc_id", "lang", F.col("text").substr(start.cast("int"), F.lit(SEGMENT)).alias("text"))


def language_id(docs: DataFrame, folds: int = 5, held: int = 0, per_lang: int = 500, most: int = 8_000, landmarks: int = 256) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learned from documents outside fold `held`."""
    small_batches(docs)
    rows = training_rows(docs.select("doc_id", "text", "lang"), fold("doc_id", folds) != held, per_lang, most).toPandas().sort_values(["doc_id", "text"])
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows["text"].tolist(), rows["lang"].tolist(), landmarks))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in byte_batches(batches):
            langs, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    narrow = docs.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
