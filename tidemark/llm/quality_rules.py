"""Operator 9: quality rules by robust multivariate outliers.

Every document gets counts from its whole text (base rules) and a vector of transformed statistics. For each
language and source, and for all documents together, the minimum-covariance-determinant estimate of centre and scatter
is found by concentration steps: all vectors get their Mahalanobis distances, the nearest `inner` share of them gives
the next estimate, until no determinant falls any more. There are two starts, median and MAD, and mean and covariance;
each group takes the estimate of the lowest determinant, and borrows from that of all documents as much as `borrow`
rows weigh against its own, so a small group is judged mostly by what holds everywhere, without a size at which that
changes. A document whose distance lies beyond `beyond` is rejected.

A step is one aggregation for all groups and both starts: moments are summed by classes of distance (BINS to an
octave), and a running sum over a group's classes, which are few whatever its rows, tells which are the nearest. So
the share is `inner` and the rest of one class. Groups are told by a 64-bit hash of language and source.

Defined cases: text null or without words has n_words 0 and fails the base rules; a null lang or source is a group
of its own; a group without rows that pass the base rules takes the estimate of all documents; without any
such row every row fails the base rules; equal distances share a class; repeated rows give a row each; a long text is
counted whole, alone in its batch; extra columns are not read; an empty table gives an empty result. No spread is taken
to be under the sampling noise of its statistic, as counts of the documents' sizes have it (NOISE, its mean over all
documents): where most documents have none of something, as repeated lines, one in a short text is no sign.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, claim, judged_rows, small_batches, without
from tidemark.session import cut, sized_broadcast

STATS = ["f_length", "f_word", "f_symbols", "f_lines", "f_repeats", "f_upper"]
#: Sampling variance of each statistic, by column of a document: Poisson for counts, 1/4n for roots of shares.
NOISE = ["v_length", "v_word", "v_symbols", "v_lines", "v_repeats", "v_upper"]
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(rb"[A-Z]")
_LETTER = re.compile(rb"[A-Za-z]")
WINDOW = 8
#: A log determinant that falls by less is at rest.
STILL = 0.01
#: Classes of squared distances to an octave.
BINS = 32
#: The key of all documents together.
ALL = 0


def repeated_words(ws: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of `size` words that the text has twice or more, the first one included."""
    n = len(ws) - size + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int64, len(ws))
    if len(known) == len(ws):
        return 0
    key = ids[:n].copy()
    for i in range(1, size):  # pairs of (window so far, next word) are numbered anew: equal numbers are equal windows
        _, key = np.unique(key * len(known) + ids[i : i + n], return_inverse=True)
        if key.max(initial=0) == n - 1:
            return 0
    twice = np.bincount(key)[key] > 1
    edge = np.zeros(len(ws) + 1, np.int64)
    edge[:n] += twice
    edge[size : size + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters of a text."""
    text = text or ""
    raw = text.encode()
    ws = raw.split()
    joined = b"".join(ws)
    chars = len(joined) if text.isascii() else len(joined.decode())
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            lines += 1
            dup += line in seen
            seen.add(line)
    upper = len(_UPPER.findall(raw))
    return len(ws), chars, len(_SYMBOLS.findall(text)), dup, repeated_words(ws), lines, upper, len(_LETTER.findall(raw))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]
    claim({})
    for batch in byte_batches(batches):
        rows = [text_counts(t) for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        keep = [batch.column(c) for c in ("doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "lang", "source", *names])


def document_counts(docs: DataFrame) -> DataFrame:
    """The counts of every row, with its id, lang and source."""
    small_batches(docs)
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"))
    return narrow.mapInArrow(_count, f"doc_id {kind}, lang string, source string, {longs}").withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )


def chi_square(p: int, x: float) -> float:
    """Distribution function of chi-square with p degrees of freedom, by its series."""
    a, z = p / 2, x / 2
    term = total = 1 / a
    for i in range(1, 500):
        term *= z / (a + i)
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a))) if z > 0 else 0.0


def chi_square_quantile(p: int, q: float) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(p, mid) < q else (low, mid)
    return high


def shape(n: int, rows: int, sums: np.ndarray, products: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, inverse scatter and log determinant from sums over the `n` inner ones of `rows` rows; floors: least variances."""
    p = len(sums)
    inner = n / rows
    scale = inner / chi_square(p + 2, chi_square_quantile(p, inner)) if inner < 1 else 1.0  # consistent for normal vectors
    mean = sums / n
    scatter = (products / n - np.outer(mean, mean)) * scale
    spread = np.sqrt(np.maximum(np.diag(scatter), 1e-12))
    wide = np.maximum(spread, np.sqrt(floors))
    rho = np.clip(scatter / np.outer(spread, spread), -0.95, 0.95)
    np.fill_diagonal(rho, 1.0)
    full = 0.9 * rho * np.outer(wide, wide) + 0.1 * np.diag(wide**2)
    return mean, np.linalg.inv(full), float(np.linalg.slogdet(full)[1])


_PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i, len(STATS))]
_ESTIMATE = "g long, start int, n long, centre array<double>, inverse array<double>, det double"


def _shapes(floors: list[float]):
    def shaped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                products = np.zeros((len(STATS), len(STATS)))
                for (i, j), x in zip(_PAIRS, row.products):
                    products[i, j] = products[j, i] = x
                mean, inverse, det = shape(row.inside, row.n, np.asarray(row.sums, float), products, np.array(floors))
                out.append((row.g, row.start, row.n, mean.tolist(), inverse.ravel().tolist(), det))
            yield pd.DataFrame(out, columns=["g", "start", "n", "centre", "inverse", "det"])

    return shaped


def _estimates(sums: DataFrame, floors: list[float]) -> DataFrame:
    """From g, start, n, inside (rows summed), sums, products to estimates; few rows, so few tasks."""
    return cut(sums.select("g", "start", "n", "inside", "sums", "products").coalesce(8).mapInPandas(_shapes(floors), _ESTIMATE))


def _moments(n: str = "n") -> list:
    return [F.count("*").alias(n), *(F.sum(s).alias(f"s{i}") for i, s in enumerate(STATS)), *(F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{i}_{j}") for i, j in _PAIRS)]


def _arrays() -> list:
    return [F.array(*(F.col(f"s{i}") for i in range(len(STATS)))).alias("sums"), F.array(*(F.col(f"p{i}_{j}") for i, j in _PAIRS)).alias("products")]


def _d2(centre: str, inverse: str):
    """Column: the squared distance of a row's vector to an estimate."""
    gap = [F.col(s) - F.col(centre)[i] for i, s in enumerate(STATS)]
    return sum(((1 if i == j else 2) * gap[i] * gap[j] * F.col(inverse)[i * len(STATS) + j] for i, j in _PAIRS), F.lit(0.0))


def _medians(both: DataFrame) -> DataFrame:
    """Start 1: a mean that is the median and a diagonal scatter by the median absolute deviation."""
    middle = lambda parts: F.array(*(F.percentile_approx(c, 0.5) for c in parts))
    m = sized_broadcast(cut(both.groupBy("g").agg(middle(map(F.col, STATS)).alias("m"))))
    d = both.join(m, "g").groupBy("g").agg(F.count("*").alias("n"), F.first("m").alias("m"), middle(F.abs(F.col(s) - F.col("m")[i]) for i, s in enumerate(STATS)).alias("d"))
    n, m = F.col("n"), F.col("m")
    products = [n * (m[i] * m[j] + (F.pow(1.4826 * F.col("d")[i], F.lit(2.0)) if i == j else F.lit(0.0))) for i, j in _PAIRS]
    return d.select("g", F.lit(1).alias("start"), "n", F.col("n").alias("inside"), F.array(*(n * m[i] for i in range(len(STATS)))).alias("sums"), F.array(*products).alias("products"))


def _step(both: DataFrame, estimates: DataFrame, floors: list[float], inner: float) -> DataFrame:
    """The estimates of the nearest `inner` share of each group's rows under each start."""
    near = both.join(sized_broadcast(estimates.select("g", "start", "centre", "inverse")), "g")
    bins = near.withColumn("bin", F.floor(F.log2(_d2("centre", "inverse") + 1e-9) * BINS).cast("int")).groupBy("g", "start", "bin").agg(*_moments("k"))
    group = Window.partitionBy("g", "start")
    before = F.coalesce(F.sum("k").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nearest = bins.withColumn("n", F.sum("k").over(group)).withColumn("before", before).where(F.col("before") < inner * F.col("n"))
    parts = [c for c in bins.columns if c not in ("g", "start", "bin", "k")]
    sums = nearest.groupBy("g", "start").agg(F.first("n").alias("n"), F.sum("k").alias("inside"), *(F.sum(c).alias(c) for c in parts))
    return _estimates(sums.select("g", "start", "n", "inside", *_arrays()), floors)


def _statistics(counts: DataFrame, prior: float = 200.0) -> DataFrame:
    """The transformed vectors; ratios of short texts are drawn towards their group's median (word length) or 0."""
    middle = counts.where("n_words > 0").groupBy("lang", "source").agg(F.percentile_approx(F.col("word_chars") / F.col("n_words"), 0.5).alias("m"))
    c = counts.alias("c").join(sized_broadcast(middle).alias("m"), F.col("c.lang").eqNullSafe(F.col("m.lang")) & F.col("c.source").eqNullSafe(F.col("m.source")), "left").select("c.*", F.coalesce("m.m", F.lit(0.0)).alias("m"))
    n, m = F.col("n_words"), F.col("m")
    share = lambda part, whole, extra: F.sqrt(F.col(part) / (F.col(whole) + F.lit(extra)))
    noise = lambda whole, extra: 0.25 / (F.col(whole) + F.lit(extra))
    return c.select(
        "doc_id", F.xxhash64(F.col("lang").isNull(), "lang", F.col("source").isNull(), "source").alias("g"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.log1p(n).alias("f_length"),
        ((F.col("word_chars") - m * n) / (n + F.lit(prior)) * 1.0).alias("f_word"),
        share("n_symbols", "word_chars", 100.0).alias("f_symbols"),
        share("n_dup_lines", "n_lines", 5.0).alias("f_lines"),
        share("n_repeat_words", "n_words", 50.0).alias("f_repeats"),
        share("n_upper", "n_letters", 100.0).alias("f_upper"),
        (1 / (1 + n)).alias("v_length"), (m / (n + F.lit(prior))).alias("v_word"), noise("word_chars", 100.0).alias("v_symbols"), noise("n_lines", 5.0).alias("v_lines"),
        (WINDOW * noise("n_words", 50.0)).alias("v_repeats"), noise("n_letters", 100.0).alias("v_upper"),
    )


def _borrowed(borrow: float, centre: list[float], inverse: list[float]):
    """Estimates drawn towards that of all documents, by `borrow` rows of it to a group's own."""
    p = len(STATS)
    every = np.linalg.inv(np.reshape(inverse, (p, p)))

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                own = row.n / (row.n + borrow)
                scatter = own * np.linalg.inv(np.reshape(row.inverse, (p, p))) + (1 - own) * every
                out.append((row.g, (own * np.array(row.centre) + (1 - own) * np.array(centre)).tolist(), np.linalg.inv(scatter).ravel().tolist()))
            yield pd.DataFrame(out, columns=["g", "centre", "inverse"])

    return drawn


def quality_rules(docs: DataFrame, inner: float = 0.75, steps: int = 100, beyond: float = 0.999, borrow: float = 5.0 * len(STATS)) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    inner: share of rows that an estimate rests on; steps: it is an error if determinants still fall after so many;
    beyond: the quantile of chi-square past which a document is rejected; borrow: rows that the estimate of all
    documents counts for in each group's.
    """
    rows = cut(_statistics(cut(document_counts(docs))))
    fit = rows.where(~F.col("base_failed"))
    floors = [v or 1e-6 for v in fit.agg(*(F.avg(v) for v in NOISE)).first()]
    both = fit.select(*STATS, F.explode(F.array("g", F.lit(ALL).cast("long"))).alias("g"))
    plain = both.groupBy("g").agg(*_moments()).select("g", F.lit(0).alias("start"), "n", F.col("n").alias("inside"), *_arrays())
    estimates = _estimates(plain.unionByName(_medians(both)), floors)
    found: list[DataFrame] = []  # a start's determinant is none of an inner share, so the starts themselves are not among them
    for _ in range(steps):
        estimates = _step(both, estimates, floors, inner)
        found.append(estimates)
        lowest = reduce(DataFrame.unionByName, found[:-1], estimates.limit(0)).groupBy("g", "start").agg(F.min("det").alias("low"))
        fall = estimates.join(lowest, ["g", "start"]).agg(F.max(F.col("low") - F.col("det"))).first()[0]
        if len(found) > 1 and (fall or 0.0) < STILL:
            break
    else:
        raise RuntimeError(f"determinants still fall after {steps} steps")
    best = cut(reduce(DataFrame.unionByName, found).groupBy("g").agg(F.min_by(F.struct("n", "centre", "inverse"), F.struct("det", "start")).alias("e")).select("g", "e.*").coalesce(8))
    every = best.where(F.col("g") == ALL).first()
    pooled = lambda c: F.array(*map(F.lit, every[c])) if every else F.lit(None).cast("array<double>")
    own = cut(best.mapInPandas(_borrowed(borrow, every["centre"], every["inverse"]), "g long, centre array<double>, inverse array<double>")) if every else best.select("g", "centre", "inverse")
    judged = rows.join(sized_broadcast(own), "g", "left").withColumn("centre", F.coalesce("centre", pooled("centre"))).withColumn("inverse", F.coalesce("inverse", pooled("inverse")))
    judged = judged.withColumn("distance", _d2("centre", "inverse"))
    far = F.coalesce(F.col("distance") > chi_square_quantile(len(STATS), beyond), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "distance")


def keep_clean(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that quality_rules() keeps; a doc_id with several rows goes with all of them if one is rejected."""
    return without(docs, quality_rules(judged_rows(docs), **how).where(~F.col("kept")))
