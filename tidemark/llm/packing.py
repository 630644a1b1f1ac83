"""Operator 3: best-fit packing by a configuration linear program over the length histogram.

Documents are encoded, ended by one id and cut into pieces of at most `capacity` tokens. The number of pieces of
each length (at most `capacity` numbers, whatever the corpus) is all that the driver sees. The linear program
(least number of sequences, each filled by a configuration of lengths, that cover the histogram) is solved by
multiplicative weights: the weight of a length falls as it is covered, and the configurations worth most at these
weights are found by a knapsack dynamic program. Rounding keeps whole copies, and the program is solved again for the
pieces that rounding leaves, at every size of the input; the last few pieces are filled by the same dynamic program,
largest first. The outcome, for each length, is a short list of runs of places; pieces are numbered within their
length by Spark, and the number gives sequence and offset by arithmetic.

Defined cases: null or empty text is one piece of the end id alone; every row is packed, repeated rows too; a long text
is encoded whole, alone in its batch; pieces of one length are interchangeable, and ties among them go by doc_id, piece
and ids; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, claim, memory, small_batches
from tidemark.session import cut, sized_broadcast

#: Distinct chunks whose ids a worker remembers.
MEMO_CHUNKS = 300_000
#: Fixed value: how byte-level encodings of this kind part texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Power of a length that is its first weight: over 1, few long pieces are worth more than many short ones, which stay for later.
LARGE_FIRST = 1.2
_BOUNDARY = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?!\S)|\s\n")


class ChunkEncoder:
    """Encodes with a byte-level tokenizer whose words take the space before them.

    A space before a character that is no white space always starts a new word of such a tokenizer, and so does a
    newline after one, so texts are cut there and each chunk encodes alone as it does inside its text (texts with
    longer runs of white space are cut before words alone). The ids of a chunk are remembered while there is room.

    New chunks are encoded by `tiktoken`, which is faster, with the ranks that the tokenizer's own file gives: where
    tokens are numbered as they are merged, both libraries merge alike. Files that are not so, and texts that hold a
    special token, are left to `tokenizers`.
    """

    def __init__(self, path: str):
        self.path = path
        self.memo: dict[str, bytes] = memory()
        with open(path) as file:
            told = json.load(file)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.fast = self.ranked(told)

    @cached_property
    def library(self):
        """The tokenizer itself, loaded when a text needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    @staticmethod
    def ranked(told: dict):
        """A tiktoken encoding of the file's vocabulary, or None where the file doesn't allow it."""
        import tiktoken

        model, before = told["model"], told["pre_tokenizer"] or {}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        first = len(model["vocab"]) - len(pairs) - sum(t["content"] in model["vocab"] for t in told["added_tokens"])
        plain = told["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if not plain or any(model["vocab"][a + b] != first + i for i, (a, b) in enumerate(pairs)):
            return None
        shown = [c for c in range(256) if chr(c).isprintable() and c not in (32, 173)]  # bytes written as themselves
        other = [c for c in range(256) if c not in shown]
        byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(other)}
        special = {t["content"] for t in told["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, strings: list[str]) -> list[bytes]:
        if self.fast is None or any(s in t for s in self.special for t in strings):
            return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]
        return [array("I", self.fast.encode_ordinary(t)).tobytes() for t in strings]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        parts = [t.replace("\n", " \n").split(" ") if _ODD.search(t) is None else _BOUNDARY.split(t) for t in texts]
        heads = self.ids([p[0] for p in parts])
        known = [list(map(self.memo.get, p)) for p in parts]
        fresh = list({c for p, k in zip(parts, known) if None in k for c, ids in zip(p[1:], k[1:]) if ids is None})
        found: dict[str, bytes] = {}
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            found.update(zip(part, self.ids([c if c[:1] == "\n" else " " + c for c in part])))
        out = []
        for h, p, k in zip(heads, parts, known):
            ids = [found.get(c, b"") if i is None else i for i, c in zip(k, p)] if None in k else k
            ids[0] = h
            out.append(b"".join(ids))
        if len(self.memo) < MEMO_CHUNKS:
            self.memo.update(found)
        return out


_encoders: dict[str, ChunkEncoder] = {}


def spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones, after a first piece with the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece."""
    small_batches(docs)
    last = np.array([end], "<u4").tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = ChunkEncoder(tokenizer_path)
        claim(_encoders[tokenizer_path].memo)
        for batch in byte_batches(batches):
            rows, ids = [], []
            encoded = _encoders[tokenizer_path].encode([t or "" for t in batch.column("text").to_pylist()])
            for i, raw in enumerate(encoded):
                raw += last
                for k, (start, length) in enumerate(spans(len(raw) // 4, capacity)):
                    part = raw[4 * start : 4 * (start + length)]
                    rows.append((i, k, start, length, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            at, piece, start, length, crc = zip(*rows)
            columns = [batch.column("doc_id").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(split, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def price(worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack dynamic program: what the best filling of each room is worth, and a length that it takes (0: it leaves one place)."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    offered = np.flatnonzero(worth[: capacity + 1] > 0)
    if not len(offered):
        return best, choice
    value, fitting = worth[offered], np.searchsorted(offered, np.arange(capacity + 1), "right")
    for room in range(int(offered[0]), capacity + 1):
        k = fitting[room]
        got = value[:k] + best[room - offered[:k]]
        j = got.argmax()
        best[room], choice[room] = (got[j], offered[j]) if got[j] > best[room - 1] + 1e-12 else (best[room - 1], 0)
    return best, choice


def filling(choice: np.ndarray, room: int) -> list[int]:
    """The lengths that fill a room best."""
    out = []
    while room > 0:
        if choice[room]:
            out.append(int(choice[room]))
        room -= int(choice[room]) or 1
    return out


def program(demand: np.ndarray, capacity: int, rounds: int = 120, step: float = 0.34, rate: float = 2e-3, slack: float = 2e-3) -> tuple[dict[tuple, float], float]:
    """Fractional use of configurations that covers `demand` (pieces of each length), and a lower bound of the sequences.

    A length's weight starts at a power of its size and falls as its cover rises over the mean: multiplicative weights. At these
    weights the knapsack program prices the best configuration with each length; those within `slack` of the best of
    all are used, so that no cover rises by more than about `step` in a round or over 1. Rounds end when every
    length is covered or no configuration is used any more.
    """
    sizes, there = (np.arange(capacity + 1) / capacity) ** LARGE_FIRST, demand > 0
    cover, used = np.zeros(capacity + 1), defaultdict(float)
    bound = float((demand * np.arange(capacity + 1)).sum() / capacity)  # sizes are a dual solution, too
    for k in range(rounds):
        open_ = there & (cover < 1 - 1e-9)
        if not open_.any():
            break
        weight = np.where(there, sizes * np.exp(-rate * np.clip((cover - cover[there].mean()) / step, -40, 40)), 0.0)
        if k % 20 == 0:  # weights under which no configuration is worth more than 1 are a dual solution
            bound = max(bound, float((demand * weight).sum() / price(weight, capacity)[0][capacity]))
        worth = np.where(open_, weight, 0.0)
        best, choice = price(worth, capacity)
        free, want = np.minimum(1.5 * step, 1 - cover) * demand, np.minimum(step, 1 - cover) * demand
        moved = False
        for length in np.flatnonzero(open_)[::-1].tolist():
            if want[length] <= 1e-9 or worth[length] + best[capacity - length] < (1 - slack) * best[capacity]:
                continue
            config = Counter([length, *filling(choice, capacity - length)])
            amount = min(want[length] / config[length], *(free[a] / n for a, n in config.items()))
            if amount > 1e-9:
                moved = True
                used[tuple(sorted(config.items(), reverse=True))] += amount
                for a, n in config.items():
                    free[a] -= amount * n
                    want[a] -= amount * n
                    cover[a] += amount * n / demand[a]
        if not moved:
            break
    return used, bound


def solve(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Configurations (length -> copies) and how often each is used, and how many of these sequences the program gave.

    Together the configurations hold the histogram exactly. A solution of the program is rounded by carrying
    fractions from configuration to configuration, largest lengths first, as far as pieces are left; the program
    is solved anew for what rounding leaves, as long as that places pieces. Whatever remains, fewer pieces than
    lengths as a rule, is filled from the largest length down, the rest of each sequence by the knapsack program.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan: list[tuple[dict[int, int], int]] = []

    def use(config: dict[int, int], times: int) -> None:
        plan.append((config, times))
        for length, copies in config.items():
            left[length] -= copies * times

    if left[capacity]:
        use({capacity: 1}, int(left[capacity]))
    while left.any():
        before, carry = int(left.sum()), 0.0
        used, _ = program(left.copy(), capacity)
        for config, amount in sorted(used.items(), key=lambda x: (-x[0][0][0], -x[1], x[0])):
            carry += amount
            times = min(int(carry + 1e-6), *(int(left[a]) // n for a, n in config))
            if times > 0:
                carry -= times
                use(dict(config), times)
        if before == int(left.sum()):
            break
    placed = sum(times for _, times in plan)
    sizes = (np.arange(capacity + 1) / capacity) ** LARGE_FIRST
    while left.any():
        large = int(np.flatnonzero(left)[-1])
        config, room = Counter([large]), capacity - large
        left[large] -= 1
        _, choice = price(np.where(left > 0, sizes, 0.0), room)
        for length in sorted(filling(choice, room), reverse=True):
            if left[length] > config[length] - (length == large):
                config[length] += 1
                room -= length
        while True:
            fits = [a for a in np.flatnonzero(left[: room + 1]).tolist() if left[a] > config[a] - (a == large)]
            if not fits:
                break
            config[fits[-1]] += 1
            room -= fits[-1]
        left[large] += 1
        use(dict(config), max(1, int(min(left[a] // n for a, n in config.items()))))
    return plan, placed


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length its runs of places: first number, first sequence, copies in a sequence, offset of the first copy."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    given: dict[int, int] = defaultdict(int)
    sequence = 0
    for config, times in plan:
        offset = 0
        for length, copies in config.items():
            runs[length].append((given[length], sequence, copies, offset))
            given[length] += copies * times
            offset += copies * length
        sequence += times
    return {length: np.array(r, np.int64) for length, r in runs.items()}


def pack(cut_pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces with sequence_id and offset; cut_pieces should be cheap to read twice or more."""
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = cut_pieces.sparkSession.sparkContext.broadcast(places(solve(histogram, capacity)[0]))
    shares = max(16, sum(histogram.values()) // 20_000)
    dealt = cut_pieces.withColumn("_share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)))
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("length", "_share").agg(F.count("*").alias("_n")).select("length", "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_share").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = dealt.withColumn("_number", F.row_number().over(within).cast("long")).join(sized_broadcast(first), ["length", "_share"])
    numbered = numbered.select(*cut_pieces.columns, (F.col("_first") + F.col("_number") - 1).alias("_number"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            number, length = frame.pop("_number").to_numpy(), frame["length"].to_numpy()
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for one in np.unique(length):
                rows, run = np.flatnonzero(length == one), runs.value[int(one)]
                r = run[np.searchsorted(run[:, 0], number[rows], "right") - 1]
                k = number[rows] - r[:, 0]
                sequence[rows], offset[rows] = r[:, 1] + k // r[:, 2], r[:, 3] + k % r[:, 2] * one
            yield frame.assign(sequence_id=sequence, offset=offset)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema)
    return numbered.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(pieces(docs, tokenizer_path, capacity, end)), capacity)
