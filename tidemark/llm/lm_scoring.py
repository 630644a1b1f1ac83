"""Operator 2: scores of whole documents by a gated recurrent language model.

Corpus part, over all training documents: the count of every word (hashed to 64 bits; each task counts its own,
counts are summed by word). The words counted most, KNOWN at most, are sent to all workers with their counts; the
`vocabulary` most frequent of them are the model's words. All others are one `unknown` word to the model, and the
probability of a word given `unknown` is (c + 0.5) over the sum of that for all words outside the vocabulary and one
unseen word. Rare words, which are not sent, meet their counts by a join on the word.

Model part: a gated recurrent model (gated_model) is trained on all training documents, every token once (a corpus of
fewer than `least_tokens` is passed over up to four times). They are dealt to shards as ranks of their words, and each
pass to `rounds` rounds: in a round every shard trains on its part from the same parameters, and a tree of tasks
averages them (SUMS of its means come to the driver). A shard has about `shard_tokens` tokens on SLOTS slots; larger
corpora have up to SLOTS_MOST slots and shards as many times longer, so a shard's number of steps stays and numpy is
called less often a token. In training, texts of over 2,048 tokens are cut; in scoring the state is carried through
whole texts.

Defined cases: null text is empty and has the end token alone; without training documents every count is 0 and the
model is that of the end token and `unknown`; a long text is laid on one slot and its state carried to its end; words
of equal counts take their ranks by hash; every row gives a row, repeated rows too; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import gated_model
from tidemark.llm.common import byte_batches, claim, distinct_words, fold, gathered, memory, numbered_words, small_batches
from tidemark.session import cut

#: Words whose counts are sent to all workers, at most.
KNOWN = 1 << 18
#: Bytes of text that are laid on slots together.
LAY_BYTES = 20 << 20
#: Sums of shards' parameters that the driver gets, and that a task of the tree of sums takes.
SUMS, BRANCH = 8, 16
MEMO_WORDS = 400_000
#: Slots that a shard trains together in small and in large corpora; one more for each so many tokens.
SLOTS, SLOTS_MOST, SLOT_TOKENS = 16, 192, 500_000
#: What a worker remembers of words, for one lexicon.
_held: dict = memory()


def _hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 5)
    return h - (1 << 64) if h >> 63 else h


def word_counts(texts: DataFrame) -> DataFrame:
    """word (its hash) and n over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        claim({})

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(map(_hash, held), pa.int64()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in byte_batches(batches):
            own, _ = numbered_words(batch.column("text"))
            for word, n in zip(distinct_words(own), np.bincount(own.indices, minlength=len(own.dictionary)).tolist()):
                held[word] = held.get(word, 0) + n
            if len(held) > MEMO_WORDS:
                yield out()
        yield out()

    return texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """The known words' hashes (ascending), counts and ranks in the model (-1: outside its vocabulary)."""

    def __init__(self, known: pd.DataFrame, documents: int, tokens: int, distinct: int, vocabulary: int):
        known = known.sort_values("word")
        self.word, self.n = known["word"].to_numpy(np.int64), known["n"].to_numpy(np.int64)
        self.tokens, self.distinct, self.documents = tokens, distinct, documents
        top = np.lexsort((self.word, -self.n))[:vocabulary]
        inside = int(self.n[top].sum()) + documents
        self.out_tokens, self.out_distinct = tokens - inside, max(0, distinct - len(top) - (documents > 0))
        counts = np.concatenate((self.n[top], [documents, max(self.out_tokens, 1)])).astype(float)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.counts, self.end, self.unknown = counts[order], int(rank[-2]), int(rank[-1])
        self.rank = np.full(len(self.word), -1)
        self.rank[top] = rank[: len(top)]
        self.mark = uuid.uuid4().hex

    def base_total(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def out_total(self) -> float:
        return self.out_tokens + 0.5 * (self.out_distinct + 1)

    def look_up(self, words: list[bytes]) -> list[np.ndarray]:
        """Of each word its hash, rank in the model, and log10(c + 0.5) or nan where the count must be joined."""
        h = np.array(list(map(_hash, words)), np.int64)
        at = np.minimum(np.searchsorted(self.word, h), max(len(self.word) - 1, 0))
        here = self.word[at] == h if len(self.word) else np.zeros(len(h), bool)
        at = at[here]
        rank, log = np.full(len(h), self.unknown, np.int32), np.full(len(h), np.nan)
        rank[here] = np.where(self.rank[at] >= 0, self.rank[at], self.unknown)
        log[here] = np.log10(self.n[at] + 0.5)
        return [h, rank, log]

    def read(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text the ranks (with the end), log10(c + 0.5) of the words, hashes.

        Words are numbered as they come; the numbers of the first MEMO_WORDS are remembered with what they mean.
        """
        claim(_held)
        if _held.get("of") != self.mark:
            _held.clear()
            _held.update(of=self.mark, memo={}, table=self.look_up([]))
        memo, table = _held["memo"], _held["table"]
        held = len(memo)
        words, sizes = numbered_words(texts)
        own = distinct_words(words)
        ids = list(map(memo.get, own))
        fresh: dict[bytes, int] = {}
        if None in ids:
            for i, k in enumerate(ids):
                if k is None:
                    ids[i] = fresh.setdefault(own[i], held + len(fresh))
        if fresh:
            table = [np.concatenate(p) for p in zip(table, self.look_up(list(fresh)))]
        if held + len(fresh) <= MEMO_WORDS:
            _held["table"] = table
            memo.update(fresh)
        at, numbers = words.indices.to_numpy(), np.array(ids, np.int64)
        h, rank, log = (t[numbers][at] for t in table)
        ends = np.cumsum(sizes).tolist()
        cuts = [slice(z - n, z) for z, n in zip(ends, sizes.tolist())]
        return [(np.append(rank[k], np.int32(self.end)), log[k], h[k]) for k in cuts]


def lexicon(counts: DataFrame, documents: int, vocabulary: int) -> Lexicon:
    """The words of the highest counts, whole levels of counts, at most KNOWN words."""
    level = F.floor(F.log2("n") * 64).cast("int")
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect()
    held, least = 0, None
    for r in levels:
        if held + r.k > KNOWN:
            break
        held, least = held + r.k, r.level
    known = counts.where(level >= least).toPandas() if least is not None else pd.DataFrame({"word": [], "n": []})
    return Lexicon(known, documents, (totals[0] or 0) + documents, totals[1] + (documents > 0), vocabulary)


def slots_of(tokens: int) -> int:
    """How many slots a shard of a corpus of so many tokens trains together."""
    return max(SLOTS, min(SLOTS_MOST, tokens // SLOT_TOKENS))


def fit(sample: DataFrame, lex, shards: int, rounds: int, passes: int) -> dict[str, np.ndarray]:
    """Passes over the sample in rounds, each followed by averaging over shards, weighted by tokens."""
    context = sample.sparkSession.sparkContext
    model = gated_model.new_model(lex.value.counts)
    names = [k for k in model if k != "edges"]
    most = slots_of(lex.value.tokens)
    lot = F.xxhash64("text", "doc_id")
    kind = np.dtype("<u2" if len(lex.value.counts) <= 1 << 16 else "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches):
            ranks = [r.astype(kind).tobytes() for r, _, _ in lex.value.read(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.binary()), batch.column("shard"), batch.column("round")], names=["ranks", "shard", "round"])

    dealt = sample.select("text", F.pmod(lot, F.lit(shards)).cast("int").alias("shard"), F.pmod(F.shiftrightunsigned(lot, 20), F.lit(rounds)).cast("int").alias("round"))
    dealt = cut(dealt.mapInArrow(encode, "ranks binary, shard int, round int").repartitionById(shards, F.col("shard")))
    for turn in range(passes * rounds):
        sent = context.broadcast(model)

        def pass_over(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            texts = gated_model.segments([np.frombuffer(r, kind).astype(np.int32) for b in batches for r in b.column("ranks").to_pylist()])
            if texts:
                got = gated_model.train(sent.value, texts, most)
                n = sum(map(len, texts))
                flat = np.concatenate([got[k].ravel() for k in names]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([int(texts[0][0]) * 31 + n], pa.int64()), pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["key", "n", "flat"])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = n = 0
            total = None
            for batch in batches:
                for name, k, raw in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), batch.column("flat")):
                    flat = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64) * k
                    key, n, total = key ^ name, n + k, flat if total is None else total + flat
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["key", "n", "flat"])

        shape = "key long, n long, flat binary"
        sums, width = dealt.where(F.col("round") == turn % rounds).select("ranks").mapInArrow(pass_over, shape), shards
        while True:  # a tree: each level's tasks take some BRANCH means each, however many shards there are
            width = max(SUMS, -(-width // BRANCH))
            sums = sums.repartition(width, "key").mapInArrow(add_up, shape)
            if width == SUMS:
                break
        parts = sums.collect()
        sent.destroy()
        if not parts:
            continue
        weight = np.array([p.n for p in parts], float) / sum(p.n for p in parts)
        flat = sum(w * np.frombuffer(p.flat, np.float32) for w, p in zip(weight, parts)).astype(np.float32)
        at = 0
        for k in names:
            model[k] = flat[at : at + model[k].size].reshape(model[k].shape)
            at += model[k].size
    return model


def lm_scoring(docs: DataFrame, folds: int = 5, held: int = 1, vocabulary: int = 4_096, least_tokens: int = 6_000_000, shard_tokens: int = 250_000, rounds: int = 4) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    small_batches(docs)
    context = docs.sparkSession.sparkContext
    narrow = docs.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    training = narrow.where(~F.col("held_out"))
    documents = training.count()
    counts = cut(word_counts(training))
    found = lexicon(counts, documents, vocabulary)
    lex = context.broadcast(found)
    shard_tokens = shard_tokens * slots_of(found.tokens) // SLOTS
    rounds = max(1, min(rounds, math.ceil(found.tokens / shard_tokens)))
    shards = max(1, math.ceil(found.tokens / rounds / shard_tokens))
    passes = max(1, min(4, math.ceil(least_tokens / max(found.tokens, 1))))
    model = context.broadcast(fit(training, lex, shards, rounds, passes))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, LAY_BYTES):
            read = [r for part in byte_batches([batch]) for r in lex.value.read(part.column("text"))]
            got = gated_model.score(model.value, [r for r, _, _ in read]) / math.log(10)
            rows = []
            for ranks, log, h in read:
                rare, out = np.isnan(log), ranks[:-1] == lex.value.unknown
                rows.append((len(ranks), int((~rare).sum()) + (lex.value.documents > 0), int(out.sum()), float(log[~rare].sum()) + math.log10(lex.value.documents + 0.5), float(log[out & ~rare].sum()), h[rare]))
            tokens, known, out, base, inner, rare = zip(*rows)
            longs = [pa.array(c, pa.int64()) for c in (tokens, known, out)]
            reals = [pa.array(c, pa.float64()) for c in (got, base, inner)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *longs, *reals, pa.array(rare, pa.list_(pa.int64()))], names=["doc_id", "held_out", "n_tokens", "n_known", "n_out", "model", "base", "inner", "rare"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    scored = narrow.mapInArrow(judge, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, n_out long, model double, base double, inner double, rare array<long>")
    scored = cut(scored.withColumn("_row", F.monotonically_increasing_id()))
    rare = scored.select("_row", F.explode("rare").alias("word")).groupBy("_row", "word").agg(F.count("*").alias("k"))
    met = rare.join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("met")
    )
    more, met_n = F.coalesce("more", F.lit(0.0)), F.coalesce("met", F.lit(0))
    base = F.col("base") + more - F.col("n_tokens") * math.log10(found.base_total())
    return scored.join(met, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + met_n).alias("n_known"), F.lit(found.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("model") + F.col("inner") + more - F.col("n_out") * math.log10(found.out_total())).alias("score"),
    )
