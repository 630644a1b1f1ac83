"""Operator 7: quality by the perplexity of an interpolated modified Kneser-Ney model trained on trusted text.

The model is one of pairs of tokens. Tokens are the words of at most LONGEST_WORD bytes that trusted text holds twice
or more, at most `words` of them (the most frequent ones; a parameter of the model, as a subword vocabulary is), and
the bytes of all other words, each with a mark after its last one, so that no word of any alphabet is unknown; every
text ends with a mark.

Counts and documents meet in shards by pair of tokens. Each task counts the pairs of its trusted texts and sends one
block to each shard, where counts are summed; statistics of single tokens (bounded by the vocabulary) are summed over
the shards and sent to all tasks. Then each task sends the pairs of its documents, a chunk of them at a time, in
blocks to the same shards, which look them up and send each chunk one block of partial sums, to be added where the
chunk's documents are named. A block holds sorted differences of mixed pair numbers by byte planes, compressed, so a
pair takes three to four bytes of shuffle; mixing spreads frequent pairs evenly, and each task sends a pair once a
document.

A trusted document is scored without its own counts of pairs, so that thresholds hold for text that the model hasn't
seen. A document's mean negative log probability of a word is drawn towards its language's median with the weight of
`prior` words, so that short texts don't fail by chance, and must not exceed the `quantile` of the trusted documents
of its language (of all trusted documents, for a language without any; all documents of any language, without any
trusted ones). Defined cases: text that is null or has no word has null perplexity and is not kept; a very long text is
one chunk of its own; of equal counts the words first in byte order enter the vocabulary; null lang is a language
of its own; every row gives a row, equal rows equal ones; perplexity is Infinity past the range of a double; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MOST_IDS, byte_batches, claim, gathered, memory, small_batches
from tidemark.session import cut, sized_broadcast

#: Tokens 0 to 253 are bytes (UTF-8 has no higher one), then the end of a text, the end of a spelled word, and words.
END, STOP, FIRST = 254, 255, 256
TOKEN_BITS, ROW_BITS = 18, 28
WORDS = (1 << TOKEN_BITS) - FIRST
_PAIR = np.uint64((1 << 2 * TOKEN_BITS) - 1)
_MIX = 0x9E3779B97
_UNMIX = np.uint64(pow(_MIX, -1, 1 << 2 * TOKEN_BITS))
#: Bytes of the longest word that the vocabulary takes: it goes to all tasks, so it is bounded in bytes too.
LONGEST_WORD = 64
#: Bytes of text whose pairs are put into blocks at once; different words that a task counts before it sends them on.
CHUNK, HELD_WORDS = 4 << 20, 300_000
#: Of each token: its count as the first of a pair, how many pairs it begins that occur 1, 2, 3, 4 and more times, how many it ends.
_FACTS, _SLICE = 7, 1024
_held = memory()
#: A level that finds the best matches: a tenth less to shuffle than at the least one.
_SHRINK = pa.Codec("zstd", compression_level=16)


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, compressed."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return _SHRINK.compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpacked(block: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(block, decompressed_size=8 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def lookup(sent: tuple[str, bytes]) -> Callable[..., int]:
    """The numbers of words, built once in a worker; the mark between words is the end of a text."""
    claim(_held)
    mark, joined = sent
    if _held.get("of") != mark:
        _held.clear()
        _held.update(of=mark, ids=dict(zip(joined.split(b"\n"), range(FIRST, FIRST + WORDS))) if joined else {})
        _held["ids"][b"\n"] = END
    return _held["ids"].get


def pairs(texts: list[str], get: Callable[..., int]) -> tuple[np.ndarray, np.ndarray]:
    """Mixed numbers of (token before, token) of every token of the texts, and the places of their texts."""
    ws: list[bytes] = []
    sizes = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        start = len(ws)
        ws += text.encode().split()
        ws.append(b"\n")
        sizes[i] = len(ws) - start
    ids = np.array(list(map(get, ws, repeat(-1))), np.int64)
    spell = ids < 0
    spelled = [ws[i] for i in np.flatnonzero(spell)]
    room = np.ones(len(ws), np.int64)
    room[spell] = [len(w) + 1 for w in spelled]
    inside = np.repeat(spell, room)
    token = np.empty(len(inside), np.uint64)
    token[inside] = np.frombuffer(b"\xff".join([*spelled, b""]), np.uint8)
    token[~inside] = ids[~spell]
    before = np.concatenate((np.array([END], np.uint64), token[:-1]))
    mixed = ((before << np.uint64(TOKEN_BITS) | token) * np.uint64(_MIX)) & _PAIR
    return mixed, np.repeat(np.repeat(np.arange(len(texts)), sizes), room)


def unmixed(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = (mixed * _UNMIX) & _PAIR
    return (pair >> np.uint64(TOKEN_BITS)).astype(np.int64), (pair & np.uint64((1 << TOKEN_BITS) - 1)).astype(np.int64)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin, and their lengths."""
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(ordered)))


def _parts(mixed: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Shards that ascending mixed numbers fall into, with their places."""
    shift = np.uint64(2 * TOKEN_BITS) - np.uint64(shards.bit_length() - 1)
    begin, size = _runs(mixed >> shift)
    for b, n in zip(begin.tolist(), size.tolist()):
        yield int(mixed[b] >> shift), slice(b, b + n)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema.names), schema.types)], schema=schema)


#: kind 0: counts of pairs. 1: pairs asked for (places: twice the document's place in its chunk, and 1 for a trusted one).
#: 2: on the way to the chunk's sums, keys: names, ns: words of its documents. places of a sum: partial losses.
_BLOCK = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()), ("ns", pa.binary()), ("chunk", pa.int64()), ("docs", pa.int64()), ("places", pa.binary())])
_BLOCK_SQL = "shard int, kind int, size long, keys binary, ns binary, chunk long, docs long, places binary"
_SUM = pa.schema([("chunk", pa.int64()), ("docs", pa.int64()), ("names", pa.binary()), ("words", pa.binary()), ("losses", pa.binary())])
_SUM_SQL = "chunk long, docs long, names binary, words binary, losses binary"


def _block(shard: int, kind: int, mixed: np.ndarray, n: np.ndarray, chunk: int | None = None, docs: int | None = None, places: np.ndarray | None = None) -> tuple:
    steps = np.diff(mixed, prepend=np.uint64(0))
    return shard, kind, len(mixed), packed(steps), packed(n), chunk, docs, None if places is None else packed(places)


def vocabulary(texts: DataFrame, words: int, slices: int) -> list[bytes]:
    """The most frequent words that texts hold twice or more; counts meet in slices of the words, as sorted blocks."""
    schema = pa.schema([("slice", pa.int32()), ("words", pa.binary()), ("size", pa.int64()), ("ns", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def blocks() -> pa.RecordBatch:
            parts: list[list[bytes]] = [[] for _ in range(slices)]
            for word in sorted(held):
                parts[zlib.crc32(word) % slices].append(word)
            rows = [(i, zlib.compress(b"\n".join(ws), 6), len(ws), packed(np.array([held[w] for w in ws]))) for i, ws in enumerate(parts) if ws]
            held.clear()
            return _table(rows, schema)

        claim({})
        for batch in byte_batches(batches):
            for text in batch.column("text").to_pylist():
                held.update(text.encode().split())
            for word in [w for w in held if len(w) > LONGEST_WORD]:
                del held[word]
            if len(held) > HELD_WORDS:
                yield blocks()
        yield blocks()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        at = None

        def out() -> pa.RecordBatch:
            often = [(w, n) for w, n in held.items() if n > 1]
            held.clear()
            return _table(often, pa.schema([("word", pa.binary()), ("n", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                if row["slice"] != at:
                    yield out()
                    at = row["slice"]
                for word, n in zip(zlib.decompress(row["words"]).split(b"\n"), unpacked(row["ns"], row["size"]).tolist()):
                    held[word] += n
        yield out()

    sent = texts.select("text").mapInArrow(count, "slice int, words binary, size long, ns binary")
    counted = sent.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(merge, "word binary, n long")
    return counted.orderBy(F.desc("n"), "word").limit(words).select("word").toArrow().column("word").to_pylist()


def counts(texts: DataFrame, sent, shards: int) -> DataFrame:
    """The summed counts of all pairs of the texts: blocks of kind 0, one or more a shard, no pair in two of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = lookup(sent.value)
        for batch in gathered(batches, CHUNK):
            mixed = np.sort(pairs(batch.column("text").to_pylist(), get)[0])
            begin, n = _runs(mixed)
            mixed = mixed[begin]
            yield _table([_block(s, 0, mixed[at], n[at]) for s, at in _parts(mixed, shards)], _BLOCK)

    def add(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        mixed, n = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(mixed, kind="stable")
        begin, _ = _runs(mixed[order])
        return [(mixed[order][begin], np.add.reduceat(n[order], begin))]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        shard, fresh = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["shard"] != shard:
                    yield _table([_block(shard, 0, *add(held)[0])], _BLOCK)
                    held, fresh = [], 0
                shard = row["shard"]
                held.append((np.cumsum(unpacked(row["keys"], row["size"]), dtype=np.uint64), unpacked(row["ns"], row["size"])))
                fresh += row["size"]
                if fresh > max(1 << 22, len(held[0][0])):
                    held, fresh = add(held), 0
        if held:
            yield _table([_block(shard, 0, *add(held)[0])], _BLOCK)

    blocks = texts.select("text").mapInArrow(count, _BLOCK_SQL)
    return cut(blocks.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(merge, _BLOCK_SQL))


def facts(model: DataFrame, tokens: int) -> np.ndarray:
    """_FACTS of every token, summed over all shards by slices of tokens; bounded by the vocabulary."""
    schema = pa.schema([("slice", pa.int32()), ("facts", pa.binary())])
    slices = -(-tokens // _SLICE)

    def rows(total: np.ndarray) -> pa.RecordBatch:
        flat = total.reshape(slices, -1)
        return _table([(i, packed(flat[i])) for i in np.flatnonzero(flat.any(1)).tolist()], schema)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((slices * _SLICE, _FACTS), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                n = unpacked(row["ns"], row["size"]).astype(np.int64)
                v, w = unmixed(np.cumsum(unpacked(row["keys"], row["size"]), dtype=np.uint64))
                np.add.at(total, (v, 0), n)
                np.add.at(total, (v, np.minimum(n, 5)), 1)
                np.add.at(total, (w, 6), 1)
        yield rows(total)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((slices, _SLICE * _FACTS), np.int64)
        for batch in batches:
            for i, block in zip(batch.column("slice").to_pylist(), batch.column("facts").to_pylist()):
                total[i] += unpacked(block, total.shape[1]).astype(np.int64)
        yield rows(total)

    summed = model.mapInArrow(one, "slice int, facts binary").repartition("slice").mapInArrow(together, "slice int, facts binary").toArrow()
    total = np.zeros((slices, _SLICE * _FACTS), np.int64)
    for i, block in zip(summed.column("slice").to_pylist(), summed.column("facts").to_pylist()):
        total[i] = unpacked(block, total.shape[1])
    return total.reshape(-1, _FACTS)[:tokens]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken from counts of 0, 1, 2, 3 and more, held within bounds where few counts of counts are known."""
    n1, n2, n3, n4 = (max(int(n), 1) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.1, 0.2, 0.3], [0, 0.9, 1.8, 2.7])


def kneser_ney(facts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token its count before others, the weight it leaves to single tokens, its probability alone; the discounts of pairs."""
    total, ends = facts[:, 0], facts[:, 6]
    alone = discounts(*((ends == k).sum() for k in (1, 2, 3, 4)))
    taken = alone[np.minimum(ends, 3)]
    every = max(int(ends.sum()), 1)
    single = (ends - taken) / every + (taken.sum() / every if ends.any() else 1.0) / len(facts)
    of_pairs = discounts(*(facts[:, k].sum() for k in (1, 2, 3, 4)))
    left = of_pairs[1] * facts[:, 1] + of_pairs[2] * facts[:, 2] + of_pairs[3] * facts[:, 3:6].sum(1)
    return total, np.where(total > 0, left / np.maximum(total, 1), 1.0), single, of_pairs


def losses(docs: DataFrame, model: DataFrame, words, known, shards: int) -> DataFrame:
    """name, loss, n_words of every different name: negative log probability and words (docs: name, text, own)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = lookup(words.value)
        for batch in gathered(batches, CHUNK):
            texts = batch.column("text").to_pylist()
            names = batch.column("name").to_numpy(zero_copy_only=False)
            chunk = int.from_bytes(hashlib.blake2b(names.tobytes(), digest_size=8).digest(), "little", signed=True)
            own = batch.column("own").to_numpy(zero_copy_only=False).astype(np.uint64)
            mixed, place = pairs(texts, get)
            both = np.sort(mixed << np.uint64(ROW_BITS) | place.astype(np.uint64))
            begin, n = _runs(both)
            both = both[begin]
            mixed, place = both >> np.uint64(ROW_BITS), both & np.uint64((1 << ROW_BITS) - 1)
            _, w = unmixed(mixed)
            spoken = np.bincount(place.astype(np.int64), n * ((w >= FIRST) | (w == STOP)), len(names)).astype(np.int64)
            yield _table([(-1 - chunk % shards, 2, len(names), names.tobytes(), packed(spoken), chunk, len(names), None)], _BLOCK)
            place = place * np.uint64(2) + own[place.astype(np.int64)]
            for s, at in _parts(mixed, shards):
                yield _table([_block(s, 1, mixed[at], n[at], chunk, len(names), place[at])], _BLOCK)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, left, single, taken = known.value
        shard, keys, seen = None, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 2:
                    yield _table([(row["chunk"], row["docs"], row["keys"], row["ns"], None)], _SUM)
                    continue
                if row["shard"] != shard:
                    shard, keys, seen = row["shard"], np.zeros(0, np.uint64), np.zeros(0, np.uint32)
                mixed, n = np.cumsum(unpacked(row["keys"], row["size"]), dtype=np.uint64), unpacked(row["ns"], row["size"]).astype(np.int64)
                if row["kind"] == 0:  # the shard's one block of counts comes first
                    keys, seen = mixed, n
                    continue
                place = unpacked(row["places"], row["size"]).astype(np.int64)
                count = np.zeros(len(mixed), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, mixed), len(keys) - 1)
                    count = np.where(keys[at] == mixed, seen[at], 0)
                count = np.maximum(count - n * (place & 1), 0)
                v, w = unmixed(mixed)
                p = (count - taken[np.minimum(count, 3)]) / np.maximum(total[v], 1) + left[v] * single[w]
                loss = np.bincount(place >> 1, -n * np.log(p), row["docs"]).astype(np.float32)
                yield _table([(row["chunk"], row["docs"], None, None, packed(loss.view(np.uint32)))], _SUM)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total, names, spoken, times = None, None, None, None, 0

        def out() -> pa.RecordBatch:
            if names is None:  # a task was run again and read its rows in another order
                raise RuntimeError("sums of a chunk whose documents are not named")
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(total / times), pa.array(spoken)], names=["name", "loss", "n_words"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] != chunk:
                    if chunk is not None:
                        yield out()
                    chunk, total, names, spoken, times = row["chunk"], np.zeros(row["docs"]), None, None, 0
                if row["names"] is not None:  # chunks of equal rows share a number
                    names, spoken, times = np.frombuffer(row["names"], np.int64), unpacked(row["words"], row["docs"]).astype(np.int64), times + 1
                else:
                    total += unpacked(row["losses"], row["docs"]).astype(np.uint32).view(np.float32)
        if chunk is not None:
            yield out()

    asked = docs.select("name", "text", "own").mapInArrow(ask, _BLOCK_SQL)
    met = model.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    sums = met.mapInArrow(answer, _SUM_SQL).repartition(shards, "chunk").sortWithinPartitions("chunk")
    return sums.mapInArrow(add, "name long, loss double, n_words long").groupBy("name").agg(F.max("loss").alias("loss"), F.max("n_words").alias("n_words"))


def perplexity_filter(docs: DataFrame, trusted: DataFrame, quantile: float = 0.995, prior: float = 50.0, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, perplexity (of a word), threshold, keep for every row of docs; trusted: the doc_ids of trusted documents."""
    small_batches(docs)
    context = docs.sparkSession.sparkContext
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = cut(trusted.select("doc_id").where("doc_id is not null").distinct()).withColumn("_t", F.lit(True))
    many = ids.limit(MOST_IDS + 1).count() > MOST_IDS
    narrow = docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang")).join(ids if many else F.broadcast(ids), "doc_id", "left")
    narrow = narrow.select("doc_id", "lang", "text", F.coalesce("_t", F.lit(False)).alias("own"), F.xxhash64("doc_id", "text").alias("name"))
    if many:  # what a shuffle brings comes in any order; a task that runs again must cut the same chunks
        narrow = narrow.sortWithinPartitions("name")
    good = narrow.where("own and text <> ''")
    size = good.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    top = vocabulary(good, min(words, WORDS), max(16, size >> 25))
    shards = 1 << min(max(size >> 26, 16) - 1, 4095).bit_length()  # some 10 million words of trusted text to a shard
    sent = context.broadcast((uuid.uuid4().hex, b"\n".join(top)))
    model = counts(good, sent, shards)
    known = context.broadcast(kneser_ney(facts(model, FIRST + len(top))))
    lost = losses(narrow, model, sent, known, shards)
    about = narrow.select("doc_id", "lang", "own", "name")
    scored = cut(about.join(lost, "name"))
    rate = F.col("loss") / F.col("n_words")
    middle = sized_broadcast(cut(scored.where("n_words > 0").groupBy("lang").agg(F.percentile_approx(rate, 0.5, 10_000).alias("m"))))
    drawn = (F.col("loss") + prior * F.col("m")) / (F.col("n_words") + F.lit(prior))
    placed = scored.alias("r").join(middle.alias("m"), F.col("r.lang").eqNullSafe(F.col("m.lang")), "left").select("r.*", drawn.alias("drawn"))
    trusted_rows = placed.where("own and n_words > 0")
    limit = sized_broadcast(cut(trusted_rows.groupBy("lang").agg(F.percentile_approx("drawn", quantile, 10_000).alias("limit"))))
    every = trusted_rows.agg(F.percentile_approx("drawn", quantile, 10_000)).first()[0]
    judged = placed.alias("r").join(limit.alias("t"), F.col("r.lang").eqNullSafe(F.col("t.lang")), "left")
    threshold = F.coalesce(F.col("t.limit"), F.lit(every).cast("double"), F.lit(float("inf")))
    spoken = F.col("r.n_words") > 0
    return judged.select(
        "r.doc_id", "r.n_words", F.when(spoken, F.exp(F.col("r.loss") / F.col("r.n_words"))).alias("perplexity"), F.exp(threshold).alias("threshold"),
        F.coalesce(spoken & (F.col("r.drawn") <= threshold), F.lit(False)).alias("keep"),
    )
