"""Operator 8: n-gram Jaccard join with vertical partitioning.

A document is the set of its distinct word n-grams, as 64-bit hashes. Documents with one and the same set form a
class, and only one of each class is joined further. All n-grams have one global order: by hash, the frequent ones
last. Two sets of similarity t or more share an n-gram among the first |x| - ceil(t |x|) + 1 of each, so these
prefixes find all candidates. For a candidate pair the order is cut into fragments; the overlap of the two sets is
counted in each fragment apart and summed per pair, and the pair links if the sum is enough.

Frequent n-grams are told by their counts in the prefixes by hash alone, and, for documents that mostly hold such
n-grams, by their counts over these documents' whole sets. The order is one and the same for all documents whatever
the counts, so no link depends on them.

Groups may hold a third of all rows, so pairs within a group are not all made. First every document of a group
(n-gram and size class) is held against one only, that in which the n-gram comes earliest in the order. Links make
components. A group that still has several components gets new such documents by lot, one of all and one of its largest
component, as long as that joins many more of the pairs that are left. Then the documents outside a group's
largest component are held against those of other components. Any two linked documents share a group, so afterwards
they are in one component. This last join goes by n-gram and size class, the smaller document on one side: a partner
of at least its size can link only if what follows the n-gram in it leaves room for that, which many don't, as
documents made from one template, with more words of their own than the similarity allows: these meet nobody.

Three lossless filters precede the exact count: sizes; places (the n-gram that is a pair's first common one leaves
room for an overlap of no more than what follows it in either set); and parity bitmaps (each n-gram flips one bit, so bitmaps differ
in no more bits than the sets differ in n-grams; a bitmap has about a bit for each n-gram, a power of two in all, and
the longer one of a pair is folded). Groups go by as many bits of a hash as keep chance meetings rare; such a meeting
adds a candidate, which the filters reject.

Defined cases: null text or text without words has the empty set and links with nothing; rows that share a doc_id
are one node; a null doc_id has a null component; a long text's set is made whole, alone in its batch; an empty table
gives an empty result; every row gives a row; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm.common import MOST_IDS, byte_batches, claim, id_number, judged_rows, lower_words, memory, small_batches, without
from tidemark.llm.components import components
from tidemark.session import cut, sized_broadcast

#: Least 64-bit lanes of a parity bitmap.
LANES = 8
#: Fragments of the order: ranges of hashes, the frequent n-grams' ranges last.
FRAGMENTS, LATE_FRAGMENTS = 6, 2
#: Pairs left, to an n-gram of a prefix, past which groups draw new documents to be held against.
PAIRS = 4
MEMO_WORDS = 250_000
_memo: dict[bytes, int] = memory()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; frequent ones are remembered."""
    found = list(map(_memo.get, ws))
    if None in found:
        for i, h in enumerate(found):
            if h is None:
                found[i] = h = xxhash.xxh64_intdigest(ws[i])
                if len(_memo) < MEMO_WORDS:
                    _memo[ws[i]] = h
    return np.array(found, np.uint64)


def ngram_set(text: str | None, n: int = 3) -> np.ndarray:
    """The distinct n-grams' hashes in ascending order; with fewer words the whole sequence is the one n-gram."""
    ws = lower_words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    h = word_hashes(ws)
    size = min(n, len(ws))
    key = np.full(len(ws) - size + 1, size, np.uint64)
    for i in range(size):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    key.sort()
    return key if len(key) < 2 else key[np.concatenate(([True], key[1:] != key[:-1]))]


def prefix_size(n: np.ndarray | int, percent: int):
    return n - -(-n * percent // 100) + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _marks(s: np.ndarray) -> tuple[int, int]:
    """Two fingerprints of a set."""
    return int(_signed(s.sum(dtype=np.uint64, keepdims=True))[0]), int(_signed(np.bitwise_xor.reduce(_mix(s + np.uint64(1)), keepdims=True))[0])


def _parity(s: np.ndarray) -> np.ndarray:
    lanes = LANES
    while 64 * lanes < len(s):
        lanes *= 2
    bits = np.bincount((s & np.uint64(64 * lanes - 1)).astype(np.int64), minlength=64 * lanes).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def _apart(a: str, b: str):
    """Column: the bits in which two bitmaps differ, the longer one folded once (sizes that pass differ less than that)."""
    short = F.least(F.size(a), F.size(b))
    same = lambda c: F.when(F.size(c) == short, F.col(c)).otherwise(F.zip_with(F.slice(c, 1, short), F.slice(c, short + 1, short), lambda x, y: x.bitwiseXOR(y)))
    return F.aggregate(F.zip_with(same(a), same(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def _describe(n: int, percent: int):
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_memo)
        for batch in byte_batches(batches):
            size, one, two, parity, first = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = ngram_set(text, n)
                a, b = _marks(s) if len(s) else (0, 0)
                size.append(len(s)), one.append(a), two.append(b), parity.append(_parity(s))
                first.append(_signed(s[: prefix_size(len(s), percent) * 5 // 4 + 4]) if len(s) else np.zeros(0, np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(parity, longs), pa.array(first, longs)],
                names=["doc_id", "n", "one", "two", "parity", "first"],
            )

    return described


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of x are among `some` (ascending)."""
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def _prefixes(percent: int, heavy):
    """From the first n-grams in hash order to the prefix in the global order, or null where they are too few."""

    def cut_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            grams, ends = batch.column("first").flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(batch.column("first")).to_numpy(zero_copy_only=False))
            late = _among(grams, heavy.value)
            for n, a, b in zip(batch.column("n").to_pylist(), [0, *ends[:-1]], ends):
                first, last, p = grams[a:b], late[a:b], prefix_size(n, percent)
                light = first[~last]
                out.append(light[:p] if len(light) >= p else np.concatenate((light, first[last]))[:p] if len(first) == n else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n", "one")), pa.array(out, pa.list_(pa.int64()))], names=["id", "n", "one", "prefix"])

    return cut_down


def _ordered(n: int, percent: int, heavy):
    """Prefixes in the global order from whole texts."""

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_memo)
        for batch in byte_batches(batches):
            ids, sizes, marks, out = batch.column("doc_id"), [], [], []
            for text in batch.column("text").to_pylist():
                s = ngram_set(text, n)
                last = _among(_signed(s), heavy.value)
                sizes.append(len(s)), marks.append(_marks(s)[0] if len(s) else 0)
                out.append(_signed(np.concatenate((s[~last], s[last]))[: prefix_size(len(s), percent)]) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["id", "n", "one", "prefix"])

    return ordered


def _fragments(n: int, heavy):
    """The fragments of every set: its n-grams within each range of the order."""

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_memo)
        edges, late_edges = (np.array([(1 << 64) // count * k for k in range(1, count)], np.uint64) for count in (FRAGMENTS, LATE_FRAGMENTS))
        for batch in byte_batches(batches):
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("one").to_pylist()
            rows = []
            for i, mark, text in zip(ids, marks, batch.column("text").to_pylist()):
                s = ngram_set(text, n)
                if len(s) and _marks(s)[0] == mark:
                    last = _among(_signed(s), heavy.value)
                    parts = np.split(s[~last], np.searchsorted(s[~last], edges)) + np.split(s[last], np.searchsorted(s[last], late_edges))
                    rows += [(i, mark, k, _signed(part)) for k, part in enumerate(parts) if len(part)]
            at, mark, k, grams = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(mark, pa.int64()), pa.array(k, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["id", "one", "fragment", "grams"])

    return fragments


class _Join:
    """What the rounds of candidates share."""

    def __init__(self, texts: DataFrame, sets: DataFrame, n: int, percent: int, repeats: bool):
        self.texts, self.sets, self.n, self.percent, self.repeats, self.heavy = texts, sets, n, percent, repeats, None

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs a, b (distinct) that link."""
        info = self.sets.select("id", "n", "one", "parity")
        t = self.percent
        left, right = (info.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"), F.col("one").alias(f"k{c}")) for c in "ab")
        like = 100 * F.least("na", "nb") >= t * F.greatest("na", "nb")
        close = _apart("pa", "pb") * (100 + t) <= (F.col("na") + F.col("nb")) * (100 - t)
        near = cut(pairs.join(left, "a").join(right, "b").where(like).where(close).select("a", "b", "na", "nb", "ka", "kb"))
        need = cut(near.select(F.col("a").alias("doc_id"), F.col("ka").alias("one")).unionByName(near.select(F.col("b").alias("doc_id"), F.col("kb").alias("one"))).distinct())
        chosen = self.texts.join(sized_broadcast(need), "doc_id").select("doc_id", "one", "text")
        parts = chosen.mapInArrow(_fragments(self.n, self.heavy), "id long, one long, fragment int, grams array<long>")
        parts = cut(parts.dropDuplicates(["id", "one", "fragment"]) if self.repeats else parts)
        ofb = near.join(parts.select(F.col("id").alias("b"), F.col("one").alias("kb"), "fragment", F.col("grams").alias("gb")), ["b", "kb"])
        both = ofb.join(parts.select(F.col("id").alias("a"), F.col("one").alias("ka"), "fragment", F.col("grams").alias("ga")), ["a", "ka", "fragment"])
        partial = both.select("a", "b", "ka", "kb", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("shared"))
        total = partial.groupBy("a", "b", "ka", "kb", "na", "nb").agg(F.sum("shared").alias("shared"))
        return cut(total.where(100 * F.col("shared") >= t * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b").distinct())


    def open_groups(self, posted: DataFrame, known: DataFrame) -> DataFrame:
        """The rows of groups that have several components, each with its component `of` and the group's largest, `main`."""
        placed = posted.join(known, "id", "left").select("h", "id", "n", "at", "step", F.coalesce("component", "id").alias("of"))
        sizes = placed.groupBy("h", "of").agg(F.count("*").alias("c"))
        main = sizes.groupBy("h").agg(F.max_by("of", F.struct("c", "of")).alias("main"), F.count("*").alias("k")).where("k > 1").select("h", "main")
        return cut(placed.join(main, "h"))

    def pairs_left(self, groups: DataFrame) -> int:
        """How many pairs last_pairs() would look at, at most."""
        rows = self.with_room(groups)
        near, out = F.col("most") >= F.col("n"), F.col("outside")
        some = lambda c: F.sum(c.cast("double"))
        made = some(near & out) * F.count("*") + some(near & ~out) * some(out)
        return int(rows.groupBy("h", "step").agg(made.alias("k")).agg(F.sum("k")).first()[0] or 0)

    def with_room(self, groups: DataFrame) -> DataFrame:
        """The rows that leave room for any partner, with the size of the largest one, `most`."""
        t = self.percent
        most = F.floor((F.col("n") - F.col("at")) * (100 + t) / t) - F.col("n")
        return groups.withColumn("most", most).where(F.col("most") >= -F.floor(-F.col("n") * t / 100)).withColumn("outside", F.col("of") != F.col("main"))

    def drawn_pairs(self, groups: DataFrame, turn: int) -> DataFrame:
        """Every document against two of its group, drawn by lot: one of all and one of the largest component."""
        lot = F.xxhash64(F.lit(turn), "id")
        inside = F.col("of") == F.col("main")
        chosen = lambda lot, name: F.max(F.struct(lot.alias("lot"), "id", "of", "n")).alias(name)
        leads = groups.groupBy("h", "step").agg(chosen(lot, "one"), chosen(F.when(inside, lot), "two"))
        leads = leads.select("h", "step", F.explode(F.array("one", "two")).alias("z"))
        met = groups.join(leads, ["h", "step"]).where((F.col("of") != F.col("z.of")) & (F.col("id") != F.col("z.id")))
        return met.select(F.least("id", "z.id").alias("a"), F.greatest("id", "z.id").alias("b")).distinct()

    def last_pairs(self, groups: DataFrame) -> DataFrame:
        """All pairs of a group's documents in different components that leave room for a link."""
        rows = self.with_room(groups)
        # 1: a smaller document outside the main component meets all larger ones; 0: one inside meets those outside
        small = rows.where("most >= n").select("h", F.col("outside").cast("int").alias("turn"), F.explode(F.sequence("step", _size_class(F.col("most"), self.percent))).alias("step"), *(F.col(c).alias(f"{c}x") for c in ("id", "n", "most", "of")))
        large = rows.select("h", F.explode(F.when(F.col("outside"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("turn"), "step", *(F.col(c).alias(f"{c}y") for c in ("id", "n", "most", "of")))
        fits = (F.col("ny") <= F.col("mostx")) & (F.col("nx") <= F.col("mosty")) & ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("idx") != F.col("idy"))))
        met = small.join(large, ["h", "turn", "step"]).where((F.col("ofx") != F.col("ofy")) & fits)
        return met.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def _size_class(n, percent: int):
    """Column: sizes of one class differ less than a link allows; it doesn't fall as n grows."""
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(100 / percent)))).cast("int")


def _often(grams: DataFrame, most: int) -> np.ndarray:
    """n-grams (column h) of more than `most` rows, ascending; the caller keeps their number bounded by its choice of `most`."""
    found = grams.groupBy("h").count().where(F.col("count") > most).select("h").toArrow().column("h")
    return np.sort(found.to_numpy().astype(np.int64))


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90, frequent: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component) for every row of docs.

    n: words of an n-gram; percent: least similarity in hundredths; frequent: n-grams in more prefixes than this
    come last in the order (raised with the corpus so that there are at most 2^20 of them). Ids that are no integers
    are joined as numbers and named again at the end.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        numbered = cut(docs.select("doc_id", "text", id_number(docs).alias("_number")))
        got = cut(ngram_components(numbered.select(F.col("_number").alias("doc_id"), "text"), n, percent, frequent))
        names = numbered.where("doc_id is not null").select("doc_id", "_number").distinct()
        placed = names.join(got.select(F.col("doc_id").alias("_number"), "component_id").distinct(), "_number")
        first = placed.groupBy("component_id").agg(F.min("doc_id").alias("_first"))
        told = placed.join(first, "component_id").select("_number", "doc_id", "_first")
        return got.withColumnRenamed("doc_id", "_number").join(told, "_number", "left").select("doc_id", "n_shingles", F.col("_first").alias("component_id"))
    small_batches(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = cut(texts.mapInArrow(_describe(n, percent), "doc_id long, n long, one long, two long, parity array<long>, first array<long>"))
    filled = base.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    repeats = bool(base.groupBy("doc_id").count().where("count > 1").limit(1).count())
    classes = cut(filled.groupBy("n", "one", "two").agg(F.min("doc_id").alias("id")))  # cut: so the join's partitions of a crowd of copies can be split
    members = filled.select("doc_id", "n", "one", "two").join(classes, ["n", "one", "two"]).select("doc_id", "one", "id")
    members = cut(members.distinct() if repeats else members)
    copies = members.where("doc_id <> id").select("doc_id", "one")
    sets = filled.join(sized_broadcast(copies), ["doc_id", "one"], "left_anti").select(F.col("doc_id").alias("id"), "n", "one", "parity", "first")
    sets = cut(sets.dropDuplicates(["id", "one"])) if repeats else sets
    join = _Join(texts, sets, n, percent, repeats)

    context = docs.sparkSession.sparkContext
    grams = sets.agg(F.sum(F.size("first"))).first()[0] or 0
    bits = min(64, max(32, grams.bit_length() + 16))
    heavy = context.broadcast(_often(sets.select(F.explode("first").alias("h")), max(frequent, grams >> 20)))
    shape = "id long, n long, one long, prefix array<long>"
    first = sets.select("id", "n", "one", "first")
    prefixed = first.mapInArrow(_prefixes(percent, heavy), shape)
    if len(heavy.value):
        dense = cut(prefixed.where(F.col("prefix").isNull()).select(F.col("id").alias("doc_id"), "one"))
        whole = texts.join(sized_broadcast(dense, MOST_IDS), "doc_id").select("doc_id", "one", "text").mapInArrow(_fragments(n, context.broadcast(np.zeros(0, np.int64))), "id long, one long, fragment int, grams array<long>")
        inside = cut(whole.select(F.explode("grams").alias("h")).groupBy("h").count().where(F.col("count") > frequent))
        most = max(frequent, (inside.agg(F.sum("count")).first()[0] or 0) >> 20)
        more_heavy = inside.where(F.col("count") > most).select("h").toArrow().column("h").to_numpy().astype(np.int64)
        heavy = context.broadcast(np.union1d(heavy.value, more_heavy))
        prefixed = cut(first.mapInArrow(_prefixes(percent, heavy), shape))
        more = cut(prefixed.where(F.col("prefix").isNull()).select(F.col("id").alias("doc_id"), "one"))
        found = texts.join(sized_broadcast(more.select("doc_id").distinct(), MOST_IDS), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_ordered(n, percent, heavy), shape)
        found = found.join(more.withColumnRenamed("doc_id", "id"), ["id", "one"], "left_semi").dropDuplicates(["id", "one"])
        prefixed = prefixed.where(F.col("prefix").isNotNull()).unionByName(found.select("id", "n", "one", "prefix"))
    join.heavy = heavy
    posted = prefixed.select("id", "n", _size_class(F.col("n"), percent).alias("step"), F.posexplode("prefix").alias("at", "h")).withColumn("h", F.shiftrightunsigned("h", 64 - bits))
    shared = posted.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    posted = cut(posted.join(shared, "h"))

    room = (100 + percent) * F.least(F.col("n") - F.col("at"), F.col("nz") - F.col("pz")) >= percent * (F.col("n") + F.col("nz"))
    lead = posted.groupBy("h", "step").agg(F.min(F.struct("at", "id", "n")).alias("l"), F.count("*").alias("c")).where("c > 1")
    lead = lead.select("h", "step", F.col("l.id").alias("z"), F.col("l.at").alias("pz"), F.col("l.n").alias("nz"))
    pairs = posted.join(lead, ["h", "step"]).where((F.col("id") != F.col("z")) & room)
    tried = cut(pairs.select(F.least("id", "z").alias("a"), F.greatest("id", "z").alias("b")).distinct())
    links = join.verified(tried)
    if repeats:  # an id with several texts is one node
        ids = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
        links = links.unionByName(members.join(ids, "doc_id").select("a", F.col("id").alias("b")).where("a <> b"))
    known = components(links)
    again = lambda links: components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links))

    groups = join.open_groups(posted, known)
    left, before, turn = join.pairs_left(groups), None, 0
    while left > PAIRS * grams and (before is None or left < 0.8 * before):
        fresh = cut(join.drawn_pairs(groups, turn).join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(fresh)
        known = again(join.verified(fresh))
        groups, before, turn = join.open_groups(posted, known), left, turn + 1
        left = join.pairs_left(groups)
    rest = cut(join.last_pairs(groups).join(tried, ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        known = again(join.verified(rest))

    home = (members.groupBy("doc_id").agg(F.min("id").alias("id")) if repeats else members.drop("one")).join(known, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id"))
    return base.select("doc_id", F.col("n").alias("n_shingles")).join(home, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Of each component the rows with its smallest doc_id (by number, where ids are no integers) stay, one row of each doc_id; a null doc_id stays."""
    numbered = docs.withColumn("doc_id", id_number(docs))
    kept = without(docs, ngram_components(numbered, **how).where("doc_id <> component_id"))
    repeated = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.limit(1).count():
        return kept
    ids = sized_broadcast(repeated, MOST_IDS)
    return without(kept, judged_rows(repeated.withColumn("text", F.lit(None).cast("string")))).unionByName(kept.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
