"""What several operators of this package share: folds, words, byte-balanced batches and bounded samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut, sized_broadcast

#: Bytes of text that a Python worker handles at once; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
#: Rows that are sent to a Python worker at once, at most.
BATCH_ROWS = 512


_memories: list[dict] = []


def memory() -> dict:
    """A dictionary in which a worker remembers what it has computed for words, until another operator claims the room."""
    _memories.append({})
    return _memories[-1]


def claim(mine: dict) -> None:
    """A worker outlives its stage: forgets what other operators have remembered in it."""
    for other in _memories:
        if other is not mine:
            other.clear()


def small_batches(rows: DataFrame) -> None:
    """From now on the session sends whole texts to Python workers by BATCH_ROWS at most; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)


def fold(column: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds))


def words(text: str | None) -> list[bytes]:
    """The runs of characters other than space and U+0009 to U+000D (bytes.split() cuts at just these)."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As words(), with A-Z (and nothing else) in lower case."""
    return text.encode().lower().split() if text else []


def numbered_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """lower_words() of all texts end to end, as numbers of their distinct words, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = lists.flatten()
    some = pc.not_equal(pc.binary_length(found), 0)
    if not pc.all(some).as_py():  # Arrow gives an empty word before and after white space at the ends
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~some.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        found = found.filter(some)
    return found.cast(pa.binary()).dictionary_encode(), sizes


def distinct_words(words: pa.DictionaryArray) -> list[bytes]:
    """The distinct words of numbered_words(); to_pylist() would make an Arrow scalar of each first."""
    return words.dictionary.to_numpy(zero_copy_only=False).tolist()


def byte_batches(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches where the texts so far reach `most` bytes."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)


def gathered(batches: Iterable[pa.RecordBatch], most: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Record batches put together until their texts reach `most` bytes; larger ones are cut first."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in byte_batches(batches, text, most):
        more = pc.sum(pc.binary_length(batch.column(text))).as_py() or 0
        if held and size + more > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held)


#: Most ids that are sent to all workers to pick rows of documents; past it the texts are shuffled.
MOST_IDS = 200_000


def id_number(df: DataFrame, column: str = "doc_id"):
    """An id as a number: itself where ids are integers, else 63 bits of a hash of it as text; null for null."""
    if isinstance(df.schema[column].dataType, T.IntegralType):
        return F.col(column).cast("long")
    text = F.col(column).cast("string")
    return F.when(text.isNotNull(), F.shiftrightunsigned(F.xxhash64(F.lit("id"), text), 1))


def row_id(docs: DataFrame):
    """The number of doc_id, or for a row without one a negative hash of its text."""
    own = -1 - F.shiftrightunsigned(F.xxhash64(F.lit("row"), F.col("text").cast("string")), 2)
    return F.coalesce(id_number(docs), own)


def judged_rows(docs: DataFrame) -> DataFrame:
    """docs under row_id(), so that a row without doc_id is judged by its own text."""
    return docs.withColumn("doc_id", row_id(docs))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose row_id() is not among ids (column doc_id)."""
    gone = sized_broadcast(cut(ids.select(F.col("doc_id").alias("_gone")).distinct()), MOST_IDS)
    return docs.join(gone, row_id(docs) == gone["_gone"], "left_anti")


def bounded_sample(keys: DataFrame, most: int, *by: str) -> DataFrame:
    """At most `most` rows of a narrow frame, in the order of a hash of the columns `by`: the same rows on every run."""
    order = F.xxhash64(F.lit("sample"), *by)
    return keys.orderBy(order, *by).limit(most)
