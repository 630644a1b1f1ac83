"""Operator 4: token counts by batch encoding in Arrow functions that return lengths only.

Rows without text count as empty. Every row of the input gives one row; extra columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, claim, memory, small_batches

#: Distinct words whose counts a worker remembers.
MEMO_WORDS = 400_000
#: Bytes of words given to the library in one call.
CALL_BYTES = 1 << 20


class WordCounter:
    """Counts tokens with a tokenizer that never lets a token span white space.

    Space and U+0009 to U+000D are therefore safe boundaries: each word encodes alone as it does inside its text
    (marks do not compose with white space, and lower-casing goes by character). Words are encoded by the library
    in batches of bounded bytes; the count of a word is remembered while there is room.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo: dict[bytes, int] = memory()

    def learn(self, fresh: list[bytes]) -> None:
        start = held = 0
        for i in range(len(fresh) + 1):
            if i == len(fresh) or held + len(fresh[i]) > CALL_BYTES and i > start:
                part = fresh[start:i]
                encoded = self.library.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
                self.memo.update(zip(part, map(len, encoded)))
                start, held = i, 0
            if i < len(fresh):
                held += len(fresh[i])

    def counts(self, texts: list[bytes]) -> list[int]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        parts = [t.split() for t in texts]
        self.learn(list(set().union(*parts).difference(self.memo)))
        get = self.memo.__getitem__
        return [sum(map(get, p)) for p in parts]


_counters: dict[str, WordCounter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    small_batches(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _counters:
            _counters[tokenizer_path] = WordCounter(tokenizer_path)
        counter = _counters[tokenizer_path]
        claim(counter.memo)
        for batch in byte_batches(batches):
            texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
            tokens = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
