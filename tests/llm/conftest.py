"""Documents with every odd case: nulls, empty and very long texts, repeated rows, clashing columns."""

from __future__ import annotations

import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, n int, kept boolean, h long"
LONG = "ab cd. Ef, gh " * 6000
ODD = [
    (9001, None, "en", "src1"), (9002, "", None, None), (9003, " \n\t ", "en", None), (9004, LONG, "en", "src0"),
    (9005, "one", "de", "src1"), (9006, "Zwei Worte", None, "src1"), (9007, "12 345 *** |||", "en", "src2"),
    (9008, "a b c   d\x1ce é́ <|endoftext|> <|startoftext|>x", "fr", "src2"), (9009, "l\n\n\nl\nl \n l", "fr", "src2"),
    (9010, "Wort " * 40, "de", "src0"), (9010, "Wort " * 40, "de", "src0"), (None, "no id at all here", "en", "src0"),
]


def held(doc_id, fold: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == fold


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows alone, with more columns whose names clash with results."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 0.5, 7, 1, True, 3) for i, t, g, s in ODD], SCHEMA).cache()


@pytest.fixture(scope="session")
def docs(spark, sf_dir, odd):
    """The smallest documents table and the odd rows."""
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plain.unionByName(odd.select(*plain.columns)).repartition(3).cache()


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
