"""Operator 13: exact duplicates by a tree merge of sorted digest runs, in DataFrame functions alone.

Each text becomes a digest: 64 bits to sort and deal by, and its SHA-256 and length by which equality is verified at
every level, so texts that share the short digest stay apart. A partition of the input is a run: its distinct digests
in order, each with the best row so far and a count. In round k runs whose numbers agree but for the k-th digit meet
at the one whose digit is 0 (binomial rounds, of `fan_in` runs at a time); there they are sorted together and equal
neighbours become one. A run is dealt over shards of the digest, so that no task holds a whole run, and a text that
fills the corpus is one row a run from the first round on. The answers go back to the runs, and from a run to its
documents, so a hot text's rows meet their answer in as many places as the corpus has partitions.

A null text counts as an empty one. A row without doc_id stays only where none of its equals has one. Of rows equal
in both one stays. Every row of the input gives one row; extra columns are not read. Texts of any length are one
digest. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: What two texts must agree in to be equal: the short digest, then the proof.
KEY = ["digest", "proof", "size"]


def digests(docs: DataFrame, doc_id: str, text: str, normalise: Callable[[Column], Column] | None) -> DataFrame:
    """A narrow row a document, written once: digest, proof, length, the run it is in and its own number."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = normalise(whole) if normalise else whole
    narrow = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("_text"))
    marked = narrow.select(
        "doc_id", F.xxhash64("_text").alias("digest"), F.unhex(F.sha2("_text", 256)).alias("proof"), F.octet_length("_text").alias("size"), F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row")
    )
    return cut(marked)


def tree_merge(rows: DataFrame, best: Callable[[Column], Column], fan_in: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """The runs of all partitions, and the one run that is left after the last round."""

    def merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("run", *KEY).agg(best(F.col("best")).alias("best"), F.sum("n").alias("n"))

    first = cut(merged(rows.select("run", *KEY, "best", F.lit(1).cast("long").alias("n"))))
    last = first.agg(F.max("run")).first()[0] or 0
    now, stride = first, 1
    while stride <= last:
        stride *= fan_in
        met = now.withColumn("run", F.col("run") - F.pmod("run", F.lit(stride)))
        now = cut(merged(met.repartition(shards, "run", "digest").sortWithinPartitions("run", *KEY)))
    return first, now


def exact_dedup(docs: DataFrame, keep: str = "largest", normalise: Callable[[Column], Column] | None = None, doc_id: str = "doc_id", text: str = "text", fan_in: int = 16, shards: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row: of equal texts the row with the largest (or the smallest) doc_id stays.

    `normalise` maps the text's column to the one compared. `shards` is the number of parts a round deals runs to,
    by default the session's number of shuffle partitions.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    if fan_in < 2:
        raise ValueError("fan_in is 2 at least")
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = digests(docs, doc_id, text, normalise)
    largest = keep == "largest"
    last_without_id = F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull()
    best = F.struct(last_without_id.alias("flag"), "doc_id", "row").alias("best")
    first, final = tree_merge(marked.withColumn("best", best), F.max if largest else F.min, fan_in, shards)
    answers = final.select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("_row"), F.col("n").alias("group_size"))
    told = first.select("run", *KEY).join(answers, KEY)
    found = marked.join(told, ["run", *KEY])
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("_row")).alias("kept"), F.lower(F.hex("proof")).alias("text_sha256"))
