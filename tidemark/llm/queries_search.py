"""Queries of exact copies, ranked search and periodic runs, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, small_batches
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.lexical_search import lexical_search
from tidemark.llm.periodic_runs import periodic_runs, planted_words
from tidemark.session import table


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every whole document; a tenth of the documents is made periodic from some word on."""
    docs = table(spark, sf_dir, "documents")
    small_batches(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches):
            texts = [planted_words(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    found = periodic_runs(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(plant, f"doc_id {kind}, text string"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    got = found.select("doc_id", "runs", "collapsed", longest.alias("_best"), lines.alias("_lines"))
    start, length, period = -F.col("_best.s"), F.col("_best.length"), -F.col("_best.p")
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * _best.length) div (-_best.p)").alias("exponent_milli"), F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BITS = ", ".join(["-1"] * 8)
_CRC = f"xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), {_BITS}])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, CAST(4294967295 AS BIGINT)), 4294967295)"
QUERIES = {"op11_periodic_runs": op11_periodic_runs, "op12_lexical_search": op12_lexical_search, "op13_exact_dedup": op13_exact_dedup}
ORACLES: dict[str, str] = {
    "op11_periodic_runs": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w, {_CRC} AS h FROM documents), a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
  p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a), t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
  u AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM t), m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
  s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM m), l AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
  r AS (SELECT doc_id, start, length, min(q) AS period FROM l GROUP BY 1, 2, 3), x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
  k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN x ON u.doc_id = x.doc_id AND u.i = x.i GROUP BY 1),
  b AS (SELECT doc_id, count(*) AS n_runs, arg_max({{'s': start, 'l': length, 'p': period}}, (length, -start, -period)) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1)
  SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op12_lexical_search": f"""WITH d AS (SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
  n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1), a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
  q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1) CROSS JOIN a),
  s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms))))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN n USING (doc_id) JOIN w USING (term) CROSS JOIN a GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0)
  SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM r WHERE place <= 10""",
    "op13_exact_dedup": """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), g AS (SELECT *, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size FROM t)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM g""",
}
