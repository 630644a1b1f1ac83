"""Queries of the operators that hold documents against each other or against other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import decontamination
from tidemark.llm.license_scan import license_scan
from tidemark.llm.ngram_join import ngram_components
from tidemark.session import table


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly so."""
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by links of similarity 0.9 over 3-word shingles."""
    return ngram_components(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, as files source/thousands/hundreds/doc_id of a tree."""
    level = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), level(1000), level(100), F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return license_scan(files).withColumnRenamed("file_id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages of corpus_pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"op5_decontamination": op5_decontamination, "op8_ngram_join": op8_ngram_join, "op10_license_scan": op10_license_scan, "pipeline": pipeline}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLES: dict[str, str] = {
    "op8_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams FROM w),
  u AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b)
  SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, min(root) AS component_id FROM s JOIN r ON r.id = s.doc_id GROUP BY 1, 2""",
}
