"""The driver tables as entities for plans: parts with signals from their line items, documents with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.session import load


def part_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each part; line items are aggregated by key before the join, as interaction cards are."""
    items = load(spark, sf_dir, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08))
    signals = items.groupBy("l_partkey").agg(
        F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("best"), F.bool_or(F.col("l_linestatus") == "F").alias("inhibitory"), F.count(F.lit(1)).alias("n")
    )
    part = load(spark, sf_dir, "part")
    size = F.col("p_size")
    oral = F.when(size <= 16, "Low").when(size <= 33, "Medium").otherwise("High")
    engineered = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 2 == 0
    return part.join(signals, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("scaffold_type"), oral.alias("oral_class"), engineered.alias("engineered"), "inhibitory",
        F.coalesce(F.col("n") > 0, F.lit(False)).alias("has_experimental_affinity"), F.col("best").alias("best_affinity_value"), F.col("p_partkey").alias("_pos"),
    )


SQL_PARTS = """snap AS (
  SELECT p_partkey AS candidate_id, p_name AS canonical_name, p_type AS scaffold_type,
    CASE WHEN p_size <= 16 THEN 'Low' WHEN p_size <= 33 THEN 'Medium' ELSE 'High' END AS oral_class,
    CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 2 = 0 AS engineered, inhibitory,
    coalesce(n > 0, false) AS has_experimental_affinity, best AS best_affinity_value FROM part LEFT JOIN (
      SELECT l_partkey, min(l_extendedprice / l_quantity) AS best, bool_or(l_linestatus = 'F') AS inhibitory, count(*) AS n
      FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.08 GROUP BY l_partkey) s ON p_partkey = l_partkey)"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their texts, and labels where there are any."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(load(spark, sf_dir, "labels"), "doc_id", "left").withColumn("_pos", F.col("doc_id"))


SQL_DOCS = "docs AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
