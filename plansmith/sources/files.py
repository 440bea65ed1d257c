"""Files in and out: JSON lines, CSV with a byte-order mark, logs, Markdown reports, manifests."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansmith.session import with_position


def first_existing(paths: Iterable[str]) -> str:
    tried = list(paths)
    for p in tried:
        if os.path.exists(p):
            return p
    raise FileNotFoundError(f"none of these exist: {tried}")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, position: bool = True) -> DataFrame:
    """Rows of JSON lines under a declared schema; blank lines are skipped, bad ones fail the read. With the input order in _pos."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return with_position(rows) if position else rows


def read_csv(spark: SparkSession, path: str | list[str], schema: str, limit: int | None = None) -> DataFrame:
    """CSV with a header, every column as declared; a byte-order mark is taken off the first name."""
    rows = spark.read.schema(schema).options(header=True, enforceSchema=True, multiLine=True, escape='"', encoding="UTF-8").csv(path)
    return rows if limit is None else rows.limit(limit)


def read_subjects(spark: SparkSession, root: str, part: str, subjects: list[str], schema: str) -> DataFrame:
    """root/<part>/<subject>_<part>.csv of the given subjects, with a column subject; other files aren't opened."""
    rows = read_csv(spark, [f"{root}/{part}/{s}_{part}.csv" for s in subjects], schema)
    return rows.withColumn("subject", F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)_{part}\.csv$", 1))


LOG_LINE = r"Epoch:?\s*\[?(\d+)/(\d+)\]?\s*\(?(\d+)/(\d+)\)?[^\n]*?(?:actor_)?loss:?\s*([-\d.eE]+)(?:[^\n]*?lr:?\s*([-\d.eE]+))?(?:[^\n]*?reward:?\s*([-\d.eE]+))?"


def read_training_logs(spark: SparkSession, path: str) -> DataFrame:
    """(source, epoch, step, loss, lr, reward) of progress lines in all *.log files below path; other lines are passed over."""
    lines = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.log").text(path).select(F.col("_metadata.file_path").alias("source"), "value")
    hit = lines.filter(F.col("value").rlike(f"(?i){LOG_LINE}"))
    group = lambda i: F.nullif(F.regexp_extract("value", f"(?i){LOG_LINE}", i), F.lit(""))
    return hit.select(
        "source", group(1).try_cast("int").alias("epoch"), group(3).try_cast("int").alias("step"), group(5).try_cast("double").alias("loss"), group(6).try_cast("double").alias("lr"), group(7).try_cast("double").alias("reward"),
    )


def write_jsonl(df: DataFrame, path: str, order: list | None = None) -> None:
    """A folder of JSON lines, nulls written; with an order, one file in it."""
    text = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"), *(order or []))
    text = text.orderBy(*order).coalesce(1).select("value") if order else text
    text.write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV with a header; quotes in cells are doubled, as read_csv expects."""
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_with_manifest(df: DataFrame, path: str, counts: DataFrame) -> None:
    """Parquet rows in path/rows and a one-file manifest in path/manifest."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_summary_json(summary: DataFrame, rows: DataFrame, path: str, order: list) -> None:
    """{"summary": ..., "rows": [...]} of a one-row frame and all rows of another, in order, as one file in a folder: one line for the summary, one for each row. The driver sees no row."""
    text = lambda df: F.to_json(F.struct(*(F.col(c) for c in df.columns)), {"ignoreNullFields": "false"})
    at = lambda part, n: F.struct(F.lit(part).alias("part"), n.cast("long").alias("n")).alias("at")
    head = summary.select(F.concat(F.lit('{"summary": '), text(summary), F.lit(', "rows": [')).alias("value"), at(0, F.lit(0)))
    place = F.row_number().over(Window.orderBy(*order))
    each = rows.select(text(rows).alias("value"), place.alias("k"))
    each = each.select(F.concat(F.when(F.col("k") > 1, ",").otherwise(""), "value").alias("value"), at(1, F.col("k")))
    end = summary.select(F.lit("]}").alias("value"), at(2, F.lit(0)))
    head.unionByName(each).unionByName(end).orderBy("at").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_markdown(summary: dict[str, object], rows: DataFrame, columns: list[str], path: str, order: list) -> None:
    """Bullets and a table of all rows, in order, as one file in a folder. Bars become slashes and line ends blanks; cells are whole. The driver sees no row."""
    spark = rows.sparkSession
    cell = lambda c: F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "|\n\r", "/  ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    top = [*(f"- {k}: {v}" for k, v in summary.items()), "", f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
    head = spark.createDataFrame([(i - len(top), x) for i, x in enumerate(top)], "n bigint, value string")
    body = rows.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("n"), line.alias("value"))
    head.unionByName(body).orderBy("n").coalesce(1).select("value").write.mode("overwrite").text(path)


def choice_docs(rows: DataFrame) -> DataFrame:
    """Multiple-choice rows (id, question, A, B, C, D, answer, category) as (id, query, choices, gold, category); gold counts from 0."""
    gold = F.array_position(F.array(*map(F.lit, "ABCD")), F.col("answer")) - 1
    return rows.select("id", F.col("question").alias("query"), F.array("A", "B", "C", "D").alias("choices"), gold.cast("int").alias("gold"), "category")
