"""Line dedup: lines that many documents share stay in one of them.

Lines are exploded and normalised, hashed to 128 bits, documents are counted per hash, and the kept lines are
put together again by position. Only hashes and ids are shuffled for the count; the text moves once, to meet the
positions of its dropped lines, so that work grows with a document's lines however many of them go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.llm.common import BLANK, ascii_lower, pair_hash, table

#: A shared line's documents are spread over at least this many groups, and more where the session has more shuffle partitions, so a line that a third of all documents hold isn't one task's work.
SALTS = 16


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    high, low = pair_hash(key)
    return F.struct(high.alias("a"), low.alias("b"))


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, suffix: str = ""
) -> DataFrame:
    """df's columns with text_col reduced to the kept lines, and n_lines, n_dropped (+ suffix).

    A line counts from min_chars code points of its key on. Keys found in min_docs or more documents (distinct
    ids) lose all their lines but those in the largest id that holds the key.
    Null or empty text: one empty line, which stays. Rows with the same id are one document for the counts and
    each keeps its row; a null id counts as no document and is never the largest. Empty input: empty result.
    Columns of df named n_lines or n_dropped are replaced (choose a suffix to keep them); other columns pass through.
    """
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    salts = max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    keyed = F.transform(_lines(text), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("at")))
    long = F.filter(keyed, lambda s: F.length(s["k"]) >= min_chars)
    # Rows may have the same id: a position belongs to an id and a text. The text is hashed below explode(), once a row and not once a
    # line; what is exploded is no mere column, or else Spark adds a filter that finds all lines another time.
    marked = df.select(doc.alias("__doc"), F.xxhash64(text).alias("__text"), long.alias("__m"))
    marks = F.transform("__m", lambda s: F.struct(_hash(s["k"]).alias("h"), s["at"].alias("at")))
    pairs = marked.select("__doc", "__text", F.explode(marks).alias("m")).select("__doc", "__text", "m.h.a", "m.h.b", "m.at")
    shared = (
        pairs.groupBy("a", "b")
        .agg(F.countDistinct("__doc").alias("n"), F.max("__doc").alias("__last"))
        .filter(F.col("n") >= min_docs)
        .select("a", "b", "__last", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    dropped = (
        pairs.withColumn("salt", F.pmod(F.xxhash64("__doc"), F.lit(salts)).cast("int"))
        .hint("merge")
        .join(shared, ["a", "b", "salt"])
        .filter(~F.col("__doc").eqNullSafe(F.col("__last")))
        .groupBy("__doc", "__text")
        .agg(F.collect_list("at").alias("__gone"))
    )
    rows = df.join(dropped, doc.eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__text")), "left").withColumn("__lines", _lines(text))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.transform(stay, lambda i: F.get(F.col("__lines"), i)))
    # Lines are referred to more than once here, so they are split once, not for each line.
    rows = rows.withColumns({"__kept": kept, "__n": F.size("__lines").cast("long")})
    out = rows.withColumns(
        {f"n_lines{suffix}": F.col("__n"), f"n_dropped{suffix}": F.col("__n") - F.size("__kept"), text_col: F.array_join("__kept", "\n")}
    )
    return out.drop("__doc", "__text", "__gone", "__lines", "__kept", "__n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM parts
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, coalesce(last <> doc_id, false) AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
