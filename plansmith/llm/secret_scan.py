"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed (SHA-256). The ledger is a table under a name of its own, to which each run
appends: only blobs that it doesn't hold for the current rule version are scanned, once each however many paths share
them; findings are then joined back to all paths. However many runs there were, the plan reads one table.
Spans come from built-in functions alone: the pieces that split() leaves between matches and the matches of
regexp_extract_all() alternate, so running lengths give each match's place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.llm.common import fresh_path, settled, table


@dataclass(frozen=True)
class Rule:
    """kind; pattern; gate: a literal that every match holds, to skip texts cheaply; group of min_chars characters at least (0: the match)."""

    kind: str
    pattern: str
    gate: str | None = None
    group: int = 0
    min_chars: int = 0


#: A private key goes up to its END line, past headers with single hyphens; without one, to the end of its base64 lines.
_KEY = "[A-Z ]{0,40}PRIVATE KEY-----"
_LINES = r"[\x20\t]*\r?\n[A-Za-z0-9+/=]{16,}[A-Za-z0-9+/=\r\n]*(?:\n|\z)"
#: Kinds in the order in which spans with the same start are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, min_chars=8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", "AKIA"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", rf"-----BEGIN {_KEY}(?:[^-]*(?:-{{1,4}}[^-]+){{0,12}}-----END {_KEY}|{_LINES})?", "PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
)
BASE = ("assign", "access", "hex")
#: Goes up with every change of RULES, so that stored blobs are scanned again.
RULE_VERSION = 3
#: Groups in which the paths of a blob meet its findings, and parts in which the query's documents arrive.
SALTS, DELIVERIES = 16, 2
LEDGER = "blob string, rule_version int, spans array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    steps = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), checked.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(
            end.alias("at"), F.when(F.length(x["part"]) >= rule.min_chars, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans")
        )

    spans = F.aggregate(steps, start, step)["spans"]
    hit = text.rlike(rule.pattern) if rule.gate is None else text.contains(rule.gate) & text.rlike(rule.pattern)
    return F.when(hit, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rule_version, spans in order of start, then kind) of blobs (blob, text)."""
    spans = F.array_sort(F.concat(*(_spans(F.col("text"), r, i) for i, r in enumerate(rules))))
    return blobs.select("blob", F.lit(version).alias("rule_version"), spans.alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows of all runs so far; none where there was no run."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(versions: DataFrame, path: str | None = None, text_col: str = "text", version: int = RULE_VERSION) -> str:
    """Scans what the ledger at path has not seen of versions under this rule version, and appends it; returns the path (a new one without).

    Copies meet by hash before the scan; of each only one text moves. Nulls are scanned as empty texts. Rows of older
    rule versions stay. Empty input: the ledger as it was. One run at a time may write to a ledger; a run that
    fails adds nothing.
    """
    spark = versions.sparkSession
    path = path or fresh_path(spark, "ledger")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    seen = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    ledger = read_ledger(spark, path)
    known = ledger.filter(F.col("rule_version") == version).select("blob")
    seen = seen.join(known, "blob", "left_anti") if known.limit(1).count() else seen
    with settled(spark):
        scan_blobs(seen.groupBy("blob").agg(F.first("text").alias("text")), version=version).write.mode("append").parquet(path)
    return path


def join_findings(df: DataFrame, path: str, text_col: str = "text", version: int = RULE_VERSION) -> DataFrame:
    """df with secret_spans from the ledger at path; texts that it doesn't hold have none."""
    ledger = read_ledger(df.sparkSession, path)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__b")
    found = ledger.filter((F.col("rule_version") == version) & (F.size("spans") > 0)).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"), salts)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # Paths of one blob with findings may be many: they meet it in as many places as there are salts.
    rows = df.withColumns({"__at": F.sha2(text, 256), "__a": F.pmod(F.spark_partition_id(), F.lit(SALTS))})
    rows = rows.join(found, (F.col("__at") == F.col("__blob")) & (F.col("__a") == F.col("__b")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.withColumn("secret_spans", F.coalesce("__spans", none)).drop("__at", "__a", "__blob", "__spans", "__b")


def find_secrets(df: DataFrame, text_col: str = "text", path: str | None = None, version: int = RULE_VERSION) -> tuple[DataFrame, str]:
    """(df with a column secret_spans, the path of the updated ledger).

    secret_spans: array of (start, kind as an index of RULES, end), in code points, end exclusive; empty for none and
    for null or empty texts. All rows pass through, repeated ones too; a column secret_spans of df is replaced.
    """
    path = update_ledger(df, path, text_col, version)
    return join_findings(df, path, text_col, version), path


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in RULES))
    kept = spans if kinds is None else F.filter(spans, lambda s: F.element_at(names, s["kind"] + 1).isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each span, or run of overlapping spans, replaced by mark. Null text stays null."""

    def step(acc: Column, s: Column) -> Column:
        """at: end of what is dealt with."""
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        )

    done = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in DELIVERIES parts, as the versions of a history do; each is scanned against the ledger that those before it left, and findings are joined to all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = fresh_path(spark, "ledger")
    for part in range(DELIVERIES):
        update_ledger(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(DELIVERIES)) == part), path)
    rows = join_findings(docs, path)
    spans = F.col("secret_spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == BASE.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, BASE), F.sha2(listed(spans, BASE), 256).alias("base_sha256"), listed(spans).alias("spans"))


def _sql_kind(ordinal: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {ordinal} AS o, '{rule.kind}' AS kind, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits,
    regexp_extract_all(t, '{p}', {rule.group}) AS parts, {rule.min_chars} AS least FROM docs WHERE regexp_matches(t, '{p}')"""


ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_sql_kind(i, r) for i, r in enumerate(RULES))}),
each AS (SELECT doc_id, o, kind, least, gaps, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM found),
placed AS (
  SELECT doc_id, o, kind, hits[i] AS hit,
    CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM each WHERE length(parts[i]) >= least
),
texts AS (SELECT doc_id, o, s, kind || ':' || s || ':' || (s + length(hit)) AS x FROM placed)
SELECT d.doc_id, CAST(count(*) FILTER (WHERE o = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (WHERE o = 1) AS BIGINT) AS n_access,
  CAST(count(*) FILTER (WHERE o = 2) AS BIGINT) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY s, o) FILTER (WHERE o <= 2), '')) AS base_sha256,
  coalesce(string_agg(x, ',' ORDER BY s, o), '') AS spans
FROM docs d LEFT JOIN texts USING (doc_id) GROUP BY d.doc_id
"""
