"""Registered queries over whole tables of cards, answers, records and files, with their SQL counterparts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.catalog import query
from plansmith.functions import normalize as N
from plansmith.functions import salvage, short_schema
from plansmith.functions.hints import Hints, hints
from plansmith.functions.registry import PROTEIN
from plansmith.operators import compile as batch
from plansmith.operators import datasets, evaluate, records, snapshot
from plansmith.operators.entities import SQL_PARTS, part_candidates
from plansmith.plans import prompts
from plansmith.plans.model import Filter, Plan
from plansmith.session import load, spread
from plansmith.sources import files
from plansmith.streaming.filters import follow


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or a temporary one on a local master."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return f"{at.rstrip('/')}/files-{uuid.uuid4().hex}"


# ---- cards ----


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text card for every part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    word = F.element_at(F.array(F.lit("yes"), F.lit("No"), F.lit("n/a")), (k % 3 + 1).cast("int"))
    lines = [
        F.concat(F.lit("Protein ID: P"), k), F.concat(F.lit("Canonical Name: "), "p_name"), F.when(size % 4 != 0, F.concat(F.lit("Organism: "), "p_brand")), F.lit("Domains:"),
        F.concat(F.lit("- scaffold="), "p_type", F.lit(";engineered="), word), F.lit("CMC / Developability:"),
        F.concat(F.lit("- oral="), F.when(size % 7 == 0, "unknown").when(size <= 25, "Low").otherwise("High"), F.lit("; expression=E. coli;stability="), size.cast("string")),
        F.when(k % 5 < 2, F.lit("Interactions:")), F.when(k % 5 == 0, F.lit("- inhibitory=yes;x")).when(k % 5 == 1, F.lit("- inhibitory=no")),
        F.when(k % 6 == 0, F.lit("Affinity:")), F.when(k % 6 == 0, F.concat(F.lit("- KD "), size, F.lit(" nM (Experimental)"))),
    ]
    ids = F.when(k % 10 == 0, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>"))
    meta = F.struct(F.lit("").alias("protein_id"), ids.alias("interaction_ids"), F.array(F.lit("part")).alias("table_sources"))
    return load(spark, sf_dir, "part").select(F.concat(F.lit("c"), k).alias("chunk_id"), F.lit("cards").alias("source"), F.concat_ws("\n", *lines).alias("content"), meta.alias("metadata"))


def _interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for every returned line item."""
    items = load(spark, sf_dir, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08))
    said = F.concat(F.lit("Is Inhibitor: "), F.when(F.col("l_linestatus") == "F", "Yes").otherwise("No"), F.lit("\n- Kd "), F.col("l_quantity").cast("int"), F.lit(" (Experimental)"))
    name = F.concat_ws("-", F.lit("i"), "l_orderkey", "l_linenumber", "l_suppkey")
    return items.select(name.alias("interaction_id"), said.alias("content"), F.struct(F.concat(F.lit("P"), "l_partkey").alias("protein_id")).alias("metadata"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.snapshot(_cards(spark, sf_dir), _interactions(spark, sf_dir))


_SQL_MET = """met AS (SELECT l_partkey, min(l_quantity) AS q, bool_or(l_linestatus = 'F') AS f, string_agg(x, ',' ORDER BY x) AS ids FROM (
  SELECT *, 'i-' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS x FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.08) GROUP BY l_partkey)"""


@query(f"""WITH {_SQL_MET} SELECT 'P' || p_partkey AS candidate_id, p_name AS canonical_name, CASE WHEN p_size % 4 = 0 THEN 'Unknown' ELSE p_brand END AS organism, p_type AS scaffold_type,
CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS engineered, CASE WHEN p_size % 7 = 0 THEN 'Unknown' WHEN p_size <= 25 THEN 'Low' ELSE 'High' END AS oral_class,
'E. coli' AS expression_system, CAST(p_size AS VARCHAR) AS stability_signal, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE f END AS inhibitory,
p_partkey % 6 = 0 OR q IS NOT NULL AS has_experimental_affinity, CAST(CASE WHEN p_partkey % 6 = 0 THEN p_size ELSE q END AS DOUBLE) AS best_affinity_value FROM part LEFT JOIN met ON p_partkey = l_partkey""")
def snapshot_build(spark, sf_dir):
    return _snapshot(spark, sf_dir).drop("trace")


@query(f"""WITH {_SQL_MET} SELECT 'P' || p_partkey AS candidate_id, CASE WHEN p_partkey % 10 = 0 THEN 'own' ELSE coalesce(ids, '') END AS ids, 'part' AS tables, 'cards' AS card_source
FROM part LEFT JOIN met ON p_partkey = l_partkey""")
def snapshot_provenance(spark, sf_dir):
    t = F.col("trace")
    return _snapshot(spark, sf_dir).select("candidate_id", F.array_join(F.array_sort(t["interaction_ids"]), ",").alias("ids"), F.array_join(t["table_sources"], ",").alias("tables"), t["card_source"].alias("card_source"))


@query(f"""WITH {_SQL_MET} SELECT 'P' || l_partkey AS key, f AS inhibits, CAST(q AS DOUBLE) AS value, true AS tested FROM met""")
def tri_state_any(spark, sf_dir):
    return snapshot.signals(_interactions(spark, sf_dir)).drop("ids")


@query("""SELECT 'c' || p_partkey AS chunk_id, p_name AS name, 2 + CAST(p_size % 4 <> 0 AS INT) AS scalars, 'Domains>scaffold=' || p_type || ';engineered=' || ['yes', 'No', 'n/a'][CAST(p_partkey % 3 + 1 AS INT)] AS first_item,
2 + CAST(p_partkey % 5 < 2 AS INT) + CAST(p_partkey % 6 = 0 AS INT) AS items FROM part""")
def card_parse(spark, sf_dir):
    card = F.col("card")
    rows = spread(_cards(spark, sf_dir)).withColumn("card", snapshot.parsed(F.col("content")))
    first = F.get(card["items"], F.lit(0))
    return rows.select("chunk_id", card["scalars"]["Canonical Name"].alias("name"), F.size(card["scalars"]).alias("scalars"), F.concat_ws(">", first["section"], first["item"]).alias("first_item"), F.size(card["items"]).alias("items"))


# ---- answers ----


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with an answer in one of six shapes, right and wrong ones."""
    rows, m = part_candidates(spark, sf_dir), F.col("candidate_id") % 6
    said = (
        F.when(m == 0, F.concat(F.lit('{"oral_class":"'), F.lower("oral_class"), F.lit('","engineered":"yes","limit":"7"}')))
        .when(m == 1, F.concat(F.lit('{"filters":[{"field":"oral","op":"=","value":"'), F.upper("oral_class"), F.lit('"},{"field":"price","op":"=","value":1}],"sort":[{"field":"affinity","direction":"strongest"}],"limit":0}')))
        .when(m == 2, F.lit('{"filters":[{"field":"price","op":"=","value":1}],"limit":3}'))
        .when(m == 3, F.lit('{"oral_class":"Huge","organism":"n/a","limit":5}'))
        .when(m == 4, F.lit("no json here"))
        .otherwise(F.lit('Sure:\n```json\n{"oral_class":"High","has_experimental_affinity":true,"sort_by":"affinity","sort_dir":"descending","limit":4}\n```\nDone.'))
    )
    return rows.withColumn("answer", said)


@query(f"""WITH {SQL_PARTS} SELECT candidate_id, CASE candidate_id % 6 WHEN 0 THEN 'oral_class eq "' || oral_class || '"; engineered eq true' WHEN 1 THEN 'oral_class eq "' || oral_class || '"'
WHEN 5 THEN 'oral_class eq "High"; has_experimental_affinity eq true' ELSE '' END AS filters, CASE candidate_id % 6 WHEN 1 THEN 'best_affinity_value asc' WHEN 5 THEN 'best_affinity_value desc' ELSE '' END AS sorts,
CAST([7, 20, 3, 5, 20, 4][CAST(candidate_id % 6 + 1 AS INT)] AS INT) AS n_limit, ['', 'invalid_limit', 'empty_filters', 'invalid_slot_value,empty_filters', 'parse_failed,missing_filters,empty_filters', ''][CAST(candidate_id % 6 + 1 AS INT)] AS errors,
CASE WHEN candidate_id % 6 IN (0, 3, 5) THEN 'sketch' ELSE 'plan' END AS form, candidate_id % 6 IN (0, 5) AS schema_ok FROM snap""")
def validate_batch(spark, sf_dir):
    done = batch.validate_batch(_answers(spark, sf_dir), "answer")
    filters = F.transform("plan.filters", lambda f: F.concat_ws(" ", f["field"], f["op"], f["value"]))
    sorts = F.transform("plan.sort", lambda s: F.concat_ws(" ", s["field"], s["direction"]))
    return done.select(
        "candidate_id", F.array_join(filters, "; ").alias("filters"), F.array_join(sorts, "; ").alias("sorts"), F.col("plan.limit").alias("n_limit"), F.array_join("trace.errors", ",").alias("errors"), "trace.form", "trace.schema_ok"
    )


def _flat(oral, engineered, limit) -> F.Column:
    return F.concat(F.lit('{"oral_class":"'), oral, F.lit('","engineered":'), engineered.cast("string"), F.lit(',"limit":'), limit.cast("string"), F.lit("}"))


@query(f"""WITH {SQL_PARTS}, a AS (SELECT *, candidate_id % 4 AS m, CAST(candidate_id % 30 + 1 AS INT) AS n FROM snap)
SELECT candidate_id, oral_class, engineered, n AS n_limit, m IN (1, 3) AS repair_attempted, m = 1 AS used_repair, m IN (2, 3) AS used_projection,
CASE m WHEN 0 THEN '' WHEN 1 THEN 'semantic_mismatch_limit' WHEN 3 THEN 'semantic_mismatch_engineered'
ELSE 'parse_failed,missing_filters,empty_filters,semantic_mismatch_oral_class,semantic_mismatch_engineered' || CASE WHEN n = 20 THEN '' ELSE ',semantic_mismatch_limit' END END AS reasons FROM a""")
def finalize_batch(spark, sf_dir):
    """Right at once; repaired; beyond repair, so that the request's own words decide; repaired no better."""
    m, n, oral, engineered = F.col("candidate_id") % 4, (F.col("candidate_id") % 30 + 1).cast("int"), F.col("oral_class"), F.col("engineered")
    right, off = _flat(oral, engineered, n), _flat(oral, ~engineered, n)
    prompt = F.concat(F.lit("Find oral "), F.lower(oral), F.lit(" candidates, "), F.when(engineered, "engineered").otherwise("non-engineered"), F.lit(", limit "), n.cast("string"))
    first = F.when(m == 0, right).when(m == 1, _flat(oral, engineered, n + 1)).when(m == 2, F.lit("I can't tell")).otherwise(off)
    rows = part_candidates(spark, sf_dir).withColumns({"prompt": prompt, "first": first, "repaired": F.when(m == 1, right).when(m == 3, off)})
    done = batch.finalize_batch(rows.select("candidate_id", "prompt", "first", "repaired"), "prompt", "first", "repaired")
    value = lambda name: F.get(F.filter("plan.filters", lambda f: f["field"] == name), F.lit(0))["value"]
    return done.select(
        "candidate_id", F.btrim(value("oral_class"), F.lit('"')).alias("oral_class"), value("engineered").cast("boolean").alias("engineered"), F.col("plan.limit").alias("n_limit"), "repair_attempted", "used_repair", "used_projection",
        F.array_join("repair_reasons", ",").alias("reasons"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold plan for every part, and an answer with some things wrong."""
    rows, i = spread(part_candidates(spark, sf_dir)), F.col("candidate_id")
    limit = F.element_at(F.array(F.lit(5), F.lit(10), F.lit(20)), (i % 3 + 1).cast("int"))

    def plan(oral):
        text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        filters = F.array(F.struct(F.lit("oral_class").alias("field"), F.lit("eq").alias("op"), text(oral).alias("value")), F.struct(F.lit("engineered").alias("field"), F.lit("eq").alias("op"), F.col("engineered").cast("string").alias("value")))
        sort = F.array(F.struct(F.lit("best_affinity_value").alias("field"), F.lit("asc").alias("direction")))
        return F.struct(F.lit(PROTEIN.intent).alias("intent"), F.lit(PROTEIN.name).alias("entity"), filters.alias("filters"), sort.alias("sort"), limit.alias("limit"), F.array().cast("array<string>").alias("return_fields"))

    said = F.when(i % 11 != 0, plan(F.when(i % 3 == 0, F.lit("High")).otherwise(F.col("oral_class"))))
    answers = rows.select(i.alias("plan_id"), plan(F.col("oral_class")).alias("gold"), said.alias("plan"), (i % 13 != 0).alias("parsed"))
    return batch.score_batch(answers, rows)


_SQL_SCORED = f"""{SQL_PARTS}, p AS (SELECT candidate_id AS plan_id, oral_class, engineered, CASE WHEN candidate_id % 3 = 0 THEN 'High' ELSE oral_class END AS said, [5, 10, 20][CAST(candidate_id % 3 + 1 AS INT)] AS k FROM snap),
r AS (SELECT oral_class, engineered, candidate_id, row_number() OVER (PARTITION BY oral_class, engineered ORDER BY best_affinity_value NULLS LAST, candidate_id) AS r FROM snap),
gold AS (SELECT plan_id, candidate_id FROM p JOIN r ON p.oral_class = r.oral_class AND p.engineered = r.engineered AND r <= k),
found AS (SELECT plan_id, candidate_id FROM p JOIN r ON p.said = r.oral_class AND p.engineered = r.engineered AND r <= k WHERE plan_id % 11 <> 0),
both_ AS (SELECT plan_id, count(*) AS c FROM gold JOIN found USING (plan_id, candidate_id) GROUP BY plan_id), n AS (SELECT plan_id, count(*) AS g FROM gold GROUP BY plan_id),
scores AS (SELECT plan_id, plan_id % 11 <> 0 AS draft_valid, plan_id % 13 <> 0 AS json_parsed, plan_id % 11 <> 0 AS non_empty_filter,
CAST(CASE WHEN plan_id % 11 = 0 THEN 0 WHEN oral_class = said THEN 1 ELSE 0.5 END AS DOUBLE) AS field_value_exact_match, CAST(CASE WHEN plan_id % 11 = 0 THEN 0 WHEN oral_class = said THEN 1 ELSE 0.8333 END AS DOUBLE) AS slot_accuracy,
plan_id % 11 <> 0 AS execution_success, CASE WHEN plan_id % 11 = 0 THEN 0.0 ELSE round_even(coalesce(c, 0) / g, 4) END AS result_overlap_at_k FROM p LEFT JOIN n USING (plan_id) LEFT JOIN both_ USING (plan_id))"""


@query(f"WITH {_SQL_SCORED} SELECT * FROM scores")
def score_batch(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(f"WITH {_SQL_SCORED} SELECT plan_id, field_value_exact_match, slot_accuracy FROM scores")
def slot_accuracy(spark, sf_dir):
    return _scored(spark, sf_dir).select("plan_id", "field_value_exact_match", "slot_accuracy")


@query(f"""WITH {_SQL_SCORED} SELECT round_even(count(*) FILTER (WHERE draft_valid) / count(*), 4) AS plan_valid_rate, round_even(count(*) FILTER (WHERE json_parsed) / count(*), 4) AS json_parse_rate,
round_even(count(*) FILTER (WHERE non_empty_filter) / count(*), 4) AS non_empty_filter_rate, round_even(avg(field_value_exact_match), 4) AS field_value_exact_match, round_even(avg(slot_accuracy), 4) AS slot_accuracy,
round_even(count(*) FILTER (WHERE execution_success) / count(*), 4) AS execution_success_rate, round_even(avg(result_overlap_at_k), 4) AS result_overlap_at_k FROM scores""")
def score_summary(spark, sf_dir):
    return evaluate.summarize(_scored(spark, sf_dir))


@query(f"""WITH {_SQL_SCORED} SELECT plan_id, json_parsed AND field_value_exact_match = 1 AND slot_accuracy = 1 AND result_overlap_at_k = 1 AS perfect, NOT execution_success OR result_overlap_at_k = 0 AS failed FROM scores""")
def perfect_and_failed(spark, sf_dir):
    return _scored(spark, sf_dir).select("plan_id", evaluate.perfect().alias("perfect"), evaluate.is_failed().alias("failed"))


@query(f"""WITH {SQL_PARTS}, x AS (
SELECT 0 AS plan_id, candidate_id, row_number() OVER (ORDER BY best_affinity_value DESC NULLS FIRST, candidate_id) AS r, 7 AS k FROM snap WHERE oral_class IN ('High', 'Low')
UNION ALL SELECT 1, candidate_id, row_number() OVER (ORDER BY best_affinity_value NULLS LAST, candidate_id), 10 FROM snap WHERE best_affinity_value >= 1000 AND engineered
UNION ALL SELECT 2, candidate_id, row_number() OVER (ORDER BY candidate_id), 9 FROM snap WHERE best_affinity_value IS NOT NULL
UNION ALL SELECT 3, candidate_id, row_number() OVER (ORDER BY oral_class DESC NULLS FIRST, candidate_id), 12 FROM snap WHERE best_affinity_value <= 1500
UNION ALL SELECT 4, candidate_id, row_number() OVER (ORDER BY best_affinity_value NULLS LAST, candidate_id), 6 FROM snap)
SELECT CAST(plan_id AS INT) AS plan_id, CAST(r AS INT) AS rank, candidate_id FROM x WHERE r <= k""")
def execute_batch(spark, sf_dir):
    rows = part_candidates(spark, sf_dir)
    up, down = [("best_affinity_value", "asc")], [("best_affinity_value", "desc")]
    plans = [
        (0, [("oral_class", "in", '["High","Low","High"]')], down, 7), (1, [("best_affinity_value", "gte", "1000"), ("engineered", "eq", "true")], up, 10), (2, [("best_affinity_value", "exists", None)], [], 9),
        (3, [("best_affinity_value", "lte", "1500.0")], [("oral_class", "desc")], 12), (4, [], up, 6), (5, [("oral_class", "eq", "7")], [], 5), (6, [("price", "eq", "7")], [], 5),
    ]
    plans = spark.createDataFrame([(i, ("s", "e", f, s, n, [])) for i, f, s, n in plans], f"plan_id int, plan {batch.PLAN}")
    return batch.execute_batch(rows, plans)


@query("""WITH a AS (SELECT event_id, event_id % 6 AS m, TRY_CAST(props ->> '$.k' AS INT) AS k FROM events)
SELECT event_id, CASE WHEN m = 5 THEN NULL WHEN m = 4 OR (m = 3 AND k <= 0) THEN 20 ELSE k END AS n_limit, CASE m WHEN 0 THEN 'High' WHEN 1 THEN 'Low' WHEN 2 THEN NULL WHEN 3 THEN 'Medium' WHEN 4 THEN 'High' END AS oral FROM a""")
def draft_parse_variant(spark, sf_dir):
    """Whole; fenced; behind prose; cut off with misspelt keys; loose pairs without a limit; nothing."""
    k, m = F.try_variant_get(F.try_parse_json("props"), "$.k", "int").cast("string"), F.col("event_id") % 6
    said = (
        F.when(m == 0, F.concat(F.lit('{"oral_class":"High","limit":'), k, F.lit("}"))).when(m == 1, F.concat(F.lit('Here\n```json\n{"limit":'), k, F.lit(',"oral_class":"Low"}\n``` there')))
        .when(m == 2, F.concat(F.lit('as asked {"a": [1, {"b": 2}]} and {"limit": '), k, F.lit("} so"))).when(m == 3, F.concat(F.lit('{"limit":'), k, F.lit(',"higheral_class":"Medium","engimber_":tru')))
        .when(m == 4, F.lit('"oral class": "High", "engineered": fal')).otherwise(F.lit("nothing"))
    )
    draft = F.parse_json(salvage.draft_json(said))
    return load(spark, sf_dir, "events").select("event_id", F.variant_get(draft, "$.limit", "int").alias("n_limit"), F.variant_get(draft, "$.oral_class", "string").alias("oral"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'no repair hints available' WHEN 1 THEN 'the JSON is malformed or truncated; limit must match the request (7)'
WHEN 2 THEN 'oral_class must match the request oral level (High); engineered must be false because the request says non-engineered' ELSE 'limit must be a positive integer; wrapped prose' END AS issues FROM nation""")
def issue_texts(spark, sf_dir):
    m = F.col("n_nationkey") % 4
    codes = F.when(m == 0, F.array().cast("array<string>")).when(m == 1, F.array(F.lit("parse_failed"), F.lit("semantic_mismatch_limit"), F.lit("parse_failed"))).when(m == 2, F.array(F.lit("semantic_mismatch_oral_class"), F.lit("semantic_mismatch_engineered")))
    codes = codes.otherwise(F.array(F.lit("invalid_limit"), F.lit("wrapped_prose")))
    asked: Hints = hints(F.lit("oral high, non-engineered, limit 7"))
    return load(spark, sf_dir, "nation").select("n_nationkey", prompts.issues(codes, asked).alias("issues"))


@query("""SELECT n_nationkey, 'user' AS role, 'Req: Only ' || n_name || chr(10) || 'JSON only.' AS wrapped, 'Only ' || n_name AS bare, 3 AS messages, 'assistant' AS last_role, n_name AS last_content FROM nation""")
def chat_rows(spark, sf_dir):
    request = F.concat(F.lit("Only "), "n_name")
    wrapped, bare = prompts.messages(request, with_hints=False), prompts.messages(request, with_hints=False, wrap=False)
    made = prompts.chat(request, F.col("n_name"), with_hints=False)
    return load(spark, sf_dir, "nation").select(
        "n_nationkey", wrapped[1]["role"].alias("role"), wrapped[1]["content"].alias("wrapped"), bare[1]["content"].alias("bare"), F.size(made).alias("messages"), F.element_at(made, -1)["role"].alias("last_role"),
        F.element_at(made, -1)["content"].alias("last_content"),
    )


# ---- rules ----


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CASE c_custkey % 4 WHEN 1 THEN c_name ELSE 'x' END END AS kept, CASE WHEN c_custkey % 4 = 1 THEN c_name END AS first_said,
CASE WHEN c_custkey % 4 = 1 THEN 'v' || c_nationkey END AS matched FROM customer""")
def text_rules(spark, sf_dir):
    m = F.col("c_custkey") % 4
    said = F.when(m == 0, " N/A ").when(m == 1, F.col("c_name")).otherwise("x")
    values = F.array(F.lit("n/a"), F.lit(None).cast("string"), F.lit("Unknown"), F.when(m == 1, F.col("c_name")).otherwise(""))
    text = F.concat(F.lit("KIND="), F.when(m == 1, F.concat(F.lit(" v"), "c_nationkey", F.lit(" ;rest"))).otherwise(""))
    return load(spark, sf_dir, "customer").select("c_custkey", N.unblank(said, PROTEIN).alias("kept"), N.first_said(values).alias("first_said"), N.first_match(F.when(m == 1, text), "kind=([^;]+)").alias("matched"))


# ---- datasets ----


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_candidates(spark, sf_dir).withColumn("candidate_id", F.col("candidate_id").cast("string")).withColumn("organism", F.lit("Unknown"))
    null = F.lit(None).cast("string")
    plan = F.struct(
        null.alias("candidate_id"), null.alias("scaffold_type"), F.when(F.col("_pos") % 2 == 0, F.col("oral_class")).alias("oral_class"), F.col("engineered"), F.when(F.col("has_experimental_affinity"), True).alias("has_experimental_affinity"),
        null.alias("organism"), F.when(F.col("_pos") % 3 == 0, "best_affinity_value").alias("sort_by"), F.when(F.col("_pos") % 3 == 0, "asc").alias("sort_dir"), (F.col("_pos") % 2 * 5 + 5).cast("int").alias("limit"),
    )
    return rows.withColumn("plan", plan)


_SQL_FLAT = """'{"candidate_id":null,"scaffold_type":null,"oral_class":' || CASE WHEN candidate_id % 2 = 0 THEN '"' || oral_class || '"' ELSE 'null' END || ',"engineered":' || CASE WHEN engineered THEN 'true' ELSE 'false' END
|| ',"has_experimental_affinity":' || CASE WHEN has_experimental_affinity THEN 'true' ELSE 'null' END || ',"organism":null,"sort_by":' || CASE WHEN candidate_id % 3 = 0 THEN '"best_affinity_value","sort_dir":"asc"' ELSE 'null,"sort_dir":null' END
|| ',"limit":' || CASE WHEN candidate_id % 2 = 0 THEN '5' ELSE '10' END || '}'"""


@query(f"WITH {SQL_PARTS} SELECT candidate_id, {_SQL_FLAT} AS json FROM snap")
def plan_json_text(spark, sf_dir):
    return _planned(spark, sf_dir).select(F.col("_pos").alias("candidate_id"), datasets.plan_json(F.col("plan")).alias("json"))


@query(f"""WITH {SQL_PARTS} SELECT candidate_id, 8 + CASE WHEN candidate_id % 2 = 0 THEN 5 ELSE 0 END + 4 + CASE WHEN has_experimental_affinity THEN 3 ELSE 0 END + CASE WHEN candidate_id % 3 = 0 THEN 3 ELSE 0 END AS cases,
{_SQL_FLAT} AS wanted, 2 AS chats FROM snap""")
def repair_rows(spark, sf_dir):
    rows = _planned(spark, sf_dir).withColumn("prompt", F.lit("Find oral high candidates"))
    chats = datasets.repair_chats(rows, 3, 2).groupBy("candidate_id").agg(F.count("*").cast("int").alias("chats"), F.min(F.element_at("conversations", -1)["content"]).alias("wanted"))
    out = rows.select("candidate_id", F.col("_pos"), F.size(datasets.repair_cases(F.col("plan"))).alias("cases")).join(chats, "candidate_id")
    return out.select(F.col("_pos").alias("candidate_id"), "cases", "wanted", "chats")


@query(f"""WITH {SQL_PARTS} SELECT 'q' || candidate_id || '_var' || (v + 1) AS id, CAST((candidate_id * 2 + v) % 10 AS VARCHAR) AS corruption_family, {_SQL_FLAT} AS chosen, 3 AS messages, 'gold_plan_vs_rule_corruption' AS preference_source
FROM snap, (VALUES (0), (1)) t(v)""")
def preference_pairs(spark, sf_dir):
    rows = _planned(spark, sf_dir).withColumns({"id": F.concat(F.lit("q"), "candidate_id"), "prompt": F.lit("x")})
    pairs = datasets.preference_pairs(rows, variants=2)
    return pairs.select("id", "corruption_family", F.element_at("chosen", -1)["content"].alias("chosen"), F.size("rejected").alias("messages"), "preference_source")


@query(f"""WITH {SQL_PARTS} SELECT 'train' AS family, 2 * count(*) AS rows FROM snap UNION ALL SELECT 'engineered_bridge', 3 * count(*) FILTER (WHERE engineered) FROM snap
UNION ALL SELECT 'final_bridge', count(*) FILTER (WHERE has_experimental_affinity) FROM snap""")
def family_union(spark, sf_dir):
    return datasets.manifest(datasets.training_chats(_planned(spark, sf_dir).drop("plan"), 5, {"train": 2, "engineered_bridge": 3, "final_bridge": 1, "hard": 0}))


@query("""SELECT 'train' AS part, least(count(*), 50) AS rows FROM customer UNION ALL SELECT 'dev', 30 FROM customer HAVING count(*) >= 80 UNION ALL SELECT 'rest', count(*) - 80 FROM customer HAVING count(*) > 80""")
def seeded_split(spark, sf_dir):
    return datasets.split(load(spark, sf_dir, "customer"), "c_custkey", 11, {"train": 50, "dev": 30}, "rest").groupBy("part").agg(F.count("*").alias("rows"))


@query("""SELECT 'dev_' || i AS id, 'dev' AS category FROM (SELECT unnest(range(1, 26)) AS i)""")
def holdout_ids(spark, sf_dir):
    return datasets.holdout(_planned(spark, sf_dir).drop("plan"), 5, "dev", 25, {"train": 50}).select("id", "category")


_CONV = """c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"""


@query(f"WITH {_CONV} SELECT conv_id, n AS turns, text AS last_text, role AS last_role FROM c WHERE i = n")
def last_message(spark, sf_dir):
    return datasets.conversation_parts(load(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turns", "last_text", "last_role")


@query(f"WITH {_CONV} SELECT conv_id, coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY i) FILTER (WHERE i < n), '') AS context FROM c GROUP BY conv_id")
def context_messages(spark, sf_dir):
    parts = datasets.conversation_parts(load(spark, sf_dir, "conversations"), "conv_id", "turn")
    return parts.select("conv_id", F.array_join(F.transform("context", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n").alias("context"))


# ---- records ----


def _antibodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of an antibody table: some fields blank or not there."""
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        F.col("p_name").alias("Proteins_canonical_name"), F.col("p_brand").alias("Targets_gene_name"), F.when(k % 4 == 0, " ").otherwise(F.col("p_type")).alias("epitope_domain"), k.cast("string").alias("pdb_id"),
        F.col("p_size").cast("double").alias("PDB_Resolution_A"), F.when(k % 3 != 0, F.concat(F.lit("s"), k)).alias("Sources_identifier"), F.concat(F.lit(" about "), "p_name").alias("Proteins_description"), F.lit("t").alias("Sources_title"),
        F.when(k % 5 != 0, F.concat(F.lit("yes "), k)).alias("GT_answer"), k.alias("_pos"),
    )


@query("""SELECT p_partkey, 'RecordType: AntibodyAntigenEvidence' || chr(10) || 'Antibody: ' || p_name || chr(10) || 'TargetLineage: ' || p_brand AS head, 8 AS lines,
CASE WHEN p_partkey % 3 = 0 THEN 'NA' ELSE 's' || p_partkey END AS source, CASE WHEN p_partkey % 4 = 0 THEN 'NA' ELSE p_type END AS domain FROM part""")
def record_rendering(spark, sf_dir):
    rows = _antibodies(spark, sf_dir)
    r = records.record(rows)
    text = records.short_output(r)
    return rows.select(F.col("_pos").alias("p_partkey"), F.array_join(F.slice(F.split(text, "\n"), 1, 3), "\n").alias("head"), F.size(F.split(text, "\n")).alias("lines"), r["source_id"].alias("source"), r["domain"].alias("domain"))


@query("""SELECT 'short' AS kind, 'train' AS part, count(*) - 6 AS records FROM part UNION ALL SELECT 'short', 'dev', 6 UNION ALL SELECT 'strict', 'train', count(*) - 6 FROM part UNION ALL SELECT 'strict', 'dev', 6
UNION ALL SELECT 'full', 'train', count(*) - 6 FROM part UNION ALL SELECT 'full', 'dev', 6""")
def template_explode(spark, sf_dir):
    """Records behind the prompts of each kind: every record once for each template."""
    rows, out = _antibodies(spark, sf_dir), None
    for kind, templates in (("short", records.SHORT_PROMPTS), ("strict", records.STRICT_PROMPTS), ("full", records.FULL_PROMPTS)):
        made = records.schema_rows(rows, kind)
        for part in ("train", "dev"):
            n = made[part].agg((F.count("*") / len(templates)).cast("long").alias("records")).select(F.lit(kind).alias("kind"), F.lit(part).alias("part"), "records")
            out = n if out is None else out.unionByName(n)
    return out


@query("""SELECT 2 * count(*) AS seeds, count(DISTINCT p_partkey) AS answers FROM part WHERE p_partkey % 5 <> 0""")
def interaction_seeds(spark, sf_dir):
    made = records.interaction_seeds(_antibodies(spark, sf_dir))
    said = F.regexp_extract(F.element_at("conversations", -1)["content"], r"yes (\d+)", 1)
    return made.agg(F.count("*").alias("seeds"), F.countDistinct(said).alias("answers"))


@query("""SELECT count(*) + count(*) FILTER (WHERE p_partkey < 25) AS seeds FROM part""")
def record_seeds(spark, sf_dir):
    return records.record_seeds(_antibodies(spark, sf_dir)).agg(F.count("*").alias("seeds"))


@query("""SELECT count(*) AS rows, round_even(avg(CASE p_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 7 ELSE 0 END), 4) AS mean_key_hits, round_even(count(*) FILTER (WHERE p_partkey % 3 = 0) / count(*), 4) AS exact_8_lines_rate,
round_even(count(*) FILTER (WHERE p_partkey % 3 < 2) / count(*), 4) AS recordtype_ok_rate, count(*) FILTER (WHERE p_partkey % 3 = 2) AS extra_text_rows, count(*) FILTER (WHERE p_partkey % 3 = 0) AS compliant_rows,
round_even(count(*) FILTER (WHERE p_partkey % 3 = 0) / count(*), 4) AS compliance_rate FROM part""")
def short_schema_totals(spark, sf_dir):
    rows = _antibodies(spark, sf_dir)
    whole, m = records.short_output(records.record(rows)), F.col("_pos") % 3
    text = F.when(m == 0, whole).when(m == 1, F.substring_index(whole, "\n", 7)).otherwise("nothing here")
    return short_schema.compliance_totals(rows.select(text.alias("answer")), "answer")


# ---- multiple choice and log probabilities ----


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return load(spark, sf_dir, "benchmark").select(
        i.alias("id"), F.md5("text").alias("question"), *(F.concat(F.lit(x), i).alias(x.upper()) for x in "abcd"), F.element_at(F.array(*map(F.lit, "ABCD")), (i % 4 + 1).cast("int")).alias("answer"),
        F.concat(F.lit("s"), i % 3).alias("subject"), F.concat(F.lit("s"), i % 3).alias("category"),
    )


_Q = """q AS (SELECT item_id AS id, md5(text) AS question, 'a' || item_id AS a, 'b' || item_id AS b, 'c' || item_id AS c, 'd' || item_id AS d, ['A', 'B', 'C', 'D'][CAST(item_id % 4 + 1 AS INT)] AS answer, 's' || item_id % 3 AS subject,
md5(text) || chr(10) || 'A. a' || item_id || chr(10) || 'B. b' || item_id || chr(10) || 'C. c' || item_id || chr(10) || 'D. d' || item_id || chr(10) || '答案：' AS shown FROM benchmark)"""


@query(f"WITH {_Q} SELECT id, question AS query, a || ',' || b || ',' || c || ',' || d AS choices, CAST(id % 4 AS INT) AS gold, subject AS category FROM q")
def choice_docs(spark, sf_dir):
    return files.choice_docs(_questions(spark, sf_dir)).withColumn("choices", F.array_join("choices", ","))


@query(f"""WITH {_Q}, s AS (SELECT subject, string_agg(shown || answer || chr(10), chr(10) || chr(10) ORDER BY id) AS shots FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY id) AS r FROM q) WHERE r <= 2 GROUP BY subject)
SELECT id, '以下是中国关于' || subject || '考试的单项选择题，请选出其中的正确答案。' || chr(10) || chr(10) || shots || chr(10) || chr(10) || shown AS prompt FROM q JOIN s USING (subject)""")
def choice_prompts(spark, sf_dir):
    rows = _questions(spark, sf_dir)
    shown = records.with_shots(rows, rows, 2)
    q = F.struct("question", "A", "B", "C", "D", "answer")
    return shown.select("id", records.choice_prompt(q, F.col("subject"), F.col("shots")).alias("prompt"))


@query(f"""WITH {_Q} SELECT subject || '_dev_' || id AS id, subject, answer AS chosen, ['B', 'C', 'D', 'A'][CAST(id % 4 + 1 AS INT)] AS rejected, '以下是中国关于' || subject || '考试的单项选择题。请只输出正确选项字母。' || chr(10) || chr(10) || shown AS asked FROM q""")
def choice_pairs(spark, sf_dir):
    made = records.choice_pairs(_questions(spark, sf_dir))
    return made.select("id", "subject", F.col("chosen")[1]["content"].alias("chosen"), F.col("rejected")[1]["content"].alias("rejected"), F.col("chosen")[0]["content"].alias("asked"))


@query(f"""WITH {_Q} SELECT id, CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN 'A' ELSE answer END AS prediction, CASE WHEN id % 5 = 0 THEN false WHEN id % 5 = 1 THEN answer = 'A' ELSE true END AS correct FROM q""")
def scored_choices(spark, sf_dir):
    rows = _questions(spark, sf_dir)
    said = rows.filter("id % 5 <> 0").select("id", F.when(F.col("id") % 5 == 1, "A").otherwise(F.col("answer")).alias("prediction"))
    return records.scored_choices(rows, said).select("id", "prediction", "correct")


@query(f"""WITH {_Q} SELECT coalesce(subject, 'total') AS subject, count(*) AS rows, count(*) FILTER (WHERE CASE WHEN id % 5 = 0 THEN false WHEN id % 5 = 1 THEN answer = 'A' ELSE true END) AS correct,
round_even(count(*) FILTER (WHERE CASE WHEN id % 5 = 0 THEN false WHEN id % 5 = 1 THEN answer = 'A' ELSE true END) / count(*), 4) AS accuracy FROM q GROUP BY ROLLUP (subject)""")
def choice_accuracy(spark, sf_dir):
    rows = _questions(spark, sf_dir)
    said = rows.filter("id % 5 <> 0").select("id", F.when(F.col("id") % 5 == 1, "A").otherwise(F.col("answer")).alias("prediction"))
    return evaluate.accuracy_rollup(records.scored_choices(rows, said), F.col("subject"), F.col("correct"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, (l_quantity + l_tax) / 2 AS logp, 2 AS tokens, CAST(CASE WHEN l_quantity >= l_discount * 100 AND l_quantity >= 20 THEN 0 WHEN l_discount * 100 >= 20 THEN 1 ELSE CASE WHEN l_quantity >= 20 THEN 0 ELSE 2 END END AS INT) AS best
FROM lineitem""")
def log_probabilities(spark, sf_dir):
    q, tax = F.col("l_quantity"), F.col("l_tax")
    m = evaluate.mean_logprob(F.array(q, F.col("l_discount"), tax), F.array(F.lit(1), F.lit(0), F.lit(1)))
    best = evaluate.best_choice(F.array(q, F.col("l_discount") * 100, F.lit(20.0), q))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", m["logp"].alias("logp"), m["tokens"].alias("tokens"), best.cast("int").alias("best"))


@query("""SELECT max(p_size) AS max_prompt, max(p_size + 7) AS max_total, round_even(count(*) FILTER (WHERE p_size % 9 = 0) / count(*), 4) AS no_supervision_rate, max(p_size + 7) <= 60 AND count(*) FILTER (WHERE p_size % 9 = 0) = 0 AS fits FROM part""")
def token_fit(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.col("p_size").alias("prompt_tokens"), (F.col("p_size") + 7).alias("total_tokens"), (F.col("p_size") % 9).alias("supervised_tokens"))
    return evaluate.token_fit(rows, 60)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '0,0,0,1,1,1,0' ELSE '0,0,0,1,1,1,1' END AS mask FROM nation")
def answer_masks(spark, sf_dir):
    k = F.col("n_nationkey").cast("int") + 50
    ids = F.array(k, F.lit(1), F.lit(2), k, k, F.when(F.col("n_nationkey") % 2 == 0, 9).otherwise(8), k)
    return load(spark, sf_dir, "nation").select("n_nationkey", F.array_join(records.answer_mask(ids, [1, 2], [9], 100), ",").alias("mask"))


# ---- files and streams ----


@query("""SELECT '- nations: 25' AS line, 1 AS copies UNION ALL SELECT '', 1 UNION ALL SELECT '| n_nationkey | n_name |', 1 UNION ALL SELECT '|---|---|', 1 UNION ALL SELECT '| ' || n_nationkey || ' | a/' || n_name || ' |', 1 FROM nation""")
def markdown_report(spark, sf_dir):
    path = scratch(spark)
    rows = load(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("a|"), "n_name").alias("n_name"))
    files.write_markdown({"nations": 25}, rows, ["n_nationkey", "n_name"], path, ["n_nationkey"])
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").cast("int").alias("copies"))


@query("""SELECT count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation""")
def summary_report(spark, sf_dir):
    path, rows = scratch(spark), load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    files.write_summary_json(rows.agg(F.count("*").alias("n")), rows, path, ["n_nationkey"])
    read = spark.read.schema("summary struct<n:bigint>, rows array<struct<n_nationkey:int,n_name:string>>").option("multiLine", True).json(path)
    return read.select("summary.n", F.array_join("rows.n_name", ",").alias("names"))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS note FROM supplier")
def jsonl_round_trip(spark, sf_dir):
    rows, path = load(spark, sf_dir, "supplier").withColumn("note", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name"))), scratch(spark)
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double, note string", position=False)


@query("""SELECT doc_id, lang, 'a "b", ' || source || chr(10) || 'c' AS text FROM documents""")
def csv_round_trip(spark, sf_dir):
    """Quotes, commas and line ends inside a cell."""
    path = scratch(spark)
    files.write_csv(load(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit('a "b", '), "source", F.lit("\nc")).alias("text")), path)
    return files.read_csv(spark, path, "doc_id bigint, lang string, text string")


@query("""SELECT CAST(event_id % 3 AS INT) AS epoch, CAST(event_id AS INT) AS step, round(value, 2) AS loss, CASE WHEN event_id % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS lr FROM events WHERE event_id % 5 <> 0""")
def log_scan(spark, sf_dir):
    path, i = scratch(spark), F.col("event_id")
    line = F.concat(F.lit("Epoch:["), i % 3, F.lit("/3]("), i, F.lit("/99999) loss: "), F.round("value", 2).cast("string"), F.when(i % 2 == 0, " lr:0.5").otherwise(""))
    logs = load(spark, sf_dir, "events").select(F.when(i % 5 != 0, line).otherwise("warming up").alias("value"))
    logs.write.text(f"{path}/plain")
    spark.read.text(f"{path}/plain").write.text(path + "/run.log")
    return _logs(spark, path).select("epoch", "step", "loss", "lr")


def _logs(spark: SparkSession, path: str) -> DataFrame:
    """Spark names what it writes itself; only here do its files pass for logs."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path + "/run.log")):
        if s.getPath().getName().endswith(".txt"):
            fs.rename(s.getPath(), spark._jvm.org.apache.hadoop.fs.Path(s.getPath().toString()[:-4] + ".log"))
    return files.read_training_logs(spark, path)


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND value >= 10")
def stream_filter(spark, sf_dir):
    """Events as a stream, through a plan, into a table."""
    path = scratch(spark)
    stream = spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    plan = Plan((Filter("event_type", "in", ["click", "view"]), Filter("value", "gte", 10.0)), return_fields=("event_id", "event_type", "value"))
    follow(stream, plan).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id bigint, event_type string, value double").parquet(f"{path}/rows")
