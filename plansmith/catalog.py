"""Registered queries of the plan engine with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansmith.functions import hints as H
from plansmith.functions import normalize as N
from plansmith.functions import short_schema
from plansmith.functions.registry import PROTEIN
from plansmith.operators import batch, datasets, evaluate
from plansmith.operators.entities import SQL_DOCS, SQL_PARTS, labelled_documents, part_candidates
from plansmith.operators.execute import metadata, run
from plansmith.plans.model import Filter, Plan, Sort
from plansmith.session import load, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a function under its name, with SQL for the same rows."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


AFFINITY, WEAKEST = Sort("best_affinity_value"), Sort("best_affinity_value", "desc")
COLUMNS = "candidate_id, scaffold_type, oral_class, best_affinity_value"


def _parts(spark: SparkSession, sf_dir: str, plan: Plan) -> DataFrame:
    return run(part_candidates(spark, sf_dir), plan).select(*COLUMNS.split(", "))


def _sql(where: str, order: str, limit: str = "") -> str:
    return f"WITH {SQL_PARTS} SELECT {COLUMNS} FROM snap WHERE {where} {order and 'ORDER BY ' + order} {limit and 'LIMIT ' + limit}"


# ---- plans ----


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size = 7 ORDER BY p_retailprice ASC NULLS LAST, p_partkey LIMIT 20")
def plan_eq_topk(spark, sf_dir):
    part = load(spark, sf_dir, "part").withColumn("_pos", F.col("p_partkey"))
    return run(part, Plan((Filter("p_size", "eq", 7),), (Sort("p_retailprice"),), 20)).select("p_partkey", "p_name", "p_size", "p_retailprice")


@query(f"WITH {SQL_DOCS} SELECT doc_id, lang, quality FROM docs WHERE quality IS NOT DISTINCT FROM NULL")
def plan_eq_null_safe(spark, sf_dir):
    return run(labelled_documents(spark, sf_dir), Plan((Filter("quality", "eq", None),))).select("doc_id", "lang", "quality")


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (3, 5, 8)")
def plan_in_list(spark, sf_dir):
    part = load(spark, sf_dir, "part").withColumn("_pos", F.col("p_partkey"))
    return run(part, Plan((Filter("p_size", "in", [3, 5, 8]),))).select("p_partkey", "p_size")


@query(f"WITH {SQL_DOCS} SELECT doc_id, quality FROM docs WHERE quality = 1 OR quality IS NULL")
def plan_in_with_null(spark, sf_dir):
    return run(labelled_documents(spark, sf_dir), Plan((Filter("quality", "in", [1, None]),))).select("doc_id", "quality")


@query("SELECT p_partkey FROM part WHERE false")
def plan_in_empty(spark, sf_dir):
    part = load(spark, sf_dir, "part").withColumn("_pos", F.col("p_partkey"))
    return run(part, Plan((Filter("p_size", "in", []),))).select("p_partkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE contains('FO', o_orderstatus)")
def plan_in_substring_compat(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").withColumn("_pos", F.col("o_orderkey"))
    return run(orders, Plan((Filter("o_orderstatus", "in", "FO"),)), substring=True).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000")
def plan_gte(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").withColumn("_pos", F.col("o_orderkey"))
    return run(orders, Plan((Filter("o_totalprice", "gte", 250000),))).select("o_orderkey", "o_totalprice")


@query(_sql("best_affinity_value <= 950", ""))
def plan_lte(spark, sf_dir):
    return _parts(spark, sf_dir, Plan((Filter("best_affinity_value", "lte", 950),)))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def plan_range(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").withColumn("_pos", F.col("o_orderkey"))
    plan = Plan((Filter("o_totalprice", "gte", 100000), Filter("o_totalprice", "lte", 120000)), (Sort("o_totalprice", "desc"),), 50)
    return run(orders, plan).select("o_orderkey", "o_totalprice")


@query(_sql("best_affinity_value IS NOT NULL", ""))
def plan_exists(spark, sf_dir):
    return _parts(spark, sf_dir, Plan((Filter("best_affinity_value", "exists"),)))


@query(_sql("scaffold_type LIKE 'S%' AND oral_class = 'High' AND engineered AND has_experimental_affinity", ""))
def plan_conjunction4(spark, sf_dir):
    rows = part_candidates(spark, sf_dir).withColumn("first", F.left("scaffold_type", F.lit(1)))
    filters = (Filter("first", "eq", "S"), Filter("oral_class", "eq", "High"), Filter("engineered", "eq", True), Filter("has_experimental_affinity", "eq", 1))
    return run(rows, Plan(filters)).select(*COLUMNS.split(", "))


@query(_sql("oral_class = 'Low'", "best_affinity_value ASC NULLS LAST, candidate_id", "30"))
def sort_asc_nulls_last(spark, sf_dir):
    return _parts(spark, sf_dir, Plan((Filter("oral_class", "eq", "Low"),), (AFFINITY,), 30))


@query(_sql("oral_class = 'Low'", "best_affinity_value DESC NULLS FIRST, candidate_id", "30"))
def sort_desc_nulls_first(spark, sf_dir):
    return _parts(spark, sf_dir, Plan((Filter("oral_class", "eq", "Low"),), (WEAKEST,), 30))


@query(_sql("true", "scaffold_type ASC NULLS LAST, oral_class DESC NULLS FIRST, candidate_id", "100"))
def sort_multi_key_stable(spark, sf_dir):
    return _parts(spark, sf_dir, Plan((), (Sort("scaffold_type"), Sort("oral_class", "desc")), 100))


@query("SELECT s_suppkey FROM supplier LIMIT 0")
def limit_zero(spark, sf_dir):
    return run(load(spark, sf_dir, "supplier").withColumn("_pos", F.col("s_suppkey")), Plan(limit=0)).select("s_suppkey")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 20")
def limit_default_20(spark, sf_dir):
    return run(load(spark, sf_dir, "supplier").withColumn("_pos", F.col("s_suppkey")), Plan(limit=PROTEIN.limit)).select("s_suppkey", "s_name")


@query(f"""WITH {SQL_PARTS} SELECT count(*) AS total_rows, count(*) FILTER (WHERE engineered AND oral_class = 'High') AS filtered_count,
least(count(*) FILTER (WHERE engineered AND oral_class = 'High'), 25) AS returned_count, CAST(25 AS BIGINT) AS "limit" FROM snap""")
def plan_metadata(spark, sf_dir):
    return metadata(part_candidates(spark, sf_dir), Plan((Filter("engineered", "eq", True), Filter("oral_class", "eq", "High")), limit=25))


@query(f"WITH {SQL_PARTS} SELECT candidate_id, canonical_name FROM snap WHERE inhibitory ORDER BY best_affinity_value NULLS LAST, candidate_id LIMIT 10")
def return_fields_projection(spark, sf_dir):
    plan = Plan((Filter("inhibitory", "eq", True),), (AFFINITY,), 10, return_fields=("candidate_id", "canonical_name"))
    return run(part_candidates(spark, sf_dir), plan, project=True)


# ---- snapshot ----


@query(r"SELECT event_id, TRY_CAST(regexp_extract(props, '(-?\d+(?:\.\d+)?)', 1) AS DOUBLE) AS value_read FROM events")
def first_number_in_text(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", N.first_number(F.col("props")).alias("value_read"))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN line END AS head, length(line) AS n FROM l),
s AS (SELECT doc_id, n, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h)
SELECT doc_id, section, count(*) AS lines, CAST(sum(n) AS BIGINT) AS chars FROM s GROUP BY ALL""")
def card_line_sections(spark, sf_dir):
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    head = F.last(F.when(F.col("i") % 3 == 0, F.col("line")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("i"))
    return lines.withColumn("section", head).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).cast("bigint").alias("chars"))


# ---- rules of the registry ----


@query("""SELECT p_partkey, CASE lower(trim(x)) WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' WHEN 'unknown' THEN 'Unknown' END AS oral
FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ' HIGH ' WHEN 1 THEN 'low' WHEN 2 THEN 'oral_class' WHEN 3 THEN 'unknown' ELSE p_type END AS x FROM part)""")
def normalize_enum(spark, sf_dir):
    m = F.col("p_size") % 5
    raw = F.when(m == 0, " HIGH ").when(m == 1, "low").when(m == 2, "oral_class").when(m == 3, "unknown").otherwise(F.col("p_type"))
    return load(spark, sf_dir, "part").select("p_partkey", N.value(raw, "oral_class", PROTEIN).alias("oral"))


@query("""SELECT c_custkey, CASE WHEN lower(trim(x)) IN ('true', 'yes', 'y', '1', 'engineered') THEN true WHEN lower(trim(x)) IN ('false', 'no', 'n', '0') THEN false END AS flag
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN ' n' WHEN 2 THEN '0' WHEN 3 THEN 'TRUE' ELSE c_mktsegment END AS x FROM customer)""")
def normalize_bool(spark, sf_dir):
    m = F.col("c_custkey") % 5
    raw = F.when(m == 0, "Yes").when(m == 1, " n").when(m == 2, "0").when(m == 3, "TRUE").otherwise(F.col("c_mktsegment"))
    return load(spark, sf_dir, "customer").select("c_custkey", N.value(raw, "has_experimental_affinity", PROTEIN).alias("flag"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'oral_class' WHEN 1 THEN 'best_affinity_value' WHEN 2 THEN 'canonical_name' WHEN 3 THEN 'engineered' END AS field,
CASE s_suppkey % 4 WHEN 0 THEN 'gte' WHEN 1 THEN 'eq' WHEN 2 THEN 'in' END AS op, CASE s_suppkey % 3 WHEN 0 THEN 'asc' WHEN 1 THEN 'desc' END AS direction FROM supplier""")
def normalize_alias(spark, sf_dir):
    of = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (F.col("s_suppkey") % n + 1).cast("int"))
    return load(spark, sf_dir, "supplier").select(
        "s_suppkey", N.field_name(of(5, [" Oral ", "binding_strength", "name", "ENGINEERED", "price"]), PROTEIN).alias("field"),
        N.operator(of(4, [">=", "==", "IN", "like"]), PROTEIN).alias("op"), N.direction(of(3, ["Strongest", "descending", "up"]), PROTEIN).alias("direction"),
    )


@query(r"""SELECT event_id, CASE WHEN n > 0 THEN n ELSE 20 END AS n_limit, x IS NOT NULL AND NOT coalesce(n > 0, false) AS bad FROM
(SELECT event_id, x, CASE WHEN regexp_full_match(x, '\s*-?\d+\s*') THEN TRY_CAST(trim(x) AS INT) END AS n FROM (
SELECT event_id, CASE event_id % 4 WHEN 0 THEN regexp_extract(props, '(\d+)', 1) WHEN 1 THEN 'top five' WHEN 2 THEN ' -3 ' END AS x FROM events))""")
def normalize_limit(spark, sf_dir):
    m = F.col("event_id") % 4
    raw = F.when(m == 0, F.regexp_extract("props", r"(\d+)", 1)).when(m == 1, "top five").when(m == 2, " -3 ")
    return load(spark, sf_dir, "events").select("event_id", N.limit(raw).alias("n_limit"), N.limit_is_bad(raw).alias("bad"))


# ---- requests ----


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot rows with a request text that states some of their facts."""
    rows = part_candidates(spark, sf_dir)
    n = (F.col("candidate_id") % 30 + 1).cast("string")
    flag = F.when(F.col("engineered"), "engineered").otherwise("non-engineered")
    form = F.element_at(
        F.array(
            F.concat(F.lit("Find oral "), F.lower("oral_class"), F.lit(" candidates, "), flag, F.lit(", strongest affinity first, limit "), n),
            F.concat(F.lit("Keep only "), n, F.lit(" entries with oral class = "), F.col("oral_class"), F.lit(" and experimental affinity")),
            F.concat(F.lit("找 oral 分档是 "), F.col("oral_class"), F.lit(" 的 "), flag, F.lit(" 候选，前 "), n, F.lit(" 个，按亲和力排序")),
            F.concat(F.lit("Everything about "), F.col("canonical_name")),
        ),
        (F.col("candidate_id") % 4 + 1).cast("int"),
    )
    return rows.withColumn("prompt", form)


@query(f"""WITH {SQL_PARTS} SELECT candidate_id, CASE WHEN candidate_id % 4 < 3 THEN CAST(candidate_id % 30 + 1 AS INT) END AS n_limit FROM snap""")
def hints_limit(spark, sf_dir):
    rows, asked = H.asked(_asked(spark, sf_dir), F.col("prompt"))
    return rows.select("candidate_id", asked.limit.alias("n_limit"))


@query(f"""WITH {SQL_PARTS} SELECT candidate_id, CASE WHEN candidate_id % 4 < 3 THEN oral_class END AS oral, CASE WHEN candidate_id % 4 IN (0, 2) THEN engineered END AS engineered,
CASE WHEN candidate_id % 4 = 1 THEN true END AS tested FROM snap""")
def hints_oral(spark, sf_dir):
    rows, asked = H.asked(_asked(spark, sf_dir), F.col("prompt"))
    return rows.select("candidate_id", asked.oral_class.alias("oral"), asked.engineered.alias("engineered"), asked.has_experimental_affinity.alias("tested"))


@query(f"""WITH {SQL_PARTS} SELECT candidate_id, CASE WHEN candidate_id % 4 IN (0, 2) THEN 'best_affinity_value' END AS sort_by, CASE WHEN candidate_id % 4 IN (0, 2) THEN 'asc' END AS sort_dir FROM snap""")
def hints_sort(spark, sf_dir):
    rows, asked = H.asked(_asked(spark, sf_dir), F.col("prompt"))
    return rows.select("candidate_id", asked.sort_by.alias("sort_by"), asked.sort_dir.alias("sort_dir"))


@query(f"""WITH {SQL_PARTS} SELECT candidate_id, CASE candidate_id % 4
WHEN 0 THEN 'oral_class=' || oral_class || ', engineered=' || CASE WHEN engineered THEN 'True' ELSE 'False' END || ', limit=' || (candidate_id % 30 + 1) || ', sort_by=best_affinity_value, sort_dir=asc'
WHEN 1 THEN 'oral_class=' || oral_class || ', has_experimental_affinity=True, limit=' || (candidate_id % 30 + 1)
WHEN 2 THEN 'oral_class=' || oral_class || ', engineered=' || CASE WHEN engineered THEN 'True' ELSE 'False' END || ', limit=' || (candidate_id % 30 + 1) || ', sort_by=best_affinity_value, sort_dir=asc'
ELSE 'No deterministic slot hints extracted.' END AS hints FROM snap""")
def hints_rendered(spark, sf_dir):
    rows, asked = H.asked(_asked(spark, sf_dir), F.col("prompt"))
    return rows.select("candidate_id", asked.rendered().alias("hints"))


@query(f"""WITH {SQL_PARTS} SELECT candidate_id, CASE WHEN candidate_id % 4 = 0 THEN oral_class END AS oral_class, CASE WHEN candidate_id % 4 IN (0, 2) THEN engineered END AS engineered,
CASE WHEN candidate_id % 4 < 3 THEN true END AS tested, CASE WHEN candidate_id % 4 IN (0, 2) THEN CAST(candidate_id % 30 + 1 AS INT) ELSE 20 END AS n_limit FROM snap""")
def rule_draft_roundtrip(spark, sf_dir):
    rows = _asked(spark, sf_dir)
    draft = H.rule_draft(F.col("prompt"), list(PROTEIN.by_name["scaffold_type"].values))
    return rows.select("candidate_id", draft["oral_class"].alias("oral_class"), draft["engineered"].alias("engineered"), draft["has_experimental_affinity"].alias("tested"), draft["limit"].alias("n_limit"))


def _flat(limit: int = 20) -> dict[str, F.Column]:
    """A flat plan that asks for a row's oral class and engineering and always for the same limit."""
    null = F.lit(None).cast("string")
    return {
        "candidate_id": null, "scaffold_type": null, "oral_class": F.lit("High"), "engineered": F.lit(True), "has_experimental_affinity": F.lit(None).cast("boolean"), "organism": null,
        "sort_by": F.lit("best_affinity_value"), "sort_dir": F.lit("asc"), "limit": F.lit(limit),
    }


_SQL_REASONS = """CASE WHEN candidate_id % 4 < 3 AND oral_class <> 'High' THEN 'semantic_mismatch_oral_class' END,
CASE WHEN candidate_id % 4 IN (0, 2) AND NOT engineered THEN 'semantic_mismatch_engineered' END, CASE WHEN candidate_id % 4 = 1 THEN 'semantic_mismatch_has_experimental_affinity' END,
CASE WHEN candidate_id % 4 < 3 AND candidate_id % 30 + 1 <> 20 THEN 'semantic_mismatch_limit' END"""


@query(f"WITH {SQL_PARTS} SELECT candidate_id, concat_ws(';', {_SQL_REASONS}) AS reasons FROM snap")
def semantic_mismatch_reasons(spark, sf_dir):
    rows, asked = H.asked(_asked(spark, sf_dir), F.col("prompt"))
    return rows.select("candidate_id", F.array_join(H.mismatches(_flat(), asked), ";").alias("reasons"))


@query(f"""WITH {SQL_PARTS} SELECT candidate_id, CASE WHEN candidate_id % 4 < 3 THEN oral_class ELSE 'High' END AS oral_class, CASE WHEN candidate_id % 4 IN (0, 2) THEN engineered ELSE true END AS engineered,
CASE WHEN candidate_id % 4 = 1 THEN true END AS tested, CASE WHEN candidate_id % 4 < 3 THEN CAST(candidate_id % 30 + 1 AS INT) ELSE 20 END AS n_limit FROM snap""")
def hint_projection(spark, sf_dir):
    rows, asked = H.asked(_asked(spark, sf_dir), F.col("prompt"))
    p = H.project(_flat(), asked)
    return rows.select("candidate_id", p["oral_class"].alias("oral_class"), p["engineered"].alias("engineered"), p["has_experimental_affinity"].alias("tested"), p["limit"].alias("n_limit"))


@query(f"""WITH {SQL_PARTS}, m AS (SELECT candidate_id, len(list_filter([{_SQL_REASONS}], lambda x: x IS NOT NULL)) AS miss FROM snap)
SELECT candidate_id, miss > 0 AS use_projection FROM m""")
def candidate_quality_pick(spark, sf_dir):
    rows, asked = H.asked(_asked(spark, sf_dir), F.col("prompt"))
    none, yes = F.array().cast("array<string>"), F.lit(True)
    own = H.quality(yes, none, _flat(), asked, F.lit(False))
    other = H.quality(yes, none, H.project(_flat(), asked), asked, F.size(H.mismatches(_flat(), asked)) > 0)
    return rows.select("candidate_id", (other > own).alias("use_projection"))


# ---- evaluation ----


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for every part: gold asks for its oral class, engineering and a bound; predicted gets some wrong."""
    rows = part_candidates(spark, sf_dir)
    wrong = F.when(F.col("candidate_id") % 3 == 0, F.lit("High")).otherwise(F.col("oral_class"))
    return rows.select(
        F.col("candidate_id").alias("plan_id"), "oral_class", "engineered", "scaffold_type", wrong.alias("predicted_oral"), F.element_at(F.array(F.lit(5), F.lit(10), F.lit(20)), (F.col("candidate_id") % 3 + 1).cast("int")).alias("limit")
    )


_SQL_PLANS = f"""{SQL_PARTS}, plans AS (SELECT candidate_id AS plan_id, oral_class, engineered, scaffold_type, CASE WHEN candidate_id % 3 = 0 THEN 'High' ELSE oral_class END AS predicted_oral,
CASE candidate_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 20 END AS k FROM snap),
ranked AS (SELECT oral_class, engineered, scaffold_type, candidate_id, row_number() OVER (PARTITION BY oral_class, engineered, scaffold_type ORDER BY best_affinity_value NULLS LAST, candidate_id) AS r FROM snap),
gold AS (SELECT plan_id, candidate_id FROM plans p JOIN ranked r ON p.oral_class = r.oral_class AND p.engineered = r.engineered AND p.scaffold_type = r.scaffold_type AND r.r <= k),
pred AS (SELECT plan_id, candidate_id FROM plans p JOIN ranked r ON p.predicted_oral = r.oral_class AND p.engineered = r.engineered AND p.scaffold_type = r.scaffold_type AND r.r <= k),
common AS (SELECT plan_id, count(*) AS c FROM gold JOIN pred USING (plan_id, candidate_id) GROUP BY plan_id),
sizes AS (SELECT plan_id, count(*) AS g FROM gold GROUP BY plan_id),
overlap AS (SELECT plan_id, coalesce(g, 0) AS n_gold, coalesce(c, 0) AS n_common, round_even(coalesce(c, 0) / g, 4) AS result_overlap_at_k FROM plans LEFT JOIN sizes USING (plan_id) LEFT JOIN common USING (plan_id))"""
_SHAPE = batch.Shape(("oral_class", "engineered", "scaffold_type"), sort=(AFFINITY,))


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plans = spread(part_candidates(spark, sf_dir)), _plans(spark, sf_dir)
    return batch.overlap_many(rows, plans, {"oral_class": "predicted_oral"}, _SHAPE, "candidate_id")


@query(f"WITH {_SQL_PLANS} SELECT plan_id, n_gold, n_common, result_overlap_at_k FROM overlap")
def overlap_at_k(spark, sf_dir):
    return _overlap(spark, sf_dir)


@query(f"""WITH {SQL_DOCS} SELECT lang || '/' || source AS family, count(*) AS rows, round_even(avg(coalesce(quality, 0)), 4) AS mean_overlap, round_even(avg(coalesce(toxic, 0)), 4) AS mean_field,
round_even(avg(n_chars), 4) AS mean_slot, count(*) FILTER (WHERE quality = 1) AS repair_attempted, count(*) FILTER (WHERE toxic = 1) AS used_repair, count(*) FILTER (WHERE n_chars > 1000) AS non_empty_filter FROM docs GROUP BY ALL""")
def family_summary(spark, sf_dir):
    rows = labelled_documents(spark, sf_dir).withColumns(
        {
            "result_overlap_at_k": F.col("quality"), "field_value_exact_match": F.col("toxic"), "slot_accuracy": F.col("n_chars"), "repair_attempted": F.col("quality") == 1, "used_repair": F.col("toxic") == 1,
            "non_empty_filter": F.col("n_chars") > 1000,
        }
    )
    return evaluate.family_summary(rows, F.concat_ws("/", "lang", "source"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'zh_research' WHEN 1 THEN 'keep_rows_en' WHEN 2 THEN 'from_registry_en' ELSE 'other' END AS family FROM customer""")
def family_label(spark, sf_dir):
    prompt = F.element_at(F.array(F.lit("研究问题是这样的：x"), F.lit("Keep candidate rows carrying y"), F.lit("From the protein registry, pull"), F.lit("Please find")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", evaluate.family(prompt).alias("family"))


@query(f"""WITH {SQL_PARTS}, r AS (SELECT candidate_id, unnest(list_filter([{_SQL_REASONS}], lambda x: x IS NOT NULL)) AS reason FROM snap) SELECT reason, count(*) AS count FROM r GROUP BY reason""")
def reason_frequency(spark, sf_dir):
    rows, asked = H.asked(_asked(spark, sf_dir), F.col("prompt"))
    return evaluate.reason_counts(rows.withColumn("reasons", H.mismatches(_flat(), asked)), "reasons")


@query(f"""WITH {SQL_PARTS}, c AS (SELECT 'oral_class' AS field, count(*) AS present, count(*) FILTER (WHERE candidate_id % 4 < 3) AS matched FROM snap
UNION ALL SELECT 'engineered', count(engineered), count(*) FILTER (WHERE candidate_id % 4 IN (0, 2)) FROM snap
UNION ALL SELECT 'organism', 0, 0) SELECT field, CAST(present AS BIGINT) AS present, CAST(matched AS BIGINT) AS matched, CASE WHEN present > 0 THEN round_even(matched / present, 4) END AS rate FROM c""")
def hint_coverage(spark, sf_dir):
    rows, asked = H.asked(_asked(spark, sf_dir), F.col("prompt"))
    null = F.lit(None).cast("string")
    return evaluate.hint_coverage(rows, {"oral_class": (F.col("oral_class"), asked.oral_class), "engineered": (F.col("engineered"), asked.engineered), "organism": (null, F.lit("x"))})


@query(f"""WITH {SQL_DOCS} SELECT count(*) AS rows, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS final_perfect_rows, round_even(count(*) FILTER (WHERE quality = 1 AND toxic = 0) / count(*), 4) AS final_perfect_rate,
count(quality) AS first_schema_ok_rows, round_even(count(quality) / count(*), 4) AS first_schema_ok_rate, count(*) FILTER (WHERE toxic = 1) AS used_repair_rows, round_even(count(*) FILTER (WHERE toxic = 1) / count(*), 4) AS used_repair_rate FROM docs""")
def completion_audit(spark, sf_dir):
    checks = {"final_perfect": (F.col("quality") == 1) & (F.col("toxic") == 0), "first_schema_ok": F.col("quality").isNotNull(), "used_repair": F.col("toxic") == 1}
    return evaluate.completion_audit(labelled_documents(spark, sf_dir), checks)


@query(f"""WITH {SQL_DOCS} SELECT coalesce(lang, 'total') AS subject, count(*) AS rows, count(*) FILTER (WHERE quality = 1) AS correct, round_even(count(*) FILTER (WHERE quality = 1) / count(*), 4) AS accuracy
FROM docs WHERE quality IS NOT NULL GROUP BY ROLLUP (lang)""")
def accuracy_rollup(spark, sf_dir):
    return evaluate.accuracy_rollup(labelled_documents(spark, sf_dir).filter("quality IS NOT NULL"), F.col("lang"), F.col("quality") == 1)


@query("""WITH p AS (SELECT l_discount * 10 - l_tax * 12 AS m FROM lineitem) SELECT count(*) AS rows, round_even(count(*) FILTER (WHERE m > 0) / count(*), 4) AS preference_accuracy,
round_even(avg(m), 6) AS mean_margin, round_even(avg(ln(1 + exp(-0.1 * m))), 6) AS mean_loss FROM p""")
def preference_margin(spark, sf_dir):
    return evaluate.preference(load(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("chosen_logp"), (F.col("l_tax") * 12).alias("rejected_logp")))


# ---- datasets ----


@query("""WITH r AS (SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (ORDER BY s_nationkey NULLS LAST, s_acctbal DESC NULLS FIRST, s_suppkey) AS n FROM supplier)
SELECT s_suppkey, s_nationkey, CASE WHEN n <= 6 THEN 'head' ELSE 'rest' END AS part FROM r""")
def split_first6_rest(spark, sf_dir):
    order = [F.col("s_nationkey").asc_nulls_last(), F.col("s_acctbal").desc_nulls_first(), F.col("s_suppkey")]
    head, rest = datasets.head_and_rest(load(spark, sf_dir, "supplier"), order, "s_suppkey")
    return head.withColumn("part", F.lit("head")).unionByName(rest.withColumn("part", F.lit("rest"))).select("s_suppkey", "s_nationkey", "part")


@query("""SELECT s_suppkey, o AS "offset", ['a', 'b', 'c', 'd', 'e'][CAST((s_suppkey * 2 + o) % 5 + 1 AS INT)] AS template FROM supplier, (VALUES (0), (1)) t(o)""")
def round_robin_template(spark, sf_dir):
    rows = load(spark, sf_dir, "supplier").withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return rows.select("s_suppkey", "offset", datasets.turn(F.array(*map(F.lit, "abcde")), F.col("s_suppkey") * 2 + F.col("offset")).alias("template"))


@query(f"""WITH {SQL_PARTS}, c AS (SELECT candidate_id, candidate_id % 10 AS m, oral_class, engineered, CASE WHEN candidate_id % 3 = 0 THEN 20 ELSE 10 END AS k FROM snap)
SELECT candidate_id, CASE m WHEN 9 THEN NULL WHEN 1 THEN CASE oral_class WHEN 'High' THEN 'Low' WHEN 'Low' THEN 'High' ELSE 'Low' END WHEN 6 THEN 'oral_class' ELSE oral_class END AS oral_class,
CASE m WHEN 9 THEN NULL WHEN 0 THEN CAST(NOT engineered AS VARCHAR) ELSE CAST(engineered AS VARCHAR) END AS engineered,
CASE m WHEN 9 THEN NULL WHEN 2 THEN NULL WHEN 7 THEN 'candidate_id' ELSE 'best_affinity_value' END AS sort_by,
CASE m WHEN 9 THEN '20' WHEN 3 THEN CASE WHEN k = 20 THEN '5' ELSE '20' END WHEN 8 THEN 'top five' ELSE CAST(k AS VARCHAR) END AS n_limit FROM c""")
def corrupt_sketch_mode(spark, sf_dir):
    flat = _flat() | {"oral_class": F.col("oral_class"), "engineered": F.col("engineered"), "limit": F.when(F.col("candidate_id") % 3 == 0, 20).otherwise(10)}
    rows = part_candidates(spark, sf_dir).withColumn("plan", F.struct(*(c.alias(k) for k, c in flat.items())))
    bad = rows.select("candidate_id", datasets.corrupted(F.col("plan"), F.col("candidate_id")).alias("b"))
    return bad.select("candidate_id", "b.oral_class", "b.engineered", "b.sort_by", F.col("b.limit").alias("n_limit"))


@query("""WITH k AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS r, n_chars FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS q FROM k WHERE r = 1) SELECT doc_id, lang, source FROM c WHERE q <= 3""")
def dedupe_priority_cap(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("h"))
    return datasets.dedupe_capped(docs, ["h"], [F.desc("n_chars"), F.col("doc_id")], ["lang", "source"], 3).select("doc_id", "lang", "source")


@query(f"""WITH {SQL_PARTS}, f AS (SELECT 'engineered' AS family FROM snap WHERE engineered UNION ALL SELECT 'all' FROM snap) SELECT family, count(*) AS rows FROM f GROUP BY family""")
def dataset_manifest(spark, sf_dir):
    rows = part_candidates(spark, sf_dir)
    return datasets.manifest(rows.filter("engineered").select(F.lit("engineered").alias("family")).unionByName(rows.select(F.lit("all").alias("family"))))


_RECORD = "concat_ws({sep}, 'RecordType: AntibodyAntigenEvidence', 'Antibody: ' || p_name, 'TargetLineage: ' || p_brand, 'BindingOutcome: ' || p_type, 'EpitopeDomain: NA', 'PDBID: ' || p_partkey, 'ResolutionA: ' || p_size{tail})"
_SOURCE = ", 'SourceIdentifier: s' || p_partkey"


@query(f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN {_RECORD.format(sep="chr(10)", tail=_SOURCE)} WHEN 1 THEN {_RECORD.format(sep="chr(10)", tail="")} ELSE 'nothing here' END AS answer FROM part""")
def short_schema_normalize(spark, sf_dir):
    said = lambda tail: F.expr(_RECORD.format(sep="' | '", tail=tail).replace("'RecordType: AntibodyAntigenEvidence'", "''"))
    m = F.col("p_partkey") % 3
    text = F.when(m == 0, said(_SOURCE)).when(m == 1, said("")).otherwise(F.lit("  nothing here "))
    return spread(load(spark, sf_dir, "part")).select("p_partkey", short_schema.normalized(text).alias("answer"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 7 ELSE 0 END AS key_hits, p_partkey % 3 = 0 AS exact_8_lines, p_partkey % 3 < 2 AS recordtype_ok, CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END AS extra_text, p_partkey % 3 = 0 AS compliant FROM part""")
def short_schema_compliance(spark, sf_dir):
    said = lambda tail: F.expr(_RECORD.format(sep="'\\n'", tail=tail))
    m = F.col("p_partkey") % 3
    text = F.when(m == 0, said(_SOURCE)).when(m == 1, said("")).otherwise(F.lit("nothing here"))
    return spread(load(spark, sf_dir, "part")).select("p_partkey", short_schema.judged(text).alias("j")).select("p_partkey", "j.*")


@query("SELECT item_id, ['A', 'B', 'C', 'D'][CAST(item_id % 4 + 1 AS INT)] AS answer, ['B', 'C', 'D', 'A'][CAST(item_id % 4 + 1 AS INT)] AS wrong FROM benchmark")
def mc_wrong_answer(spark, sf_dir):
    answer = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("item_id") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "benchmark").select("item_id", answer.alias("answer"), datasets.wrong_choice(answer).alias("wrong"))


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'B' ELSE '' END AS choice FROM benchmark")
def extract_answer(spark, sf_dir):
    text = F.element_at(F.array(F.lit("答案：C，not A"), F.lit("I think (b) fits"), F.lit("none of them")), (F.col("item_id") % 3 + 1).cast("int"))
    return load(spark, sf_dir, "benchmark").select("item_id", evaluate.choice_letter(text).alias("choice"))


import plansmith.catalog_tables  # noqa: E402, F401  registers the queries over whole tables
