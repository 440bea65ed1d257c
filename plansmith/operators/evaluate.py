"""Scores of predicted plans and what is told of many: rates, families, audits, preferences, multiple choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansmith.functions.normalize import half_even, mean, rate
from plansmith.operators.execute import run
from plansmith.plans.model import Plan, compact

# How requests of each family begin.
FAMILIES = {
    "From the {registry} registry": "from_registry_en",
    "I am shortlisting entries from the candidate table": "shortlisting_en",
    "For this screen, I only want molecules with": "screen_en",
    "请按数据库语义理解这个检索": "zh_semantic",
    "我在库里做初筛": "zh_prescreen",
    "研究问题是这样的": "zh_research",
    "Keep a database shortlist for candidates showing": "keep_shortlist_en",
    "做一个候选清单给我": "zh_shortlist",
    "Search the candidate registry for entries satisfying": "search_registry_en",
    "I need a candidate shortlist restricted to": "restricted_shortlist_en",
    "Within the protein-candidate table, retain only rows with": "retain_rows_en",
    "请直接按数据库语义筛选": "zh_direct_filter",
    "做一个不带解释的候选筛选": "zh_no_explain",
    "我想从候选库里锁定": "zh_lock_candidates",
    "Build a database shortlist for candidates meeting": "build_shortlist_en",
    "候选初筛条件如下": "zh_prescreen_brief",
    "Filter the candidate inventory down to rows annotated with": "inventory_filter_en",
    "For downstream review, retain only protein candidates tagged with": "downstream_review_en",
    "Database query request: among candidate entries": "db_request_en",
    "请从候选表里筛出满足": "zh_table_filter",
    "只保留": "zh_keep_only",
    "我要一个数据库候选列表": "zh_db_candidate_list",
    "Keep candidate rows carrying": "keep_rows_en",
    "候选清单需求": "zh_candidate_list_need",
}
METRICS = ("draft_valid", "json_parsed", "non_empty_filter", "field_value_exact_match", "slot_accuracy", "execution_success", "result_overlap_at_k")


def _filters(plan: Plan) -> set[tuple[str, ...]]:
    return {(f.field, f.op, compact(f.value)) for f in plan.filters}


def _slots(plan: Plan) -> set[tuple[str, ...]]:
    head = {("intent", plan.intent), ("entity", plan.entity), ("limit", str(plan.limit))}
    return head | {("filter", *f) for f in _filters(plan)} | {("sort", s.field, s.direction) for s in plan.sort}


def _share(gold: set, predicted: set) -> float:
    return round(len(gold & predicted) / len(gold), 4) if gold else float(not predicted)


def score(predicted: Plan | None, gold: Plan, rows: DataFrame, id_col: str = "candidate_id", parsed: bool | None = None) -> dict[str, object]:
    """Metrics of one plan; both plans run on rows. Many plans are better scored with operators.batch."""
    parsed = predicted is not None if parsed is None else parsed
    if predicted is None or not (predicted.intent and predicted.entity):
        return dict.fromkeys(METRICS, False) | {"json_parsed": parsed, "field_value_exact_match": 0.0, "slot_accuracy": 0.0, "result_overlap_at_k": 0.0}
    out = {
        "draft_valid": True, "json_parsed": parsed, "non_empty_filter": bool(predicted.filters), "field_value_exact_match": _share(_filters(gold), _filters(predicted)),
        "slot_accuracy": round(len(_slots(gold) & _slots(predicted)) / len(_slots(gold)), 4),
    }
    try:
        wanted, found = (run(rows, p).select(id_col).distinct().withColumn(n, F.lit(1)) for p, n in ((gold, "g"), (predicted, "p")))
    except ValueError:
        return out | {"execution_success": False, "result_overlap_at_k": 0.0}
    n = wanted.join(found, id_col, "full").agg(F.count("g").alias("g"), F.count("p").alias("p"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("both")).first()
    return out | {"execution_success": True, "result_overlap_at_k": round(n.both / n.g, 4) if n.g else float(not n.p)}


def summarize(scores: DataFrame) -> DataFrame:
    """One row of rates and means; zeros of nothing."""
    flag = lambda c: rate(F.coalesce(F.col(c), F.lit(False)))
    return scores.agg(
        flag("draft_valid").alias("plan_valid_rate"), flag("json_parsed").alias("json_parse_rate"), flag("non_empty_filter").alias("non_empty_filter_rate"),
        mean(F.col("field_value_exact_match")).alias("field_value_exact_match"), mean(F.col("slot_accuracy")).alias("slot_accuracy"),
        flag("execution_success").alias("execution_success_rate"), mean(F.col("result_overlap_at_k")).alias("result_overlap_at_k"),
    )


def family(prompt: Column, families: dict[str, str] = FAMILIES, registry: str = "protein") -> Column:
    return F.coalesce(*(F.when(prompt.startswith(p.format(registry=registry)), F.lit(n)) for p, n in families.items()), F.lit("other"))


def family_summary(rows: DataFrame, label: Column) -> DataFrame:
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    return rows.groupBy(label.alias("family")).agg(
        F.count(F.lit(1)).alias("rows"), mean(F.col("result_overlap_at_k")).alias("mean_overlap"), mean(F.col("field_value_exact_match")).alias("mean_field"), mean(F.col("slot_accuracy")).alias("mean_slot"),
        yes("repair_attempted"), yes("used_repair"), yes("non_empty_filter"),
    )


def reason_counts(rows: DataFrame, reasons: str, position: str = "_pos") -> DataFrame:
    """(reason, count) by falling count, ties by first appearance."""
    # The outer form, since Spark would filter by the reasons of the plain one below any shuffle, where rows may lie in few tasks.
    each = rows.select(F.col(position).alias("p"), F.posexplode_outer(reasons).alias("i", "reason")).filter(F.col("i").isNotNull())
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("p", "i")).alias("first")).orderBy(F.desc("count"), "first").select("reason", "count")


def is_failed() -> Column:
    return ~F.coalesce(F.col("execution_success"), F.lit(False)) | (F.coalesce("result_overlap_at_k", F.lit(0.0)) == 0)


def failed(rows: DataFrame) -> DataFrame:
    return rows.filter(is_failed())


def perfect() -> Column:
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("draft_valid", "json_parsed", "non_empty_filter", "execution_success")]
    ones = [F.coalesce(F.col(c) == 1.0, F.lit(False)) for c in ("field_value_exact_match", "slot_accuracy", "result_overlap_at_k")]
    out = flags[0]
    for c in [*flags[1:], *ones]:
        out &= c
    return out


def completion_audit(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows, and for each check its count (<name>_rows) and rate (<name>_rate), in one pass."""
    parts = [F.count(F.lit(1)).alias("rows")]
    for name, hit in checks.items():
        hit = F.coalesce(hit, F.lit(False))
        parts += [F.count_if(hit).alias(f"{name}_rows"), rate(hit).alias(f"{name}_rate")]
    return rows.agg(*parts)


def hint_coverage(rows: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(field, present, matched, rate) where pairs name what is wanted and what was read; rate is null where nothing is wanted."""
    stacked = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), want.isNotNull().alias("has"), want.cast("string").eqNullSafe(got.cast("string")).alias("hit")) for n, (want, got) in pairs.items()))).alias("x"))
    out = stacked.groupBy("x.field").agg(F.count_if("x.has").alias("present"), F.count_if(F.col("x.has") & F.col("x.hit")).alias("matched"))
    return out.withColumn("rate", half_even(F.try_divide(F.col("matched").cast("double"), F.col("present"))))


def accuracy_rollup(rows: DataFrame, group: Column, hit: Column) -> DataFrame:
    """(subject, rows, correct, accuracy) for each group, and for all under "total"."""
    out = rows.select(group.alias("subject"), hit.alias("hit")).rollup("subject").agg(F.count(F.lit(1)).alias("rows"), F.count_if("hit").alias("correct"), rate(F.col("hit")).alias("accuracy"), F.grouping("subject").alias("g"))
    return out.withColumn("subject", F.when(F.col("g") == 1, F.lit("total")).otherwise(F.col("subject"))).drop("g")


def preference(rows: DataFrame, beta: float = 0.1) -> DataFrame:
    """(rows, preference_accuracy, mean_margin, mean_loss) of chosen_logp and rejected_logp."""
    margin = F.col("chosen_logp") - F.col("rejected_logp")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), rate(margin > 0).alias("preference_accuracy"), half_even(F.avg(margin), 6).alias("mean_margin"), half_even(F.avg(F.log1p(F.exp(-beta * margin))), 6).alias("mean_loss"),
    )


def mean_logprob(logps: Column, mask: Column) -> Column:
    """struct(logp, tokens): the mean over masked positions, 0.0 and 0 of none."""
    kept = F.filter(F.zip_with(logps, mask, lambda a, m: F.when(m == 1, a)), lambda a: a.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return F.struct(F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0)).alias("logp"), F.size(kept).alias("tokens"))


def best_choice(scores: Column) -> Column:
    """Index of the greatest of an array; the first of equals."""
    return F.array_position(scores, F.array_max(scores)) - 1


def choice_letter(text: Column) -> Column:
    """The first A, B, C or D in a text of any case, "" without one; a word for answer may stand before it."""
    return F.regexp_extract(F.upper(F.trim(text)), r"(?:答案|选项|ANSWER)?\s*[:：]?\s*([ABCD])", 1)


def first_pass_perfect(plan: Column, gold: Column, schema_ok: Column) -> Column:
    """Whether a plan was right at once: filters and sort keys in the same order, whatever fields it returns."""
    return F.coalesce(schema_ok, F.lit(False)) & plan.dropFields("return_fields").eqNullSafe(gold.dropFields("return_fields"))


def token_fit(rows: DataFrame, limit: int) -> DataFrame:
    """(max_prompt, max_total, no_supervision_rate, fits) of prompt_tokens, total_tokens and supervised_tokens."""
    out = rows.agg(F.max("prompt_tokens").alias("max_prompt"), F.max("total_tokens").alias("max_total"), rate(F.col("supervised_tokens") == 0).alias("no_supervision_rate"))
    return out.withColumn("fits", F.coalesce((F.col("max_total") <= limit) & (F.col("no_supervision_rate") == 0), F.lit(True)))
