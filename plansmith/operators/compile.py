"""Whole tables of answers to plans: validation, the choice between answers, execution and scores.

Drafts are read and validated in Arrow batches by the same functions that handle one draft on the driver, so both
always agree; what comes out are typed columns, and everything after that is joins and aggregations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plansmith.functions.hints import Hints, hints
from plansmith.operators.execute import order
from plansmith.plans.choose import Candidate, predict
from plansmith.plans.model import Plan, Sort, compact
from plansmith.session import ship, spread

PLAN = (
    "struct<intent:string,entity:string,filters:array<struct<field:string,op:string,value:string>>,sort:array<struct<field:string,direction:string>>,"
    "limit:int,return_fields:array<string>>"
)
TRACE = "struct<parsed:boolean,form:string,errors:array<string>,notes:array<string>,empty_filters:boolean,projected:boolean,schema_ok:boolean>"
HINTS = tuple(f.name for f in fields(Hints))
#: Plans up to which range-only plans meet all rows by broadcast.
BROADCAST_PLANS = 50_000


def plan_row(plan: Plan) -> dict:
    """The plan as a row of type PLAN: a filter's value is JSON text."""
    out = plan.as_dict()
    return out | {"filters": [f | {"value": None if f["value"] is None else compact(f["value"])} for f in out["filters"]], "limit": min(plan.limit, 2**31 - 1)}


def _trace_row(c: Candidate) -> dict:
    t = c.trace
    return {"parsed": t.parsed, "form": t.form, "errors": t.errors, "notes": t.notes, "empty_filters": t.empty_filters, "projected": t.projected, "schema_ok": t.schema_ok}


def _in_batches(kind: str, each: Callable[..., dict]) -> Callable:
    """An Arrow UDF of type kind that works each(...) out once for all equal arguments of a batch."""
    made = to_arrow_type(T.StructType.fromDDL(kind))

    def of(*columns: pa.Array) -> pa.Array:
        seen: dict[tuple, int] = {}
        at = [seen.setdefault(x, len(seen)) for x in zip(*(c.to_pylist() for c in columns), strict=True)]
        return pa.array([each(*x) for x in seen], made).take(pa.array(at, pa.int64()))

    return F.arrow_udf(of, kind)


def _validated(answer: str | None) -> dict:
    c = Candidate.read(answer or "")
    return {"plan": plan_row(c.plan), "trace": _trace_row(c)}


def validate_batch(rows: DataFrame, answer: str) -> DataFrame:
    """rows, dealt out, with plan and trace of each answer; null answers are empty ones."""
    ship(rows.sparkSession)
    read = _in_batches(f"plan {PLAN}, trace {TRACE}", _validated)
    return spread(rows).withColumn("_v", read(F.col(answer))).withColumns({"plan": F.col("_v.plan"), "trace": F.col("_v.trace")}).drop("_v")


CHOSEN = (
    f"plan {PLAN}, trace {TRACE}, first_plan {PLAN}, first_trace {TRACE}, repair_reasons array<string>, projection_reasons array<string>, repair_attempted boolean, "
    "used_repair boolean, projection_attempted boolean, used_projection boolean"
)


def _chosen(first: str | None, repaired: str | None, *asked) -> dict:
    p = predict(first or "", dict(zip(HINTS, asked, strict=True)), repaired)
    return {
        "plan": plan_row(p.final.plan), "trace": _trace_row(p.final), "first_plan": plan_row(p.first.plan), "first_trace": _trace_row(p.first), "repair_reasons": p.repair_reasons,
        "projection_reasons": p.projection_reasons, "repair_attempted": p.repair_attempted, "used_repair": p.used_repair, "projection_attempted": p.projection_attempted, "used_projection": p.used_projection,
    }


def finalize_batch(rows: DataFrame, prompt: str, first: str, repaired: str) -> DataFrame:
    """rows, dealt out, with the plan that counts for each request: the first answer's, the repaired one's (null: none was made) or the one aligned with the request's hints, and how it came to that."""
    ship(rows.sparkSession)
    done = spread(rows).withColumn("_c", _in_batches(CHOSEN, _chosen)(F.col(first), F.col(repaired), *(c for _, c in hints(F.col(prompt)).items())))
    return done.select(*rows.columns, "_c.*")


# ---- execution ----


def _value(filter_: Column, kind: T.DataType) -> Column:
    return F.try_variant_get(F.try_parse_json(filter_["value"]), "$", kind.simpleString())


def execute_batch(rows: DataFrame, plans: DataFrame, id_col: str = "candidate_id", position: str = "_pos") -> DataFrame:
    """(plan_id, rank, id_col) of each plan's rows in plans (plan_id, plan of type PLAN).

    Plans with the same fields, operators and order run together: the driver sees one row for each such shape, of which
    there are as many as the vocabulary allows. Plans of a shape with the same filters are one class: rows meet classes, are
    ranked there up to the greatest limit, and only what is left meets the plans. Equality and lists of values are join keys,
    ranges conditions on top of them. Values that don't fit a column's type, and fields that rows lack, match nothing; an
    unsupported operator is an error.
    """
    shape = F.struct(F.transform("plan.filters", lambda f: F.struct(f["field"], f["op"])).alias("filters"), F.col("plan.sort").alias("sort"))
    tagged = plans.withColumns({"_shape": F.to_json(shape), "_class": F.to_json("plan.filters")})
    out = rows.sparkSession.createDataFrame([], f"plan_id {plans.schema['plan_id'].dataType.simpleString()}, rank int, {id_col} {rows.schema[id_col].dataType.simpleString()}")
    for s in tagged.groupBy("_shape").agg(F.first(shape).alias("s"), F.max("plan.limit").alias("most"), F.count_distinct("_class").alias("n")).collect():
        mine = tagged.filter(F.col("_shape") == s["_shape"]).select("plan_id", "plan", "_class")
        out = out.unionByName(_same_shape(rows, mine, s, id_col, position))
    return out


def _same_shape(rows: DataFrame, plans: DataFrame, s, id_col: str, position: str) -> DataFrame:
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    sorts = tuple(Sort(x["field"], x["direction"]) for x in s["s"]["sort"])
    asked, met, keyed, here = plans.select("plan_id", F.col("plan.limit").alias("limit"), "_class"), [], False, rows
    wanted = plans.groupBy("_class").agg(F.max("plan.limit").alias("most"), F.first("plan.filters").alias("filters"))
    for i, f in enumerate(s["s"]["filters"]):
        name, op, v = f["field"], f["op"], f"_v{i}"
        if op not in {"eq", "in", "gte", "lte", "exists"}:
            raise ValueError(f"unsupported operator: {op}")
        if name not in kinds:
            here = here.filter(F.lit(False))
            continue
        if op == "exists":
            here = here.filter(F.col(name).isNotNull())
            continue
        said = F.col("filters")[i]
        if op == "in":
            many = F.try_variant_get(F.try_parse_json(said["value"]), "$", f"array<{kinds[name].simpleString()}>")
            wanted = wanted.withColumn(v, F.explode(F.array_distinct(F.coalesce(many, F.array(_value(said, kinds[name]))))))
        else:
            wanted = wanted.withColumn(v, _value(said, kinds[name]))
        a, b = F.col(f"r.{name}"), F.col(f"p.{v}")
        met.append(a == b if op in {"eq", "in"} else a >= b if op == "gte" else a <= b)
        keyed = keyed or op in {"eq", "in"}
    needed = dict.fromkeys(c for c in [*(f["field"] for f in s["s"]["filters"]), *(x.field for x in sorts), id_col, position] if c in kinds)
    here, wanted = here.select(*needed), wanted.drop("filters")
    if not met:  # the same rows for all of them, up to each one's limit
        top = here.orderBy(*order(here, sorts, position)).limit(s["most"])
        top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order(here, sorts, position)))).select("rank", id_col)
        return top.alias("r").join(asked.alias("p"), F.col("r.rank") <= F.col("p.limit")).select("p.plan_id", "rank", id_col)
    few = not keyed and s["n"] <= BROADCAST_PLANS
    both = here.alias("r").join((F.broadcast(wanted) if few else wanted).alias("p"), reduce(and_, met)).select("p._class", "p.most", *(F.col(f"r.{c}").alias(c) for c in needed))
    rank = F.row_number().over(Window.partitionBy("_class").orderBy(*order(both, sorts, position)))
    # The literal bound lets Spark cut each class before the shuffle.
    best = both.withColumn("rank", rank).filter((F.col("rank") <= (s["most"] or 0)) & (F.col("rank") <= F.col("most"))).select("_class", "rank", id_col)
    return best.alias("r").join(asked.alias("p"), (F.col("r._class") == F.col("p._class")) & (F.col("r.rank") <= F.col("p.limit"))).select("p.plan_id", "r.rank", F.col(f"r.{id_col}").alias(id_col))


# ---- scores ----


def _share(gold: Column, said: Column) -> Column:
    found = F.bround(F.size(F.array_intersect(gold, said)) / F.size(F.array_distinct(gold)), 4)
    return F.when(F.size(gold) > 0, found).otherwise((F.size(said) == 0).cast("double"))


def filter_texts(plan: Column) -> Column:
    return F.transform(plan["filters"], lambda f: F.concat_ws("\x1f", f["field"], f["op"], F.coalesce(f["value"], F.lit("null"))))


def slot_texts(plan: Column) -> Column:
    head = F.array(F.concat_ws("\x1f", F.lit("intent"), plan["intent"]), F.concat_ws("\x1f", F.lit("entity"), plan["entity"]), F.concat_ws("\x1f", F.lit("limit"), plan["limit"].cast("string")))
    sorts = F.transform(plan["sort"], lambda s: F.concat_ws("\x1f", F.lit("sort"), s["field"], s["direction"]))
    return F.concat(head, F.transform(filter_texts(plan), lambda f: F.concat_ws("\x1f", F.lit("filter"), f)), sorts)


def _run_text(plan: Column) -> Column:
    """What of a plan decides its rows, as text: plans with the same one are run once."""
    return F.to_json(F.struct(plan["filters"].alias("filters"), plan["sort"].alias("sort"), plan["limit"].alias("limit")))


def _overlaps(pairs: DataFrame, plans: DataFrame, rows: DataFrame, id_col: str, position: str) -> DataFrame:
    """(_g, _p, overlap) of pairs of plans by their run texts; plans (plan_id, plan) has each of them once under its text."""
    ran = execute_batch(rows, plans, id_col, position).select("plan_id", id_col).distinct()
    side = lambda c, n: pairs.join(ran.withColumnRenamed("plan_id", c), c).select("_g", "_p", id_col, F.lit(1).alias(n))
    n = side("_g", "g").join(side("_p", "f"), ["_g", "_p", id_col], "full").groupBy("_g", "_p")
    n = n.agg(F.count("g").alias("g"), F.count("f").alias("f"), F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("both"))
    out = pairs.join(n, ["_g", "_p"], "left").na.fill(0, ["g", "f", "both"])
    return out.select("_g", "_p", F.when(F.col("g") > 0, F.bround(F.col("both") / F.col("g"), 4)).otherwise((F.col("f") == 0).cast("double")).alias("overlap"))


def score_batch(answers: DataFrame, rows: DataFrame, id_col: str = "candidate_id", position: str = "_pos") -> DataFrame:
    """(plan_id, draft_valid, json_parsed, non_empty_filter, field_value_exact_match, slot_accuracy, execution_success, result_overlap_at_k) of answers (plan_id, plan, gold, parsed), both plans of type PLAN; a null plan was no plan."""
    p, g, ok = F.col("plan"), F.col("gold"), F.col("plan").isNotNull() & F.coalesce(F.col("plan.intent") != "", F.lit(False)) & F.coalesce(F.col("plan.entity") != "", F.lit(False))
    number = lambda c: F.when(ok, c).otherwise(F.lit(0.0))
    flat = answers.select(
        "plan_id", ok.alias("draft_valid"), F.col("parsed").alias("json_parsed"), (ok & (F.size(p["filters"]) > 0)).alias("non_empty_filter"),
        number(_share(filter_texts(g), filter_texts(p))).alias("field_value_exact_match"), number(_share(slot_texts(g), slot_texts(p))).alias("slot_accuracy"), ok.alias("execution_success"),
        F.when(ok, _run_text(g)).alias("_g"), F.when(ok, _run_text(p)).alias("_p"),
    )
    both = answers.filter(ok).select(_run_text(g).alias("_g"), _run_text(p).alias("_p"), "gold", "plan")
    pairs = both.select("_g", "_p").distinct()
    plans = both.select(F.inline(F.array(F.struct(F.col("_g").alias("plan_id"), F.col("gold").alias("plan")), F.struct(F.col("_p").alias("plan_id"), "plan"))))
    ran = plans.groupBy("plan_id").agg(F.first("plan").alias("plan"))
    scores = _overlaps(pairs, ran, rows, id_col, position)
    return flat.join(scores, ["_g", "_p"], "left").select(*(c for c in flat.columns if c not in {"_g", "_p"}), F.when(F.col("draft_valid"), F.col("overlap")).otherwise(F.lit(0.0)).alias("result_overlap_at_k"))
