"""Tables of answers are compiled as single answers are on the driver."""

from pyspark.sql import functions as F

from plansmith.functions.hints import hints
from plansmith.operators import compile as batch
from plansmith.operators import evaluate
from plansmith.plans.choose import Candidate, predict
from plansmith.plans.model import Filter, Plan, Sort

ANSWERS = [
    None, "", "none", '{"scaffold_type":"kunitz","oral_class":"High","limit":5}', '{"oral_class":"Huge","sort_by":"price","limit":"x"}', '[1]', '{"filters":"x","sort":7,"limit":2}',
    '{"filters":[{"field":"oral","op":"in","value":["high","LOW","no"]},{"field":"affinity","op":">=","value":3},{"field":"organism","op":"exists"},7],"sort":[{"field":"name","direction":"weakest"}],"limit":9}',
    '{"statper_class":"kunitz","engimber_":fal,"limit":3', "x" * 50_000 + '{"oral_class":"Low","limit":4}',
]


def test_validation_agrees(spark):
    rows = spark.createDataFrame(list(enumerate(ANSWERS * 2)), "i int, a string")
    got = {r.i: r for r in batch.validate_batch(rows, "a").collect()}
    for i, a in enumerate(ANSWERS * 2):
        c = Candidate.read(a or "")
        assert got[i].plan.asDict(True) == batch.plan_row(c.plan)
        assert (got[i].trace.errors, got[i].trace.form, got[i].trace.notes) == (c.trace.errors, c.trace.form, c.trace.notes)
    assert batch.validate_batch(rows.limit(0), "a").count() == 0


def test_choice_agrees(spark):
    prompt = "Find oral high candidates, engineered, limit 5"
    pairs = [(a, b) for a in ANSWERS[2:6] for b in (None, ANSWERS[3])]
    rows = spark.createDataFrame([(i, prompt, a, b) for i, (a, b) in enumerate(pairs)], "i int, p string, a string, b string")
    asked = spark.range(1).select(hints(F.lit(prompt)).struct().alias("h")).first().h.asDict()
    for r in batch.finalize_batch(rows, "p", "a", "b").collect():
        want = predict(r.a, asked, r.b)
        assert r.plan.asDict(True) == batch.plan_row(want.final.plan) and r.repair_reasons == want.repair_reasons
        assert (r.used_repair, r.used_projection, r.projection_reasons) == (want.used_repair, want.used_projection, want.projection_reasons)


def test_scores_agree(spark):
    rows = spark.createDataFrame([(f"c{i}", "kunitz" if i % 3 else "knottin", float(i % 7) if i % 5 else None, i % 2 == 0, i) for i in range(40)], "candidate_id string, scaffold_type string, best_affinity_value double, engineered boolean, _pos int")
    up = (Sort("best_affinity_value"),)
    plans = [
        Plan((Filter("scaffold_type", "eq", "kunitz"),), up, 5), Plan((Filter("scaffold_type", "in", ["kunitz", "knottin"]), Filter("engineered", "eq", True)), up, 7), Plan((Filter("best_affinity_value", "gte", 3.0),), (), 9),
        Plan((), up, 4), Plan((Filter("organism", "exists"),), up, 4), Plan((Filter("best_affinity_value", "exists"), Filter("best_affinity_value", "lte", 2.0)), (Sort("best_affinity_value", "desc"),), 50),
    ]
    pairs = [(p, g) for p in [*plans, None] for g in plans]
    data = [(i, None if p is None else batch.plan_row(p), batch.plan_row(g), p is not None) for i, (p, g) in enumerate(pairs)]
    table = spark.createDataFrame(data, f"plan_id int, plan {batch.PLAN}, gold {batch.PLAN}, parsed boolean")
    got = {r.plan_id: r.asDict() for r in batch.score_batch(table, rows).collect()}
    assert len(got) == len(pairs)
    for i in range(0, len(pairs), 3):
        p, g = pairs[i]
        assert {k: got[i][k] for k in evaluate.METRICS} == evaluate.score(p, g, rows), (p, g)
