"""What a step moves and where its work lands, as the tables grow."""

import uuid

import pytest
from py4j.protocol import Py4JJavaError

from plansmith import catalog
from plansmith.operators import compile as batch
from plansmith.plans.model import Filter, Plan, Sort


def stages(spark, work):
    """What work() gives, and (records read and written by shuffles, tasks) of each stage that it ran."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store, out = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore(), []
    for s in sorted({s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}):
        try:
            x = store.lastStageAttempt(s)
        except Py4JJavaError:  # skipped
            continue
        out.append((x.shuffleReadRecords() + x.shuffleWriteRecords(), x.numTasks()))
    return got, out


def test_equal_plans_run_once(spark):
    rows = spark.range(2000).selectExpr("id AS candidate_id", "'kunitz' AS scaffold_type", "cast(id % 7 AS double) AS best_affinity_value", "id AS _pos")
    plan = lambda k: batch.plan_row(Plan((Filter("scaffold_type", "eq", "kunitz"),), (Sort("best_affinity_value"),), k))
    table = spark.createDataFrame([(i, plan(i % 2 + 3), plan(4), True) for i in range(2000)], f"plan_id int, plan {batch.PLAN}, gold {batch.PLAN}, parsed boolean")
    got, moved = stages(spark, lambda: batch.score_batch(table, rows).collect())
    assert sorted(r.plan_id for r in got) == list(range(2000))
    assert {(r.plan_id % 2, r.result_overlap_at_k) for r in got} == {(0, 0.75), (1, 1.0)}
    assert max(n for n, _ in moved) < 50_000


def test_alike_plans_overlap_once(spark):
    got, moved = stages(spark, lambda: catalog.QUERIES["overlap_at_k"](spark, "/root/testdata/sf0.01").collect())
    assert len(got) == 2000
    assert max(n for n, _ in moved) < 10_000


@pytest.mark.parametrize(
    ("name", "work"),
    [
        ("finalize_batch", "ArrowEvalPython"), ("validate_batch", "ArrowEvalPython"), ("reason_frequency", "RLIKE"), ("hints_rendered", "RLIKE"), ("snapshot_build", "aggregate("),
        ("short_schema_compliance", "array_intersect"), ("candidate_quality_pick", "RLIKE"),
    ],
)
def test_long_work_is_dealt_out_first(spark, sf, name, work):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above, dealt, below = plan.partition("Repartition")
    assert dealt and work in above and work not in below
