import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from plansmith import catalog
from plansmith.functions import salvage
from plansmith.functions.hints import hints
from plansmith.functions.registry import PROTEIN
from plansmith.operators import evaluate
from plansmith.operators.execute import metadata, run
from plansmith.plans.choose import predict
from plansmith.plans.model import Filter, Plan, Sort, compact, flatten
from plansmith.plans.validate import validate
from plansmith.streaming.filters import follow


@pytest.fixture(scope="module")
def rows(spark):
    data = [("A", 5.0, True, 1), ("B", None, None, 2), ("C", 3.0, False, 3), ("D", 3.0, True, 4), ("E", None, False, 5)]
    return spark.createDataFrame(data, "candidate_id string, best double, engineered boolean, _pos int")


CASES = [
    ((), (Sort("best"),), 3, "CDA", 5),
    ((), (Sort("best", "desc"),), 3, "BEA", 5),
    ((), (Sort("best", "desc"),), None, "BEACD", 5),
    ((), (), 2, "AB", 5),
    ((Filter("best", "exists"),), (), None, "ACD", 3),
    ((Filter("best", "gte", 3.0),), (), None, "ACD", 3),
    ((Filter("best", "lte", 3),), (), None, "CD", 2),
    ((Filter("best", "eq", None),), (), None, "BE", 2),
    ((Filter("best", "in", [3.0, None]),), (), None, "BCDE", 4),
    ((Filter("best", "in", []),), (), None, "", 0),
    ((Filter("best", "in", None),), (), None, "", 0),
    ((), (), 0, "", 5),
    ((Filter("best", "eq", "3.0"),), (), None, "", 0),
    ((Filter("candidate_id", "eq", 5),), (), None, "", 0),
    ((Filter("engineered", "eq", 1),), (), None, "AD", 2),
    ((Filter("engineered", "eq", True), Filter("best", "gte", 4)), (), None, "A", 1),
    ((Filter("nowhere", "eq", None),), (Sort("nowhere"),), None, "ABCDE", 5),
    ((Filter("nowhere", "exists"),), (), None, "", 0),
    ((Filter("candidate_id", "in", ["A", "E", "Z"]),), (Sort("engineered"), Sort("best", "desc")), None, "EA", 2),
    ((Filter("best", "gte", None),), (), None, "", 0),
]


@pytest.mark.parametrize(("filters", "sorts", "limit", "want", "count"), CASES)
def test_vectors(rows, filters, sorts, limit, want, count):
    plan = Plan(filters, sorts, limit)
    assert "".join(r.candidate_id for r in run(rows, plan).collect()) == want
    m = metadata(rows, plan).first()
    assert (m.total_rows, m.filtered_count, m.returned_count) == (5, count, len(want))


def test_nan_substring_and_errors(spark, rows):
    nan = spark.createDataFrame([("A", math.nan, 1), ("B", 2.0, 2)], "candidate_id string, best double, _pos int")
    for op, value, want in (("gte", 1.0, "B"), ("lte", 9.0, "B"), ("eq", math.nan, ""), ("in", [math.nan, 2.0], "B")):
        assert "".join(r[0] for r in run(nan, Plan((Filter("best", op, value),))).collect()) == want
    assert "".join(r[0] for r in run(rows, Plan((Filter("candidate_id", "in", "xAE"),)), substring=True).collect()) == "AE"
    with pytest.raises(ValueError):
        run(rows, Plan((Filter("best", "like", 1),)))
    with pytest.raises(ValueError):
        run(rows, Plan(limit=-1))


def test_plan_pushes_down(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").withColumn("_pos", F.col("p_partkey"))
    text = run(part, Plan((Filter("p_size", "gte", 7),), (Sort("p_size"),), 5, return_fields=("p_partkey", "p_size")), project=True)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in text and "GreaterThanOrEqual(p_size,7)" in text and "p_name" not in text.split("ReadSchema")[-1]


def test_validate_plan_form():
    plan, trace = validate({"filters": [{"field": "oral", "op": "=", "value": "high"}, {"field": "scaffold", "value": "KUNITZ"}, {"field": "price", "op": "=", "value": 1}], "sort": [{"field": "affinity", "direction": "strongest"}]})
    assert plan.filters == (Filter("oral_class", "eq", "High"), Filter("scaffold_type", "eq", "kunitz"))
    assert plan.sort == (Sort("best_affinity_value", "asc"),) and plan.limit == 20 and trace.schema_ok and trace.form == "plan" and trace.notes
    plan, trace = validate({"filters": [{"field": "engineered", "op": "eq", "value": "yes"}], "limit": "7"})
    assert plan.filters == (Filter("engineered", "eq", True),) and plan.limit == 7
    _, trace = validate({"filters": [{"field": "unknown", "op": "=", "value": 1}]})
    assert trace.errors == ["empty_filters"] and trace.empty_filters
    for draft, parsed, errors in (
        (None, False, ["parse_failed", "missing_filters", "empty_filters"]), ([], True, ["invalid_draft_type", "missing_filters", "empty_filters"]),
        ({"filters": "x", "sort": 3, "limit": -1}, True, ["invalid_filters", "invalid_sort", "invalid_limit", "empty_filters"]),
    ):
        assert validate(draft, parsed)[1].errors == errors
    assert validate({"filters": [{"field": "affinity", "op": ">=", "value": "3.5"}, {"field": "name", "op": "in", "value": ["a", "b"]}]})[0].filters == (
        Filter("best_affinity_value", "gte", 3.5), Filter("canonical_name", "in", ["a", "b"]),
    )
    assert validate({"filters": [{"field": "oral", "op": "exists"}], "limit": float("inf")})[1].errors == ["invalid_limit"]


def test_validate_flat_form():
    plan, trace = validate({"scaffold_type": "knottin", "oral_class": "low", "engineered": "false", "organism": "n/a", "sort_by": "affinity", "sort_dir": None, "limit": 5})
    assert plan.filters == (Filter("scaffold_type", "eq", "knottin"), Filter("oral_class", "eq", "Low"), Filter("engineered", "eq", False))
    assert plan.sort == (Sort("best_affinity_value", "asc"),) and plan.limit == 5 and trace.form == "sketch" and trace.schema_ok
    assert flatten(plan)["oral_class"] == "Low" and list(flatten(plan))[-1] == "limit" and Plan.of(plan.as_dict()) == plan
    _, trace = validate({"oral_class": "oral_class", "scaffold_type": "candidate_id", "candidate_id": "candidate_id", "limit": "top", "sort_by": "price"})
    assert trace.errors == ["invalid_slot_value", "invalid_sort", "invalid_limit"]


GOOD = '{"scaffold_type":"kunitz","oral_class":"High","limit":5}'


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GOOD, json.loads(GOOD)), (f"```json\n{GOOD}\n```", json.loads(GOOD)), (f"Sure: {GOOD} done", json.loads(GOOD)), (GOOD[:-1], json.loads(GOOD)), ("", None), ("no json", None),
        ('{"oral_class":"High"}', {"limit": 20, "oral_class": "High"}), ('{"statper_class":"kunitz","higheral_class":"Low","engimber_":fal,"limit":3', {"limit": 3, "scaffold_type": "kunitz", "oral_class": "Low", "engineered": False}),
        ('{"scafold_type":"kunitz","top":7,"x"', {"limit": 7, "scaffold_type": "kunitz"}), ('{"limit":4}', {"limit": 4}), ('"oral class" : "Low, "limit": -2', {"limit": 20, "oral_class": "Low, "}),
    ],
)
def test_salvage(text, want):
    assert salvage.first_object(text, {"limit"}) == want


def test_salvage_column(spark):
    texts = [GOOD, f"so: {GOOD}", None, "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.d and json.loads(r.d) for r in df.select("i", salvage.draft_json(F.col("t")).alias("d")).collect()}
    assert got == {0: json.loads(GOOD), 1: json.loads(GOOD), 2: None, 3: None}


HINTS = [
    ("找 kunitz 候选，oral high，engineered，带实验亲和力，优先把亲和力更强的放前面，先给我前 5 个。", ("kunitz", "High", True, True, 5, "asc")),
    ("Keep knottin, oral class Medium, non-engineered only; rank by affinity quality and keep no more than 12 hits", ("knottin", "Medium", False, None, 12, "asc")),
    ("候选控制在 ２０ 个以内", (None, None, None, None, 20, None)),
    ("trim the output to 7. top 9", (None, None, None, None, 9, None)),
    ("nothing said", (None,) * 6),
    ("sort the binders by binding potency, experimental affinity, cap the response at 3", (None, None, None, True, 3, "asc")),
]


def test_hints(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HINTS)], "i int, t string")
    h = hints(F.col("t"))
    for r in df.select("i", h.struct().alias("h"), h.rendered().alias("r")).collect():
        assert (r.h.scaffold_type, r.h.oral_class, r.h.engineered, r.h.has_experimental_affinity, r.h.limit, r.h.sort_dir) == HINTS[r.i][1], HINTS[r.i][0]
        assert r.i != 4 or r.r == "No deterministic slot hints extracted."


def test_predictions():
    asked = {"scaffold_type": "kunitz", "oral_class": "High", "limit": 5}
    p = predict(GOOD, asked)
    assert not p.repair_reasons and not p.repair_attempted and not p.projection_attempted and p.final is p.first
    p = predict('{"scaffold_type":"knottin","limit":5}', asked, GOOD)
    assert p.repair_reasons == ["semantic_mismatch_scaffold_type", "semantic_mismatch_oral_class"] and p.used_repair and not p.used_projection
    p = predict(GOOD[:-20], {**asked, "sort_by": "best_affinity_value"}, "junk")
    assert not p.used_repair and p.used_projection and p.final.plan.sort == (Sort("best_affinity_value"),) and p.final.plan.limit == 5
    assert json.loads(p.final.answer)["oral_class"] == "High"
    p = predict("junk", {})
    assert p.repair_reasons == ["parse_failed", "missing_filters", "empty_filters"] and not p.projection_attempted


def test_scores(spark):
    rows = spark.createDataFrame([("A", "kunitz", 1), ("B", "kunitz", 2), ("C", "knottin", 3)], "candidate_id string, scaffold_type string, _pos int")
    gold = Plan((Filter("scaffold_type", "eq", "kunitz"),), limit=20)
    assert evaluate.score(gold, gold, rows)["result_overlap_at_k"] == 1.0
    other = evaluate.score(Plan((Filter("scaffold_type", "eq", "kunitz"),), limit=1), gold, rows)
    assert (other["slot_accuracy"], other["field_value_exact_match"], other["result_overlap_at_k"]) == (0.75, 1.0, 0.5)
    assert evaluate.score(None, gold, rows)["draft_valid"] is False
    assert evaluate.score(Plan((Filter("scaffold_type", "like", "x"),)), gold, rows)["execution_success"] is False
    table = spark.createDataFrame([(True, True, True, 1.0, 1.0, True, 1.0), (False, False, False, 0.0, 0.5, False, 0.0)], ", ".join(f"{m} {'double' if m in ('field_value_exact_match', 'slot_accuracy', 'result_overlap_at_k') else 'boolean'}" for m in evaluate.METRICS))
    assert list(evaluate.summarize(table).first()) == [0.5, 0.5, 0.5, 0.5, 0.75, 0.5, 0.5]
    assert list(evaluate.summarize(table.limit(0)).first()) == [0.0] * 7
    one = spark.createDataFrame([([-1.0, -3.0, -9.0], [1, 1, 0]), ([-1.0], [0])], "l array<double>, m array<int>").select(evaluate.mean_logprob(F.col("l"), F.col("m")).alias("x")).collect()
    assert [tuple(r.x) for r in one] == [(-2.0, 2), (0.0, 0)]


def test_streams(spark, rows, tmp_path):
    rows.drop("_pos").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.drop("_pos").schema).parquet(str(tmp_path / "in"))
    out = follow(stream, Plan((Filter("best", "gte", 3.0),), return_fields=("candidate_id",)))
    q = out.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r[0] for r in spark.table("kept").collect()} == set("ACD")
    with pytest.raises(ValueError):
        follow(stream, Plan(limit=3))


def test_registry_and_json():
    assert PROTEIN.field_of(" Binding_Strength ") == "best_affinity_value" and PROTEIN.field_of("") is None
    assert PROTEIN.value_of("oral_class", True) is True and PROTEIN.value_of("organism", " filters ") is None
    assert compact({"a": "é", "b": [1, None]}) == '{"a":"é","b":[1,null]}'


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_sql_agrees(name, spark, sf):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, sf)
    rel = con.execute(catalog.ORACLE[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(df.columns)
    same = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(str([same(r[names.index(c)]) for c in sorted(names)]) for r in rel.fetchall())
    assert sorted(str([same(v) for v in r]) for r in df.select(*sorted(df.columns)).collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
