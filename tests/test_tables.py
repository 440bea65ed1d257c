import json

import pytest
from pyspark.sql import functions as F

from plansmith.functions import short_schema
from plansmith.functions.hints import hints
from plansmith.operators import datasets, snapshot
from plansmith.plans import prompts
from plansmith.sources import files


CARD = """Protein Card: Alpha
Canonical Name: Alpha one
Organism: Homo: sapiens
Domains:
- scaffold=kunitz; engineered=Yes
- scaffold=knottin; engineered=no
CMC / Developability:
- oral=n/a; expression=E. coli; stability=good; really
oral=High
Affinity:
- 12.5 nM (experimental)
- about -3
ignored
Organism: late
"""


@pytest.fixture(scope="module")
def snap(spark):
    meta = lambda i, ids=None, src=None: (i, ids, src)
    cards = [("c1", "s1", CARD, meta("P1", [], ["t"])), ("c2", "s2", "Protein ID: P2\nnothing", meta("")), ("c3", None, None, meta(None)), ("c4", "s", "Affinity:\n- Experimental only", meta("P4", ["given"]))]
    acts = [("i1", "Is Inhibitor: no\n- 7 nM\n- 4.5", meta("P2")[:1]), ("i2", "Is Inhibitor: YES \n- none (Experimental)", ("P2",)), ("", "- 1", ("P2",)), ("i9", "x", ("",)), ("i4", "Is Inhibitor: 0", ("P4",))]
    return {r.candidate_id: r for r in snapshot.snapshot(spark.createDataFrame(cards, snapshot.CARDS), spark.createDataFrame(acts, snapshot.INTERACTIONS)).collect()}


def test_card_row(snap):
    r = snap["P1"]
    assert (r.canonical_name, r.organism, r.scaffold_type, r.engineered, r.expression_system) == ("Alpha one", "Homo: sapiens", "kunitz", True, "E. coli")
    assert r.oral_class == "Unknown" and r.stability_signal == "good; really" and r.inhibitory is None
    assert r.has_experimental_affinity and r.best_affinity_value == -3.0 and r.trace.table_sources == ["t"] and r.trace.interaction_ids == []


def test_card_filled_from_interactions(snap):
    r = snap["P2"]
    assert (r.inhibitory, r.best_affinity_value, r.has_experimental_affinity, r.canonical_name) == (True, 1.0, True, "P2")
    assert r.trace.interaction_ids == ["i1", "i2"] and r.scaffold_type == "unknown"
    assert snap["c3"].organism == "Unknown" and snap["c3"].has_experimental_affinity is False and snap["c3"].best_affinity_value is None
    assert snap["P4"].inhibitory is False and snap["P4"].has_experimental_affinity and snap["P4"].trace.interaction_ids == ["given"]


def candidates(spark, n=60):
    rows = [(f"P{i}", ["knottin", "unknown", "kunitz"][i % 3], ["High", "Unknown", "Low"][i % 3], [True, False, None][i % 3], i % 2 == 0 or i % 3 == 0, "Human" if i % 4 else "Unknown", float(i) if i % 5 else None) for i in range(n)]
    return spark.createDataFrame(rows, "candidate_id string, scaffold_type string, oral_class string, engineered boolean, has_experimental_affinity boolean, organism string, best_affinity_value double")


def test_splits_and_plans(spark):
    df = candidates(spark)
    parts = datasets.split(df, "candidate_id", 7, {"train": 30, "dev": 5, "test": 5}, "rest")
    assert {r.part: r.n for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"train": 30, "dev": 5, "test": 5, "rest": 20}
    again = datasets.split(df.repartition(7), "candidate_id", 7, {"train": 30, "dev": 5, "test": 5}, "rest")
    assert sorted(map(tuple, parts.select("candidate_id", "part").collect())) == sorted(map(tuple, again.select("candidate_id", "part").collect()))
    for r in df.select("*", datasets.gold_plan(7).alias("p")).collect():
        facts = [r.p[k] for k in ("candidate_id", "scaffold_type", "oral_class", "engineered", "has_experimental_affinity", "organism") if r.p[k] is not None]
        assert 1 <= len(facts) <= 4 and r.p.limit in (5, 10, 20) and (r.p.sort_by is None) == (r.best_affinity_value is None)
        assert r.p.scaffold_type in (None, r.scaffold_type) and r.p.scaffold_type != "unknown"


def test_holdout_wording_and_hints(spark):
    df = candidates(spark)
    rows = datasets.holdout(df, 131, "v10", 16, {"train": 30}).withColumn("h", hints(F.col("prompt")).struct()).collect()
    assert len(rows) == 16 and len({r.id for r in rows}) == 16
    assert all(r.h.limit == r.plan.limit and r.h.scaffold_type == r.plan.scaffold_type for r in rows)
    assert len(datasets.holdout(df, 131, "v12", 8, {"train": 100}).collect()) == 8


def test_training_chats_and_pairs(spark):
    df = candidates(spark)
    chats = datasets.training_chats(df, 7, {"train": 3, "v10": 2, "engineered_bridge": 2, "knottin_high": 2, "completion": 0}).collect()
    by = {}
    for r in chats:
        by.setdefault(r.family, []).append(r)
        assert [m.role for m in r.conversations] == ["system", "user", "assistant"] and json.loads(r.conversations[-1].content)["limit"] in (5, 10, 20)
    assert len(by["train"]) == 180 and len(by["v10"]) == 120 and len(by["engineered_bridge"]) == 40 and set(by) == {"train", "v10", "engineered_bridge", "knottin_high"}
    assert by["train"][0].conversations[1].content.startswith("Req: ") and not by["v10"][0].conversations[1].content.startswith("Req: ")
    eval_rows = datasets.holdout(df, 5, "v13", 20, {"train": 10}).withColumn("_pos", F.substring_index("id", "_", -1).cast("int") - 1)
    pairs = datasets.preference_pairs(eval_rows, variants=2).collect()
    assert len(pairs) == 40 and {p.corruption_family for p in pairs} == set("0123456789") and pairs[0].id.endswith("_var1")
    for p in pairs:
        good, bad = (json.loads(x[-1].content) for x in (p.chosen, p.rejected))
        assert list(good) == list(bad) and p.chosen[:-1] == p.rejected[:-1]
        assert good != bad or p.corruption_family in "24"
        if p.corruption_family == "8":
            assert bad["limit"] == "top five"


def test_repair_messages(spark):
    df = spark.createDataFrame([("find kunitz, non-engineered, top 5", "{", ["parse_failed", "semantic_mismatch_limit", "semantic_mismatch_engineered", "odd_code", "parse_failed"])], "r string, b string, e array<string>")
    r = df.select(prompts.repair_messages(F.col("r"), F.col("b"), F.col("e")).alias("m"), prompts.issues(F.array().cast("array<string>"), hints(F.col("r"))).alias("n")).first()
    text = r.m[1].content
    assert "Issues: the JSON is malformed or truncated; limit must match the request (5); engineered must be false because the request says non-engineered; odd code\nBad: {\nJSON only." in text
    assert r.n == "no repair hints available" and "scaffold_type=kunitz, engineered=False, limit=5" in text


def test_short_schema(spark):
    full = "\n".join(f"{k}: v{i}" for i, k in enumerate(short_schema.KEYS)).replace("v0", short_schema.RECORD)
    texts = [full, full.replace("\n", " "), full.replace("\n", " | ").replace("RecordType: AntibodyAntigenEvidence | ", ""), "free text", "", "PDBID: 1 PDBID: 2"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r for r in df.select("i", short_schema.normalized(F.col("t")).alias("n"), short_schema.judged(F.col("t")).alias("j")).collect()}
    assert got[0].n == got[1].n == got[2].n == full and got[3].n == "free text" and got[5].n == "PDBID: 1"
    assert [got[i].j.compliant for i in range(5)] == [True, True, False, False, False] and got[2].j.key_hits == 7 and got[3].j.extra_text == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"x","n":1}\n\n{"id":"y"}\n', encoding="utf-8")
    rows = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int")
    assert [(r.id, r.n) for r in rows.orderBy("_pos").collect()] == [("x", 1), ("y", None)]
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    files.write_jsonl(rows.drop("_pos"), str(tmp_path / "out"), [F.col("id")])
    lines = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")).splitlines()
    assert [json.loads(x) for x in lines] == [{"id": "x", "n": 1}, {"id": "y", "n": None}]
    (tmp_path / "val").mkdir()
    (tmp_path / "val" / "med_val.csv").write_text("﻿id,question,A,B,C,D,answer\n1,q,a,b,c,d,B\n", encoding="utf-8")
    got = files.read_subjects(spark, str(tmp_path), "val", ["med"], "id string, question string, A string, B string, C string, D string, answer string").withColumn("category", F.col("subject"))
    r = files.choice_docs(got).first()
    assert (r.id, r.gold, r.category, r.choices) == ("1", 1, "med", list("abcd"))
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("start\nEpoch:[1/3](20/100), loss: 2.5, lr: 0.0001, epoch_Time: 3\nEpoch:[2/3](40/100), actor_loss: 0.7, reward: 1.5\n")
    logs = files.read_training_logs(spark, str(tmp_path / "logs")).orderBy("epoch").collect()
    assert [(r.epoch, r.step, r.loss, r.lr, r.reward) for r in logs] == [(1, 20, 2.5, 0.0001, None), (2, 40, 0.7, None, 1.5)]
    files.write_markdown({"rows": 2}, rows, ["id", "n"], str(tmp_path / "md"), ["_pos"])
    text = [x for p in (tmp_path / "md").glob("part-*") for x in p.read_text().splitlines()]
    assert text[0] == "- rows: 2" and "| y |  |" in text
    assert files.first_existing([str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        files.first_existing([str(tmp_path / "no")])


def test_schema_rows_and_seeds(spark):
    from plansmith.operators import records

    cols = [s for s, _ in records.FIELDS.values()]
    data = [tuple([*(f"{c}{i:02d}" if c != "mutations" else None for c in cols), "yes" if i % 2 else " ", i]) for i in range(9)]
    df = spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in cols) + ", GT_answer string, _pos int")
    for kind, n in (("full", 8), ("short", 10), ("strict", 5)):
        out = records.schema_rows(df, kind)
        assert out["train"].count() == 3 * n and out["dev"].count() == 6 * n and out["eval"].count() == 6
        r = out["dev"].first().conversations
        assert r[1].content.startswith("RecordType: AntibodyAntigenEvidence\nAntibody: Proteins_canonical_name0") and len(r[1].content.splitlines()) == (16 if kind == "full" else 8)
        assert kind != "full" or "KeyMutations: NA" in r[1].content
    pairs = records.interaction_seeds(df).collect()
    assert len(pairs) == 8 and pairs[1].conversations[1].content.endswith("\n\nSource identifier: Sources_identifier01")
    assert records.record_seeds(df, more=2).count() == 11


def test_multiple_choice(spark):
    from plansmith.operators import records

    q = "id int, question string, A string, B string, C string, D string, answer string, subject string"
    df = spark.createDataFrame([(1, "q1", "a", "b", "c", "d", " d ", "med"), (2, "q2", "a", "b", "c", "d", "A", "med")], q)
    p = records.choice_pairs(df).orderBy("id").collect()
    assert [(r.id, r.chosen[1].content, r.rejected[1].content) for r in p] == [("med_dev_1", "D", "A"), ("med_dev_2", "A", "B")]
    shots = records.with_shots(df, df, 1)
    text = shots.select(records.choice_prompt(F.struct("question", "A", "B", "C", "D", "answer"), F.col("subject"), F.col("shots")).alias("t")).collect()[1].t
    assert text == "以下是中国关于med考试的单项选择题，请选出其中的正确答案。\n\nq1\nA. a\nB. b\nC. c\nD. d\n答案：D\n\n\nq2\nA. a\nB. b\nC. c\nD. d\n答案："
    said = records.scored_choices(df.withColumn("answer", F.trim("answer")), spark.createDataFrame([("1", "d")], "id string, prediction string")).orderBy("id").collect()
    assert [(r.prediction, r.correct) for r in said] == [("d", True), ("", False)]


def test_answer_mask(spark):
    from plansmith.operators import records

    def plain(ids, b, e, longest):
        out, i = [0] * len(ids), 0
        while i < len(ids):
            if ids[i : i + len(b)] != b:
                i += 1
                continue
            j = i + len(b)
            while j < len(ids) and ids[j : j + len(e)] != e:
                j += 1
            for k in range(i + len(b), min(j + len(e), longest, len(ids))):
                out[k] = 1
            i = j + len(e)
        return out

    import random

    rng = random.Random(4)
    rows = [[rng.choice([1, 2, 3, 9]) for _ in range(rng.randrange(0, 30))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, ids array<int>")
    for b, e, longest in (([1, 2], [3], 25), ([1], [2, 3], 99), ([1, 2, 3], [9, 9], 20)):
        for r in df.select("i", records.answer_mask(F.col("ids"), b, e, longest).alias("m")).collect():
            assert r.m == plain(rows[r.i], b, e, longest), (rows[r.i], b, e)


def test_repair_cases_are_told_apart(spark):
    from plansmith.plans.choose import Candidate, semantic_reasons, structural_reasons
    from plansmith.plans.model import flatten

    rows = datasets.holdout(candidates(spark), 3, "v12", 12, {"train": 20})
    out = datasets.repair_chats(rows.withColumnRenamed("id", "key"), 7, 4, key="key").collect()
    assert len(out) == 48 and all(r.conversations[-1].role == "assistant" for r in out)
    for r in rows.select("plan", datasets.repair_cases(F.col("plan")).alias("c"), datasets.plan_json(F.col("plan")).alias("good")).collect():
        right = Candidate.read(r.good)
        assert not right.trace.errors and flatten(right.plan)["limit"] == r.plan.limit
        asked = {k: v for k, v in r.plan.asDict().items() if v is not None and k not in ("candidate_id", "organism")}
        for c in r.c:
            got = Candidate.read(c.text)
            reasons = structural_reasons(got.trace) + semantic_reasons(got.plan, asked)
            for e in c.errors:
                if e.startswith("semantic_mismatch") and "statper" not in c.text and "higheral" not in c.text and "engimber" not in c.text:
                    assert e in reasons, (c.text, c.errors, reasons)


def test_demo(spark, sf):
    from plansmith import demo
    from plansmith.operators.entities import part_candidates

    text = demo.render("oral high engineered, affinity, limit 3", part_candidates(spark, sf))
    assert '"best_affinity_value"' in text and text.count('"candidate_id":') == 3
