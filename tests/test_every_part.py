"""Plan scores against brute force over a few parts; every part has a plan."""

from statistics import mean

import pytest

from plansmith import catalog
from plansmith.operators.entities import part_candidates


def ranked(rows, key):
    out = {}
    for r in sorted(rows, key=lambda r: (r.best_affinity_value is None, r.best_affinity_value or 0, r.candidate_id)):
        out.setdefault(key(r, r.oral_class), []).append(r.candidate_id)
    return out


def said(r):
    return "High" if r.candidate_id % 3 == 0 else r.oral_class


def overlaps(rows, key):
    """(plan_id, n_gold, n_common, overlap) of every part."""
    by = ranked(rows, key)
    for r in rows:
        k = (5, 10, 20)[r.candidate_id % 3]
        gold, found = (set(by.get(key(r, o), [])[:k]) for o in (r.oral_class, said(r)))
        yield r.candidate_id, len(gold), len(gold & found), round(len(gold & found) / len(gold), 4)


def scored(rows):
    """(plan_id, overlap, field, slot) of every part; every eleventh has no plan. Two filters, and four slots beside them."""
    for (i, _, _, x), r in zip(overlaps(rows, lambda r, o: (o, r.engineered)), rows, strict=True):
        same, none = said(r) == r.oral_class, i % 11 == 0
        yield (i, 0.0, 0.0, 0.0) if none else (i, x, 1.0, 1.0) if same else (i, x, 0.5, round(5 / 6, 4))


@pytest.fixture(scope="module")
def small(spark, sf, tmp_path_factory):
    """The tables of the parts below 60."""
    at = tmp_path_factory.mktemp("parts")
    for name, key in (("part", "p_partkey"), ("lineitem", "l_partkey")):
        spark.read.parquet(f"{sf}/{name}.parquet").filter(f"{key} < 60").write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_plans_of_every_part(spark, small):
    rows = part_candidates(spark, small).collect()
    want = sorted(overlaps(rows, lambda r, o: (o, r.engineered, r.scaffold_type)))
    assert len(want) == spark.read.parquet(f"{small}/part.parquet").count() > 50
    assert sorted((r.plan_id, r.n_gold, r.n_common, r.result_overlap_at_k) for r in catalog.QUERIES["overlap_at_k"](spark, small).collect()) == want
    want = sorted(scored(rows))
    got = sorted((r.plan_id, r.result_overlap_at_k, r.field_value_exact_match, r.slot_accuracy) for r in catalog.QUERIES["score_batch"](spark, small).collect())
    assert got == want
    got = sorted((r.plan_id, r.field_value_exact_match, r.slot_accuracy) for r in catalog.QUERIES["slot_accuracy"](spark, small).collect())
    assert got == [(w[0], *w[2:]) for w in want]
    (total,) = catalog.QUERIES["score_summary"](spark, small).collect()
    assert total.result_overlap_at_k == pytest.approx(mean(w[1] for w in want), abs=1e-4)
    assert total.slot_accuracy == pytest.approx(mean(w[3] for w in want), abs=1e-4)
    assert total.plan_valid_rate == pytest.approx(mean(w[0] % 11 != 0 for w in want), abs=1e-4)
