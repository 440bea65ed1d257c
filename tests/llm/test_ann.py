import numpy as np
import pytest
from helpers import read
from pyspark.sql import functions as F

from plansmith.llm import ann


def brute(rows, asked, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in asked:
        d = np.sqrt(((x - np.array(v, float)) ** 2).sum(1))
        best = {}
        for j, s in zip(ids.tolist(), d.tolist()):
            if j != i:
                best[j] = min(s, best.get(j, s))
        out[i] = sorted((s, j) for j, s in best.items())[:k]
    return out


def test_recall_and_order(spark, sf):
    df = read(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    asked = df.filter("vec_id % 20 = 0")
    want = brute(rows, [(r.vec_id, r.embedding) for r in asked.collect()])
    got = {}
    for r in ann.nearest(df, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    exact = {(i, j): s for i, x in want.items() for s, j in x}
    hits = 0
    for i, x in got.items():
        assert x == sorted(x) and len(x) == 10 and i not in {j for _, j in x}
        for s, j in x:
            if (i, j) in exact:
                hits += 1
                assert s == pytest.approx(exact[i, j], rel=1e-12)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_copies_ties_and_bad_vectors(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.5]
    rows = [(i, v) for i in range(40)] + [(i, w) for i in range(40, 44)] + [(44, None), (45, [0.0] * 3), (46, [1.0, None, 2.0]), (47, [1.0, float("nan"), 2.0]), (48, [float("inf"), 0.0, 1.0]), (49, [1.0, 2.0]), (None, v), (3, v), (3, w)]
    df = spark.createDataFrame([(i, x, "a") for i, x in rows], "vec_id bigint, embedding array<double>, t string")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id in (0, 5, 41, 44, 45)")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert [x[1] for x in sorted(got[0])] == list(range(1, 11)) and {x[2] for x in got[0]} == {0.0}
    assert [x[1] for x in sorted(got[5])] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert [x[1] for x in sorted(got[41])][:4] == [3, 40, 42, 43] and set(got) == {0, 5, 41}
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0
    assert len(ann.nearest(df.filter("vec_id in (0, 40)"), df.filter("vec_id = 0")).collect()) == 1


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES", 4)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 8)), 5 + 1e-3 * rng.normal(size=(150, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = brute(rows, [r for r in rows if r[0] >= 200])
    got = {}
    for r in ann.nearest(df, df.filter(F.col("vec_id") >= 200)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[i] & {j for _, j in want[i]}) for i in want]) > 9.5


def test_lengths_are_searched_apart(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id in (3, 105)"), k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got[3]) == [(1, 2, 1.0), (2, 4, 1.0), (3, 1, 2.0)] and sorted(got[105]) == [(1, 104, 1.0), (2, 106, 1.0), (3, 103, 2.0)]


def test_share_compared_falls():
    """The more vectors, the smaller the share that a query meets, while recall stays."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(16_000, 64))
    shares = []
    for n in (500, 4000, 16_000):
        met = ann.Tables(x[:n], ann.Settings()).met(x[:30])
        d = ((x[:30, None] - x[None, :n]) ** 2).sum(2)
        near = np.argsort(d, axis=1)[:, 1:11]
        assert np.take_along_axis(met, near, 1).mean() > 0.92
        shares.append(met.mean())
    assert shares[1] < 0.85 * shares[0] and shares[2] < 0.75 * shares[1], shares
