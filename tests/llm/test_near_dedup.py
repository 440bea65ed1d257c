import random

import pytest
from helpers import docs, read

from plansmith.llm import common, near_dedup
from plansmith.llm.components import components


def brute(rows, percent=85):
    """component by all pairs of sets."""
    import re

    sets, parent = {}, {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_equals_all_pairs_on_documents(spark, sf):
    df = read(spark, sf)
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df).collect()}
    assert got == want
    assert len({c for _, c, _ in want.values()}) < len(want)


def test_chains_and_edges(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for k in range(40):  # a chain: neighbours alike, ends not
        base[3 * k % 120] = f"n{k}"
        texts.append(" ".join(base))
    texts += [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A b\tc\nd e", " ".join(base) + " x" * 30000]
    texts += [texts[0]] * 5
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df).collect()}
    assert got == brute(rows)
    assert {r.doc_id for r in near_dedup.keep_one(df).collect()} == {i for i, x in got.items() if x[2]}


def test_nulls_repeats_empty(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", "q", "q", "z"], [7, 7, None, None, 3])
    got = sorted(map(str, near_dedup.near_groups(df).collect()))
    assert len(got) == 5 and near_dedup.keep_one(df).count() == 5
    assert near_dedup.near_groups(df.limit(0)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200), (300, 250), (300, 260)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200, 250: 250, 260: 250, 300: 250}


@pytest.mark.parametrize("keys", [0, 50_000])
def test_hubs(spark, monkeypatch, keys):
    """Hot keys meet by broadcast, or in groups where there are too many of them: the same result."""
    monkeypatch.setattr(common, "HOT", 4)
    monkeypatch.setattr(common, "HOT_KEYS", keys)
    monkeypatch.setattr(near_dedup, "PAIRS", 3)
    pairs = [(0, i) for i in range(1, 40)] + [(39, i) for i in range(40, 60)] + [(70, 71), (90, 80), (90, 81)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(60)}, 70: 70, 71: 70, 80: 80, 81: 80, 90: 80}
    rng = random.Random(4)
    rows = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(100)]
        for i in range(30):
            text = list(base)
            text[rng.randrange(100)] = f"x{group}y{i}"
            rows.append((len(rows), " ".join(text)))
    # A long passage that all of another kind share: one bucket, many components.
    shared = " ".join(f"s{i}" for i in range(40))
    rows += [(len(rows) + i, shared + " " + " ".join(f"o{i}q{j}" for j in range(30))) for i in range(25)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs(spark, [t for _, t in rows])).collect()}
    assert got == brute(rows)
