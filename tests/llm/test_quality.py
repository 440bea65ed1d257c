import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import docs, read
from pyspark.sql import functions as F

from plansmith.llm import quality
from plansmith.llm.common import fresh_path, remove


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    found = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    hit = {j for i in range(len(found) - 7) if runs[tuple(found[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(found)
    return n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def taken(counts):
    n = Counter(counts)
    if not all(n[i] for i in (1, 2, 3, 4)):
        return {0: 0, 1: 0.5, 2: 1.0, 3: 1.5}
    y = n[1] / (n[1] + 2 * n[2])
    return {0: 0} | {i: max(0.1 * i, min(0.95 * i, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)}


def mean_bits(texts):
    """By the definition: for each occurrence, modified Kneser-Ney from all the others, the discounts from all."""
    pairs = [list(zip([None, *words(t)], words(t))) for t in texts]
    grams = Counter(p for x in pairs for p in x)
    after, before = defaultdict(Counter), Counter(v for _, v in grams)
    for (u, v), n in grams.items():
        after[u][v] = n
    high, low = taken(grams.values()), taken(before.values())

    def bits(u, v):
        row = after[u].copy()
        row[v] -= 1
        left = before.copy()
        if not row[v]:
            left[v] -= 1
        types = sum(left.values())
        short = 1 / (len(before) + 1)
        if types:
            short = (left[v] - low[min(left[v], 3)]) / types + sum(low[min(n, 3)] for n in left.values()) / types * short
        every = sum(row.values())
        if not every:
            return -math.log2(short)
        return -math.log2((row[v] - high[min(row[v], 3)]) / every + sum(high[min(n, 3)] for n in row.values()) / every * short)

    return lambda i: sum(bits(u, v) for u, v in pairs[i]) / len(pairs[i])


def quantile(x, q):
    return float(np.quantile(np.array(x), q))


def limits(rows, rules):
    """Bands of (lang, n_words, bits) of texts that pass the base rules."""
    once = {(a, n, round(b * 1000)) for a, n, b in rows}
    every = [b for _, _, b in once]
    out = {}
    for lang in {a for a, _, _ in rows}:
        own = [b for a, _, b in once if a == lang]
        share = len(own) / (len(own) + rules.lean)
        mid, up = ((share * quantile(own, q) + (1 - share) * quantile(every, q)) / 1000 for q in (0.5, 0.75))
        out[lang] = rules.below * mid, mid + rules.above * max(up - mid, rules.floor)
    return out


@pytest.mark.parametrize(("block", "slice_"), [(quality.BLOCK, quality.SLICE), (700, 200)])
def test_equals_definition(spark, sf, monkeypatch, block, slice_):
    monkeypatch.setattr(quality, "BLOCK", block)
    monkeypatch.setattr(quality, "SLICE", slice_)
    rows = sorted(read(spark, sf).collect(), key=lambda r: len(r.text))[:120]
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id bigint, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang]
        mean = mean_bits([r.text for r in mine])
        for i in range(0, len(mine), max(1, len(mine) // 12)):
            assert got[mine[i].doc_id].perplexity == pytest.approx(2 ** mean(i), rel=1e-9)
    passed = [(r.lang, got[r.doc_id].n_words, math.log2(got[r.doc_id].perplexity)) for r in rows if not got[r.doc_id].base_failed]
    band = limits(passed, quality.Rules())
    for r in rows:
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base(r.text)
        low, high = band[r.lang]
        assert math.log2(g.low) == pytest.approx(low, abs=1e-6) and math.log2(g.high) == pytest.approx(high, abs=1e-6)
        assert g.kept == (not g.base_failed and low <= math.log2(g.perplexity) <= high)


def test_model_alone_answers_alike(spark, sf):
    """A block that wasn't counted as such is looked up in the sorted arrays."""
    rows = read(spark, sf).select("lang", F.col("text").alias("t"), F.col("doc_id").alias("id"))
    path = fresh_path(spark, "test")
    grid, languages = quality.build_model(rows, path)
    score = lambda x: {r.id: r.bits for r in quality.scored(x, path, grid, languages, quality.Rules()).collect()}
    first = score(rows)
    assert score(rows.repartition(5)) == pytest.approx(first, rel=1e-9)
    remove(spark, f"{path}/answers")
    assert score(rows) == first


def test_arrays_round_trip():
    rng = np.random.default_rng(1)
    for x in ([], [0], [2**64 - 1], [0, 1, 2, 2**63, 2**64 - 1], np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))):
        x = np.array(x, np.uint64)
        assert (quality.unpack(quality.pack(x)) == x).all()
    grams = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 5000, dtype=np.uint64))
    for grid in (quality.Grid(0, 0, 1), quality.Grid(2, 0, 3), quality.Grid(4, 3, 6)):
        for at, i in quality._groups(grid.slices(grams)):
            assert (grid.unpack(grid.pack(grams[i]), at) == grams[i]).all()
        w = np.unique(grams >> np.uint64(32))
        for at, i in quality._groups(grid.word_slices(w)):
            assert (grid.unpack_words(grid.pack_words(w[i]), at) == w[i]).all()


def test_grid_grows_with_the_input():
    assert [2 ** (2 * g.near + g.extra) >= n / quality.SLICE for n in (0, 10**7, 10**9, 10**12, 10**14) for g in [quality.Grid.of(n)]] == [True] * 5
    assert quality.Grid.of(0).near == 0


def test_word_order_counts(spark):
    """The same words in an order that no other text has are rejected, and so are words that no other text has."""
    heads, tails = [a + b for a in "bdgk" for b in "aeio"], [a + b for a in "lmnr" for b in "tsvz"]
    pairs = list(zip([f"{h}xu" for h in heads], [f"u{t}o" for t in tails], strict=True))
    rng = random.Random(1)
    texts = [" ".join(f"{a} {b}" for a, b in rng.sample(pairs, 16)) for _ in range(200)]
    salad = " ".join(sorted((w for p in pairs for w in p), key=lambda w: w[::-1]))
    junk = " ".join(f"{w}###" for w in salad.split())
    copies = [" ".join(f"z{i}" for i in range(40))] * 300
    got = {r.doc_id: r for r in quality.assess(docs(spark, [*texts, salad, junk, *copies])).collect()}
    n = len(texts)
    assert not got[n].base_failed and got[n].perplexity > got[n].high and not got[n].kept
    assert not got[n + 1].base_failed and got[n + 1].perplexity > got[n + 1].high and not got[n + 1].kept
    assert got[n + 2].perplexity < got[n + 2].low and not got[n + 2].kept
    assert sum(r.kept for r in got.values()) == n


SCORES = "lang string, n_words bigint, n_repeat_words bigint, bits double"


def test_bands(spark):
    rows = [("en", 50, 0, 2 + i / 100) for i in range(100)] + [("xx", 50, 0, 2.5 + i / 10) for i in range(10)] + [("", 50, 0, 3.0), ("xx", 5, 0, 9.0)]
    rows += [("en", 50, 0, 2.5)] * 500  # copies count once
    rules = quality.Rules()
    got = {r.lang: (r.low, r.high) for r in quality.bands(spark.createDataFrame(rows, SCORES)).collect()}
    want = limits([(a, n, b) for a, n, _, b in rows if n >= rules.min_words], rules)
    assert got.keys() == want.keys()
    for lang, x in want.items():
        assert got[lang] == pytest.approx(x, abs=1e-9)


def test_rare_language_rejects(spark):
    """A text far off all others is rejected in a language of its own too."""
    rows = [("en", 50, 0, 2 + i / 100) for i in range(100)] + [("xx", 50, 0, 40.0), ("yy", 5, 0, 2.0)]
    got = {r.lang: r.high for r in quality.bands(spark.createDataFrame(rows, SCORES)).collect()}
    assert got["xx"] < 40 and got["yy"] is not None


def test_edges(spark):
    long = " ".join(f"w{i % 911}v{i % 7}" for i in range(60_000))
    texts = [None, "", " \n", "a b c " * 10, "one\n\none\n \none", "é" * 40 + " \x85 x\x1cy", " ".join(f"w{i}" for i in range(25)), long]
    df = docs(spark, texts + texts[3:4], [0, 1, 2, 3, 4, None, 6, 7, 3]).withColumn("kept", F.lit(1)).withColumn("lang", F.when(F.col("doc_id") != 6, "en"))
    got = quality.assess(df).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(base(t) for t in texts + texts[3:4])
    assert 6 in {r.doc_id for r in got if r.kept} and [r.doc_id for r in quality.keep_good(df).collect()].count(6) == 1
    assert quality.assess(df.limit(0)).count() == 0
    assert quality.assess(docs(spark, [None, ""])).filter("kept").count() == 0
