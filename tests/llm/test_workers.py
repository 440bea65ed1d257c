import pyarrow as pa
from helpers import docs

from plansmith.llm import near_dedup, quality, shingles, tokenizing


def test_caches_end_with_their_task(spark):
    """Spark keeps workers: what an operator remembered there must not be held beside what the next one needs."""
    df = docs(spark, [" ".join(f"d{i}w{j}" for j in range(60)) for i in range(200)])
    assert quality.assess(df).count() == near_dedup.near_groups(df).count() == 200

    def held(batches):
        from plansmith.llm import quality, shingles

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(quality._HASHES) + len(shingles._WORDS)], pa.int64())], ["n"])

    assert sum(r.n for r in spark.range(0, 16, 1, 16).mapInArrow(held, "n bigint").collect()) == 0


def test_task_forgets_what_was_before_and_what_it_learnt():
    from plansmith.llm.workers import tidied

    known = tokenizing.encoder(tokenizing.vocabulary_path("byte_bpe_50k.json"))
    first = known.ids("some words of a text")
    assert known.cache

    def run(batches):
        assert not known.cache
        for b in batches:
            yield b + len(shingles.shingle_set("a b c d e f"))
        assert shingles._WORDS

    assert list(tidied(run)(iter([1, 2]))) == [3, 4]
    assert not shingles._WORDS and known.ids("some words of a text") == first
