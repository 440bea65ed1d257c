import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import docs, read
from tokenizers import Tokenizer

from plansmith.llm import bpe, packing, token_files
from plansmith.llm.common import fresh_path
from plansmith.llm.tokenizing import ChunkEncoder, vocabulary_path

WORD, BYTE = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n", "a", "A  b\t\tc \n d", "x" * 700, "ab" * 400, "Don't we'll I'M 'S", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ ß", "é ́ é",
    "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "a b　c\u0085d\x1ce", "12345 6.7 ½ ٣", "😀👩‍👩‍👧 ﻿ ​", "a\r\nb \r c", "   lead and trail   ", "\x00\x01", "line\nFeed. é\nÉcole,\n\nTwo\n 3\n4 a\n!b x\n", "foo'. bar's. A, x|| a.b. <|ENDOFTEXT|>. <|endoftext|>.",
]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def u4(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_and_rank_merges_equal_library(path, spark, sf):
    t, fast, own = library(path), ChunkEncoder(path), bpe.RankBpe(path)
    texts = [x or "" for x in ODD] + [r.text for r in read(spark, sf).limit(60).collect()]
    rng = random.Random(5)
    texts += ["".join(rng.choice("ab \n\t'é.1Σ") for _ in range(rng.randrange(40))) for _ in range(400)]
    for text in texts:
        want = t.encode(text, add_special_tokens=False).ids
        assert fast.ids(text) == u4(want), repr(text)
        assert own.ids(text) == u4(want), repr(text)
        assert own.decode(u4(want)) == t.decode(want, skip_special_tokens=False)


def test_long_words_merge_alike():
    b = bpe.RankBpe(WORD)
    rng = random.Random(3)
    for n in (1, 2, 3, 40, 200):
        for _ in range(30):
            w = "".join(rng.choice("thenoi") for _ in range(n))
            assert bpe.merge_short(w + "</w>", n, b.rank, b.two) == bpe.merge_long(w + "</w>", n, b.rank)


def test_encode_texts(spark):
    t, df = library(WORD), docs(spark, ODD)
    got = {r.doc_id: r for r in bpe.encode_texts(df, WORD, digests=True).collect()}
    full = {r.doc_id: r for r in bpe.encode_texts(df, WORD).collect()}
    for i, x in enumerate(ODD):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(u4(ids)).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert full[i].ids == ids
    assert bpe.encode_texts(df.limit(0), WORD).count() == 0


def test_token_files(spark):
    t = library(WORD)
    ids = [*range(len(ODD) - 2), 3, None]
    df, path = docs(spark, ODD, ids), fresh_path(spark, "t")
    manifest = token_files.write_tokens(df, WORD, path)
    want = sorted(((-1 if i is None else i), x or "") for i, x in zip(ids, ODD))
    got = [(-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.scan_tokens(spark, path).orderBy("start").collect()]
    at, expected = 0, []
    for i, x in want:
        e = [*t.encode(x, add_special_tokens=False).ids, 1]
        expected.append((i, at, len(e), zlib.crc32(u4(e))))
        at += len(e)
    assert [x[0] for x in got] == [x[0] for x in expected]
    assert sorted(x[2:] for x in got) == sorted(x[2:] for x in expected)
    assert sum(x[2] for x in got) == at == manifest["ids"]
    keys = spark.createDataFrame([(5,), (5,), (3,), (10**12,), (None,)], "doc_id bigint")
    found = token_files.lookup_tokens(keys, path).collect()
    assert sorted(r.doc_id for r in found) == [3, 3, 5, 5]
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found} <= set(got)
    empty = fresh_path(spark, "t")
    token_files.write_tokens(df.limit(0), WORD, empty)
    assert token_files.scan_tokens(spark, empty).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    h = token_files.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(5000))
    assert token_files.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_single_lookups_read_a_few_bytes(tmp_path):
    """Opening a shard and finding a key takes a bounded number of bytes, however large the shard."""
    keys = np.unique(np.random.default_rng(2).integers(-(2**62), 2**62, 60_000))
    writer = token_files.ShardWriter(str(tmp_path / "s.tok"), 2)
    for k in keys.tolist():
        writer.add(k, np.arange(k % 5, dtype="<u4"))
    writer.close()
    shard, read = token_files.Shard(str(tmp_path / "s.tok")), []
    plain = shard.file.read_at
    for x in (shard.keys, shard.ends, shard.marks, shard.rows, shard.index.words, shard.index.ranks, shard.index.rest):
        x.read = lambda n, at: read.append(n) or plain(n, at)
    for i in (0, 17, 59_000):
        assert shard.find(keys[i : i + 1]).tolist() == [i] and shard.key(i) == keys[i]
        assert shard.row(i)[1].tolist() == list(range(int(keys[i]) % 5))
    assert sum(read) < 3 * 2000
    assert (shard.find(keys) == np.arange(len(keys))).all()
    assert shard.find(np.array([1, 2, 3])).tolist() == [-1] * 3


def packed_ok(rows, want, size=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, ids in want.items():
        at = 0
        for r in sorted(by_doc.pop(d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(u4(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return sum(r.length for r in rows) / (size * len(by_seq))


def test_packing(spark, sf):
    t, df = library(BYTE), read(spark, sf)
    want = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in df.collect()}
    full = packed_ok(packing.pack(df.repartition(3), BYTE).collect(), want)
    assert full > 0.97
    rows = packing.pack(docs(spark, ODD), BYTE, size=64, windows=2, with_ids=True).collect()
    packed_ok(rows, {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(ODD)}, 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack(df.limit(0), BYTE).count() == 0
