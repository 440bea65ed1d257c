"""BPE encoding and decoding with a contiguous rank array.

A short word keeps its part boundaries and the rank of every adjacent pair in two lists; the least rank is found by
a scan, its boundary deleted, and the two neighbouring ranks refreshed. Words of over LONG symbols take a heap
instead, since repeated scans cost their square. Normaliser and pre-tokeniser are those of the vocabulary file, run
by the library's own parts; merging and decoding are done here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.llm.common import table
from plansmith.llm.tokenizing import _HIDDEN, _SHOWN, BYTES, CACHED_CHARS, CACHED_CHUNKS, LATIN, Chunked, _way, vocabulary_path
from plansmith.session import ship

LONG = 128
#: The pattern of the vocabulary file for which the next one stands, on LATIN in lower case.
LATIN_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
NEVER = 1 << 60
_READY: dict[str, "RankBpe"] = {}


def merge_short(s: str, n: int, rank, two) -> list[str]:
    """Parts of s, whose first n - 1 symbols are single characters and whose last is the rest. two: ranks of pairs of single characters."""
    if n < 2:
        return [s]
    bounds = [*range(n), len(s)]
    ranks = [two(s[i : i + 2], NEVER) for i in range(n - 2)]
    ranks.append(rank((s[n - 2], s[n - 1 :]), NEVER))
    while ranks:
        least = min(ranks)
        if least == NEVER:
            break
        i = ranks.index(least)
        del bounds[i + 1], ranks[i]
        if i:
            ranks[i - 1] = rank((s[bounds[i - 1] : bounds[i]], s[bounds[i] : bounds[i + 1]]), NEVER)
        if i < len(ranks):
            ranks[i] = rank((s[bounds[i] : bounds[i + 1]], s[bounds[i + 1] : bounds[i + 2]]), NEVER)
    return [s[a:b] for a, b in zip(bounds, bounds[1:])]


def merge_long(s: str, n: int, rank, two=None) -> list[str]:
    """The same parts with a heap of (rank, left part) over linked parts."""
    end = [*range(1, n), len(s)]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    part = lambda i: s[i : end[i]]
    heap = [(r, i, end[i], end[i + 1]) for i in range(n - 1) if (r := rank((part(i), part(i + 1)), NEVER)) != NEVER]
    heapq.heapify(heap)
    live = [True] * n
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = after[i] if live[i] else -1
        if j < 0 or end[i] != mid or end[j] != stop:
            continue
        end[i], after[i], live[j] = end[j], after[j], False
        if after[i] >= 0:
            before[after[i]] = i
            if (r := rank((part(i), part(after[i])), NEVER)) != NEVER:
                heapq.heappush(heap, (r, i, end[i], end[after[i]]))
        if (k := before[i]) >= 0 and (r := rank((part(k), part(i)), NEVER)) != NEVER:
            heapq.heappush(heap, (r, k, end[k], end[i]))
    out, i = [], 0
    while i >= 0:
        out.append(part(i))
        i = after[i]
    return out


def _u4(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


class RankBpe(Chunked):
    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        library, model = Tokenizer.from_file(path), spec["model"]
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        ranks = {p: i for i, p in enumerate(pairs)}
        self.rank = ranks.get
        self.two = {a + b: i for (a, b), i in ranks.items() if len(a) == len(b) == 1}.get
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.bytewise = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        if self.bytewise:
            self.byte = {chr(b): b for b in _SHOWN} | {c: b for b, c in _HIDDEN.items()}
        self.way = _way(spec)
        self.words: dict[str, bytes] = {}
        #: Latin-1 chunks of a lower-casing, splitting vocabulary need no call into the library.
        self.latin = self.way == "drop" and LATIN_RULE in json.dumps(spec["pre_tokenizer"], ensure_ascii=False) and spec["normalizer"]["normalizers"][-1]["type"] == "Lowercase"

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            n, s = len(word), word + self.suffix
            parts = (merge_short if n <= LONG else merge_long)(s, n, self.rank, self.two)
            ids = _u4([self.vocab[p] for p in parts if p in self.vocab])
            if len(self.words) >= CACHED_CHUNKS // 2:
                self.words.clear()
            if n <= CACHED_CHARS:
                self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        ids: list[bytes] = []
        for piece in self.cut.split(chunk) if self.cut and any(t in chunk for t in self.special) else [chunk]:
            if piece in self.special:
                ids.append(_u4([self.special[piece]]))
            elif self.latin and LATIN.fullmatch(piece):
                for word in LATIN_WORDS.findall(piece.lower()):
                    ids.append(self._word(word if word.isascii() else word.translate(BYTES)))
            elif piece:
                text = self.normalizer.normalize_str(piece) if self.normalizer else piece
                for word, _ in self.pre_tokenizer.pre_tokenize_str(text):
                    ids.append(self._word(word))
        return b"".join(ids)

    def fresh(self, chunks: list[str]) -> list[bytes]:
        return [self._chunk(self.spelled(c)) for c in chunks]

    def decode(self, ids: bytes) -> str:
        """As the library: without a decoder, tokens joined by spaces; a byte-level one gives the bytes back. Special tokens stay."""
        tokens = map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if not self.bytewise:
            return " ".join(tokens)
        return bytes(b for t in tokens for b in ([self.byte[c] for c in t] if t not in self.special else t.encode())).decode("utf-8", "replace")


def ready(path: str) -> RankBpe:
    if path not in _READY:
        _READY[path] = RankBpe(path)
    return _READY[path]


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id_col, n_tokens and ids (array<int>) and decoded (string) per row; with digests, their SHA-256 instead: ids_sha256, decoded_sha256.

    path: vocabulary file. Null text counts as empty: no ids, an empty decoded text. Rows repeat as they come; empty
    input gives an empty result. One map over the rows, no shuffle. Only id_col and text_col are read, so other
    columns can't clash.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n, left, right = [], [], []
                for ids in bpe.many(part.column(1).to_pylist()):
                    decoded = bpe.decode(ids)
                    n.append(len(ids) // 4)
                    left.append(hashlib.sha256(ids).hexdigest() if digests else np.frombuffer(ids, "<u4").astype("i4"))
                    right.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(left, pa.string() if digests else pa.list_(pa.int32())), pa.array(right, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["__id", "n_tokens", *(x.split()[0] for x in tail.split(", "))])

    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    return rows.mapInArrow(run, f"__id {kind}, n_tokens bigint, {tail}").withColumnRenamed("__id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), digests=True)
