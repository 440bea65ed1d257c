"""Token-id files with a minimal perfect hash index.

Rows are range-partitioned and sorted by key, so shards and the rows in them ascend. Each shard is one file: raw
ids, then row keys and offsets, then a minimal perfect hash over the distinct keys whose slots hold a fingerprint
and the key's first row. The hash's bits lie in blocks with the rank before each. Opening a shard reads only its
footer; a lookup hashes the key, reads a block of bits with its rank, then the slot's fingerprint, row and offsets, and the
ids: constant time, without keys or index in memory. Many lookups at once read the sections whole. Files are written
under a temporary name and moved, so a lost or repeated task leaves one whole file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.llm.common import fresh_path, table
from plansmith.llm.tokenizing import encoder, vocabulary_path
from plansmith.session import ship

MAGIC = b"TOKSHRD2"
LEVELS, BITS = 40, 512
#: Up to so many entries of a section are read one by one.
FEW = 64
#: Keys that a scan looks up together.
LOOKED_UP = 4096


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over uint64 keys."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Section:
    """An array that may lie in a file: few entries are read one by one, many together with all others."""

    def __init__(self, read, at: int, n: int, kind: str) -> None:
        self.read, self.at, self.n, self.kind, self.held = read, at, n, np.dtype(kind), None

    @classmethod
    def of(cls, x: np.ndarray) -> "Section":
        out = cls(None, 0, len(x), x.dtype.str)
        out.held = x
        return out

    def __len__(self) -> int:
        return self.n

    def all(self) -> np.ndarray:
        if self.held is None:
            self.held = self.part(0, self.n)
        return self.held

    def part(self, i: int, j: int) -> np.ndarray:
        if self.held is not None:
            return self.held[i:j]
        return np.frombuffer(self.read((j - i) * self.kind.itemsize, self.at + i * self.kind.itemsize), self.kind)

    def take(self, at: np.ndarray, run: int = 1) -> np.ndarray:
        """Runs of entries from multiples of run on, a row each."""
        if self.held is not None or len(at) > FEW:
            return self.all().reshape(-1, run)[at]
        return np.array([self.part(i * run, (i + 1) * run) for i in at.tolist()], self.kind).reshape(len(at), run)


class PerfectHash:
    """Cascaded bit arrays: a key that lies alone on its bit is placed there, the others go on to the next level. A slot is the bit's rank.

    sizes: bits of each level, whole blocks of 512. words: all levels' bits. ranks: bits set before each block. rest:
    keys that no level took, sorted; their slots follow.
    """

    def __init__(self, sizes: list[int], words: Section, ranks: Section, rest: Section, placed: int) -> None:
        self.sizes, self.words, self.ranks, self.rest, self.placed = sizes, words, ranks, rest, placed
        self.base = np.cumsum([0, *sizes]) // BITS

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """keys: distinct uint64."""
        levels, rest = [], keys
        while len(rest) and len(levels) < LEVELS:
            size = -(-2 * len(rest) // BITS) * BITS
            at = (_mix(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            levels.append(bits)
            rest = rest[~alone]
        bits = np.concatenate([*levels, np.zeros(0, bool)])
        ranks = np.cumsum(np.append(0, bits.reshape(-1, BITS).sum(1)))
        words = np.packbits(bits, bitorder="little").view("<u8")
        return cls([len(x) for x in levels], Section.of(words), Section.of(ranks[:-1].astype("<i8")), Section.of(np.sort(rest)), int(ranks[-1]))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; keys that weren't built in get any slot or -1."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, size in enumerate(self.sizes):
            if not len(todo):
                return out
            at = (_mix(keys[todo], n) % np.uint64(size)).astype(np.int64)
            block, word, bit = self.base[n] + at // BITS, at % BITS // 64, (at % 64).astype(np.uint64)
            words = self.words.take(block, BITS // 64)
            own = words[np.arange(len(at)), word]
            hit = own >> bit & np.uint64(1) == 1
            before = np.where(np.arange(BITS // 64) < word[:, None], np.bitwise_count(words), 0).sum(1)
            before = before + np.bitwise_count(own & (np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = self.ranks.take(block[hit])[:, 0] + before[hit]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            rest = self.rest.all()
            at = np.minimum(np.searchsorted(rest, keys[todo]), len(rest) - 1)
            hit = rest[at] == keys[todo]
            out[todo[hit]] = self.placed + at[hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 977) >> np.uint64(32)).astype(np.uint32)


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    def __init__(self, uri: str, width: int) -> None:
        self.fs, self.path = _filesystem(uri)
        self.temporary = f"{self.path}.{uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.width = self.fs.open_output_stream(self.temporary), width
        self.keys: list[int | None] = []
        self.ends = [0]

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(key)
        self.ends.append(self.ends[-1] + len(ids))

    def close(self) -> None:
        null = sum(k is None for k in self.keys)  # nulls come first
        keys = np.array(self.keys[null:], np.int64)
        distinct, first = np.unique(keys, return_index=True)
        index = PerfectHash.build(distinct.view(np.uint64))
        slots = index.slots(distinct.view(np.uint64))
        marks, rows = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
        marks[slots], rows[slots] = fingerprints(distinct.view(np.uint64)), first + null
        sections = {"keys": keys, "ends": np.array(self.ends, np.int64), "marks": marks, "rows": rows, "rest": index.rest.all(), "words": index.words.all(), "ranks": index.ranks.all()}
        at, places = self.ends[-1] * self.width, {}
        for name, x in sections.items():
            self.out.write(x.tobytes())
            places[name] = [at, len(x), x.dtype.str]
            at += x.nbytes
        footer = json.dumps({"width": self.width, "null": null, "levels": index.sizes, "placed": index.placed, "sections": places}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.path)


class Shard:
    """A shard opened for reading. row(i) gives ids; find(keys) gives rows, or -1."""

    def __init__(self, uri: str) -> None:
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a whole token shard: {uri}")
        n = int.from_bytes(tail[:8], "little")
        footer = json.loads(self.file.read_at(n, size - 16 - n))
        self.width, self.null = footer["width"], footer["null"]
        section = {name: Section(self.file.read_at, *place) for name, place in footer["sections"].items()}
        self.keys, self.ends, self.marks, self.rows = map(section.get, ("keys", "ends", "marks", "rows"))
        self.index = PerfectHash(footer["levels"], section["words"], section["ranks"], section["rest"], footer["placed"])

    def find(self, keys: np.ndarray) -> np.ndarray:
        raw = keys.astype(np.int64).view(np.uint64)
        slots = self.index.slots(raw)
        ok = np.flatnonzero(slots >= 0)
        ok = ok[self.marks.take(slots[ok])[:, 0] == fingerprints(raw[ok])]
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.rows.take(slots[ok])[:, 0]
        return out

    def row(self, i: int) -> tuple[int, np.ndarray]:
        """Ids of the shard before row i, and its own."""
        a, b = self.ends.part(i, i + 2).tolist()
        return a, np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def key(self, i: int) -> int | None:
        return None if i < self.null else int(self.keys.part(i - self.null, i - self.null + 1)[0])

    def copies(self, i: int) -> range:
        """The rows with the key of row i, which is its first."""
        stop = i + 1
        while stop < self.null + len(self.keys) and self.key(stop) == self.key(i):
            stop += 1
        return range(i, stop)


def write_tokens(df: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1) -> dict:
    """Writes path/shard-*.tok and path/manifest.json; returns the manifest.

    Texts are encoded with the tokenizers library, without special tokens; end_id follows each. Null text: empty.
    Rows ascend by id, null ids first; rows with the same id follow each other in order of their text, and the index
    knows the first. Empty input: a manifest without shards. Other columns of df aren't read. Ids take two bytes
    where the vocabulary allows. The driver gets one row per shard.
    """
    from tokenizers import Tokenizer

    ship(df.sparkSession)
    width = 2 if max(Tokenizer.from_file(vocabulary).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, encode = TaskContext.get().partitionId(), encoder(vocabulary)
        name, shard = f"shard-{number:07d}.tok", None
        for b in batches:
            shard = shard or ShardWriter(f"{path}/{name}", width)
            for key, ids in zip(b.column(0).to_pylist(), encode.many(x.as_py() for x in b.column(1)), strict=True):
                shard.add(key, np.frombuffer(ids + tail, "<u4"))
        if shard:
            shard.close()
            ends = [k for k in shard.keys if k is not None]
            row = [number], [name], [len(shard.keys)], [shard.ends[-1]], [min(ends, default=None)], [max(ends, default=None)]
            kinds = pa.int32(), pa.string(), *[pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["number", "name", "rows", "ids", "first", "last"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{text_col}`").alias("t"))
    rows = rows.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    shards = rows.mapInArrow(run, "number int, name string, rows bigint, ids bigint, first bigint, last bigint").collect()
    start, listed = 0, []
    for s in sorted(shards, key=lambda s: s["number"]):
        listed.append(s.asDict() | {"start": start})
        start += s["ids"]
    manifest = {"path": path, "end_id": end_id, "width": width, "ids": start, "shards": listed}
    fs, at = _filesystem(path)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def open_manifest(path: str) -> dict:
    fs, at = _filesystem(path)
    with fs.open_input_file(f"{at}/manifest.json") as f:
        return json.loads(f.read())


OUT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], [x.split()[0] for x in OUT.split(", ")])


def scan_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of the files: each distinct key is looked up in its shard's index, which leads to its rows; rows with a null key have no entry there and come by position."""
    ship(spark)
    shards = [(s["name"], s["start"]) for s in open_manifest(path)["shards"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(f"{path}/{name}")
                shard.ends.all()
                found = [(None, i) for i in range(shard.null)]
                distinct, often = np.unique(shard.keys.all(), return_counts=True)
                for at in range(0, len(distinct), LOOKED_UP):
                    keys, first = distinct[at : at + LOOKED_UP], shard.find(distinct[at : at + LOOKED_UP])
                    if (first < 0).any():
                        raise ValueError(f"the index of {name} lacks keys")
                    found += [(k, i + j) for k, i, n in zip(keys.tolist(), first.tolist(), often[at : at + LOOKED_UP].tolist(), strict=True) for j in range(n)]
                    yield _batch([_told(shard, start, k, i) for k, i in found])
                    found = []
                if found:
                    yield _batch([_told(shard, start, k, i) for k, i in found])

    listed = spark.createDataFrame(shards, "name string, start bigint")
    return listed.repartition(max(1, len(shards))).mapInArrow(run, OUT)


def _told(shard: Shard, start: int, key: int | None, i: int) -> tuple:
    before, ids = shard.row(i)
    return key, start + before, len(ids), _crc(ids)


def lookup_tokens(keys: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the keys that the files hold: shard by range, then the perfect hash, fingerprint and one read.

    A key that was written several times gives all its rows; repeated, unknown and null keys give theirs, none and none.
    A fingerprint match is confirmed with the row's key.
    """
    ship(keys.sparkSession)
    shards = [s for s in open_manifest(path)["shards"] if s["first"] is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, shard = np.array([s["last"] for s in shards], np.int64), -1, None
        for b in batches:
            rows: list[tuple] = []
            wanted = b.column(0).to_numpy()
            at = np.searchsorted(last, wanted)
            for n in np.unique(at[at < len(shards)]).tolist():
                if n != now:
                    now, shard = n, Shard(f"{path}/{shards[n]['name']}")
                mine = wanted[at == n]
                for key, row in zip(mine.tolist(), shard.find(mine).tolist(), strict=True):
                    if row >= 0 and shard.key(row) == key:
                        rows += [_told(shard, shards[n]["start"], key, i) for i in shard.copies(row)]
            if rows:
                yield _batch(rows)

    wanted = keys.select(F.col(f"`{id_col}`").cast("long").alias("k")).filter("k IS NOT NULL")
    # Keys of one shard come one after the other, so a task opens each of its shards once.
    return wanted.repartitionByRange("k").sortWithinPartitions("k").mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), path)
    return scan_tokens(spark, path)
