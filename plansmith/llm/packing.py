"""Bounded-space online packing.

Each partition keeps a fixed number of open windows. A piece goes to the window that it fills best; when none has
room, the fullest window is emitted and a new one opened. What stays open at the end is merged: first in the
partition, then the last window of each partition with those of GROUP neighbours. Texts never move between
partitions; only the at most one open window of each does.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.llm.common import stored, table
from plansmith.llm.tokenizing import encoder, vocabulary_path
from plansmith.session import ship

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
COLUMNS = [x.split()[0] for x in PIECE.split(", ")]
GROUP = 64


class Packer:
    """pieces are (doc_id, start, ids as uint32 bytes, doc_tokens); emitted windows are lists of them, in order."""

    def __init__(self, size: int = 2048, windows: int = 64, waste: int = 16) -> None:
        self.size, self.windows, self.waste = size, windows, waste
        self.free: list[tuple[int, int]] = []  # (room, number), ascending
        self.open: dict[int, list[tuple]] = {}
        self.next = 0

    def add(self, doc: int | None, ids: bytes) -> Iterator[list[tuple]]:
        """Full sequences are cut off first; the rest is placed whole, unless the fullest window would be emitted with more than waste to pad."""
        total, at, width = len(ids) // 4, 0, 4 * self.size
        while len(ids) - 4 * at >= width:
            yield [(doc, at, ids[4 * at : 4 * at + width], total)]
            at += self.size
        if 4 * at < len(ids):
            yield from self._place((doc, at, ids[4 * at :], total))

    def _place(self, piece: tuple) -> Iterator[list[tuple]]:
        need = len(piece[2]) // 4
        i = bisect_left(self.free, (need, -1))
        if i < len(self.free):
            room, number = self.free.pop(i)
        else:
            if len(self.open) >= self.windows:
                room, number = self.free.pop(0)
                if room > self.waste:
                    doc, at, ids, total = piece
                    self.open[number].append((doc, at, ids[: 4 * room], total))
                    piece, need = (doc, at + room, ids[4 * room :], total), need - room
                yield self.open.pop(number)
            room, number = self.size, self.next
            self.next += 1
            self.open[number] = []
        self.open[number].append(piece)
        if room == need:
            yield self.open.pop(number)
        else:
            insort(self.free, (room - need, number))

    def finish(self) -> tuple[list[list[tuple]], list[tuple]]:
        """Leftovers merged in order of their room: full sequences, and the pieces of the last one, which isn't full."""
        pieces = [p for _, n in self.free for p in self.open[n]]
        return merge(pieces, self.size)


def merge(pieces: list[tuple], size: int) -> tuple[list[list[tuple]], list[tuple]]:
    done, now, room = [], [], size
    for doc, at, ids, total in pieces:
        while ids:
            cut = ids[: 4 * room]
            now.append((doc, at, cut, total))
            at, room, ids = at + len(cut) // 4, room - len(cut) // 4, ids[len(cut) :]
            if not room:
                done.append(now)
                now, room = [], size
    return done, now


def _rows(pieces: list[tuple], sequence: int) -> list[tuple]:
    out, at = [], 0
    for doc, start, ids, total in pieces:
        n = len(ids) // 4
        out.append((doc, start, n, zlib.crc32(ids), total, sequence, at))
        at += n
    return out


def _table(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(COLUMNS)


def pack(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, windows: int = 64, waste: int = 16, end_id: int | None = 1, with_ids: bool = False
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, as uint32 bytes).

    Texts are encoded with the tokenizers library without special tokens; end_id follows. Null text: empty, so its
    end_id alone (no piece without an end_id). Null and repeated ids pass through, each row packed for itself. Texts
    over size are cut into whole sequences and a rest. Empty input: empty result. Other columns of df aren't read.
    Sequence ids are unique; a sequence is padded to size by whoever reads it. The pieces are a table in the shared
    folder, so later jobs don't encode again.
    """
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    names = [*COLUMNS, "ids", "part"]
    ship(df.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, encode, serial = TaskContext.get().partitionId(), Packer(size, windows, waste), encoder(vocabulary), 0

        def batch(sequences: list[list[tuple]], left: list[tuple]) -> pa.RecordBatch:
            nonlocal serial
            rows, ids = [], []
            for s in sequences:
                rows += _rows(s, (part << 32) + serial)
                ids += [p[2] if with_ids else None for p in s]
                serial += 1
            n = len(rows)
            rows += _rows(left, -1)
            ids += [p[2] for p in left]
            return pa.RecordBatch.from_arrays([*_table(rows), pa.array(ids, pa.binary()), pa.array([part if i >= n else None for i in range(len(rows))], pa.int32())], names)

        for b in batches:
            full: list[list[tuple]] = []
            for doc, ids in zip(b.column(0).to_pylist(), encode.many(x.as_py() for x in b.column(1)), strict=True):
                full += packer.add(doc, ids + tail)
                if len(full) > 512:
                    yield batch(full, [])
                    full = []
            if full:
                yield batch(full, [])
        yield batch(*packer.finish())

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come group by group, in order."""
        names = [*COLUMNS, "ids"]

        def close(group: int, pieces: list[tuple]) -> pa.RecordBatch:
            done, rest = merge(pieces, size)
            found = [*done, *[rest] * bool(rest)]
            rows = [r for i, s in enumerate(found) for r in _rows(s, (1 << 62) + (group << 24) + i)]
            return pa.RecordBatch.from_arrays([*_table(rows), pa.array([p[2] if with_ids else None for s in found for p in s], pa.binary())], names)

        group, pieces = None, []
        for b in batches:
            for x in b.to_pylist():
                if x["group"] != group and pieces:
                    yield close(group, pieces)
                    pieces = []
                group = x["group"]
                pieces.append((x["doc_id"], x["start"], x["ids"], x["doc_tokens"]))
        if pieces:
            yield close(group, pieces)

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{text_col}`").alias("t"))
    placed = stored(rows.mapInArrow(first, f"{PIECE}, ids binary, part int"), "packed")
    group = F.floor(F.col("part") / GROUP).cast("long").alias("group")
    left = placed.filter(F.col("part").isNotNull()).select("doc_id", "start", "ids", "doc_tokens", "offset", "part", group)
    merged = left.repartition("group").sortWithinPartitions("group", "part", "offset").mapInArrow(second, f"{PIECE}, ids binary")
    out = placed.filter(F.col("part").isNull()).drop("part").unionByName(merged)
    return out if with_ids else out.drop("ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
