"""Approximate nearest neighbours by multiprobe p-stable hashing.

Equal vectors form one class that carries its smallest ids, so copies cost one row. Classes are dealt into blocks of
bounded size, and each vector moves once, to its block; queries visit every block. A block builds its tables in memory: each
projects the classes on Gaussian directions and cuts the projections into cells of one width, the more directions
the more classes there are. A query visits its own bucket of a table and perturbed ones in order of
estimated success; what it meets in any table is compared with it exactly, and the nearest of all blocks are merged.
Queries that met fewer than k are compared with all classes, in the same blocks. No pair of a query and a candidate is ever a row.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansmith.llm.common import discard, stored, table
from plansmith.llm.shingles import mix64
from plansmith.session import ship

#: Classes of a block, and queries that meet it in one task.
BLOCK, QUERIES = 32_768, 65_536
#: Queries of a task that are probed together.
TOGETHER = 64


@dataclass(frozen=True)
class Settings:
    """Among n classes tables use base + log2(n) / 2 projections. width: of a cell, in standard deviations of a projection."""

    base: float = 6.5
    tables: int = 48
    probes: int = 500
    width: float = 2.0
    seed: int = 11

    def projections(self, n: int) -> int:
        return round(self.base + np.log2(max(n, 1)) / 2)


def probe_template(m: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks among the 2 m boundary distances in ascending order, best first by expected squared distance; no set moves one projection both ways."""
    at = np.arange(1, 2 * m + 1)
    near = at * (at + 1) / (4 * (m + 1) * (m + 2))
    other = 2 * m + 1 - at
    cost = np.where(at <= m, near, 1 - other / (m + 1) + other * (other + 1) / (4 * (m + 1) * (m + 2)))
    found: list[tuple[int, ...]] = [()]
    heap = [(float(cost[0]), (0,))]
    while heap and len(found) < probes:
        score, ranks = heapq.heappop(heap)
        if not any(2 * m - 1 - r in ranks for r in ranks):
            found.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - float(cost[last]) + float(cost[last + 1]), (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (score + float(cost[last + 1]), (*ranks, last + 1)))
    return found


class Hashes:
    """places: keys of vectors in a table, and where in their cells the projections lie; probes: keys to visit."""

    def __init__(self, dim: int, projections: int, width: float, s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        self.a = rng.standard_normal((s.tables, projections, dim))
        self.b = rng.random((s.tables, projections))
        self.odd = rng.integers(1, 2**62, (s.tables, projections)) * 2 + 1
        self.width = width
        ranks = probe_template(projections, s.probes)
        self.template = np.full((len(ranks), max(map(len, ranks)) or 1), 2 * projections)
        for i, r in enumerate(ranks):
            self.template[i, : len(r)] = r

    def places(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        p = x @ self.a[t].T / self.width + self.b[t]
        cell = np.floor(p)
        with np.errstate(over="ignore"):
            return (cell.astype(np.int64) * self.odd[t]).sum(1), p - cell

    def probes(self, x: np.ndarray, t: int) -> np.ndarray:
        """A row of keys for each vector, the likeliest first."""
        key, frac = self.places(x, t)
        away = np.concatenate([frac, 1 - frac], axis=1)
        step = np.concatenate([-self.odd[t], self.odd[t]])[np.argsort(away, axis=1, kind="stable")]
        step = np.concatenate([step, np.zeros((len(x), 1), np.int64)], axis=1)
        with np.errstate(over="ignore"):
            return key[:, None] + step[:, self.template].sum(2)


class Tables:
    """The tables of a block's vectors."""

    def __init__(self, x: np.ndarray, s: Settings) -> None:
        self.x, self.s = x, s
        spread = float(np.sqrt(max(x.var(axis=0).sum(), 1e-12)))
        self.hashes = Hashes(x.shape[1], s.projections(len(x)), s.width * spread, s)
        self.tables = [Buckets(self.hashes.places(x, t)[0]) for t in range(s.tables)]

    def met(self, q: np.ndarray) -> np.ndarray:
        """For each query, whether it meets each vector."""
        out = np.zeros((len(q), len(self.x)), bool)
        for t, buckets in enumerate(self.tables):
            probes = self.hashes.probes(q, t)
            probe, rows = buckets.find(probes.ravel())
            out[probe // probes.shape[1], rows] = True
        return out


class Buckets:
    """Rows by key. The leading bits of a mixed key give where in the sorted keys to look."""

    def __init__(self, keys: np.ndarray) -> None:
        mixed = mix64(keys.view(np.uint64))
        self.rows = np.argsort(mixed)
        self.keys, self.starts, self.sizes = np.unique(mixed[self.rows], return_index=True, return_counts=True)
        bits = len(self.keys).bit_length() + 1
        self.drop = np.uint64(64 - bits)
        self.lead = np.searchsorted(self.keys >> self.drop, np.arange((1 << bits) + 1, dtype=np.uint64))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of a key, row) for each row in the keys' buckets."""
        wanted = mix64(keys.view(np.uint64))
        first = (wanted >> self.drop).astype(np.int64)
        at, end = self.lead[first], self.lead[first + 1]
        todo = np.flatnonzero(at < end)
        hits, buckets = [], []
        while len(todo):
            same = self.keys[at[todo]] == wanted[todo]
            hits.append(todo[same])
            buckets.append(at[todo[same]])
            at[todo] += 1
            todo = todo[~same & (at[todo] < end[todo])]
        hit, bucket = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (hits, buckets))
        n = self.sizes[bucket]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[bucket], n)
        return np.repeat(hit, n), self.rows[place]


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(
    df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of the rows of df that its probes meet, by Euclidean distance in double precision.

    A row with the query's id is no candidate. Ties go to the smaller id; fewer than k candidates in all: all of those.
    Vectors that are null, zero or hold a null or non-finite component take no part, as query or candidate, nor do rows
    with null ids. Vectors of different lengths have no distance: a query's candidates are those of its length.
    Repeated rows count once; an id with several vectors counts with its nearest. No candidates or no
    queries: empty result. df and queries may have any other columns. The driver gets a row for each length of vectors.
    """
    s, spark = settings, df.sparkSession
    ship(spark)
    read = lambda x: x.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    good = F.col("id").isNotNull() & _valid(F.col("v"))
    kept = k + 1
    least = Window.partitionBy("v").orderBy("id")
    classes = read(df).filter(good).withColumn("r", F.dense_rank().over(least)).filter(F.col("r") <= kept)
    classes = classes.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.size("v").alias("dim"), F.col("ids")[0].alias("class"), "ids", "v")
    classes = stored(classes, "classes")
    asked = stored(read(queries).filter(good).distinct().select(F.size("v").alias("dim"), F.xxhash64("id", "v").alias("ask"), F.col("id").alias("query_id"), "v"), "queries")
    out_schema = "query_id bigint, vec_id bigint, score double"

    def parts(rows: DataFrame, most: int) -> Column:
        """Into how many parts the rows of each length go."""
        sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).collect()
        named = F.create_map(*(F.lit(x) for r in sizes for x in (r["dim"], -(-r["n"] // most)))) if sizes else F.lit(None).cast("map<int,int>")
        return F.coalesce(F.try_element_at(named, "dim"), F.lit(0)).cast("int")

    def best(asking: DataFrame, everything: bool) -> DataFrame:
        def compare(here: pa.Table, asking: pa.Table) -> pa.Table:
            names = ["query_id", "vec_id", "score"]
            qs: list[int] = []
            found: list[int] = []
            scores: list[float] = []
            if here.num_rows and asking.num_rows:
                here = here.sort_by("class")
                x, q, ids = _matrix(here["v"]), _matrix(asking["v"]), here["ids"].to_pylist()
                tables = None if everything else Tables(x, s)
                who = asking["query_id"].to_pylist()
                for at in range(0, len(q), TOGETHER):
                    some = q[at : at + TOGETHER]
                    met = np.ones((len(some), len(x)), bool) if tables is None else tables.met(some)
                    for n, query in enumerate(who[at : at + TOGETHER]):
                        near = np.flatnonzero(met[n])  # ascending by class
                        if len(near) > kept:  # a quick pass, with room for what rounding may move
                            away = x[near]
                            away -= some[n]
                            quick = np.einsum("ij,ij->i", away, away)
                            near = near[quick <= np.partition(quick, kept - 1)[kept - 1] * (1 + 1e-9)]
                        d = np.sqrt(((x[near] - some[n]) ** 2).sum(1))
                        for i in np.lexsort((near, d))[:kept].tolist():
                            mine = [v for v in ids[near[i]] if v != query]
                            qs += [query] * len(mine)
                            found += mine
                            scores += [float(d[i])] * len(mine)
            return pa.table([pa.array(qs, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], names=names)

        blocks, chunks = parts(classes, BLOCK), parts(asking, QUERIES)
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = classes.filter(chunks > 0).select("dim", F.pmod(F.xxhash64("class"), blocks).cast("int").alias("block"), each(chunks).alias("chunk"), "class", "ids", "v")
        right = asking.filter(blocks > 0).select("dim", each(blocks).alias("block"), F.pmod("ask", chunks).cast("int").alias("chunk"), "query_id", "v")
        keys = "dim", "block", "chunk"
        pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, out_schema)
        pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = stored(best(asked, False), "nearest")
    full = found.filter(F.col("rank") == k).select("query_id")
    short = stored(asked.join(full, "query_id", "left_anti"), "short")
    if short.limit(1).count():
        rest = found.join(short.select("query_id").distinct(), "query_id", "left_anti")
        out = stored(rest.unionByName(best(short, True)), "nearest")
        discard(found)
        found = out
    discard(classes, asked, short)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))
