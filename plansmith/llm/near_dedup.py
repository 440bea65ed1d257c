"""MinHash near-dedup with odd sketches.

Equal shingle sets form a class first, so exact copies cost one row. Classes meet in the buckets of a banded MinHash
index; the MinHash samples are also folded into a parity bitmap whose XOR population count estimates high
similarities well, and drops most false candidates. A second parity bitmap, of the whole set, bounds the number of
shingles in which two sets differ from below and drops nearly all the others before texts are compared in full. In
a bucket every class is compared with the bucket's representative only; pairs of different components that still
share a bucket are compared afterwards, each in one bucket, so no link is lost and no bucket emits all its pairs.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.llm.common import SALTS, discard, hot_keys, join_hot, stored, table
from plansmith.llm.components import components
from plansmith.llm.shingles import mix64, shingle_set
from plansmith.llm.workers import tidied
from plansmith.session import ship

#: Pairs of one node that one copy of its text serves.
PAIRS = 10_000
#: Members of a bucket that one task compares with those outside the largest component.
PART = 1024
#: Up to so many ids (8 bytes each) are broadcast to fetch texts; more meet by shuffle.
BROADCAST_IDS = 100_000


@dataclass(frozen=True)
class Settings:
    """percent: least similarity of a link. A pair just there shares no band once in some 2 million times."""

    words: int = 5
    percent: int = 85
    bands: int = 25
    rows: int = 5
    samples: int = 128
    bits: int = 512
    floor: float = 0.65
    parity_bits: int = 1024

    def far(self) -> int:
        """The sketch distance at similarity floor, which lies 6 standard deviations below the links."""
        flips = 2 * self.samples * (1 - self.floor)
        return math.ceil(self.bits / 2 * (1 - math.exp(-2 * flips / self.bits)))


_RNG = np.random.Generator(np.random.PCG64(20240607))
_A = _RNG.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, 1024, dtype=np.uint64)


def minhashes(hashes: np.ndarray, samples: int) -> np.ndarray:
    out = np.full(samples, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 512):
            block = hashes[at : at + 512, None]
            out = np.minimum(out, (block * _A[:samples] + _B[:samples]).min(axis=0))
    return out


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Each (number, sample) flips one bit; int64 words."""
    with np.errstate(over="ignore"):
        at = (mix64(samples + np.arange(1, len(samples) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + samples[: bands * rows].reshape(bands, rows)[:, i])
    return key.view(np.int64)


def signature(hashes: np.ndarray) -> bytes:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return np.array([mix64(hashes).sum(dtype=np.uint64), mix64(hashes * np.uint64(3) + np.uint64(len(hashes))).sum(dtype=np.uint64)], "<u8").tobytes()


def level(n: int, bits: int) -> int:
    """Sets of n shingles are thinned to those whose hash ends in so many zeros: bits / 2 to bits of them."""
    return max(0, int(math.log2(n / (bits / 2))))


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of the set thinned at its level and at the next, one after the other, as int64 words."""
    out, spread = [], mix64(hashes ^ np.uint64(0xA24BAED4963EE407))
    for step in range(2):
        if l := level(len(hashes), bits) + step:
            spread = spread[spread & np.uint64((1 << l) - 1) == 0]
        odd = np.bincount((spread >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    return np.concatenate(out)


FEATURES = "id bigint, n bigint, node binary, keys array<bigint>, sketch array<bigint>, level int, parity array<bigint>"


def features(df: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                n, node, keys, sketch, levels, parity = [], [], [], [], [], []
                for text in part.column(1):
                    found = shingle_set(text.as_py(), s.words)
                    n.append(len(found))
                    if not len(found):
                        node.append(None), keys.append(None), sketch.append(None), levels.append(None), parity.append(None)
                        continue
                    m = minhashes(found, s.samples)
                    node.append(signature(found)), keys.append(band_keys(m, s.bands, s.rows)), sketch.append(odd_sketch(m, s.bits))
                    levels.append(level(len(found), s.parity_bits)), parity.append(parities(found, s.parity_bits))
                longs = pa.list_(pa.int64())
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, longs), pa.array(sketch, longs), pa.array(levels, pa.int32()), pa.array(parity, longs)]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in FEATURES.split(", ")])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(tidied(run), FEATURES)


def _distance(s: Settings, a: Column, b: Column) -> Column:
    words = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(s.bits // 64)]
    return sum(words[1:], words[0])


def _likely(s: Settings, x: str, y: str) -> Column:
    """Sizes, sketches and parities allow a link.

    Parities differ in at most as many bits as the sets in shingles: without thinning nothing is lost, with it the
    bound has 6 standard deviations to spare.
    """
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    most = (small + large) * ((100 - s.percent) / (100 + s.percent))
    l = F.greatest(f"{x}.level", f"{y}.level")
    words = s.parity_bits // 64
    word = lambda side, i: F.get(F.col(f"{side}.parity"), (l - F.col(f"{side}.level")) * words + i)
    bits = [F.bit_count(word(x, i).bitwiseXOR(word(y, i))) for i in range(words)]
    thinned = most / F.pow(F.lit(2.0), l)
    bound = F.when(l == 0, most + 1e-6).otherwise(thinned + 6 * F.sqrt(thinned) + 3)
    near = _distance(s, F.col(f"{x}.sketch"), F.col(f"{y}.sketch")) <= s.far()
    return (small * 100 >= large * s.percent) & near & (sum(bits[1:], bits[0]) <= bound)


def confirmed(df: DataFrame, pairs: DataFrame, classes: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """Of pairs (u, v) of nodes those whose full sets are similar enough.

    The text of a node is that of its smallest id; where an id has several texts, the one with the node's set counts.
    """
    ids = classes.select("node", "id")
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = stored(ids.join(nodes, "node"), "wanted")
    few = wanted.select("id").distinct()
    few = F.broadcast(few) if wanted.count() <= BROADCAST_IDS else few
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    texts = stored(rows.join(few, rows["id"].eqNullSafe(few["id"]), "left_semi"), "texts")
    near = wanted.withColumnRenamed("id", "want").join(texts, F.col("want").eqNullSafe(texts["id"])).select("node", "t")
    # The text of a node that many pairs name goes to PAIRS of them at a time.
    heads = near.select(F.col("node").alias("v"), F.col("t").alias("tv"))
    if pairs.count() > PAIRS:
        parts = pairs.groupBy("v").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PAIRS).cast("int")).filter("parts > 1").select("v", "parts")
        parts = stored(parts, "parts")
        wide = F.broadcast(parts) if parts.count() <= BROADCAST_IDS else parts
        pairs = pairs.join(wide, "v", "left").withColumn("part", F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        heads = heads.join(wide, "v", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    else:
        parts, pairs, heads = None, pairs.withColumn("part", F.lit(0)), heads.withColumn("part", F.lit(0))
    full = pairs.join(near.select(F.col("node").alias("u"), F.col("t").alias("tu")), "u").join(heads, ["v", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[bytes, np.ndarray | None] = OrderedDict()

        def sets(node: bytes, text: pa.Scalar) -> np.ndarray | None:
            """None where the text isn't the node's."""
            if kept.get(node) is None:
                found = shingle_set(text.as_py(), s.words)
                kept[node] = found if signature(found) == node else None
                if len(kept) > 8:
                    kept.popitem(last=False)
            return kept[node]

        for b in batches:
            u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            linked = []
            for i in range(b.num_rows):
                x, y = sets(v[i], b.column(3)[i]), sets(u[i], b.column(2)[i])
                if x is not None and y is not None:
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * same >= s.percent * (len(x) + len(y) - same):
                        linked.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in linked], pa.binary()), pa.array([v[i] for i in linked], pa.binary())], ["u", "v"])

    links = stored(full.select("u", "v", "tu", "tv").mapInArrow(tidied(run), "u binary, v binary").distinct(), "links")
    discard(wanted, texts, *([parts] if parts else []))
    return links


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of df.

    Rows link where 100 * intersection >= percent * union of their sets of distinct shingles; texts with fewer words
    are one shingle; null texts and texts without words have n_shingles 0 and link with nothing. component_id is the
    smallest id that links lead to, itself included; kept marks the rows with that id. Null ids take part but are never
    the smallest (a group of null ids alone has component_id null and keeps all). Repeated ids are rows of their own.
    Empty input: empty result. Only id_col and text_col are read.
    """
    s = settings
    rows = stored(features(df, id_col, text_col, s), "features")
    classes = stored(
        rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("level").alias("level"), F.first("parity").alias("parity")), "classes"
    )
    members = classes.select(F.explode("keys").alias("key"), "node", F.xxhash64("node").alias("rank"))
    shared = (
        members.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("rank", "node")).alias("head")).filter("m > 1")
        .select("key", F.col("head.node").alias("head"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    grouped = stored(members.withColumn("salt", F.pmod("rank", F.lit(SALTS)).cast("int")).hint("merge").join(shared, ["key", "salt"]).select("key", "node", "head"), "buckets")
    facts = classes.select("node", "n", "sketch", "level", "parity")
    rays = grouped.filter("node != head").select("node", "head").distinct()
    hot = hot_keys(rays, "head", grouped.count())
    rays = rays.join(facts, "node").select(F.struct(*facts.columns).alias("x"), F.col("head"))
    stars = join_hot(rays, facts.select(F.col("node").alias("head"), F.struct(*facts.columns).alias("y")), "head", hot).select("x", "y")
    tried = stored(stars.filter(_likely(s, "x", "y")).select(F.col("x.node").alias("u"), F.col("y.node").alias("v")), "stars")
    links = confirmed(df, tried, classes, id_col, text_col, s)
    labels = components(links)

    placed = grouped.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("c"))
    mixed = (
        placed.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key")
        .agg(F.max(F.struct("m", "c"))["c"].alias("major"), F.count("*").alias("many"), F.ceil(F.sum("m") / PART).cast("int").alias("parts"))
        .filter("many > 1").drop("many")
    )
    mixed = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    open_ = stored(placed.hint("merge").join(mixed, ["key", "salt"]).drop("salt").join(facts.join(classes.select("node", "keys"), "node"), "node"), "mixed")
    minor = open_.filter("c != major").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = open_.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    x, y = minor.alias("x"), other.alias("y")
    once = (F.col("y.c") == F.col("y.major")) | (F.col("x.node") < F.col("y.node"))
    equal = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part"))
    lead = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    crossing = x.hint("merge").join(y, equal & (F.col("x.c") != F.col("y.c")) & once & _likely(s, "x", "y") & lead).select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
    done = tried.unionByName(tried.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rest = stored(crossing.distinct().join(done, ["u", "v"], "left_anti"), "crossing")
    if rest.limit(1).count():
        more = confirmed(df, rest, classes, id_col, text_col, s)
        if more.limit(1).count():
            labels = components(links.unionByName(more))

    named = classes.select("node", "id").join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    large = hot_keys(named, "label", classes.count())
    to = stored(join_hot(named, least, "label", large).select("node", "component_id"), "groups")
    discard(*(x for x in (classes, grouped, tried, links, labels, open_, rest, hot, large) if x is not None))
    out = rows.select("id", "n", "node").join(to, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """df's rows whose id is kept: one document of each group. A repeated id stays where one of its rows does."""
    kept = near_groups(df, id_col, text_col, settings).filter("kept").select(F.col(id_col).alias("__kept")).distinct()
    return df.join(kept, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__kept")), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
