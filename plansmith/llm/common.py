"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the characters that the text contracts treat as blank.
BLANK = " \t\n\x0b\x0c\r"
#: Groups in which rows meet what many of them share.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder on a local master; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def settled(spark: SparkSession) -> Iterator[None]:
    """Inside, inputs are cut into the same partitions each time they are read, however many executors are left, and a finished job's shuffle files go at once."""
    keep = {
        "spark.sql.files.minPartitionNum": str(spark.sparkContext.defaultParallelism),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in keep}
    for k, v in keep.items():
        if k.startswith("spark.sql.classic") or before[k] is None:
            spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df as a Parquet table in the shared folder: a cut in the lineage that outlives any executor. discard() removes it."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    with settled(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables that stored() made and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            remove(t.sparkSession, path)


def ascii_lower(c: Column) -> Column:
    """Only A-Z change."""
    return F.translate(c, UPPER, LOWER)


def pair_hash(*cols: Column) -> list[Column]:
    """128 bits as two differently seeded 64-bit hashes."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5BD1E995), *cols)]


#: Rows of one key that a task joins without more ado, and hot keys up to which their rows of the other side are broadcast.
HOT, HOT_KEYS = 100_000, 50_000


def hot_keys(rows: DataFrame, key: str, most: int) -> DataFrame | None:
    """Keys of more than HOT rows, or None; of n rows at most n / HOT, counted with a combine before the shuffle. No key can have more than most rows, so with HOT at most there is nothing to count."""
    if most <= HOT:
        return None
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select(key)
    return stored(hot, "hot") if hot.limit(1).count() else None


def join_hot(rows: DataFrame, one: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """rows joined with one (a row a key), inner. Rows of hot keys stay where they are and meet their row of one by broadcast, as long as hot keys are HOT_KEYS at most, or else in SALTS groups; the others meet by shuffle."""
    if hot is None:
        return rows.join(one, key)
    hot = F.broadcast(hot) if hot.count() <= HOT_KEYS else hot
    some = one.join(hot, key, "left_semi")
    if some.count() <= HOT_KEYS:
        return rows.join(hot, key, "left_anti").join(one, key).unionByName(rows.join(F.broadcast(some), key))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    mine = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    parted = rows.withColumn("__salt", mine).hint("merge").join(one.select("*", salts), [key, "__salt"]).drop("__salt")
    return parted
