"""Session and table access."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(name: str = "plansmith", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times; conf overrides."""
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_position(df: DataFrame, name: str = "_pos") -> DataFrame:
    """df in its present order with a stable ordinal: partition number and row number in it, without a shuffle or a single task."""
    return df.withColumn(name, F.monotonically_increasing_id())


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly, for steps that work long on each of its rows: small files and joins leave few partitions, by bytes rather than by work."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers of spark, once a context: they may not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_plansmith_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._plansmith_shipped = True
