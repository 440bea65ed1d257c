"""Many plans over one table at once.

Plans come as a table: plan_id, one column for each filter value, a limit. Plans of one shape (same filtered fields,
same order) share a join: null-safe keys for equality, a residual condition for ranges. Where all filters are
equalities, rows are ranked once for each key, cut at the greatest limit before they are shuffled, and then meet
the plans. Else the plans' side is broadcast below a checked number of rows; Spark picks a shuffle join beyond it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansmith.operators.execute import order
from plansmith.plans.model import Sort

#: Plans up to which their table is broadcast: some hundred bytes each.
BROADCAST_PLANS = 50_000


@dataclass(frozen=True)
class Shape:
    """equal, least, most: fields that a plan may fix; the plans' columns are named alike. optional: a null value fixes nothing."""

    equal: tuple[str, ...] = ()
    least: tuple[str, ...] = ()
    most: tuple[str, ...] = ()
    sort: tuple[Sort, ...] = ()
    optional: bool = False


def _condition(shape: Shape) -> Column:
    pairs = [(f, F.col(f"r.{f}").eqNullSafe(F.col(f"p.{f}"))) for f in shape.equal]
    pairs += [(f, F.coalesce(F.col(f"r.{f}") >= F.col(f"p.{f}"), F.lit(False))) for f in shape.least]
    pairs += [(f, F.coalesce(F.col(f"r.{f}") <= F.col(f"p.{f}"), F.lit(False))) for f in shape.most]
    return reduce(and_, [(c | F.col(f"p.{f}").isNull()) if shape.optional else c for f, c in pairs], F.lit(True))


def _by_key(rows: DataFrame, plans: DataFrame, shape: Shape, id_col: str, position: str) -> DataFrame:
    most = plans.agg(F.max("limit")).first()[0]
    rank = F.row_number().over(Window.partitionBy(*shape.equal).orderBy(*order(rows, shape.sort, position)))
    best = rows.withColumn("rank", rank).filter(F.col("rank") <= (most or 0)).select(*shape.equal, "rank", id_col)
    met = best.alias("r").join(plans.alias("p"), _condition(shape) & (F.col("r.rank") <= F.col("p.limit")))
    return met.select("p.plan_id", "r.rank", F.col(f"r.{id_col}").alias(id_col))


def run_many(rows: DataFrame, plans: DataFrame, shape: Shape, id_col: str, position: str = "_pos") -> DataFrame:
    """(plan_id, rank, id_col) of each plan's rows; plans without rows have none. A plan without a limit, or with one below 1, has none either."""
    needed = dict.fromkeys([*shape.equal, *shape.least, *shape.most, *(s.field for s in shape.sort), id_col, position])
    rows = rows.select(*needed)
    if shape.equal and not (shape.least or shape.most or shape.optional):
        return _by_key(rows, plans, shape, id_col, position)
    few = plans.limit(BROADCAST_PLANS + 1).count() <= BROADCAST_PLANS
    right = F.broadcast(plans).alias("p") if few else plans.alias("p")
    met = rows.alias("r").join(right, _condition(shape)).select("p.plan_id", "p.limit", *(F.col(f"r.{c}").alias(c) for c in needed))
    rank = F.row_number().over(Window.partitionBy("plan_id").orderBy(*order(met, shape.sort, position)))
    return met.withColumn("rank", rank).filter(F.col("rank") <= F.col("limit")).select("plan_id", "rank", id_col)


def overlap(predicted: DataFrame, gold: DataFrame, plans: DataFrame, id_col: str) -> DataFrame:
    """(plan_id, n_gold, n_common, result_overlap_at_k) for every plan of plans; nothing wanted and nothing found counts as 1."""
    wanted = gold.select("plan_id", id_col).distinct().withColumn("g", F.lit(1))
    found = predicted.select("plan_id", id_col).distinct().withColumn("f", F.lit(1))
    both = wanted.join(found, ["plan_id", id_col], "full").groupBy("plan_id").agg(F.count("g").alias("n_gold"), F.count("f").alias("n_found"), F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("n_common"))
    out = plans.select("plan_id").join(both, "plan_id", "left").na.fill(0, ["n_gold", "n_found", "n_common"])
    share = F.when(F.col("n_gold") == 0, (F.col("n_found") == 0).cast("double")).otherwise(F.bround(F.col("n_common") / F.col("n_gold"), 4))
    return out.select("plan_id", "n_gold", "n_common", share.alias("result_overlap_at_k"))


def overlap_many(rows: DataFrame, plans: DataFrame, said: dict[str, str], shape: Shape, id_col: str, position: str = "_pos") -> DataFrame:
    """overlap() of every plan of plans as it stands against itself with the values of said's columns: field -> column. Plans alike in all that are run and compared once."""
    fields = [*shape.equal, *shape.least, *shape.most]
    asked = list(dict.fromkeys([*fields, *said.values(), "limit"]))
    tagged = plans.withColumn("_class", F.to_json(F.struct(*asked)))
    classes = tagged.groupBy(F.col("_class").alias("plan_id")).agg(*(F.first(c).alias(c) for c in asked))
    gold = run_many(rows, classes.select("plan_id", *fields, "limit"), shape, id_col, position)
    predicted = run_many(rows, classes.select("plan_id", *(F.col(said.get(f, f)).alias(f) for f in fields), "limit"), shape, id_col, position)
    each = overlap(predicted, gold, classes, id_col).withColumnRenamed("plan_id", "_class")
    return tagged.select("plan_id", "_class").join(each, "_class").drop("_class")
