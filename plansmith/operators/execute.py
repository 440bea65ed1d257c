"""Plans as DataFrame operations: one Filter, a top-k, a projection. Catalyst does the rest."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plansmith.plans.model import Filter, Plan, Sort

POSITION = "_pos"


def _literal(value: Any, kind: T.DataType) -> Column:
    """value in the column's type; null where it doesn't fit, so that nothing is equal to it."""
    if isinstance(value, bool) and not isinstance(kind, T.BooleanType) and isinstance(kind, T.NumericType):
        value = int(value)
    return F.lit(value).try_cast(kind)


def _fits(value: Any, kind: T.DataType) -> bool:
    """Whether Python would ever call a value of the column's type equal to value."""
    number = isinstance(value, (int, float))
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.BooleanType):
        return number and value in (0, 1)
    return number if isinstance(kind, T.NumericType) else isinstance(value, str)


def predicate(df: DataFrame, flt: Filter, substring: bool = False) -> Column:
    """A condition whose null counts as no, so that comparisons reach the scan as they are.

    eq is null-safe; NaN equals and exceeds nothing; range operators need both sides; an unknown column counts as
    null everywhere. in takes a list; with substring, a string as expected value is searched for the column's text.
    """
    if flt.op not in {"eq", "in", "gte", "lte", "exists"}:
        raise ValueError(f"unsupported operator: {flt.op}")
    known = flt.field in df.columns
    kind = df.schema[flt.field].dataType if known else T.StringType()
    col = F.col(f"`{flt.field}`") if known else F.lit(None).cast("string")
    no = F.lit(False)

    def within(c: Column) -> Column:
        return c & ~F.isnan(col) if isinstance(kind, (T.DoubleType, T.FloatType)) else c

    def same(value: Any) -> Column:
        if value is None:
            return col.isNull()
        if not _fits(value, kind) or isinstance(value, float) and math.isnan(value):
            return no
        lit = _literal(bool(value) if isinstance(kind, T.BooleanType) else value, kind)
        exact = isinstance(value, float) and isinstance(kind, T.IntegralType) and value != int(value)
        return no if exact else within(col == lit)

    if flt.op == "exists":
        return col.isNotNull()
    if flt.op == "eq":
        return same(flt.value)
    if flt.op == "in":
        if isinstance(flt.value, str):
            return F.contains(F.lit(flt.value), col.cast("string")) if substring else same(flt.value)
        plain = [v for v in flt.value or () if _fits(v, kind) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v))]
        if plain and len(plain) == len(flt.value) and not isinstance(kind, T.BooleanType) and not any(isinstance(v, float) and isinstance(kind, T.IntegralType) for v in plain):
            return within(col.isin(*[F.lit(v) for v in plain]))
        return reduce(lambda a, b: a | b, map(same, flt.value or ()), no)
    if flt.value is None:
        return no
    target = T.DoubleType() if isinstance(flt.value, float) and isinstance(kind, T.IntegralType) else kind
    lit = _literal(flt.value, target)
    return within(col >= lit if flt.op == "gte" else col <= lit)


def where(df: DataFrame, plan: Plan, substring: bool = False) -> DataFrame:
    conditions = [predicate(df, f, substring) for f in plan.filters]
    return df.filter(reduce(and_, conditions)) if conditions else df


def order(df: DataFrame, sorts: tuple[Sort, ...], position: str = POSITION) -> list[Column]:
    """Ascending keys put nulls last, descending ones first; the input order breaks ties either way."""
    keys = [F.col(f"`{s.field}`") for s in sorts if s.field in df.columns]
    ways = [s.direction for s in sorts if s.field in df.columns]
    return [k.desc_nulls_first() if w == "desc" else k.asc_nulls_last() for k, w in zip(keys, ways)] + [F.col(f"`{position}`").asc()]


def run(df: DataFrame, plan: Plan, position: str = POSITION, project: bool = False, substring: bool = False) -> DataFrame:
    """The plan's rows of df, whose position column gives the input order. project: only return_fields, else whole rows."""
    if plan.limit is not None and plan.limit < 0:
        raise ValueError("a limit can't be negative")
    out = where(df, plan, substring)
    if plan.sort or plan.limit is not None:  # a filter alone keeps the input order
        out = out.orderBy(*order(df, plan.sort, position))
    out = out if plan.limit is None else out.limit(plan.limit)
    return out.select(*(f for f in plan.return_fields if f in df.columns)) if project and plan.return_fields else out


def metadata(df: DataFrame, plan: Plan, substring: bool = False) -> DataFrame:
    """(total_rows, filtered_count, returned_count, limit) in one pass."""
    conditions = [predicate(df, f, substring) for f in plan.filters]
    hit = reduce(and_, conditions) if conditions else F.lit(True)
    counts = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(hit).alias("filtered_count"))
    limit = F.col("filtered_count") if plan.limit is None else F.lit(plan.limit).cast("long")
    return counts.withColumns({"returned_count": F.least(limit, "filtered_count"), "limit": limit})


def streamable(plan: Plan) -> bool:
    return not plan.sort and plan.limit is None
