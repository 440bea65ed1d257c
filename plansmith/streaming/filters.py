"""Plans over streams: filters and projections run as they are; sorts and limits need a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plansmith.operators.execute import streamable, where
from plansmith.plans.model import Plan


def follow(stream: DataFrame, plan: Plan) -> DataFrame:
    if not streamable(plan):
        raise ValueError("a stream has no last row: plans with a sort or limit can't follow it")
    out = where(stream, plan)
    return out.select(*(f for f in plan.return_fields if f in stream.columns)) if plan.return_fields else out
