"""A request in, its draft, plan and first rows out, as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansmith.functions.hints import rule_draft
from plansmith.functions.registry import PROTEIN
from plansmith.operators.execute import run
from plansmith.plans.validate import validate


def render(request: str, rows: DataFrame, preview: int = 5) -> str:
    scaffolds = [r[0] for r in rows.select("scaffold_type").distinct().collect()]
    draft = rule_draft(F.lit(request), [s for s in scaffolds if s])
    flat = rows.sparkSession.range(1).select(*(c.alias(n) for n, c in draft.items())).first().asDict()
    plan, trace = validate(flat, True, PROTEIN)
    found = [r.asDict(True) for r in run(rows, plan).drop("_pos").limit(preview).collect()]
    parts = {"Request": request, "Draft": flat, "Plan": plan.as_dict(), "Notes": trace.notes, "Top rows": found}
    return "\n".join(f"{k}:\n{v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, indent=2, default=str)}" for k, v in parts.items())
