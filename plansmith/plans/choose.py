"""Which of a first answer, a repaired one and a plan projected from the request's hints is the prediction."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from plansmith.functions.registry import PROTEIN, Entity
from plansmith.functions.salvage import first_object
from plansmith.plans.model import Filter, Plan, Sort, compact, flatten
from plansmith.plans.validate import Trace, validate

# Errors that a second answer may repair, beside any mismatch with the request.
REPAIRABLE = {"parse_failed", "invalid_draft_type", "invalid_slot_value", "missing_filters", "invalid_filters", "empty_filters", "invalid_sort", "invalid_limit"}
HINTED = ("scaffold_type", "oral_class", "engineered", "has_experimental_affinity", "organism")


@dataclass
class Candidate:
    answer: str
    draft: dict[str, Any] | None
    plan: Plan
    trace: Trace

    @classmethod
    def read(cls, answer: str, entity: Entity = PROTEIN) -> "Candidate":
        draft = first_object(answer, {"limit"})
        return cls(answer, draft, *validate(draft, draft is not None, entity))


def compared(plan: Plan, hints: dict[str, Any]) -> dict[str, bool]:
    """Whether the plan agrees, for each thing the hints say."""
    has = plan.equals()
    out = {n: has.get(n) == hints[n] for n in HINTED if hints.get(n) is not None}
    if hints.get("limit") is not None:
        out["limit"] = plan.limit == hints["limit"]
    if hints.get("sort_by") is not None:
        out["sort"] = plan.sort[:1] == (Sort(hints["sort_by"], hints.get("sort_dir") or "asc"),)
    return out


def structural_reasons(trace: Trace) -> list[str]:
    found = [e for e in trace.errors if e in REPAIRABLE]
    found += [code for code, holds in (("parse_failed", not trace.parsed), ("empty_filters", trace.empty_filters)) if holds and code not in found]
    return found or ([] if trace.schema_ok else ["schema_failed"])


def semantic_reasons(plan: Plan, hints: dict[str, Any]) -> list[str]:
    return [f"semantic_mismatch_{n}" for n, ok in compared(plan, hints).items() if not ok and n != "organism"]


def quality(c: Candidate, hints: dict[str, Any]) -> tuple[int, ...]:
    agrees = compared(c.plan, hints).values()
    yes, no = sum(agrees), sum(not a for a in agrees)
    return (
        int(c.trace.parsed), int(bool(c.plan.filters)), yes, -no, int("invalid_slot_value" not in c.trace.errors), len(c.plan.filters), int(bool(c.plan.sort)), yes - no,
        int(not c.trace.projected), -len(c.trace.errors),
    )


def projected(plan: Plan, hints: dict[str, Any], entity: Entity = PROTEIN) -> tuple[Candidate | None, list[str]]:
    """The plan with the hints' word wherever they differ, rebuilt in slot order; None when they agree."""
    off = [n for n, ok in compared(plan, hints).items() if not ok]
    if not off:
        return None, []
    values = plan.equals() | {n: hints[n] for n in HINTED if n in off}
    new = replace(plan, filters=tuple(Filter(s, "eq", values[s]) for s in entity.slots if values.get(s) is not None))
    if "limit" in off:
        new = replace(new, limit=hints["limit"])
    if "sort" in off:
        new = replace(new, sort=(Sort(hints["sort_by"], hints.get("sort_dir") or "asc"),))
    done, trace = validate(new.as_dict(), True, entity)
    reasons = [f"semantic projection aligned {n} with request hints" for n in off]
    trace.projected = True
    trace.notes += reasons
    flat = flatten(done, entity)
    return Candidate(compact(flat), flat, done, trace), reasons


@dataclass
class Prediction:
    """chosen: the better of the answers, before any projection."""

    first: Candidate
    repaired: Candidate | None
    chosen: Candidate
    projection: Candidate | None
    final: Candidate
    repair_reasons: list[str] = field(default_factory=list)
    projection_reasons: list[str] = field(default_factory=list)

    @property
    def repair_attempted(self) -> bool:
        return self.repaired is not None

    @property
    def used_repair(self) -> bool:
        return self.chosen is self.repaired

    @property
    def projection_attempted(self) -> bool:
        return self.projection is not None

    @property
    def used_projection(self) -> bool:
        return self.final is self.projection


def predict(first: str, hints: dict[str, Any] | None = None, repaired: str | None = None, entity: Entity = PROTEIN) -> Prediction:
    """hints: what functions.hints reads from the request, without its nulls. A later candidate wins only when it is better."""
    hints = {k: v for k, v in (hints or {}).items() if v is not None}
    one = Candidate.read(first, entity)
    reasons = list(dict.fromkeys([*structural_reasons(one.trace), *semantic_reasons(one.plan, hints)]))
    two = Candidate.read(repaired, entity) if reasons and repaired is not None else None
    best = two if two is not None and quality(two, hints) > quality(one, hints) else one
    three, notes = projected(best.plan, hints, entity)
    final = three if three is not None and quality(three, hints) > quality(best, hints) else best
    return Prediction(one, two, best, three, final, reasons, notes)
