"""Plans: filters, sort keys and a limit over one entity, and their flat form."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from plansmith.functions.registry import PROTEIN, Entity


@dataclass(frozen=True)
class Filter:
    field: str
    op: str = "eq"
    value: Any = None


@dataclass(frozen=True)
class Sort:
    field: str
    direction: str = "asc"


@dataclass(frozen=True)
class Plan:
    filters: tuple[Filter, ...] = ()
    sort: tuple[Sort, ...] = ()
    limit: int | None = None
    intent: str = PROTEIN.intent
    entity: str = PROTEIN.name
    return_fields: tuple[str, ...] = ()

    def as_dict(self) -> dict[str, Any]:
        return {
            "intent": self.intent,
            "entity": self.entity,
            "filters": [vars(f).copy() for f in self.filters],
            "sort": [vars(s).copy() for s in self.sort],
            "limit": self.limit,
            "return_fields": list(self.return_fields),
        }

    @classmethod
    def of(cls, raw: dict[str, Any]) -> "Plan":
        return cls(
            tuple(Filter(f["field"], f["op"], f.get("value")) for f in raw.get("filters") or ()),
            tuple(Sort(s["field"], s.get("direction") or "asc") for s in raw.get("sort") or ()),
            None if raw.get("limit") is None else int(raw["limit"]),
            raw.get("intent", PROTEIN.intent),
            raw.get("entity", PROTEIN.name),
            tuple(raw.get("return_fields") or ()),
        )

    def equals(self) -> dict[str, Any]:
        """Value of each field's filter; the last of a field counts."""
        return {f.field: f.value for f in self.filters}


def compact(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def flat_keys(entity: Entity = PROTEIN) -> tuple[str, ...]:
    return (*entity.slots, "sort_by", "sort_dir", "limit")


def flatten(plan: Plan, entity: Entity = PROTEIN) -> dict[str, Any]:
    """The flat form: equality filters on slots, the first sort key, the limit."""
    out = dict.fromkeys(flat_keys(entity))
    out["limit"] = entity.limit if plan.limit is None else plan.limit
    out |= {entity.field_of(f.field): f.value for f in plan.filters if f.op == "eq" and entity.field_of(f.field) in entity.slots}
    if plan.sort and (by := entity.field_of(plan.sort[0].field)):
        out["sort_by"], out["sort_dir"] = by, plan.sort[0].direction
    return out
