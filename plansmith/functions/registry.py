"""Entities: which fields a plan may use, under which names, and what values they take."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Any


@dataclass(frozen=True)
class Field:
    """kind: text, flag, choice or number. values: the choices, in order. extra: accepted spellings beyond the choices."""

    name: str
    kind: str = "text"
    aliases: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    slot: bool = False
    identity: bool = False

    @cached_property
    def spellings(self) -> dict[str, str]:
        return {v.lower(): v for v in (*self.values, *self.extra)}


@dataclass(frozen=True)
class Entity:
    name: str
    intent: str
    fields: tuple[Field, ...]
    shown: tuple[str, ...]
    reserved: tuple[str, ...] = ()
    limit: int = 20
    true_words: frozenset[str] = frozenset()
    false_words: frozenset[str] = frozenset()
    blank_words: frozenset[str] = frozenset()
    operators: dict[str, str] = field(default_factory=dict)
    directions: dict[str, str] = field(default_factory=dict)

    @cached_property
    def by_name(self) -> dict[str, Field]:
        return {f.name: f for f in self.fields}

    @cached_property
    def names(self) -> dict[str, str]:
        """Every accepted spelling of a field name, in lower case."""
        return {n: f.name for f in self.fields for n in (f.name, *f.aliases)}

    @cached_property
    def slots(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.slot)

    @cached_property
    def schema_words(self) -> frozenset[str]:
        return frozenset({f.name for f in self.fields} | {self.intent, self.name} | set(self.reserved))

    # ---- scalar rules; functions.normalize has them as columns ----

    def field_of(self, raw: Any) -> str | None:
        return None if raw is None else self.names.get(str(raw).strip().lower())

    def operator_of(self, raw: Any) -> str | None:
        return None if raw is None else self.operators.get(str(raw).strip().lower())

    def direction_of(self, raw: Any) -> str | None:
        return None if raw is None else self.directions.get(str(raw).strip().lower())

    def value_of(self, name: str, raw: Any) -> Any:
        """The value as the field takes it, or None. Lists are taken element by element; numbers stay numbers in number fields."""
        if raw is None or isinstance(raw, bool):
            return raw
        spec = self.by_name[name]
        if isinstance(raw, (list, tuple)):
            kept = [v for v in (self.value_of(name, x) for x in raw) if v is not None]
            return kept or None
        if spec.kind == "number" and isinstance(raw, (int, float)):
            return raw
        text = str(raw).strip()
        low = text.lower()
        if low in self.schema_words and not spec.identity:
            return None
        if spec.kind == "choice":
            return spec.spellings.get(low)
        if spec.kind == "flag":
            return True if low in self.true_words else False if low in self.false_words else None
        if spec.kind == "number":
            try:
                return float(text)
            except ValueError:
                return None
        return text


# The vocabulary of the candidate search.
PROTEIN = Entity(
    name="protein_candidate",
    intent="candidate_search",
    fields=(
        Field("candidate_id", aliases=("candidate",), slot=True, identity=True),
        Field(
            "scaffold_type", "choice", ("scaffold", "scaffold_class"),
            ("EVH1domain", "Ibody", "adnectin", "affimer", "avimer", "betarolldomain", "centyrin", "cyclotide", "knottin", "kunitz", "obody", "phdfingerdomain"), slot=True,
        ),
        Field("oral_class", "choice", ("oral", "oral_properties"), ("High", "Low", "Medium"), ("Unknown",), slot=True),
        Field("engineered", "flag", ("is_engineered",), slot=True),
        Field("has_experimental_affinity", "flag", ("experimental_affinity",), slot=True),
        Field("organism", aliases=("species",), slot=True),
        Field("canonical_name", aliases=("name",)),
        Field("expression_system"),
        Field("stability_signal", aliases=("stability",)),
        Field("inhibitory", "flag"),
        Field("best_affinity_value", "number", ("affinity", "binding_strength")),
    ),
    shown=("candidate_id", "canonical_name", "scaffold_type", "oral_class", "best_affinity_value"),
    reserved=("filters", "sort", "return_fields"),
    true_words=frozenset({"true", "yes", "y", "1", "engineered"}),
    false_words=frozenset({"false", "no", "n", "0"}),
    blank_words=frozenset({"", "null", "none", "n/a", "na"}),
    operators={"=": "eq", "==": "eq", "eq": "eq", "in": "in", ">=": "gte", "gte": "gte", "<=": "lte", "lte": "lte", "exists": "exists"},
    directions={"asc": "asc", "ascending": "asc", "strongest": "asc", "desc": "desc", "descending": "desc", "weakest": "desc"},
)
