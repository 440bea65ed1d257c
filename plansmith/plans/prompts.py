"""Messages that ask for a flat plan, or for the repair of one. Texts are parameters; these are short defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plansmith.functions.hints import Hints, hints
from plansmith.functions.registry import PROTEIN
from plansmith.plans.model import flat_keys

SYSTEM = "Answer with one JSON object with the keys {keys}. Use null for what isn't asked for; limit is {limit} unless stated. scaffold_type is one of {scaffolds}; oral_class is one of {orals}."
REPAIR = "The JSON object below doesn't fit the request. " + SYSTEM
# What each error means to the one who repairs.
ISSUES = {
    "parse_failed": "the JSON is malformed or truncated",
    "invalid_draft_type": "the answer must be one JSON object, not prose or a list",
    "invalid_slot_value": "replace unsupported slot values with valid enum or boolean values",
    "missing_filters": "keep at least one non-null filter slot",
    "invalid_filters": "keep at least one non-null filter slot",
    "empty_filters": "keep at least one non-null filter slot",
    "invalid_sort": 'sort_by must be "best_affinity_value" or null, and sort_dir must be "asc", "desc", or null',
    "invalid_limit": "limit must be a positive integer",
    "semantic_mismatch_has_experimental_affinity": "has_experimental_affinity must match the request",
    "semantic_mismatch_sort": "sort_by and sort_dir must match the requested affinity ordering",
}


def system_text(template: str = SYSTEM) -> str:
    values = {n: ", ".join(PROTEIN.by_name[n].values) for n in ("scaffold_type", "oral_class")}
    return template.format(keys=", ".join(flat_keys()), limit=PROTEIN.limit, scaffolds=values["scaffold_type"], orals=values["oral_class"])


def user_text(request: Column, asked: Hints | None = None, wrap: bool = True) -> Column:
    if asked is None and not wrap:
        return request
    lines = [F.concat(F.lit("Req: "), request) if wrap else request]
    if asked is not None:
        lines.append(F.concat(F.lit("Hints: "), asked.rendered()))
    return F.concat_ws("\n", *lines, F.lit("JSON only."))


def issue(code: Column, asked: Hints) -> Column:
    said = F.create_map(*(F.lit(x) for p in ISSUES.items() for x in p))
    expected = {"scaffold_type": "scaffold", "oral_class": "oral level"}
    out = F.when(F.map_contains_key(said, code), F.element_at(said, code))
    for slot, word in expected.items():
        hint = getattr(asked, slot)
        out = out.when(code == f"semantic_mismatch_{slot}", F.concat(F.lit(f"{slot} must match the request {word}"), F.when(hint.isNotNull(), F.concat(F.lit(" ("), hint, F.lit(")"))).otherwise("")))
    flag = F.when(asked.engineered, "engineered must be true because the request says engineered").when(~asked.engineered, "engineered must be false because the request says non-engineered")
    out = out.when(code == "semantic_mismatch_engineered", flag.otherwise("engineered must match the request"))
    out = out.when(code == "semantic_mismatch_limit", F.concat(F.lit("limit must match the request"), F.coalesce(F.concat(F.lit(" ("), asked.limit.cast("string"), F.lit(")")), F.lit(""))))
    return out.otherwise(F.replace(code, F.lit("_"), F.lit(" ")))


def issues(codes: Column, asked: Hints) -> Column:
    text = F.array_join(F.transform(F.array_distinct(codes), lambda c: issue(c, asked)), "; ")
    return F.when(F.size(codes) == 0, F.lit("no repair hints available")).otherwise(text)


def messages(request: Column, with_hints: bool = True, wrap: bool = True) -> Column:
    """array<struct<role, content>> of a request."""
    asked = hints(request) if with_hints else None
    return F.array(_message(F.lit("system"), F.lit(system_text())), _message(F.lit("user"), user_text(request, asked, wrap)))


def repair_messages(request: Column, bad: Column, codes: Column, with_hints: bool = True, wrap: bool = True) -> Column:
    asked = hints(request)
    lines = [F.lit("Fix JSON."), F.concat(F.lit("Req: " if wrap else "Original request: "), request)]
    if with_hints:
        lines.append(F.concat(F.lit("Hints: "), asked.rendered()))
    lines += [F.concat(F.lit("Issues: "), issues(codes, asked)), F.concat(F.lit("Bad: "), bad), F.lit("JSON only.")]
    return F.array(_message(F.lit("system"), F.lit(system_text(REPAIR))), _message(F.lit("user"), F.concat_ws("\n", *lines)))


def _message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def chat(request: Column, answer: Column, **how: bool) -> Column:
    return F.array_append(messages(request, **how), _message(F.lit("assistant"), answer))
