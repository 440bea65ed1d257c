"""The registry's scalar rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plansmith.functions.registry import Entity


def lookup(c: Column, table: dict[str, str]) -> Column:
    """table[c], null for what it lacks."""
    pairs = F.create_map(*(F.lit(x) for p in table.items() for x in p))
    return F.try_element_at(pairs, c)


def _key(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def field_name(c: Column, entity: Entity) -> Column:
    return lookup(_key(c), entity.names)


def operator(c: Column, entity: Entity) -> Column:
    return lookup(_key(c), entity.operators)


def direction(c: Column, entity: Entity) -> Column:
    return lookup(_key(c), entity.directions)


def flag(c: Column, yes: frozenset[str] | set[str], no: frozenset[str] | set[str]) -> Column:
    key = _key(c)
    return F.when(key.isin(*sorted(yes)), F.lit(True)).when(key.isin(*sorted(no)), F.lit(False))


def value(c: Column, name: str, entity: Entity) -> Column:
    """A text column as the field takes it: string, boolean or double by the field's kind."""
    spec, key = entity.by_name[name], _key(c)
    clean = c if spec.identity else F.when(~key.isin(*sorted(entity.schema_words)), c)
    if spec.kind == "choice":
        return lookup(_key(clean), spec.spellings)
    if spec.kind == "flag":
        return flag(clean, entity.true_words, entity.false_words)
    if spec.kind == "number":
        return F.trim(clean).try_cast("double")
    return F.trim(clean)


def limit(c: Column, default: int = 20) -> Column:
    """Null, not an integer or not positive: the default."""
    n = F.trim(c.cast("string")).try_cast("int")
    return F.when(n > 0, n).otherwise(F.lit(default))


def limit_is_bad(c: Column) -> Column:
    return c.isNotNull() & ~F.coalesce(F.trim(c.cast("string")).try_cast("int") > 0, F.lit(False))


def unblank(c: Column, entity: Entity) -> Column:
    return F.when(~_key(c).isin(*sorted(entity.blank_words)), c)


def first_match(text: Column, pattern: str) -> Column:
    """Group 1 of the first match in any case, trimmed; null without one."""
    return F.when(text.rlike(f"(?i){pattern}"), F.trim(F.regexp_extract(text, f"(?i){pattern}", 1)))


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def first_said(values: Column) -> Column:
    """The first of an array of strings that says something."""
    said = F.filter(values, lambda v: v.isNotNull() & ~F.lower(v).isin("", "n/a", "na", "unknown", "none"))
    return F.get(said, F.lit(0))


def half_even(c: Column, digits: int = 4) -> Column:
    return F.bround(c, digits)


def rate(hits: Column, digits: int = 4) -> Column:
    """Share of rows where hits holds, 0.0 of none."""
    return F.coalesce(half_even(F.try_divide(F.count_if(hits).cast("double"), F.count(F.lit(1))), digits), F.lit(0.0))


def mean(c: Column, digits: int = 4) -> Column:
    return F.coalesce(half_even(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), digits), F.lit(0.0))


def let(c: Column, f) -> Column:
    """f(c) with c worked out once a row, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))
