"""What a request text says plainly: scaffold, oral class, flags, limit and order, as columns of the text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansmith.functions.registry import PROTEIN, Entity
from plansmith.session import spread

# Phrases that state a limit, the first of the list that matches counts.
LIMIT_PHRASES = [
    r"前\s*(\d+)\s*个", r"前\s*(\d+)(?!\s*个)", r"最多(?:保留|返回)?\s*(\d+)\s*条", r"只保留\s*(\d+)\s*条", r"只留前\s*(\d+)\s*个?", r"截到\s*(\d+)\s*条",
    r"返回数量不要超过\s*(\d+)", r"不要超过\s*(\d+)", r"最多输出\s*(\d+)\s*条", r"结果上限\s*(\d+)\s*条", r"输出限制为\s*(\d+)\s*条", r"最终不要超过\s*(\d+)\s*项",
    r"控制在\s*(\d+)\s*个以内", r"limit\s*(\d+)", r"top\s*(\d+)", r"stop\s+after\s+(\d+)\s+results?", r"cap\s+the\s+list\s+at\s+(\d+)", r"return\s+the\s+first\s+(\d+)",
    r"keep\s+only\s+(\d+)", r"at\s+most\s+(\d+)", r"trim\s+the\s+output\s+to\s+(\d+)", r"keep\s+no\s+more\s+than\s+(\d+)\s+hits?", r"stop\s+once\s+(\d+)\s+rows?\s+remain",
    r"keep\s+the\s+top\s+(\d+)", r"show\s+no\s+more\s+than\s+(\d+)\s+records?", r"cap\s+the\s+response\s+at\s+(\d+)", r"stop\s+at\s+(\d+)", r"to\s+(\d+)\.?$",
]
ORAL_PHRASES = [
    r"oral\s*(?:class|level)?\s*(?:is|=)?\s*(high|medium|low)", r"oral\s*分档\s*(?:是|为)?\s*(high|medium|low)", r"口服\s*分档\s*(?:是|为)?\s*(high|medium|low)",
]
AFFINITY_WORDS = ["affinity", "binding strength", "binding potency", "binder", "亲和力", "结合强度"]
# An order is asked for by any of these; longer phrases that hold one of them need no line of their own.
ORDER_WORDS = [
    "最强", "放前面", "优先", "排序", "排前", "best affinity first", "strongest affinity first", r"strongest binders? first", r"best binders? first", "ranking by binding strength",
    r"rank(?:ed|ing)? by affinity", "rank the survivors by measured binding quality", "order the list with the best affinity first", r"put the highest-priority binders? first",
    "arrange the output by strongest measured affinity", r"prioriti[sz]e better affinity values?", "sort",
]
DIGITS = "０１２３４５６７８９", "0123456789"


@dataclass(frozen=True)
class Hints:
    """A column for each slot, null where the text is silent."""

    scaffold_type: Column
    oral_class: Column
    engineered: Column
    has_experimental_affinity: Column
    limit: Column
    sort_by: Column
    sort_dir: Column

    def items(self) -> list[tuple[str, Column]]:
        return list(vars(self).items())

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for n, c in self.items()))

    def silent(self) -> Column:
        return F.coalesce(*(c.cast("string") for _, c in self.items())).isNull()

    def rendered(self) -> Column:
        """slot=value, ... with True and False as Python spells them."""
        parts = [F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), F.initcap(c.cast("string")) if n in {"engineered", "has_experimental_affinity"} else c.cast("string"))) for n, c in self.items()]
        return F.when(self.silent(), F.lit("No deterministic slot hints extracted.")).otherwise(F.concat_ws(", ", *parts))


def _first(text: Column, phrases: list[str]) -> Column:
    """Group 1 of the first phrase in the list that the text holds, digits as ASCII."""
    return F.coalesce(*(F.when(text.rlike(f"(?iuU){p}"), F.regexp_extract(text, f"(?iuU){p}", 1)) for p in phrases))


def any_of(text: Column, phrases: list[str]) -> Column:
    return reduce(or_, (text.rlike(f"(?iu){p}") for p in phrases))


def hints(text: Column, entity: Entity = PROTEIN) -> Hints:
    low = F.lower(text)
    scaffold = F.coalesce(*(F.when(F.contains(low, F.lit(v.lower())), F.lit(v)) for v in entity.by_name["scaffold_type"].values))
    engineered = F.when(F.contains(low, F.lit("non-engineered")), F.lit(False)).when(F.contains(low, F.lit("engineered")), F.lit(True))
    tested = F.when(F.contains(text, F.lit("实验亲和力")) | F.contains(low, F.lit("experimental affinity")), F.lit(True))
    ordered = any_of(text, AFFINITY_WORDS) & any_of(text, ORDER_WORDS)
    limit = F.translate(_first(text, LIMIT_PHRASES), *DIGITS).try_cast("int")
    return Hints(scaffold, F.initcap(_first(text, ORAL_PHRASES)), engineered, tested, limit, F.when(ordered, F.lit("best_affinity_value")), F.when(ordered, F.lit("asc")))


def asked(rows: DataFrame, text: Column, entity: Entity = PROTEIN) -> tuple[DataFrame, Hints]:
    """rows, dealt out, with what their texts say in columns of their own, so that each text is read once however often its hints are named."""
    found = hints(text, entity)
    slots = {f"_asked_{n}": c for n, c in found.items() if n != "sort_dir"}
    held = {n.removeprefix("_asked_"): F.col(n) for n in slots}
    return spread(rows).withColumns(slots), Hints(**held, sort_dir=F.when(F.col("_asked_sort_by").isNotNull(), F.lit("asc")))


def rule_limit(text: Column) -> Column:
    return F.coalesce(F.translate(_first(text, [r"(?:前\s*|limit\s*)(\d+)"]), *DIGITS).try_cast("int"), F.lit(20))


def rule_draft(text: Column, scaffolds: list[str]) -> dict[str, Column]:
    """Slots of the rule baseline. scaffolds: known values, of which the first in order of spelling counts."""
    low = F.lower(text)
    names = sorted({s for s in scaffolds if s and s != "unknown"})
    oral = F.coalesce(*(F.when(F.contains(low, F.lit(f"oral {v}")), F.lit(v.capitalize())) for v in ("high", "medium", "low")))
    tested = F.contains(text, F.lit("亲和力")) | F.contains(low, F.lit("affinity"))
    return {
        "scaffold_type": F.coalesce(*(F.when(F.contains(low, F.lit(s.lower())), F.lit(s)) for s in names), F.lit(None).cast("string")),
        "oral_class": oral,
        "engineered": F.when(F.contains(low, F.lit("non-engineered")), F.lit(False)).when(F.contains(low, F.lit("engineered")), F.lit(True)),
        "has_experimental_affinity": F.when(tested, F.lit(True)),
        "sort_by": F.when(tested, F.lit("best_affinity_value")),
        "limit": rule_limit(text),
    }


def mismatches(plan: dict[str, Column], asked: Hints) -> Column:
    """Codes of the slots, the limit and the order in which a flat plan isn't what the text asks for."""

    def off(name: str, said: Column, has: Column) -> Column:
        return F.when(said.isNotNull() & ~has.eqNullSafe(said), F.lit(f"semantic_mismatch_{name}"))

    slots = [off(n, getattr(asked, n), plan[n]) for n in ("scaffold_type", "oral_class", "engineered", "has_experimental_affinity")]
    order = F.when(asked.sort_by.isNotNull() & ~(plan["sort_by"].eqNullSafe(asked.sort_by) & plan["sort_dir"].eqNullSafe(asked.sort_dir)), F.lit("semantic_mismatch_sort"))
    return F.array_compact(F.array(*slots, off("limit", asked.limit, plan["limit"]), order))


def project(plan: dict[str, Column], asked: Hints) -> dict[str, Column]:
    """The flat plan with the text's word wherever it has one."""
    return {n: F.coalesce(getattr(asked, n), c) if hasattr(asked, n) else c for n, c in plan.items()}


def quality(parsed: Column, errors: Column, plan: dict[str, Column], asked: Hints, projected: Column, slots: tuple[str, ...] = PROTEIN.slots) -> Column:
    """A struct that orders candidates: the greater is the better."""
    pairs = [(getattr(asked, n), plan[n]) for n in ("scaffold_type", "oral_class", "engineered", "has_experimental_affinity", "limit")]
    ok = [F.when(a.isNull(), 0).when(b.eqNullSafe(a), 1).otherwise(-1) for a, b in pairs]
    same = plan["sort_by"].eqNullSafe(asked.sort_by) & plan["sort_dir"].eqNullSafe(asked.sort_dir)
    ok.append(F.when(asked.sort_by.isNull(), 0).when(same, 1).otherwise(-1))
    matched, missed = (sum((F.when(c == v, 1).otherwise(0) for c in ok), F.lit(0)) for v in (1, -1))
    filters = sum((plan[n].isNotNull().cast("int") for n in slots if n in plan), F.lit(0))
    return F.struct(
        parsed.cast("int").alias("parsed"), (filters > 0).cast("int").alias("filtered"), matched.alias("matched"), (-missed).alias("unmissed"),
        (~F.array_contains(errors, "invalid_slot_value")).cast("int").alias("valid"), filters.alias("filters"), plan["sort_by"].isNotNull().cast("int").alias("sorted"),
        (matched - missed).alias("balance"), (~projected).cast("int").alias("own"), (-F.size(errors)).alias("clean"),
    )
