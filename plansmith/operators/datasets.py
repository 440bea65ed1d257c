"""Training and preference rows from a snapshot: splits, plans, wordings, chats, corruptions, pairs.

Random choices are hashes of a seed and the row's key: the same on every run and under any partitioning.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansmith.functions.registry import PROTEIN
from plansmith.functions.wording import RANKS, TEMPLATES, UNRANKED
from plansmith.plans.model import flat_keys
from plansmith.plans.prompts import chat, messages, repair_messages

FLAT = "candidate_id string, scaffold_type string, oral_class string, engineered boolean, has_experimental_affinity boolean, organism string, sort_by string, sort_dir string, limit int"


def dice(seed: int, key: Column, what: str = "") -> Column:
    """A number in [0, 1) of the seed and the key."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), key), F.lit(1 << 30)) / float(1 << 30)


def pick(seed: int, key: Column, values: list, what: str = "") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(dice(seed, key, what) * len(values)) + 1).cast("int"))


def split(df: DataFrame, key: str, seed: int, sizes: dict[str, int], rest: str | None = None) -> DataFrame:
    """df with part: rows in seeded order go to the named parts by size, what is left to rest or out.

    Ordinals come from the top sum(sizes) keys alone; a rest is found by an anti-join, so no order over all rows is made.
    """
    shuffled = F.xxhash64(F.lit(seed), key)
    total = sum(sizes.values())
    top = df.select(key).orderBy(shuffled, key).limit(total).withColumn("n", F.row_number().over(Window.orderBy(shuffled, key)))
    part, at = F.lit(None).cast("string"), 0
    for name, size in sizes.items():
        part = F.when((F.col("n") > at) & (F.col("n") <= at + size), F.lit(name)).otherwise(part)
        at += size
    out = df.join(top.select(key, part.alias("part")), key, "left")
    return out.withColumn("part", F.coalesce("part", F.lit(rest))) if rest else out.filter("part IS NOT NULL")


def gold_plan(seed: int) -> Column:
    """The flat plan that asks for a snapshot row: up to four of its facts, its order if it has a value, a limit of 5, 10 or 20."""
    key = F.col("candidate_id")
    known = lambda c, blank: F.when((F.col(c) != blank) & (F.col(c) != ""), F.col(c))
    facts = {
        "scaffold_type": known("scaffold_type", "unknown"), "oral_class": known("oral_class", "Unknown"), "engineered": F.col("engineered"),
        "has_experimental_affinity": F.when(F.col("has_experimental_affinity"), F.lit(True)), "organism": F.when(dice(seed, key, "organism") < 0.35, known("organism", "Unknown")),
    }
    count, kept = F.lit(0), {}
    for name, c in facts.items():
        count = count + c.isNotNull().cast("int")
        kept[name] = F.when(count <= 4, c)
    kept["candidate_id"] = F.when(count == 0, key)
    ranked = F.col("best_affinity_value").isNotNull()
    kept |= {"sort_by": F.when(ranked, F.lit("best_affinity_value")), "sort_dir": F.when(ranked, F.lit("asc")), "limit": pick(seed, key, [5, 10, 20], "limit")}
    return F.struct(*(kept[k].alias(k) for k in flat_keys()))


def _clauses(plan: Column, says: dict[str, Column], order: tuple[str, ...]) -> list[Column]:
    return [F.when(plan[k].isNotNull(), says[k]) for k in order]


def wording_slots(plan: Column, family: str, registry: str) -> dict[str, Column]:
    """The columns that fill a template."""
    p, cat = plan, lambda a, b: F.concat(F.lit(a), b)
    flag = lambda yes, no: F.when(p["engineered"], yes).otherwise(no)
    said = ("scaffold_type", "oral_class", "engineered", "has_experimental_affinity", "organism", "candidate_id")
    en = {
        "scaffold_type": cat("scaffold family ", p["scaffold_type"]), "oral_class": cat("oral class ", p["oral_class"]), "engineered": flag("engineered molecules only", "non-engineered molecules only"),
        "has_experimental_affinity": F.when(p["has_experimental_affinity"], "experimental affinity evidence must be present"), "organism": cat("organism ", p["organism"]), "candidate_id": cat("candidate id ", p["candidate_id"]),
    }
    zh = {
        "scaffold_type": cat("骨架类型是 ", p["scaffold_type"]), "oral_class": cat("oral 分档是 ", p["oral_class"]), "engineered": flag("只看 engineered 条目", "只看 non-engineered 条目"),
        "has_experimental_affinity": F.when(p["has_experimental_affinity"], "必须带实验亲和力证据"), "organism": cat("来源物种是 ", p["organism"]), "candidate_id": cat("候选编号是 ", p["candidate_id"]),
    }
    plain = {
        "scaffold_type": cat("scaffold=", p["scaffold_type"]), "oral_class": cat("oral ", F.lower(p["oral_class"])), "engineered": flag("engineered=true", "non-engineered"),
        "has_experimental_affinity": F.lit("experimental affinity required"), "organism": cat("organism=", p["organism"]), "candidate_id": cat("candidate_id=", p["candidate_id"]),
    }
    mixed = {
        "scaffold_type": F.concat(p["scaffold_type"], F.lit(" 候选")), "oral_class": cat("oral ", F.lower(p["oral_class"])), "engineered": flag("engineered", "non-engineered"),
        "has_experimental_affinity": F.lit("带实验亲和力"), "organism": cat("来源于 ", p["organism"]), "candidate_id": cat("id 为 ", p["candidate_id"]),
    }
    ranked = p["sort_by"].isNotNull()
    rank = RANKS.get(family, RANKS["v15"])
    return {
        "en": F.concat_ws(", ", *_clauses(p, en, said)), "zh": F.concat_ws("，" if family == "v10" else "、", *_clauses(p, zh, said)), "filters": F.concat_ws("; ", *_clauses(p, plain, said)),
        "zh_filters": F.concat_ws("、", *_clauses(p, mixed, said)), "rank": F.when(ranked, "strongest affinity first").otherwise("no extra ranking"),
        "rank_en": F.when(ranked, rank[0]).otherwise(UNRANKED[0]), "rank_zh": F.when(ranked, rank[1]).otherwise(UNRANKED[1]),
        "order_zh": F.when(ranked, "优先把亲和力更强的放前面").otherwise("不用额外排序"), "limit": p["limit"].cast("string"), "registry": F.lit(registry),
    }


def worded(plan: Column, family: str, registry: str = "protein") -> Column:
    """array of the plan in each wording of the family."""
    slots = wording_slots(plan, family, registry)
    texts = []
    for t in TEMPLATES[family]:
        parts = re.split(r"\{(\w+)\}", t)
        texts.append(F.concat(*(slots[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x)))
    return F.array(*texts)


def turn(texts: Column, index: Column) -> Column:
    """The wording whose turn it is."""
    return F.element_at(texts, (F.pmod(index, F.size(texts)) + 1).cast("int"))


def requests(rows: DataFrame, family: str, per_row: int, position: Column, registry: str = "protein") -> DataFrame:
    """rows (with plan) times per_row: family, prompt. position: the row's ordinal in its family, from 0."""
    texts = worded(F.col("plan"), family, registry)
    out = rows.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))))
    return out.withColumns({"family": F.lit(family), "prompt": turn(texts, position * per_row + F.col("offset"))})


def holdout(rows: DataFrame, seed: int, family: str, size: int, sizes: dict[str, int], registry: str = "protein") -> DataFrame:
    """(id, category, prompt, plan) of the rows that the seeded splits leave over, or of all when none is left, in seeded order."""
    parts = split(rows, "candidate_id", seed, sizes, "rest")
    left = parts.filter("part = 'rest'")
    left = left if left.limit(1).count() else parts
    order = Window.orderBy(F.xxhash64(F.lit(seed), "candidate_id"), "candidate_id")
    top = left.orderBy(F.xxhash64(F.lit(seed), "candidate_id"), "candidate_id").limit(size).withColumn("n", F.row_number().over(order))
    out = top.withColumn("plan", gold_plan(seed))
    return out.select(F.concat(F.lit(f"{family}_"), "n").alias("id"), F.lit(family).alias("category"), turn(worded(F.col("plan"), family, registry), F.col("n") - 1).alias("prompt"), "plan")


def hotspot(plan: Column) -> Column:
    return F.coalesce((plan["scaffold_type"] == "knottin") & (plan["oral_class"] == "High") & plan["engineered"] & plan["has_experimental_affinity"], F.lit(False))


def plan_json(plan: Column) -> Column:
    return F.to_json(plan, {"ignoreNullFields": "false"})


def training_chats(rows: DataFrame, seed: int, per_row: dict[str, int], registry: str = "protein") -> DataFrame:
    """(family, candidate_id, conversations) of all families that per_row names, each with so many wordings a row."""
    rows = rows.withColumn("plan", gold_plan(seed))
    only = {
        "engineered_bridge": F.col("engineered").eqNullSafe(True), "completion": F.col("engineered").eqNullSafe(True), "final_bridge": F.col("has_experimental_affinity"),
        "knottin_high": hotspot(F.col("plan")), "hotspot_prefix": hotspot(F.col("plan")),
        "hotspot_contrast": (F.col("plan.scaffold_type") == "knottin") & (F.col("plan.oral_class") == "High") & F.col("plan.has_experimental_affinity") & F.col("plan.engineered").isNotNull(),
    }
    out = None
    for family, n in per_row.items():
        if n <= 0:
            continue
        mine = rows.filter(only[family]) if family in only else rows
        ordinal = F.pmod(F.xxhash64(F.lit(seed), "candidate_id"), F.lit(len(TEMPLATES[family])))
        bare = family not in {"train", "hard", "dev", "seen", "seen_unordered", "anti_hype"}
        each = requests(mine, family, n, ordinal, registry)
        each = each.select("family", "candidate_id", chat(F.col("prompt"), plan_json(F.col("plan")), with_hints=not bare, wrap=not bare).alias("conversations"))
        out = each if out is None else out.unionByName(each)
    if out is None:
        raise ValueError("no family is asked for")
    return out


def corrupted(plan: Column, index: Column) -> Column:
    """struct of the flat plan's text fields with one thing wrong, by index modulo 10; limit becomes text."""
    mode = F.pmod(index, F.lit(10))
    reset = (mode == 9) | ((mode == 0) & plan["engineered"].isNull())
    null = F.lit(None).cast("string")
    oral = F.coalesce(F.when(plan["oral_class"] == "High", "Low").when(plan["oral_class"] == "Low", "High").when(plan["oral_class"] == "Medium", "Low"), F.lit("Medium"))
    wrong = {
        "scaffold_type": F.when(mode == 5, "candidate_id"), "oral_class": F.when(mode == 1, oral).when(mode == 6, "oral_class"), "engineered": F.when(mode == 0, (~plan["engineered"]).cast("string")),
        "has_experimental_affinity": F.when(mode == 4, "false"), "sort_by": F.when(mode == 7, "candidate_id"), "sort_dir": F.when(mode == 7, "desc"),
        "limit": F.when(mode == 3, F.when(plan["limit"] == 20, "5").otherwise("20")).when(mode == 8, "top five"),
    }
    out = []
    for k in flat_keys():
        c = F.coalesce(wrong.get(k, null), plan[k].cast("string"))
        if k in ("sort_by", "sort_dir"):
            c = F.when(mode == 2, null).otherwise(c)
        out.append(F.when(reset, F.lit(str(PROTEIN.limit)) if k == "limit" else null).otherwise(c).alias(k))
    return F.struct(*out)


def _as_json(flat: Column) -> Column:
    """Text fields back to JSON: booleans and numbers bare, null as null."""
    bare = {"engineered", "has_experimental_affinity", "limit"}

    def value(k: str) -> Column:
        quoted = F.concat(F.lit('"'), F.regexp_replace(flat[k], r'(["\\])', r"\\$1"), F.lit('"'))
        return F.coalesce(F.when(flat[k].rlike(r"^(true|false|-?\d+)$"), flat[k]).otherwise(quoted) if k in bare else quoted, F.lit("null"))

    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), value(k)) for k in flat_keys())), F.lit("}"))


def preference_pairs(rows: DataFrame, prompt: str = "prompt", plan: str = "plan", id_col: str = "id", position: str = "_pos", variants: int = 1) -> DataFrame:
    """(id, chosen, rejected, preference_source, corruption_family): the right plan against a corrupted one, variants times a row."""
    n = max(1, variants)
    out = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    index = F.col(position) * n + F.col("v")
    asked = messages(F.col(prompt), with_hints=False, wrap=False)
    answer = lambda text: F.array_append(asked, F.struct(F.lit("assistant").alias("role"), text.alias("content")))
    name = F.concat(F.col(id_col), F.concat(F.lit("_var"), F.col("v") + 1)) if n > 1 else F.col(id_col)
    return out.select(
        name.alias("id"), answer(plan_json(F.col(plan))).alias("chosen"), answer(_as_json(corrupted(F.col(plan), index))).alias("rejected"),
        F.lit("gold_plan_vs_rule_corruption").alias("preference_source"), F.pmod(index, F.lit(10)).cast("string").alias("corruption_family"),
    )


def repair_cases(plan: Column) -> Column:
    """array<struct<text, errors>> of broken answers to a flat plan, with what is wrong in each; cases that don't apply are left out."""
    whole = plan_json(plan)
    values = {k: plan[k] for k in flat_keys()}

    def case(when: Column | None, errors: list[str], text: Column | None = None, **changed: Column) -> Column:
        if text is None:
            text = F.to_json(F.struct(*((changed[k] if k in changed else c).alias(k) for k, c in values.items())), {"ignoreNullFields": "false"})
        out = F.struct(text.alias("text"), F.array(*map(F.lit, errors)).alias("errors"))
        return out if when is None else F.when(when, out)

    def other(name: str) -> Column:
        options = PROTEIN.by_name[name].values
        return F.when(plan[name] == options[0], F.lit(options[1])).otherwise(F.lit(options[0]))

    lit, has = F.lit, {k: c.isNotNull() for k, c in values.items()}
    null = {k: lit(None).cast(PLAN_KINDS[k]) for k in PROTEIN.slots}
    word, off = "schema_key_as_value", lambda k: f"semantic_mismatch_{k}"
    cases = [
        case(None, ["empty_filters"], **null), case(None, ["wrapped_prose"], F.concat(lit("请修正这个 JSON: "), whole)), case(None, ["invalid_limit"], F.regexp_replace(whole, r',"limit":\d+', "")),
        case(None, ["invalid_limit"], limit=lit("top five")), case(None, ["parse_failed"], F.regexp_replace(whole, r"\}$", "")), case(None, ["parse_failed"], F.regexp_replace(whole, r"\}$", ',"length":20')),
        case(None, ["unsupported_field_alias"], F.regexp_replace(whole, r"\}$", ',"outer":"Low"}')), case(None, [off("limit")], limit=F.when(plan["limit"] == 5, 10).otherwise(5)),
    ]
    for name, junk, typo in (("scaffold_type", "ABC", "statper_class"), ("oral_class", "Medi", "higheral_class")):
        cases += [
            case(has[name], [word, off(name)], **{name: lit("candidate_id")}), case(has[name], [word], **{name: lit("candidate_search" if name == "scaffold_type" else name)}), case(has[name], ["invalid_slot_value", off(name)], **{name: lit(junk)}),
            case(has[name], [off(name)], **{name: other(name)}), case(has[name], [off(name)], F.replace(whole, lit(f'"{name}":'), lit(f'"{typo}":'))),
        ]
    e, x = "engineered", "has_experimental_affinity"
    cases += [
        case(has[e], ["invalid_boolean_value"], engineered=lit("Age")), case(has[e], [word, off(e)], engineered=lit("candidate_id")), case(has[e], [off(e)], engineered=~plan[e]),
        case(has[e], [off(e)], F.replace(whole, lit(f'"{e}":'), lit('"engimber_":'))), case(plan[x], [off(x)], has_experimental_affinity=lit(False)), case(plan[x], ["invalid_boolean_value", off(x)], has_experimental_affinity=lit("tightness")),
        case(plan[x], ["parse_failed", off(x)], F.replace(whole, lit(f'"{x}":true'), lit(f'"{x}":tightness'))), case(has["sort_by"], ["invalid_sort"], sort_by=lit("affinity")), case(has["sort_by"], [word, "invalid_sort"], sort_by=lit("candidate_id")),
        case(has["sort_by"], ["parse_failed", "invalid_sort"], F.replace(whole, lit('"sort_dir":"asc"'), lit('"sort_dir":"\\")'))),
    ]
    return F.array_compact(F.array(*cases))


PLAN_KINDS = dict(x.split(" ") for x in FLAT.split(", "))


def repair_chats(rows: DataFrame, seed: int, per_row: int, prompt: str = "prompt", plan: str = "plan", key: str = "candidate_id") -> DataFrame:
    """(key, errors, conversations): per_row distinct broken answers of each row, chosen by seed, each with the repair that is wanted."""
    each = rows.select(key, prompt, plan, F.explode(F.array_distinct(repair_cases(F.col(plan)))).alias("c"))
    order = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), key, "c.text"), "c.text")
    kept = each.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_row)
    asked = repair_messages(F.col(prompt), F.col("c.text"), F.col("c.errors"))
    return kept.select(key, F.col("c.errors").alias("errors"), F.array_append(asked, F.struct(F.lit("assistant").alias("role"), plan_json(F.col(plan)).alias("content"))).alias("conversations"))


def wrong_choice(answer: Column) -> Column:
    """The next of A, B, C, D."""
    return F.element_at(F.array(*map(F.lit, "ABCD")), (F.pmod(F.instr(F.lit("ABCD"), answer), F.lit(4)) + 1).cast("int"))


def dedupe_capped(df: DataFrame, key: list[str], priority: list[Column], cap_by: list[str], cap: int) -> DataFrame:
    """The first row of each key by priority, then at most cap rows of each cap_by group."""
    one = df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*priority))).filter("_k = 1")
    return one.withColumn("_k", F.row_number().over(Window.partitionBy(*cap_by).orderBy(*priority))).filter(F.col("_k") <= cap).drop("_k")


def head_and_rest(df: DataFrame, order: list[Column], key: str, n: int = 6) -> tuple[DataFrame, DataFrame]:
    """The first n rows in an order that ends with the unique key, and the others: a top-n and an anti-join with its n keys."""
    head = df.orderBy(*order).limit(n)
    return head, df.join(F.broadcast(head.select(key)), key, "left_anti")


def manifest(df: DataFrame, family: str = "family") -> DataFrame:
    return df.groupBy(family).agg(F.count(F.lit(1)).alias("rows"))


def conversation_parts(turns: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns, context, last_role, last_text) of each conversation: its last message, and those before it as an array of (role, content).

    Turns with equal order stand by role and text. Conversations of one message have an empty context.
    """
    said = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))))
    last = F.element_at("s", -1)
    before = F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda x: F.struct(x["role"], x["content"]))
    return turns.groupBy(key).agg(said.alias("s")).select(key, F.size("s").cast("long").alias("turns"), before.alias("context"), last["role"].alias("last_role"), last["content"].alias("last_text"))
