"""Eight-line answers: reading the fields out of loose text, writing them in order, and judging an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansmith.functions.normalize import let, mean, rate

# Keys of an answer in order, and the type of its record.
KEYS = ["RecordType", "Antibody", "TargetLineage", "BindingOutcome", "EpitopeDomain", "PDBID", "ResolutionA", "SourceIdentifier"]
RECORD = "AntibodyAntigenEvidence"
_MARK = "\x1e"


def _segments(text: Column) -> Column:
    """array<struct<key, value>> between one key and the next, in order of the text."""
    names = "|".join(KEYS)
    clean = lambda v: F.btrim(F.regexp_replace(F.trim(v), r"\s+", " "), F.lit(" -|"))

    def pairs(parts: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1))), lambda i: i % 2 == 1)
        found = F.transform(at, lambda i: F.struct(F.get(parts, i).alias("key"), clean(F.get(parts, i + 1)).alias("value")))
        return F.filter(found, lambda x: x["key"].isNotNull() & (x["value"] != ""))

    return let(F.split(F.regexp_replace(text, rf"({names})\s*:", f"{_MARK}$1{_MARK}"), _MARK), pairs)


def fields(text: Column) -> Column:
    """map of the first value of each key."""
    return let(_segments(text), lambda found: F.map_from_entries(F.filter(found, lambda x, i: ~F.exists(F.slice(found, F.lit(1), i), lambda y: y["key"] == x["key"]))))


def normalized(text: Column) -> Column:
    """The fields one a line in order; with five others the record's type is supplied. Text without any: itself, trimmed."""

    def written(found: Column) -> Column:
        others = F.size(F.filter(F.map_keys(found), lambda k: k != KEYS[0]))
        kind = F.coalesce(F.try_element_at(found, F.lit(KEYS[0])), F.when(others >= 5, F.lit(RECORD)))
        lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in [(KEYS[0], kind), *((k, F.try_element_at(found, F.lit(k))) for k in KEYS[1:])]]
        return F.when(F.size(found) > 0, F.concat_ws("\n", *lines)).otherwise(F.trim(text))

    return let(fields(text), written)


def lines(text: Column) -> Column:
    """Lines with something on them; one long line is cut before every key."""
    names = "|".join(KEYS)
    cut = F.split(F.regexp_replace(text, rf"({names}):", f"{_MARK}$1:"), _MARK)
    cut = F.when(F.contains(text, F.lit(_MARK)) | ~text.rlike(rf"({names}):"), F.array(text)).otherwise(F.slice(cut, F.lit(2), F.size(cut)))
    found = F.when(F.contains(text, F.lit("\n")), F.split(text, r"\r\n|[\n\r]")).otherwise(cut)
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def judged(text: Column) -> Column:
    """struct(key_hits, exact_8_lines, recordtype_ok, extra_text, compliant)."""

    def of(said: Column, pairs: Column) -> Column:
        last = lambda k: F.get(F.reverse(F.filter(pairs, lambda x: x["key"] == k)), F.lit(0))["value"]
        hits = F.size(F.array_intersect(F.transform(pairs, lambda x: x["key"]), F.array(*map(F.lit, KEYS))))
        exact, kind = F.size(said) == len(KEYS), F.coalesce(last(KEYS[0]) == RECORD, F.lit(False))
        extra = F.exists(said, lambda x: ~F.contains(x, F.lit(":"))).cast("int")
        found = F.struct(hits.alias("key_hits"), exact.alias("exact_8_lines"), kind.alias("recordtype_ok"), extra.alias("extra_text"))
        return let(found, lambda j: j.withField("compliant", j["exact_8_lines"] & (j["key_hits"] == len(KEYS)) & j["recordtype_ok"] & (j["extra_text"] == 0)))

    key, value = lambda x: F.trim(F.substring_index(x, ":", 1)), lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
    pairs = lambda said: F.transform(F.filter(said, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    return let(let(text, lines), lambda said: let(pairs(said), lambda found: of(said, found)))


def compliance_totals(answers: DataFrame, text: str) -> DataFrame:
    """(rows, mean_key_hits, exact_8_lines_rate, recordtype_ok_rate, extra_text_rows, compliant_rows, compliance_rate) of a table of answers."""
    j = answers.select(judged(F.col(text)).alias("j")).select("j.*")
    return j.agg(
        F.count(F.lit(1)).alias("rows"), mean(F.col("key_hits")).alias("mean_key_hits"), rate(F.col("exact_8_lines")).alias("exact_8_lines_rate"), rate(F.col("recordtype_ok")).alias("recordtype_ok_rate"),
        F.coalesce(F.sum("extra_text"), F.lit(0)).cast("long").alias("extra_text_rows"), F.count_if("compliant").alias("compliant_rows"), rate(F.col("compliant")).alias("compliance_rate"),
    )
