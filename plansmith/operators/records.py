"""Supervised rows from structured records and multiple-choice questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansmith.functions.short_schema import KEYS, RECORD
from plansmith.operators.datasets import head_and_rest, wrong_choice

# Names of a record's fields, the source column of each, and the label of the full input.
FIELDS = {
    "file_name": ("File_Name", "File_Name"), "antibody": ("Proteins_canonical_name", "Antibody"), "lineage": ("Targets_gene_name", "Target lineage"), "host": ("Targets_species_name", "Host species"),
    "assay": ("Structural_Info_method", "Assay"), "outcome": ("target_value", "Binding outcome"), "domain": ("epitope_domain", "Epitope domain"), "pdb_id": ("pdb_id", "PDB ID"),
    "resolution": ("PDB_Resolution_A", "Resolution (A)"), "mutations": ("mutations", "Mutations"), "residues": ("epitope_residues", "Epitope residues"), "title": ("Sources_title", "Source title"),
    "source_id": ("Sources_identifier", "Source identifier"), "date": ("Sources_publication_date", "Source publication date"), "summary": ("Proteins_description", "Summary"),
}
# Fields of the full answer behind its type, in order.
FULL = {
    "Antibody": "antibody", "TargetLineage": "lineage", "BindingOutcome": "outcome", "EpitopeDomain": "domain", "PDBID": "pdb_id", "ResolutionA": "resolution", "HostSpecies": "host", "Assay": "assay",
    "KeyMutations": "mutations", "EpitopeResidues": "residues", "SourceTitle": "title", "SourceIdentifier": "source_id", "SourceDate": "date", "Summary": "summary",
}
SHORT = {k: FULL[k] for k in KEYS[1:]}
# Prompts around a record; {dataset} and {schema} are names to fill in.
FULL_PROMPTS = [
    "Convert the following antibody-antigen record into the standard evidence card format.\n\n{record}",
    "Normalize this {dataset} record into a compact structured summary. Keep every field on its own line.\n\n{record}",
    "Turn this record into an evidence-focused note for a protein binding knowledge base.\n\n{record}",
    "Read the structured record below and rewrite it as a standard antibody-antigen evidence card.\n\n{record}",
    "Prepare a comparison-ready structured summary from the following {dataset} entry.\n\n{record}",
    "Summarize the following antibody record into the {schema} structured note schema.\n\n{record}",
    "Create a compact, machine-readable evidence card from this {dataset} example.\n\n{record}",
    "Rewrite this antibody-lineage binding entry into the standard fields used for structured analysis.\n\n{record}",
]
SHORT_PROMPTS = [
    "Rewrite the following record into the exact 8-line schema shown below. Output only the schema lines.\n\n{record}",
    "Normalize this antibody-antigen record into the fixed 8-line schema. Do not add any explanation.\n\n{record}",
    "Convert the record below into the exact schema with these keys only: {keys}.\n\n{record}",
    "Read the following entry and output only the normalized 8-line evidence schema.\n\n{record}",
    "Transform this {dataset} example into the fixed schema. Keep each key on its own line and do not add extra text.\n\n{record}",
    "Produce the canonical short evidence card from the fields below. Output only the 8 required lines.\n\n{record}",
    "Standardize the following record into the short {schema} schema with no commentary.\n\n{record}",
    "Map this entry to the exact 8-field schema. Preserve values faithfully and output nothing else.\n\n{record}",
    "Return only the normalized short schema for the record below.\n\n{record}",
    "Format the following antibody-lineage entry using the strict 8-line schema and no additional prose.\n\n{record}",
]
STRICT_PROMPTS = [
    "Output exactly 8 lines. Do not add any explanation. The first line must be `RecordType: AntibodyAntigenEvidence`.\nUse this exact schema and replace only the values:\n{form}\n\nInput:\n{record}",
    "Rewrite the input into the exact 8-line schema below. Keep one field per line. Do not add any extra words.\n\n{form}\n\nInput:\n{record}",
    "Return only the normalized schema. The answer must contain exactly these 8 keys in this order and nothing else:\n{form}\n\nInput:\n{record}",
    "Format the input as the strict 8-line schema. First line must be `RecordType: AntibodyAntigenEvidence`. No prose, no bullets, no commentary.\n\n{form}\n\nInput:\n{record}",
    "Convert the input to the fixed evidence schema. Output 8 lines exactly, preserve the field order, and do not explain.\n\n{form}\n\nInput:\n{record}",
]
FORM = "\n".join([f"{KEYS[0]}: {RECORD}", *(f"{k}: <value>" for k in KEYS[1:])])


def cleaned(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("NA"))


def record(df: DataFrame) -> Column:
    """The fields of a row; what is null, blank or not there is NA."""
    return F.struct(*((cleaned(F.col(f"`{source}`")) if source in df.columns else F.lit("NA")).alias(n) for n, (source, _) in FIELDS.items()))


def _lines(pairs: dict[str, Column]) -> Column:
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), c) for k, c in pairs.items()))


def full_input(r: Column) -> Column:
    return _lines({label: r[n] for n, (_, label) in FIELDS.items()})


def full_output(r: Column) -> Column:
    said = F.concat(
        r["antibody"], F.lit(" is reported against lineage "), r["lineage"], F.lit(" with epitope domain "), r["domain"], F.lit("; representative structure "), r["pdb_id"], F.lit(" has resolution "),
        r["resolution"], F.lit(" A and source identifier "), r["source_id"], F.lit("."),
    )
    return _lines({KEYS[0]: F.lit(RECORD), **{k: r[n] for k, n in FULL.items()}, "Interpretation": said})


def short_input(r: Column) -> Column:
    return _lines({k: r[n] for k, n in SHORT.items()})


def short_output(r: Column) -> Column:
    return _lines({KEYS[0]: F.lit(RECORD), **{k: r[n] for k, n in SHORT.items()}})


def exchange(user: Column, assistant: Column) -> Column:
    """array of a user's and an assistant's message, both trimmed."""
    return F.array(*(F.struct(F.lit(who).alias("role"), F.trim(text).alias("content")) for who, text in (("user", user), ("assistant", assistant))))


def _prompts(templates: list[str], names: dict[str, str], text: Column) -> Column:
    filled = [t.replace("{keys}", ", ".join(KEYS)).replace("{form}", FORM) for t in templates]
    for k, v in names.items():
        filled = [t.replace(f"{{{k}}}", v) for t in filled]
    return F.array(*(F.concat(F.lit(t.partition("{record}")[0]), text, F.lit(t.partition("{record}")[2])) for t in filled))


def schema_rows(df: DataFrame, kind: str = "full", key: str = "_pos", dev: int = 6, names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """train and dev: (conversations) of every prompt of kind full, short or strict around every record; eval: (id, prompt) of the dev records.

    The first dev records in order of antibody, lineage, structure, source and the unique key are the dev part.
    """
    templates = {"full": FULL_PROMPTS, "short": SHORT_PROMPTS, "strict": STRICT_PROMPTS}[kind]
    names = {"dataset": "antibody", "schema": "evidence"} | (names or {})
    order = [F.col(c).asc_nulls_last() for c in ("Proteins_canonical_name", "Targets_gene_name", "pdb_id", "Sources_identifier", key)]
    head, rest = head_and_rest(df, order, key, dev)
    read, write = (full_input, full_output) if kind == "full" else (short_input, short_output)

    def each(part: DataFrame) -> DataFrame:
        rows = part.select(record(df).alias("r"))
        return rows.select(F.explode(_prompts(templates, names, read(F.col("r")))).alias("p"), write(F.col("r")).alias("a")).select(exchange(F.col("p"), F.col("a")).alias("conversations"))

    asked = head.select(F.concat(F.lit(f"{kind}_"), F.col(key)).alias("id"), _prompts(templates, names, read(record(df)))[0].alias("prompt"))
    return {"train": each(rest), "dev": each(head), "eval": asked}


def interaction_seeds(df: DataFrame) -> DataFrame:
    """(conversations): two questions about every protein pair with an answer in GT_answer."""
    c = {n: F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in ("Proteins_canonical_name", "Targets_gene_name", "Proteins_description", "GT_answer", "Sources_identifier", "Sources_title")}
    a, b, text, answer, source, title = c.values()
    one = F.concat(F.lit("Based on the following protein interaction abstract, summarize what is reported about the interaction between "), a, F.lit(" and "), b, F.lit(".\n\nAbstract: "), text)
    two = F.concat(
        F.lit("Read the following protein interaction record and provide a concise evidence-backed summary. Also mention the source identifier.\n\nProtein A: "), a, F.lit("\nProtein B: "), b,
        F.lit("\nSource: "), title, F.lit("\nIdentifier: "), source, F.lit("\nAbstract: "), text,
    )
    both = F.array(exchange(one, answer), exchange(two, F.concat(answer, F.lit("\n\nSource identifier: "), source)))
    return df.filter((a != "") & (b != "") & (answer != "")).select(F.explode(both).alias("conversations"))


def record_seeds(df: DataFrame, key: str = "_pos", more: int = 25) -> DataFrame:
    """(conversations): a compact note of every record, and a comparison-style summary of the rows whose ordinal key is below more."""
    r = {n: F.coalesce(F.trim(F.col(s).cast("string")), F.lit("")) if s in df.columns else F.lit("") for n, (s, _) in FIELDS.items()}
    note = _lines({"Antibody": r["antibody"], "Target lineage": r["lineage"], "Epitope domain": r["domain"], "PDB ID": r["pdb_id"], "Resolution": r["resolution"], "Source identifier": r["source_id"], "Host": r["host"], "Summary": r["summary"]})
    first = exchange(F.concat(F.lit("Summarize the following structured antibody-antigen record into a compact evidence note.\n\n"), note, F.lit("\nEpitope residues: "), r["residues"]), note)
    brief = _lines({"Antibody": r["antibody"], "Lineage": r["lineage"], "Domain": r["domain"], "PDB": r["pdb_id"], "Resolution": r["resolution"], "Source": r["source_id"]})
    told = F.concat(
        r["antibody"], F.lit(" targets lineage "), r["lineage"], F.lit(" through the "), r["domain"], F.lit(" domain. The representative structure is "), r["pdb_id"], F.lit(" with resolution "), r["resolution"],
        F.lit(". Source identifier: "), r["source_id"], F.lit("."),
    )
    second = exchange(F.concat(F.lit("Turn the following structured biological record into a short comparison-style summary with the key fields only.\n\n"), brief), told)
    return df.select(F.explode(F.when(F.col(key) < more, F.array(first, second)).otherwise(F.array(first))).alias("conversations"))


# ---- multiple choice ----


def question_text(q: Column, answered: bool = False) -> Column:
    """A question struct (question, A, B, C, D, answer) as text, with its answer or a gap for it."""
    said = F.concat(F.lit("答案："), F.upper(F.trim(F.coalesce(q["answer"], F.lit(""))))) if answered else F.lit("答案：")
    lines = F.concat_ws("\n", q["question"], *(F.concat(F.lit(f"{x}. "), q[x]) for x in "ABCD"), said)
    return F.concat(lines, F.lit("\n")) if answered else lines


def choice_prompt(q: Column, subject: Column, shots: Column | None = None) -> Column:
    """An introduction, the shots with their answers, the question without."""
    head = F.concat(F.lit("以下是中国关于"), subject, F.lit("考试的单项选择题，请选出其中的正确答案。"))
    before = F.array(head) if shots is None else F.concat(F.array(head), F.transform(shots, lambda s: question_text(s, True)))
    return F.array_join(F.array_append(before, question_text(q)), "\n\n")


def with_shots(questions: DataFrame, examples: DataFrame, n: int, order: str = "id") -> DataFrame:
    """questions with an array shots of the first n examples of their subject."""
    fields = ["question", "A", "B", "C", "D", "answer"]
    ranked = F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("q"))))
    few = examples.groupBy("subject").agg(F.transform(F.slice(ranked, 1, n), lambda x: x["q"]).alias("shots"))
    return questions.join(few, "subject", "left")


def choice_pairs(rows: DataFrame, subject_name: Column | None = None) -> DataFrame:
    """(id, subject, chosen, rejected, preference_source) of questions with a subject: the right letter against the next."""
    q = F.struct("question", "A", "B", "C", "D", "answer")
    name = F.col("subject") if subject_name is None else subject_name
    asked = F.concat(F.lit("以下是中国关于"), name, F.lit("考试的单项选择题。请只输出正确选项字母。\n\n"), question_text(q))
    right = F.upper(F.trim("answer"))
    user = F.struct(F.lit("user").alias("role"), asked.alias("content"))
    said = lambda c: F.array(user, F.struct(F.lit("assistant").alias("role"), c.alias("content")))
    return rows.select(
        F.concat_ws("_dev_", "subject", F.col("id").cast("string")).alias("id"), "subject", said(right).alias("chosen"), said(wrong_choice(right)).alias("rejected"),
        F.lit("correct_option_vs_next_option").alias("preference_source"),
    )


def scored_choices(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """rows (id, answer, ...) with prediction (empty where there is none) and correct."""
    said = predictions.select(F.col("id").cast("string").alias("_id"), F.col("prediction").alias("_said"))
    out = rows.join(said, rows["id"].cast("string") == F.col("_id"), "left").withColumn("prediction", F.coalesce("_said", F.lit("")))
    return out.withColumn("correct", F.col("prediction").eqNullSafe(F.col("answer"))).drop("_id", "_said")


# ---- supervised spans ----


def answer_mask(ids: Column, begin: list[int], end: list[int], longest: int) -> Column:
    """1 where ids lie behind a begin run, up to and with the next end run (or the last id), and before position longest."""
    b, e = len(begin), len(end)

    def step(acc: Column, i: Column) -> Column:
        """inside counts ids still to mark: -1 until an end run is met. wait: ids of a begin run still to pass."""
        starts = F.slice(ids, i + 1, F.lit(b)) == F.array(*map(F.lit, begin))
        ends = F.slice(ids, i + 1, F.lit(e)) == F.array(*map(F.lit, end))
        free = (acc["inside"] == 0) & (acc["wait"] == 0)
        inside = F.when(free, 0).when(acc["wait"] > 0, 0).when(acc["inside"] == -1, F.when(ends, e).otherwise(-1)).otherwise(acc["inside"])
        mark = F.when((inside != 0) & (i < longest), 1).otherwise(0)
        wait = F.when(free & starts, b - 1).when(acc["wait"] > 0, acc["wait"] - 1).otherwise(0)
        opened = (free & starts & (F.lit(b) == 1)) | (acc["wait"] == 1)
        left = F.when(opened, -1).when(inside > 0, inside - 1).otherwise(inside)
        return F.struct(left.cast("int").alias("inside"), wait.cast("int").alias("wait"), F.array_append(acc["mask"], mark.cast("int")).alias("mask"))

    start = F.struct(F.lit(0).alias("inside"), F.lit(0).alias("wait"), F.array().cast("array<int>").alias("mask"))
    positions = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(positions, start, step)["mask"]
