"""Sources as DataFrames with explicit schemas; nothing is inferred in production paths but where a caller asks for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.common import require_none

ITEM = "question string, gold_answer string, category string, sub_category string, answer_type string, difficulty int, is_correct boolean, unique_key string"


def records(spark: SparkSession, path: str, schema: str | StructType, envelopes: tuple[str, ...] = ("questions", "data", "records", "items")) -> DataFrame:
    """Rows of JSON files that hold an array, an object, an array in an array, an object with the rows under one of
    ``envelopes``, or an object a line. Lines that aren't objects are skipped."""
    raw = spark.read.text(path, wholetext=True)
    row = f"struct<{schema}>" if isinstance(schema, str) else schema.simpleString()
    whole = F.trim("value")
    lists = F.from_json(whole, f"array<{row}>")
    nested = F.flatten(F.from_json(whole, f"array<array<{row}>>"))
    boxed = F.coalesce(*[F.from_json(F.get_json_object(whole, f"$.{e}"), f"array<{row}>") for e in envelopes])
    lines = F.filter(F.transform(F.filter(F.split(whole, "\n"), lambda x: F.trim(x).startswith("{")), lambda x: F.from_json(x, row)), lambda x: x.isNotNull())
    many = F.when(whole.rlike(r"^\[\s*\["), nested).when(whole.startswith("["), lists).otherwise(F.coalesce(boxed, lines))
    single = F.array(F.from_json(whole, row))
    one_object = whole.startswith("{") & boxed.isNull() & (F.size(F.filter(F.split(whole, "\n"), lambda x: F.trim(x).rlike(r"^\{.*\}$"))) == 0)
    return raw.select(F.explode(F.when(one_object, single).otherwise(many)).alias("r")).where("r IS NOT NULL").select("r.*")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """An object a line; malformed lines are dropped, or with ``strict`` an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def with_corrupt(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and the raw text of malformed lines."""
    x = spark.read.schema(f"{schema}, _corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").cache()
    return x.where("_corrupt IS NULL").drop("_corrupt"), x.where("_corrupt IS NOT NULL").select("_corrupt")


def csv_by_id(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV with header; an empty or repeated id is an error."""
    x = spark.read.csv(path, header=True)
    x = x.withColumnsRenamed({c: c.lstrip("﻿") for c in x.columns if c.startswith("﻿")})
    require_none(x.where(F.trim(F.coalesce(F.col(key), F.lit(""))) == ""), "rows without id")
    require_none(x.groupBy(key).count().where("count > 1"), "repeated ids")
    return x


def question_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON rows with a question, their names unified."""
    x = records(spark, path, "question string, problem string, gold_answer string, answer string, category string, sub_category string, subcat string")
    return x.select(F.trim(F.coalesce("question", "problem")).alias("question"), F.coalesce("gold_answer", "answer").alias("gold_answer"), "category", F.coalesce("sub_category", "subcat").alias("sub_category")).where("question <> ''")


def last_marked(answer: Column) -> Column:
    """The answer after the last ####, without commas; null without the mark."""
    return F.when(F.contains(answer, F.lit("####")), F.replace(F.trim(F.substring_index(answer, "####", -1)), F.lit(","), F.lit("")))


def last_boxed(solution: Column) -> Column:
    """The content of the last \\boxed{}, braces balanced; null if there is none."""
    tail = F.substring_index(solution, "\\boxed{", -1)
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        depth = F.when(s["depth"] == 0, 0).when(c == "{", s["depth"] + 1).when(c == "}", s["depth"] - 1).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.when(depth > 0, F.concat(s["out"], c)).otherwise(s["out"]).alias("out"))

    found = F.aggregate(F.split(tail, ""), start, step)
    return F.when(F.contains(solution, F.lit("\\boxed{")) & (found["depth"] == 0), F.trim(found["out"]))


def word_problems(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of question and worked answer."""
    x = json_lines(spark, path, "question string, answer string")
    return x.select("question", last_marked(F.col("answer")).alias("gold_answer"), F.lit("gsm8k_jsonl").alias("source_type"), F.lit("gsm8k").alias("source"), F.lit(None).cast("int").alias("level"))


def competition(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file: problem, solution, level, type."""
    x = spark.read.schema("problem string, solution string, level string, type string").json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    level = F.regexp_extract("level", r"(\d+)", 1).try_cast("int") * 2
    return x.select(F.col("problem").alias("question"), last_boxed(F.col("solution")).alias("gold_answer"), F.lit("hendrycks_math_json").alias("source_type"), F.col("type").alias("source"), level.alias("level"))


def multiple_choice(spark: SparkSession, path: str, subjects: list[str] | None = None) -> DataFrame:
    """Headerless CSV of question, four choices and a letter; the subject is in the file name."""
    schema = "question string, a string, b string, c string, d string, answer string"
    x = spark.read.schema(schema).csv(path, recursiveFileLookup=True, pathGlobFilter="*.csv", quote='"', escape='"')
    subject = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1), "_(test|dev|val)$", "")
    x = x.withColumn("source", subject).where(F.col("answer").isin("A", "B", "C", "D"))
    if subjects:
        x = x.where(F.col("source").isin(*subjects))
    text = F.concat_ws("\n", "question", *[F.concat(F.lit(f"{k.upper()}. "), F.coalesce(F.col(k), F.lit(""))) for k in "abcd"])
    return x.select(text.alias("question"), F.col("answer").alias("gold_answer"), F.lit("mmlu_csv").alias("source_type"), "source", F.lit(None).cast("int").alias("level"))


def alternating(spark: SparkSession, path: str) -> DataFrame:
    """Text files of question and answer lines in turn; an odd number of lines is an error."""
    x = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").withColumn("file", F.col("_metadata.file_path"))
    x = x.withColumn("lines", F.filter(F.split("value", "\r?\n"), lambda l: F.trim(l) != ""))
    require_none(x.where(F.size("lines") % 2 == 1).select("file"), "files with an odd number of lines")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("lines") / 2).cast("int") - 1), lambda i: F.struct(F.trim(F.get("lines", i * 2)).alias("question"), F.trim(F.get("lines", i * 2 + 1)).alias("gold_answer")))
    out = x.where(F.size("lines") > 0).select(F.regexp_extract("file", r"([^/]+)\.txt$", 1).alias("source"), F.explode(pairs).alias("p"))
    return out.select("p.question", "p.gold_answer", F.lit("deepmind_text").alias("source_type"), "source", F.lit(None).cast("int").alias("level"))


ADAPTERS = {"gsm8k_jsonl": word_problems, "hendrycks_math_json": competition, "mmlu_csv": multiple_choice, "deepmind_text": alternating}


def imported(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """Candidates of all (adapter, path) sources: classified, hashed, first of equal texts; rows without a gold answer are
    left out."""
    from ..functions import answers as A
    from ..functions import difficulty as D
    from ..functions import taxonomy as X
    from ..functions import text as T

    x = None
    for name, path in sources:
        part = ADAPTERS[name](spark, path)
        x = part if x is None else x.unionByName(part)
    x = x.where((F.trim("question") != "") & (F.trim(F.coalesce("gold_answer", F.lit(""))) != ""))
    x = x.withColumn("c", X.classify_import(F.col("question"), F.col("source"), F.col("source_type")))
    x = x.select("question", "gold_answer", "source_type", "source", "c.category", "c.sub_category", F.col("c.rule").alias("taxonomy_rule"), A.inferred_type(F.col("gold_answer")).alias("answer_type"), F.coalesce("level", D.operation_difficulty(F.col("question"), F.lit(3))).alias("difficulty"), T.normalized(F.col("question")).alias("norm"))
    x = x.withColumn("candidate_id", F.sha2(F.concat_ws("|", "source_type", "norm"), 256)).withColumn("template_signature", T.template(F.col("question")))
    return x.withColumn("_n", F.row_number().over(W.partitionBy("norm").orderBy("candidate_id", "gold_answer"))).where("_n = 1").drop("_n", "norm")


def alpaca(spark: SparkSession, path: str) -> DataFrame:
    """Instruction rows of exactly three fields; empty instructions or outputs and ideographs are errors."""
    x = spark.read.schema("instruction string, input string, output string, _extra string").json(path, mode="FAILFAST").drop("_extra")
    x = x.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("instruction", "input", "output")])
    require_none(x.where((F.col("instruction") == "") | (F.col("output") == "")), "empty rows")
    require_none(x.where(F.concat("instruction", "input", "output").rlike("[\\u3400-\\u9fff]")), "ideographs")
    return x


def fixed_set(items: DataFrame, taxonomy: DataFrame, expected: int | None = None) -> DataFrame:
    """A checked evaluation set: unique ids and texts, known groups, an answer each, the expected number."""
    require_none(items.groupBy("question_id").count().where("count > 1"), "repeated ids")
    require_none(items.groupBy(F.lower(F.trim("question")).alias("question")).count().where("count > 1"), "repeated questions")
    require_none(items.join(taxonomy, ["category", "sub_category"], "left_anti").select("question_id"), "unknown groups")
    require_none(items.where(F.trim(F.coalesce("gold_answer", F.lit(""))) == "").select("question_id"), "items without answer")
    if expected is not None and (n := items.count()) != expected:
        raise ValueError(f"{n} items, {expected} expected")
    return items


def stage_cycle(stage: Column) -> Column:
    """0 of baseline, N of cycle_N, else -1."""
    return F.when(stage == "baseline", 0).otherwise(F.coalesce(F.regexp_extract(stage, r"^cycle_(\d+)$", 1).try_cast("int"), F.lit(-1)))


def results_long(spark: SparkSession, root: str, registry: DataFrame, schema: str) -> DataFrame:
    """Item results under ``root/<study_id>/<stage>/*.json`` of completed studies, stage turned into a cycle; other stages
    are left out."""
    x = spark.read.schema(schema).json(root, recursiveFileLookup=True, pathGlobFilter="*.json", multiLine=True)
    at = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)/[^/]+$", 1), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)/[^/]+$", 2)
    x = x.withColumns({"study_id": at[0], "cycle": stage_cycle(at[1])}).where("cycle >= 0")
    return x.join(registry.where("status = 'completed'"), "study_id")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, size, kind) of every file but temporary ones."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.when(name.rlike(r"\.(json|jsonl)$"), "json").when(name.rlike(r"\.csv$"), "table").when(name.rlike(r"\.(yaml|yml)$"), "config").when(name.rlike(r"\.(md|txt|log)$"), "text").otherwise("other")
    return x.where(~name.rlike(r"(\.tmp$|^\.|~$)")).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), kind.alias("kind"))


def tree_fingerprint(files: DataFrame, root: str) -> DataFrame:
    """One row: the hash of the sorted paths below ``root``, hashes and sizes."""
    rows = files.select(F.struct(F.replace("path", F.lit(root), F.lit("")).alias("path"), "sha256", "size").alias("f"))
    return rows.agg(F.sha2(F.to_json(F.array_sort(F.collect_list("f"))), 256).alias("fingerprint"))


def legacy_cache(inferences: DataFrame, judgments: DataFrame) -> DataFrame:
    """Old flat caches: judgments met by trimmed question text, the last judgment of a text."""
    j = judgments.groupBy(F.trim("question").alias("_q")).agg(F.max("is_correct").alias("is_correct"))
    return inferences.withColumn("_q", F.trim("question")).join(j, "_q", "left").drop("_q")


def static_items(spark: SparkSession, taxonomy: DataFrame, per_group: int = 20) -> DataFrame:
    """A synthetic set: ``per_group`` sums a group with their answers."""
    x = taxonomy.select("category", "sub_category").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(per_group))))
    a, b = F.col("i") * 7 + F.length("sub_category"), F.col("i") * 3 + F.length("category")
    return x.select(F.sha2(F.concat_ws("|", "sub_category", F.col("i").cast("string")), 256).alias("question_id"), "category", "sub_category", F.concat(F.lit("Compute "), a.cast("string"), F.lit(" + "), b.cast("string"), F.lit(".")).alias("question"), (a + b).cast("string").alias("gold_answer"), (F.col("i") % 6 + 1).cast("int").alias("difficulty"))


def call_model(prompts: DataFrame, make_client, schema: str, batch: int = 32) -> DataFrame:
    """The boundary to an external model: ``make_client()`` gives, once a task, a function from a list of prompts to a list
    of rows. Prompts go in batches; what the client raises fails the task, which Spark repeats."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(it):
        import pandas as pd

        client = make_client()
        for x in it:
            for at in range(0, len(x), batch):
                part = x.iloc[at : at + batch]
                yield pd.DataFrame(client(part["prompt"].tolist()), columns=names)

    return prompts.mapInPandas(run, schema)
