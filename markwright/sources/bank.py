"""Question banks and OCR text as DataFrames, and reports as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields that every entry of a dataset has.
REQUIRED = ("question", "model_answer", "keywords")


def read_bank(spark: SparkSession, path: str | None) -> DataFrame:
    """bank_pos, question, model_answer, keywords (array of word, weight), concepts, max_marks of a JSON array per file.

    Keywords are strings (weight 1) or objects (weight 0.01 at least); other forms are dropped. Missing fields get defaults."""
    return _entries(spark, path).select("bank_pos", *_bank_columns())


def _entries(spark: SparkSession, path: str | None) -> DataFrame:
    """bank_pos, v: the elements of the JSON array in each file; none without a path."""
    text = spark.read.text(path, wholetext=True) if path is not None else spark.createDataFrame([], "value string")
    whole = text.select(F.parse_json("value").alias("v"))
    return spark.sql("SELECT e.pos AS bank_pos, e.value AS v FROM {whole} AS w, LATERAL variant_explode(w.v) AS e", whole=whole)


def _object(c) -> Column:
    return F.try_variant_get(c, "$", "map<string,variant>")


def _bank_columns() -> list[Column]:
    """Of an entry in the column v."""
    get = lambda p, kind: F.try_variant_get("v", p, kind)
    loose = F.coalesce(get("$.keywords", "array<variant>"), F.array().cast("array<variant>"))
    word = lambda x: F.trim(F.coalesce(F.try_variant_get(x, "$.word", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))))
    keywords = F.filter(F.transform(loose, lambda x: F.struct(word(x).alias("word"), F.greatest(F.lit(0.01), F.coalesce(F.try_variant_get(x, "$.weight", "double"), F.lit(1.0))).alias("weight"))), lambda x: x["word"].isNotNull())
    return [
        F.coalesce(get("$.question", "string"), F.lit("")).alias("question"), F.coalesce(get("$.model_answer", "string"), F.lit("")).alias("model_answer"),
        keywords.alias("keywords"), F.coalesce(get("$.concepts", "array<array<string>>"), F.array().cast("array<array<string>>")).alias("concepts"), F.coalesce(get("$.max_marks", "int"), F.lit(10)).alias("max_marks"),
    ]


def bank_or_none(spark: SparkSession, path: str) -> DataFrame:
    """`read_bank`, or a bank without entries if nothing is at `path`."""
    try:
        return read_bank(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return read_bank(spark, None)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """entry, question, model_answer, keywords, concepts, max_marks, answer_pos, answer, marks: a row for each student's answer of
    a dataset, a JSON array a file. An older entry has one answer with its expected marks. An entry that lacks a required
    field, has no answers' field, or an answer without its text, fails the query that reads it, with an error that names it: the check
    is part of the plan, so the files are read once, and answers can't be read without it."""
    v = _entries(spark, path)
    lacking = missing_fields(F.map_keys(_object("v")), REQUIRED)
    both = lambda p, kind: F.try_variant_get("v", p, kind)
    answers = both("$.student_answers", "array<variant>")
    older = F.array_contains(F.map_keys(_object("v")), "student_answer")
    rows = v.select("*", lacking.alias("lacking"), answers.alias("answers"), older.alias("older"))
    rows = rows.withColumn("wrong", F.when(F.size("lacking") > 0, F.concat(F.lit("lacks "), F.array_join("lacking", ", "))).when(F.col("answers").isNull() & ~F.col("older"), "has no answers").when(F.exists("answers", lambda a: ~F.array_contains(F.map_keys(F.try_variant_get(a, "$", "map<string,variant>")), "answer")), "has an answer without text"))
    one = lambda text, marks: F.struct(text.alias("answer"), marks.alias("marks"))
    given = F.transform("answers", lambda a: one(F.try_variant_get(a, "$.answer", "string"), F.try_variant_get(a, "$.marks", "double")))
    given = F.coalesce(given, F.array(one(both("$.student_answer", "string"), both("$.expected_marks", "double"))))
    error = F.raise_error(F.concat(F.lit("entry "), F.col("bank_pos").cast("string"), F.lit(" "), F.col("wrong")))
    given = F.when(F.col("wrong").isNotNull(), error.cast("array<struct<answer: string, marks: double>>")).otherwise(given)
    rows = rows.select(F.col("bank_pos").alias("entry"), *_bank_columns(), given.alias("given"))
    return rows.select("*", F.posexplode("given").alias("answer_pos", "a")).select("*", "a.answer", "a.marks").drop("given", "a")


def missing_fields(names: Column, required: tuple[str, ...]) -> Column:
    """Of the required field names those that are not among `names`, in order."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), names))


def read_records(spark: SparkSession, path: str, label: str, text: str) -> DataFrame:
    """pos, qno and the text field named `text` of a JSON array of records; anything but an array is a ValueError."""
    found = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    if not found.where(F.schema_of_variant("v").startswith("ARRAY")).count():
        raise ValueError(f"{label} at {path} are not a JSON array")
    get = lambda p: F.coalesce(F.try_variant_get("v", p, "string"), F.lit(""))
    return _entries(spark, path).select(F.col("bank_pos").alias("pos"), get("$.qno").alias("qno"), get(f"$.{text}").alias(text))


def read_mapped(spark: SparkSession, questions: str, answers: str) -> DataFrame:
    """qno, question, answer, status, side, pos: two files, of questions and of answers (JSON arrays of records with qno), matched by
    number as `records.mapped` does; in the order of side and pos questions come first, then answers without one."""
    from ..operators.records import mapped

    one = lambda path, label, text: read_records(spark, path, label, text).withColumn("_sheet", F.lit(0))
    return mapped(one(questions, "Questions", "question"), one(answers, "Answers", "answer"), "_sheet").drop("_sheet")


def checked_bank(bank: DataFrame) -> DataFrame:
    """The bank, if no entry lacks its question or model answer."""
    if bad := bank.where("question = '' OR model_answer = ''").count():
        raise ValueError(f"{bad} entries of the bank have no question or no model answer")
    return bank


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """sheet_id (file name without its ending), full_text, word_count, of files of recognised text; one row a file."""
    from ..functions.text import word_count

    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("sheet_id"), F.col("value").alias("full_text"), word_count(F.col("value")).alias("word_count"))


def write_reports(reports: DataFrame, path: str, by: str = "student_id") -> None:
    reports.write.partitionBy(by).json(path)
