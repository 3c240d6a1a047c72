"""Reports out of scored answers: rows of each state, details with what was recognised, older names, one JSON document a student."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_name

MAX_MARKS = 10
# What a report says of answers that were not scored.
NOT_ATTEMPTED = "Not attempted."
NO_MODEL = "No model answer available for this question."
NO_ANSWER = "No answer provided. Please attempt the question."
FAILED = "Evaluation error — question skipped."


def with_q(number: Column) -> Column:
    """A question number with a Q before it, unless it begins with q or Q; null as "Q?"."""
    n = F.coalesce(number.cast("string"), F.lit("?"))
    return F.when(F.upper(F.substring(n, 1, 1)) == "Q", n).otherwise(F.concat(F.lit("Q"), n))


def recognised(payload: DataFrame, keys: list[str]) -> DataFrame:
    """keys, question_number (with its Q), question, answer, of recognised answers (question_number, question, student_text)."""
    filled = lambda c: F.coalesce(c, F.lit(""))
    return payload.select(*keys, with_q(F.col("question_number")).alias("question_number"), filled("question").alias("question"), filled("student_text").alias("answer"))


def or_else(own: Column, other: Column, empty) -> Column:
    """`own`, unless it is null or `empty`: then `other`, and `empty` where that is null."""
    return F.when(own.isNotNull() & (own != F.lit(empty)), own).otherwise(F.coalesce(other, F.lit(empty)))


def enriched(details: DataFrame, payload: DataFrame, keys: list[str]) -> DataFrame:
    """`details` (keys, question_number, question, student_answer, ocr_confidence) with what they lack from the recognised
    answers of the same number: keys, question_number, question, student_text, ocr_confidence, and pos, the last of a number counting."""
    by = [*keys, "question_number"]
    last = payload.withColumn("question_number", with_q(F.col("question_number"))).groupBy(*by).agg(F.max_by(F.struct("question", "student_text", "ocr_confidence"), "pos").alias("_o"))
    both = details.join(last, by, "left")
    both = both.withColumn("question", or_else(F.col("question"), F.col("_o.question"), "")).withColumn("student_answer", or_else(F.col("student_answer"), F.col("_o.student_text"), ""))
    sure = or_else(F.col("ocr_confidence").cast("double"), F.col("_o.ocr_confidence").cast("double"), 0.0)
    return both.withColumn("ocr_confidence", F.round(sure, 4)).select(*details.columns)


def renamed(details: DataFrame) -> DataFrame:
    """Older names gone: question_number from qno where it is missing or empty, predicted_marks from marks where that column is missing."""
    has, out = set(details.columns), details
    if "qno" in has or "question_number" in has:
        own = F.col("question_number") if "question_number" in has else F.lit(None).cast("string")
        out = out.withColumn("question_number", or_else(own, F.col("qno") if "qno" in has else F.lit(None).cast("string"), ""))
    if "predicted_marks" not in has:
        out = out.withColumn("predicted_marks", F.coalesce(F.col("marks").cast("double"), F.lit(0.0)) if "marks" in has else F.lit(0.0))
    return out.drop("qno", "marks")


def states(mapped: DataFrame) -> DataFrame:
    """Mapped answers (status, max_marks of the bank's entry or null) without the invalid ones, with state (unattempted, unevaluable
    or evaluated), the max_marks to show, counted_max (what the total takes), and feedback for those that are not scored.

    An unattempted question counts its maximum, MAX_MARKS without an entry; one that has no model answer counts nothing."""
    rows = mapped.where("status != 'invalid'")
    state = F.when(F.col("status") == "unattempted", "unattempted").when(F.col("max_marks").isNull(), "unevaluable").otherwise("evaluated")
    rows = rows.withColumn("state", state).withColumn("max_marks", F.coalesce("max_marks", F.lit(MAX_MARKS)))
    rows = rows.withColumn("counted_max", F.when(F.col("state") == "unevaluable", 0).otherwise(F.col("max_marks")))
    return rows.withColumn("feedback", F.when(F.col("state") == "unattempted", NOT_ATTEMPTED).when(F.col("state") == "unevaluable", NO_MODEL))


def unscored(rows: DataFrame) -> DataFrame:
    """`rows` (status skipped, no_answer or error; max_marks, keyword words, feedback) with the typed columns of a detail that was
    not scored: no marks; a skipped one is out of nothing and keeps its feedback, one without answer misses all keywords."""
    none, s = F.array().cast("array<string>"), F.col("status")
    out = rows.withColumn("max_marks", F.when(s == "skipped", 0).otherwise(F.coalesce("max_marks", F.lit(0))))
    out = out.withColumn("feedback", F.when(s == "no_answer", NO_ANSWER).when(s == "error", FAILED).otherwise(F.col("feedback")))
    out = out.withColumn("missing_keywords", F.when(s == "no_answer", F.col("words")).otherwise(none)).withColumn("matched_keywords", none)
    zeros = {c: F.lit(0.0) for c in ("predicted_marks", "score_out_of_10", "confidence", "ocr_confidence")}
    return out.withColumns({"student_answer": F.lit(""), **zeros}).drop("words")


def reports(details: DataFrame, key: str, order: str, at: str) -> DataFrame:
    """`key`, report (JSON, indented): status, student_id, timestamp (`at`), summary and details of each student, in order.

    details: `key`, `order`, predicted_marks, counted_max, and whatever columns a detail has. One student's details are one array."""
    shown = [c for c in details.columns if c not in (key, order, "counted_max")]
    held = F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*shown).alias("d")))), lambda x: x["d"])
    r = details.groupBy(key).agg(F.round(F.sum("predicted_marks"), 2).alias("total_marks"), F.round(F.sum(F.col("counted_max").cast("double")), 2).alias("max_total_marks"), held.alias("details"))
    share = F.when(F.col("max_total_marks") > 0, F.round(F.col("total_marks") / F.col("max_total_marks") * 100, 2)).otherwise(0.0)
    whole = F.struct(F.lit("success").alias("status"), F.col(key).cast("string").alias("student_id"), F.lit(at).alias("timestamp"), F.struct("total_marks", "max_total_marks", share.alias("percentage")).alias("summary"), "details")
    return r.select(key, F.to_json(whole, {"pretty": "true", "ignoreNullFields": "false"}).alias("report"))


def write_documents(found: DataFrame, key: str, column: str, path: str) -> None:
    """A folder name=<`key`, made safe for a file system> below `path` for each, with `column` in a text file."""
    found.select(F.col(column).alias("value"), safe_name(F.col(key).cast("string")).alias("name")).write.partitionBy("name").option("lineSep", "\n").text(path)


def written_records(rows: DataFrame, path: str) -> None:
    """Records (questions, answers, mapped ones) as JSON lines, a document a row, in as many files as tasks."""
    rows.write.option("ignoreNullFields", "false").json(path)
