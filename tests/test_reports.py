"""Reports, datasets and record files on hand-made cases."""

import json
import re

import pytest
from pyspark.sql import functions as F

from markwright.functions import text
from markwright.operators import reports
from markwright.sources import bank


def put(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_white_space_and_words(spark):
    cases = ["", " ", "a", "  a\t b　c \n", "a\nb", " x\x85\x85 y", "q . a. ", None, "அ  ஆ"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string")
    got = {r.k: r for r in df.select("k", text.collapse(F.col("c")).alias("one"), text.word_count(F.col("c")).alias("n"), text.exact_key(F.col("c")).alias("key")).collect()}
    for k, c in enumerate(cases):
        assert got[k].one == (None if c is None else " ".join(c.split())) and got[k].n == len((c or "").split())
        assert got[k].key == (None if c is None else re.sub(r"[.?!।\s]+$", "", c.strip().lower()))


def test_question_lines_keep_other_spaces(spark):
    df = spark.createDataFrame([("　a \t b\xa0\xa0c ",)], "c string")
    assert df.select(text.clean_question_line(F.col("c"))).first()[0] == "a b\xa0\xa0c"


def test_numbers_get_a_q(spark):
    df = spark.createDataFrame([("1",), ("Q2",), ("q3",), (None,), ("",)], "n string")
    assert [r[0] for r in df.select(reports.with_q(F.col("n"))).collect()] == ["Q1", "Q2", "q3", "Q?", "Q"]


def test_details_take_what_they_lack(spark):
    kind = "s int, question_number string, question string, student_answer string, ocr_confidence double"
    d = spark.createDataFrame([(1, "Q1", "", None, 0.0), (1, "Q2", "own", "mine", 0.9), (1, "Q3", None, "", None)], kind)
    p = spark.createDataFrame([(1, "1", "old", "old", 0.1, 0), (1, "1", "q", "t", 0.123456, 1), (1, "Q2", "x", "y", 0.5, 2)], "s int, question_number string, question string, student_text string, ocr_confidence double, pos int")
    got = {r.question_number: tuple(r)[2:] for r in reports.enriched(d, p, ["s"]).collect()}
    assert got == {"Q1": ("q", "t", 0.1235), "Q2": ("own", "mine", 0.9), "Q3": ("", "", 0.0)}
    assert reports.enriched(d.limit(0), p, ["s"]).collect() == []
    shown = [tuple(r) for r in reports.recognised(p, ["s"]).orderBy("question").collect()]
    assert shown == [(1, "Q1", "old", "old"), (1, "Q1", "q", "t"), (1, "Q2", "x", "y")]


def test_older_names(spark):
    d = spark.createDataFrame([("1", "", 2.5), ("2", "Q2", None)], "qno string, question_number string, marks double")
    out = reports.renamed(d)
    assert sorted(out.columns) == ["predicted_marks", "question_number"]
    assert {(r.question_number, r.predicted_marks) for r in out.collect()} == {("1", 2.5), ("Q2", 0.0)}
    assert reports.renamed(d.withColumn("predicted_marks", F.lit(1.0))).first().predicted_marks == 1.0


def test_states_and_totals(spark):
    m = spark.createDataFrame([("s", 0, "invalid", 5), ("s", 1, "unattempted", 4), ("s", 2, "unattempted", None), ("s", 3, "attempted", None), ("s", 4, "attempted", 6)], "student_id string, pos int, status string, max_marks int")
    rows = reports.states(m)
    got = {r.pos: (r.state, r.max_marks, r.counted_max) for r in rows.collect()}
    assert got == {1: ("unattempted", 4, 4), 2: ("unattempted", 10, 10), 3: ("unevaluable", 10, 0), 4: ("evaluated", 6, 6)}
    scored = rows.withColumn("predicted_marks", F.when(F.col("state") == "evaluated", 5.0).otherwise(0.0))
    r = json.loads(reports.reports(scored, "student_id", "pos", "2026-01-01T00:00:00Z").first().report)
    assert r["summary"] == {"total_marks": 5.0, "max_total_marks": 20.0, "percentage": 25.0} and [x["state"] for x in r["details"]] == ["unattempted", "unattempted", "unevaluable", "evaluated"]


def test_rows_that_are_not_scored(spark):
    d = spark.createDataFrame([("skipped", 5, ["a"], "why"), ("no_answer", 5, ["a", "b"], None), ("error", None, ["a"], None)], "status string, max_marks int, words array<string>, feedback string")
    got = {r.status: r for r in reports.unscored(d).collect()}
    assert (got["skipped"].max_marks, got["skipped"].feedback, got["skipped"].missing_keywords) == (0, "why", [])
    assert (got["no_answer"].max_marks, got["no_answer"].missing_keywords) == (5, ["a", "b"])
    assert (got["error"].max_marks, got["error"].predicted_marks, got["error"].feedback) == (0, 0.0, reports.FAILED)


def test_report_files(spark, tmp_path):
    d = spark.createDataFrame([("a/b", '{\n  "x" : 1\n}')], "student_id string, report string")
    reports.write_documents(d, "student_id", "report", str(tmp_path / "out"))
    (file,) = (tmp_path / "out" / "name=a_b").glob("*.txt")
    assert json.loads(file.read_text()) == {"x": 1}


def test_dataset(spark, tmp_path):
    base = {"question": "q", "model_answer": "m", "keywords": ["k", {"word": "w", "weight": 2}]}
    path = put(tmp_path / "d.json", [{**base, "student_answers": [{"answer": "x", "marks": 9}, {"answer": "y"}]}, {**base, "student_answer": "z", "expected_marks": 3, "max_marks": 5}])
    got = [(r.entry, r.answer_pos, r.answer, r.marks, r.max_marks, [k.word for k in r.keywords]) for r in bank.read_dataset(spark, path).orderBy("entry", "answer_pos").collect()]
    assert got == [(0, 0, "x", 9.0, 10, ["k", "w"]), (0, 1, "y", None, 10, ["k", "w"]), (1, 0, "z", 3.0, 5, ["k", "w"])]
    for bad, what in (({"question": "q"}, "entry 0 lacks keywords, model_answer"), (base, "entry 0 has no answers"), ({**base, "student_answers": [{"marks": 1}]}, "entry 0 has an answer without text")):
        for columns in (["answer"], ["entry", "question"]):  # whatever is read of it
            with pytest.raises(Exception, match=what):
                bank.read_dataset(spark, put(tmp_path / "bad.json", [bad])).select(*columns).collect()


def test_banks_and_records(spark, tmp_path):
    assert bank.bank_or_none(spark, str(tmp_path / "none.json")).collect() == []
    path = put(tmp_path / "b.json", [{"question": "q", "model_answer": "m"}])
    assert bank.bank_or_none(spark, path).first().max_marks == 10
    path = put(tmp_path / "q.json", [{"qno": 1, "question": "why"}, {"question": "how"}])
    assert [tuple(r) for r in bank.read_records(spark, path, "Questions", "question").orderBy("pos").collect()] == [(0, "1", "why"), (1, "", "how")]
    with pytest.raises(ValueError, match="not a JSON array"):
        bank.read_records(spark, put(tmp_path / "o.json", {"a": 1}), "Questions", "question")


def test_mapped_files(spark, tmp_path):
    q = put(tmp_path / "q.json", [{"qno": "1.", "question": "why"}, {"qno": "01", "question": "again"}, {"qno": "2", "question": "how"}])
    a = put(tmp_path / "a.json", [{"qno": "(1)", "answer": "so"}, {"qno": "1", "answer": "and so"}, {"qno": "7", "answer": "stray"}, {"answer": "none"}])
    got = [(r.qno, r.question, r.answer, r.status) for r in bank.read_mapped(spark, q, a).orderBy("side", "pos").collect()]
    assert got == [("1", "why", "so and so", "attempted"), ("2", "how", "", "unattempted"), ("7", "", "stray", "invalid")]
    with pytest.raises(ValueError, match="Answers at"):
        bank.read_mapped(spark, q, put(tmp_path / "no.json", {"qno": 1}))
