"""No null gives marks: each sub-score missing, in the batch and the stream's functions."""

import pytest
from pyspark.sql import functions as F

from markwright.functions import scoring
from markwright.operators import evaluate
from markwright.streaming import grade

PARTS = ["semantic", "keyword", "concept", "contradiction"]


@pytest.mark.parametrize("missing", PARTS)
def test_stream_scores(spark, missing):
    row = {"answer": "one two three four five", "max_marks": 5, "semantic": 8.0, "keyword": 8.0, "concept": 8.0, "contradiction": 0.0} | {missing: None}
    r = grade.scored(spark.createDataFrame([tuple(row.values())], "answer string, max_marks int, " + ", ".join(f"{p} double" for p in PARTS))).first()
    assert (r.raw_score, r.marks, r.rounded_score) == (None, None, None)


def whole(spark, similarity, answer="one two three four five"):
    df = spark.createDataFrame([(answer, "one two three", similarity, [("three", 1.0)], [["one"]], 5)], "answer string, model_answer string, similarity double, keywords array<struct<word string, weight double>>, concepts array<array<string>>, max_marks int")
    return evaluate.final(df).first()


def test_whole_evaluation(spark):
    r = whole(spark, None)
    assert (r.semantic_score, r.confidence, r.raw_score, r.final_marks, r.final_score, r.rounded_score) == (None,) * 6
    assert r.feedback == ["The answer could not be evaluated."] and not r.is_irrelevant and not r.is_partially_relevant
    assert whole(spark, None, "one").final_marks == 0.0  # too short, whatever its similarity
    assert whole(spark, 1.0).final_marks > 8


def test_contradiction_counts_unrounded(spark):
    df = spark.createDataFrame([("one two three four", "x", 0.9, [("one", 1.0)], [["one"]], 5)], "answer string, model_answer string, similarity double, keywords array<struct<word string, weight double>>, concepts array<array<string>>, max_marks int")
    below = evaluate.final(df, lambda a, m: F.lit(0.49996)).first()
    assert below.contradiction_score == 0.5 and not any("contradicts" in x for x in below.feedback)
    assert any("contradicts" in x for x in evaluate.final(df, lambda a, m: F.lit(0.5)).first().feedback)


def test_single_answers(spark):
    rows = spark.createDataFrame([("one two three four", "m", [("one", 1.0)], 5)], "answer string, model_answer string, keywords array<struct<word string, weight double>>, max_marks int")
    r = evaluate.single_answers(rows, F.lit(None).cast("double")).first()
    assert (r.score_out_of_10, r.scaled_marks) == (None, None)


def test_functions(spark):
    null = F.lit(None).cast("double")
    r = spark.range(1).select(scoring.clamp(null, 0.0, 1.0), scoring.scaled(null, F.lit(5)), scoring.final_marks(null, F.lit(1.0), F.lit(True)), scoring.length_factor(F.lit(None).cast("int"), F.lit(5)), scoring.length_adjustment(null), scoring.confidence_adjustment(F.lit(3.0), null), scoring.raw_score(F.lit(1.0), null, F.lit(1.0), F.lit(0.0))).first()
    assert tuple(r) == (None,) * 7
    assert spark.range(1).select(scoring.band(null, F.lit(9))).first()[0] == "unevaluable"


def test_observed(spark):
    """Figures of the rows come with the job that writes them."""
    rows = spark.createDataFrame([(4.0, False, False, 0.5), (1.0, False, True, 0.1), (0.0, True, False, 0.0), (None, False, False, None)], "rounded_score double, is_irrelevant boolean, is_partially_relevant boolean, contradiction_score double")
    out, seen = evaluate.observed(rows)
    assert len(out.collect()) == 4
    got = seen.get
    assert (got["n"], got["n_irrelevant"], got["n_partial"], got["n_contradicting"], got["n_unevaluable"], got["low"], got["high"]) == (4, 1, 1, 1, 1, 0.0, 4.0)
    assert abs(got["mean"] - 5 / 3) < 1e-12 and abs(got["deviation"] - (26 / 9) ** 0.5) < 1e-12
