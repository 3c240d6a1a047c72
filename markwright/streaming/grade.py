"""The scoring transforms over a stream of answers: they have no state, so the batch functions serve as they are."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text


def scored(answers: DataFrame) -> DataFrame:
    """answers: a stream (or table) with answer, max_marks and the sub-scores semantic, keyword, concept, contradiction."""
    words = text.word_count(text.preprocess(F.col("answer")))
    band = scoring.band(F.col("semantic") / 10, words)
    s = answers.withColumn("length_factor", F.when(scoring.no_marks(band), 0.0).otherwise(scoring.length_factor(words, F.col("max_marks"))))
    s = s.withColumn("raw_score", F.when(scoring.no_marks(band), 0.0).otherwise(scoring.raw_score(F.col("semantic"), F.col("keyword"), F.col("concept"), F.col("contradiction"))))
    marks = scoring.banded_marks(F.col("raw_score"), scoring.length_adjustment(F.col("length_factor")), band)
    return s.withColumn("marks", marks).withColumn("rounded_score", scoring.half_step(scoring.scaled(F.col("marks"), F.col("max_marks"))))
