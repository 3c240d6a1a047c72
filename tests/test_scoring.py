"""Rows whose sub-scores and results are known (FIXTURES.md, section 4), sources, text cases and a stream."""

import json

from pyspark.sql import functions as F

from markwright.functions import fuzzy, scoring, text
from markwright.sources import bank
from markwright.streaming import grade

ROWS = [  # words, max, sem, kw, con, ctr, raw, final, rounded
    (31, 5, 9.25, 9.81, 10.0, 0.0691, 9.2467, 4.625, 4.5),
    (5, 5, 3.86, 6.05, 2.5, 0.1282, 3.8068, 1.67, 1.5),
    (50, 5, 9.85, 9.3, 10.0, 0.0076, 9.7129, 4.855, 5.0),
    (7, 5, 10.0, 10.0, 3.33, 0.048, 8.1327, 3.62, 3.5),
]


def test_known_rows(spark):
    df = spark.createDataFrame([(" ".join(["w"] * r[0]), *map(float, r[1:])) for r in ROWS], "answer string, max_marks double, semantic double, keyword double, concept double, contradiction double, raw double, final double, rounded double")
    for r in grade.scored(df).collect():
        assert abs(r.raw_score - r.raw) < 3e-4 and r.rounded_score == r.rounded and abs(r.marks * r.max_marks / 10 - r.final) < 5e-3


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("w " * r[0], *map(float, r[1:6])) for r in ROWS], "answer string, max_marks double, semantic double, keyword double, concept double, contradiction double")
    df.write.parquet(f"{tmp_path}/in")
    q = grade.scored(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("graded").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("graded").count() == len(ROWS)


def test_half_steps_and_bands(spark):
    r = spark.range(1).select(*(scoring.half_step(F.lit(x)) for x in (6.24, 6.25, 6.26, 6.75)), *(scoring.relevance(F.lit(x)) for x in (0.1999, 0.20, 0.3499, 0.35))).first()
    assert list(r) == [6.0, 6.0, 6.5, 7.0, "irrelevant", "partial", "partial", "relevant"]


def test_question_numbers(spark):
    cases = {"01": "1", "(1)": "1", "Q.3": "Q3", "Q-2": "Q2", "q 5": "Q5", "II": "ii", "1:": "1", "1.a": "1.a", "Q1.A": "Q1.A"}
    got = {r.raw: r.c for r in spark.createDataFrame([(c,) for c in cases], "raw string").select("raw", text.canonical_qno(F.col("raw")).alias("c")).collect()}
    assert got == cases
    assert spark.range(1).select(text.canonical_qno(F.lit("Q1.A"), whole=True)).first()[0] == "q1.a"


def test_ratio():
    assert fuzzy.ratio("", "x") == 1.0 and fuzzy.ratio("photo synthesis", "the photo synthesis") == 1.0
    assert 0.8 < fuzzy.ratio("photosynthesis", "the photosinthesis of") < 1 and fuzzy.ratio("a", "") == 0.0


def test_bank(spark, tmp_path):
    entries = [{"question": "q", "model_answer": "m", "keywords": ["a", {"word": " b ", "weight": 0}, 7], "max_marks": 5}, {"question": "r", "model_answer": ""}]
    (tmp_path / "bank.json").write_text(json.dumps(entries))
    rows = bank.read_bank(spark, f"file://{tmp_path}/bank.json").orderBy("bank_pos").collect()
    assert [tuple(k) for k in rows[0].keywords] == [("a", 1.0), ("b", 0.01)] and rows[0].max_marks == 5
    assert rows[1].max_marks == 10 and rows[1].keywords == [] and rows[1].concepts == []


def test_ratio_against_every_window():
    import random
    from difflib import SequenceMatcher

    from markwright.functions.fuzzy import ratio

    r = random.Random(3)
    make = lambda n: " ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 6))) for _ in range(n))
    for _ in range(300):
        keyword, text = make(r.randint(0, 3)), make(r.randint(0, 12))
        words, n, best = text.split(), len(keyword.split()), 0.0
        for size in {n, max(1, n - 1), n + 1}:
            for at in range(len(words) - size + 1):
                best = max(best, SequenceMatcher(None, keyword, " ".join(words[at : at + size])).ratio())
        assert ratio(keyword, text) == (1.0 if keyword in text else best)


def test_coverage(spark, monkeypatch):
    from markwright.operators import match

    answers = spark.createDataFrame([(1, "water and watery air"), (2, ""), (3, None), (4, "fire")], "doc_id long, body string")
    bank = spark.createDataFrame([(1, ["water", "ater", "air", "water"]), (2, []), (3, None), (4, ["", "fire"]), (5, ["earth", None])], "item_id long, kws array<string>")
    want = [(1, 1, 4, 4), (4, 1, 2, 1), (4, 2, 2, 1), (4, 4, 2, 2)]
    assert sorted(map(tuple, match.coverage(answers, bank).collect())) == want
    monkeypatch.setattr(match, "BANK_WORDS", 2)  # several parts
    assert sorted(map(tuple, match.coverage(answers, bank).collect())) == want
    assert match.coverage(answers.limit(0), bank).count() == 0


def test_concepts(spark):
    groups = [["photosynthesis", "leaf"], ["", "stone"], [], ["volcano"]]
    df = spark.createDataFrame([(groups, "the photosinthesis of breath"), (None, "x")], "c array<array<string>>, t string")
    assert [list(r.f) for r in df.select(fuzzy.covered("c", "t").alias("f")).collect()] == [[True, False, False, False], []]


def test_stream_marks_by_relevance(spark):
    cases = [(90, 1.99, 0.0), (90, 2.0, 2.0), (90, 3.49, 2.0), (90, 3.5, 6.75), (2, 8.0, 0.0), (0, 8.0, 0.0)]
    df = spark.createDataFrame([(k, "w " * n, 5.0, s, 10.0, 10.0, 0.0) for k, (n, s, _) in enumerate(cases)], "k int, answer string, max_marks double, semantic double, keyword double, concept double, contradiction double")
    got = grade.scored(df).orderBy("k").collect()
    assert [round(r.marks, 6) for r in got] == [m for _, _, m in cases]
    assert [r.raw_score > 0 for r in got] == [m > 0 for _, _, m in cases]
