"""Hand-made cases by the rules themselves, not by the code under test."""

import random

from pyspark.sql import functions as F

from markwright.functions import scoring
from markwright.operators import evaluate, match, records


def test_order_of_question_numbers(spark):
    right = ["2", "Q3", "q3.b", "10", "a", "C", "i", "v", "ii", "VIII", "அ", "ஊ", "12abc", "1b", "[x]"]
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(reversed(right))], "k int, qno string")
    got = [r.qno for r in rows.orderBy(records.sort_key(F.col("qno")), "k").collect()]
    assert got == ["2", "Q3", "q3.b", "10", "a", "C", "i", "v", "ii", "VIII", "அ", "ஊ", "12abc", "1b", "[x]"]


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\x0cc  d \n\n"), (2, None), (3, "")], "id int, text string")
    assert [(r.id, r.line_pos, r.line) for r in records.lines(df, "id", "text").orderBy("id", "line_pos").collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d")]


def test_diagnosed(spark):
    df = spark.createDataFrame([(1, "\n".join(["Page 3", "", "1. yes it is", "Q2) no", "more", "- 3 -", *["x"] * 50]))], "id int, text string")
    got = {r.line_no: (r.kind, r.qno, r.shown) for r in records.diagnosed(df, "id", "text").collect()}
    assert len(got) == 40
    assert [got[k] for k in range(1, 7)] == [("noise", None, ""), ("blank", None, ""), ("number", "1", "yes it is"), ("number", "Q2", "no"), ("answer", None, "more"), ("noise", None, "")]


def test_gaps(spark):
    df = spark.createDataFrame([("s", n) for n in (1, 3, 3, 1_000_000_000, 1_000_000_002)] + [("t", 5)], "k string, n long").where("n < 10 OR n > 999999999")
    far = spark.createDataFrame([("s", n) for n in (1, 3, 3, 6)] + [("t", 5), ("u", None)], "k string, n long")
    assert sorted((r.k, r.n) for r in records.missing_numbers(far, "k", "n").collect()) == [("s", 2), ("s", 4), ("s", 5)]
    assert records.missing_numbers(df.where("n > 10"), "k", "n").first().n == 1_000_000_001


def test_mapped(spark):
    q = spark.createDataFrame([(1, "01", " one ", 0), (1, "(1)", "again", 1), (1, "Q.2", "two", 2), (1, "", "none", 3), (1, "3", None, 4)], "s int, qno string, question string, pos int")
    a = spark.createDataFrame([(1, "1)", "x", 0), (1, "1.", " ", 1), (1, "001", "y", 2), (1, "Q-2", "", 3), (1, "9", "stray", 4), (1, None, "lost", 5)], "s int, qno string, answer string, pos int")
    got = [(r.qno, r.question, r.answer, r.status) for r in records.mapped(q, a, "s").orderBy("side", "pos").collect()]
    assert got == [("1", "one", "x y", "attempted"), ("Q2", "two", "", "unattempted"), ("3", "", "", "unattempted"), ("9", "", "stray", "invalid")]


def test_bank_match(spark):
    bank = spark.createDataFrame([(0, "What is it?", [1.0, 0.0]), (1, "what  is it", [0.0, 1.0]), (2, "other", [0.6, 0.8]), (3, "far", [-1.0, 0.0]), (4, None, [-0.99, 0.1])], "bank_pos int, question string, vector array<double>")
    q = spark.createDataFrame([(10, " WHAT is it. ", [0.0, 1.0]), (11, "new", [-0.99, 0.1]), (12, "between", [0.3, 0.95]), (13, None, [0.1, -1.0])], "q_id int, question string, vector array<double>")
    got = {r.q_id: (r.bank_pos, r.how) for r in match.bank_match(q, bank).collect()}
    assert got == {10: (0, "exact"), 11: (3, "nearest"), 12: (None, "none"), 13: (None, "none")}


def test_rounded(spark):
    r = random.Random(1)
    some = [k / 1000 for k in range(-50, 10001, 5)] + [r.uniform(0, 10) for _ in range(2000)] + [k / 8 for k in range(100)] + [2.675, 7.125, 1.005, 0.0, None]
    df = spark.createDataFrame([(x,) for x in some], "x double")
    for n in (0, 2, 4):
        for x in df.select("x", scoring.rounded(F.col("x"), n).alias("y")).collect():
            assert x.y == (None if x.x is None else round(x.x, n)), x


COLUMNS = "student_answer_clean semantic_score keyword_score concept_score contradiction_score raw_score length_adjustment final_marks final_score rounded_score confidence matched_keywords missing_keywords covered_concepts missed_concepts feedback length_factor is_irrelevant is_partially_relevant semantic_weight keyword_weight".split()


def test_whole_evaluation(spark):
    long = "alpha beta " + " ".join(f"w{k}" for k in range(29))
    rows = [(1, long, 0.9248, 5), (2, "two words", 0.9, 5), (3, long, 0.1414, 5), (4, long, 0.3, 10), (5, "alpha beta w", 1.0, 5), (6, None, 0.5, 5), (7, long, -0.2, 5), (8, long, 0.2, 5), (9, long, 0.35, 5)]
    df = spark.createDataFrame([(i, a, "model text", s, [("alpha", 2.0), ("zzzzqqq", 1.0)], [["beta", "bet"], [], ["yyyyqq"]], m) for i, a, s, m in rows], "id int, answer string, model_answer string, similarity double, keywords array<struct<word string, weight double>>, concepts array<array<string>>, max_marks int")
    out = evaluate.final(df)
    assert set(COLUMNS) == set(out.columns) - set(df.columns) and len(COLUMNS) == 21
    got = {r.id: r for r in out.collect()}
    r = got[1]
    assert (r.semantic_score, r.confidence, r.keyword_score, r.concept_score) == (9.25, 0.9248, 6.67, 3.33)
    assert (r.raw_score, r.length_factor, r.length_adjustment, r.final_marks, r.final_score, r.rounded_score) == (7.125, 1.0, 1.0, 7.12, 3.56, 3.5)
    assert (r.matched_keywords, r.missing_keywords, r.covered_concepts, r.missed_concepts) == (["alpha"], ["zzzzqqq"], ["beta"], ["yyyyqq"])
    for i in (2, 6):  # empty: everything is zero
        r = got[i]
        assert (r.semantic_score, r.confidence, r.raw_score, r.length_adjustment, r.rounded_score, r.is_irrelevant) == (0, 0, 0, 0, 0, False)
        assert r.missing_keywords == ["alpha", "zzzzqqq"] and r.missed_concepts == ["beta", "yyyyqq"] and not r.matched_keywords
    assert (got[3].is_irrelevant, got[3].semantic_score, got[3].confidence, got[3].final_marks, got[3].keyword_score) == (True, 1.41, 0.1414, 0.0, 0.0)
    assert got[7].is_irrelevant and got[7].confidence == 0.0
    assert (got[4].is_partially_relevant, got[4].final_marks, got[4].rounded_score) == (True, 2.0, 2.0)
    assert not got[8].is_irrelevant and got[8].is_partially_relevant and not got[9].is_partially_relevant
    assert (got[5].length_factor, got[5].length_adjustment) == (0.1143, 0.8671)


def test_blocks_of_vectors(spark):
    """More than a block on both sides, equal vectors in several, null and short vectors, an empty bank."""
    import math

    from markwright.operators import match

    angle = lambda k: [math.cos(k % 37), math.sin(k % 37)]
    bank = [(k, angle(k * 7)) for k in range(1300)] + [(5000, None), (5001, [None, 1.0]), (5002, [1.0]), (5003, [])]
    asked = [(k, angle(k)) for k in range(600)] + [(9000, None)]
    b = spark.createDataFrame(bank, "bank_pos long, vector array<double>").repartition(3)
    q = spark.createDataFrame(asked, "q_id long, vector array<double>").repartition(2)
    scores = {j: sorted(((-round(sum(x * y for x, y in zip(v, w, strict=True)), 12), k) for k, w in bank[:1300])) for j, v in asked[:37]}
    got = {r.q_id: (r.bank_pos, round(r.score, 9), round(r.second, 9)) for r in match.nearest(q, b).collect()}
    assert got == {j: (scores[j % 37][0][1], round(-scores[j % 37][0][0], 9), round(-scores[j % 37][1][0], 9)) for j in range(600)}
    name = lambda s: "irrelevant" if s < 0.2 else "partial" if s < 0.35 else "relevant"
    counts = {j: {} for j in scores}
    for j, found in scores.items():
        for s, _ in found:
            counts[j][name(-s)] = counts[j].get(name(-s), 0) + 1
    want = {(j, band, n) for j in range(600) for band, n in counts[j % 37].items()}
    assert {tuple(r) for r in match.bands(q, b).collect()} == want
    assert match.nearest(q, b.where("bank_pos < 0")).count() == match.bands(q.where("q_id < 0"), b).count() == 0
