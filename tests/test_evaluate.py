"""Compositions of the scoring functions, on small literals."""

from pyspark.sql import functions as F

from markwright.operators import evaluate


def test_question_lines(spark):
    lines = ["Page 1", "intro", "1. What is", "it", "Then", "ok", "2.", "Now", "tamil", "Tail", "X"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "paper int, line_pos int, line string")
    got = [(r.block, r.line) for r in evaluate.question_lines(rows, "paper").orderBy("line_pos").collect()]
    assert got == [(1, "What is"), (1, "it"), (1, "Then"), (1, "ok"), (2, "tamil"), (2, "Tail")]


def test_sounds_and_contradiction(spark):
    one = spark.range(1)
    weights, found = F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.2))
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(evaluate.with_sounds(F.lit(5.0), weights, found, F.array(F.lit(0.0), F.lit(0.8)))) == 9.0
    assert value(evaluate.with_sounds(F.lit(5.0), weights, found, F.array(F.lit(0.9), F.lit(0.6)))) == 5.0
    judge = lambda a, m: F.lit(1.7)
    assert value(evaluate.contradiction(F.lit("a"), F.lit("b"))) == 0.0
    assert value(evaluate.contradiction(F.lit("a"), F.lit("b"), judge)) == 1.0
    assert value(evaluate.contradiction(F.lit(" "), F.lit("b"), judge)) == 0.0
    assert value(evaluate.contradiction(F.lit("a"), F.lit("b"), lambda a, m: F.lit(None).cast("double"))) == 0.0


def test_single_answers(spark):
    rows = spark.createDataFrame([(1, "water and air " * 30, "m", [("water", 1.0), ("fire", 1.0)], 5), (2, " ", "m", [("water", 1.0)], 5), (3, None, "m", [], 5)], "k int, answer string, model_answer string, keywords array<struct<word: string, weight: double>>, max_marks int")
    a, b, c = evaluate.single_answers(rows, F.lit(8.0)).orderBy("k").collect()
    assert a.matched == ["water"] and a.missing == ["fire"] and abs(a.scaled_marks - a.score_out_of_10 / 2) < 0.0051 and a.score_out_of_10 > 5
    assert (b.score_out_of_10, b.missing, c.score_out_of_10, c.missing) == (0.0, ["water"], 0.0, [])


def test_separate_uploads_and_totals(spark):
    q = spark.createDataFrame([(1, "1.", "what", 0), (1, "01", "again", 1), (1, "2", "why", 2)], "s int, qno string, question string, pos int")
    a = spark.createDataFrame([(1, "1", "old", 0), (1, "(1)", "new", 1), (1, "7", "x", 2), (1, "7", "y", 3), (1, "", "z", 4)], "s int, qno string, answer string, pos int")
    found = evaluate.separate_uploads(q, a, ["s"])
    assert sorted((r.qno, r.question, r.answer, r.status) for r in found.collect()) == [("1", "again", "new", "evaluated"), ("1", "what", "new", "evaluated"), ("2", "why", "", "no_answer"), ("7", "", "x", "skipped"), ("7", "", "y", "skipped")]
    marked = found.withColumn("scaled_marks", F.when(F.col("status") == "evaluated", 4.0).otherwise(0.0)).withColumn("max_marks", F.when(F.col("status") == "skipped", 0).otherwise(5))
    r = evaluate.totals(marked, ["s"]).first()
    assert (r.total_marks, r.max_total_marks, r.percentage, r.evaluated, r.no_answer, r.skipped, r.error) == (8.0, 15, 53.3, 2, 1, 2, 0)
    assert evaluate.console(evaluate.totals(marked, ["s"]), {"total_marks": "Total"}).first().line == f"  {'Total':<38}: 8.0"


def test_single_answers_by_relevance(spark):
    """The reference's rule: no marks below a confidence of 0.20 or under three words, 2.0 at most up to 0.35."""
    cases = {"water " * 90: (1.99, 2.0, 3.0, 3.49, 3.5, 8.0), "water water": (8.0,), "water in a": (8.0,)}
    rows = [(a, s) for a, many in cases.items() for s in many]
    df = spark.createDataFrame([(k, a, "m", [("water", 1.0)], 10, s) for k, (a, s) in enumerate(rows)], "k int, answer string, model_answer string, keywords array<struct<word: string, weight: double>>, max_marks int, semantic double")
    got = evaluate.single_answers(df, F.col("semantic")).orderBy("k").collect()
    assert [r.score_out_of_10 for r in got[:4]] == [0.0, 2.0, 2.0, 2.0] and got[4].score_out_of_10 == 4.25 and got[5].score_out_of_10 == 6.5
    assert got[6].score_out_of_10 == 0.0 and got[7].score_out_of_10 > 5
    assert (got[0].matched, got[0].missing, got[6].matched, got[6].missing) == ([], ["water"], [], ["water"]) and got[1].matched == ["water"]


def test_evaluations_in_one_pass(spark):
    """Without a column of similarities they are made in the pass that reads an answer for its keywords: those of `semantic_scores`,
    ratios and concepts as if each were searched alone. No answer is shuffled by its number or cut into rows of words."""
    import __spark_entry__
    from markwright.functions import fuzzy

    d = "/root/testdata/sf0.001"
    found = __spark_entry__.queries()["evaluate_answers"](spark, d)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning(doc_id" not in plan and plan.count("ArrowEvalPython [") == 1
    likened = {r.doc_id: (r.item, r.similarity) for r in __spark_entry__.queries()["semantic_scores"](spark, d).collect()}
    bank = {r.item_id: list(dict.fromkeys(w for w in r.text.lower().split(" ") if len(w) > 6)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    rows = {r.doc_id: r for r in found.collect()}
    assert rows.keys() == likened.keys() and any(r.covered_concepts for r in rows.values()) and any(r.missed_concepts for r in rows.values())
    for i, r in rows.items():
        assert (r.item, r.similarity is None or round(r.similarity, 6)) == (likened[i][0], likened[i][1] is None or likened[i][1])
        if not r.is_irrelevant and r.similarity is not None and len(r.student_answer_clean.split()) > 2:
            near = {w: max(fuzzy.ratio(w, r.student_answer_clean), fuzzy.ratio(w[:5], r.student_answer_clean)) for w in bank[r.item]}
            assert r.covered_concepts == [w for w in bank[r.item] if near[w] >= fuzzy.CONCEPT]
            assert r.matched_keywords == [w for w in bank[r.item] if fuzzy.ratio(" ".join(w.split()), r.student_answer_clean) >= fuzzy.FULL]


def test_given_similarities_stay(spark):
    s = "k int, answer string, model_answer string, similarity double, keywords array<struct<word: string, weight: double>>, concepts array<array<string>>, max_marks int"
    rows = spark.createDataFrame([(1, "water and air", "water and air", None, [("water", 1.0)], [["air"]], 5), (2, "water and air", "fire", 0.9, None, None, 5), (3, None, "fire", 0.9, [("fire", 1.0)], [[]], 5)], s)
    got = {r.k: r for r in evaluate.final(rows).collect()}
    assert (got[1].similarity, got[1].final_marks, got[2].confidence, got[3].semantic_score) == (None, None, 0.9, 0.0)
    assert (got[3].missing_keywords, got[3].covered_concepts) == (["fire"], [])
    made = {r.k: r.similarity for r in evaluate.final(rows.drop("similarity")).collect()}
    assert abs(made[1] - 1) < 1e-12 and made[2] is not None and made[3] is None


def test_answers_searched_together(spark):
    """Answers with the same keywords are searched together, which changes none of their ratios and flags, nor where texts are cut."""
    import random

    from markwright.functions import fuzzy

    r = random.Random(3)
    word = lambda n=9: "".join(r.choice("abcdeñ") for _ in range(r.randrange(1, n)))
    keywords = [" ".join(word() for _ in range(n)) for n in (1, 1, 2, 3)] + ["", None, "x" * 70]
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 2, 30, 200, 2600)] + [f"{word(300)} {word()}"]
    alone = [fuzzy._ratios(keywords, t) for t in texts]
    assert fuzzy._ratios_many(keywords, texts, [t.split() for t in texts]) == alone
    groups = [[k, (k or "")[:3]] for k in keywords] + [[], [None]]
    want = [[max((fuzzy.ratio(s, t) for s in g if s), default=0.0) >= fuzzy.CONCEPT for g in groups] for t in texts]
    for known in ([{}] * len(texts), [dict(zip(keywords, x, strict=True)) for x in alone]):
        assert fuzzy._covered_many(groups, texts, [t.split() for t in texts], known) == want
    df = spark.createDataFrame([(k, t, keywords) for k, t in enumerate(texts)] + [(99, None, None)], "k int, t string, ks array<string>").repartition(2)
    got = {x.k: x.f for x in df.select("k", fuzzy.ratios("ks", "t").alias("f")).collect()}
    assert got == dict(enumerate(alone)) | {99: []}
