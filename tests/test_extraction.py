"""Answers from sheets by hand-made cases; blocks of one pass against those of the exploded lines."""

import random

from pyspark.sql import functions as F

from markwright.operators import records


def answers(spark, sheet, expected=None):
    df = spark.createDataFrame([(1, sheet, expected)], "k int, t string, e array<string>")
    got = records.extracted_answers(df, "k", "t", "e" if expected is not None else None).collect()
    assert [r.place for r in got] == list(range(1, len(got) + 1))
    return [(r.qno, r.answer) for r in got]


def test_answers(spark):
    sheet = "Name: X\nintro\n\n1. one\n  more  of\tit\nx\nPage 3\n- 4 -\n3) three\r\n1. again\n---\n12 apples\n(a) letter\nii) roman"
    assert answers(spark, sheet) == [
        ("1", "one more of it again"), ("2", ""), ("3", "three"), *((str(k), "") for k in range(4, 12)), ("12", "apples"), ("ii", "roman"), ("(a", "letter")
    ]


def test_states(spark):
    assert answers(spark, None) == [] and answers(spark, "") == [] and answers(spark, "no number\nat all") == []
    assert answers(spark, "5.") == [("5", "")]  # a number alone, with nothing after it
    assert answers(spark, "a)\n\n\nb\nok") == [("a", "ok")]  # a line of one character goes
    assert answers(spark, "2. b\n1. a\n2.\n2. c") == [("1", "a"), ("2", "b c")]  # an empty part adds nothing
    assert answers(spark, "10. j\n9. i\nb) l\nQ2 q") == [("Q2", "q"), ("9", "i"), ("10", "j"), ("b", "l")]


def test_expected(spark):
    """Expected numbers are taken as they are: not found ones are added, repeats too; without any, none."""
    assert answers(spark, "1. a\n4. d", ["1", "2", "2", "Q7", "01"]) == [("1", "a"), ("01", ""), ("2", ""), ("2", ""), ("4", "d"), ("Q7", "")]
    assert answers(spark, "1. a\n4. d", []) == [("1", "a"), ("4", "d")]


def test_many_lines(spark):
    """Repeated rows, many answers, clashing column names."""
    sheet = "\n".join(f"{k % 900}. part {k}\nline {k}" for k in range(3000))
    df = spark.createDataFrame([(1, sheet, 5), (1, sheet, 6), (2, "1. x", 7)], "key int, line string, pos int")
    got = records.extracted_answers(df, "key", "line").collect()
    assert len(got) == 2 * 900 + 1 and sum(r.answer == "part 5 line 5 part 905 line 905 part 1805 line 1805 part 2705 line 2705" for r in got) == 2


def test_blocks_of_one_pass(spark):
    r = random.Random(3)
    texts = [(k, "\n".join(r.choice(["", " a  b ", "x", "long line\there", "é "]) for _ in range(r.randrange(30)))) for k in range(40)] + [(40, None), (41, "")]
    df = spark.createDataFrame(texts, "k int, t string")
    for least in (0, 2):
        want = records.blocks(records.lines(df, "k", "t"), "k", F.col("line_pos") % 4 == 2, least)
        got = records.sheet_blocks(df, "k", "t", lambda x: x["pos"] % 4 == 2, least)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = records.sheet_blocks(df, "k", "t", lambda x: x["pos"] % 4 == 2)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan
