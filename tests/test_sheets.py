"""Rules on recognised lines, image sources and subject routing, on small literals."""

import pytest
from pyspark.sql import functions as F

from markwright.functions import sheets
from markwright.sources import images, subjects


def values(spark, f, some):
    rows = spark.createDataFrame(list(enumerate(some)), "k int, x string")
    return [r.y for r in rows.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_question_numbers(spark):
    some = ["1. What", "Q.2) Why", "1.a part", "(a) x", "ii) y", "அ) z", "1330 couplets", "3 reasons", "text", "12 34"]
    assert [tuple(x) for x in values(spark, sheets.answer_number, some)] == [
        ("1", "What"), ("Q2", "Why"), ("1", "a part"), ("(a", "x"), ("ii", "y"), ("அ", "z"), (None, "1330 couplets"), ("3", "reasons"), (None, "text"), ("12", "34"),
    ]
    assert [x.qno for x in values(spark, sheets.paper_number, ["Q. 7 x", "12 34", "Q-3 x"])] == ["Q7", None, None]


def test_noise(spark):
    some = ["Page 3", "pages of", "Register. No 5", "பக்கம் 3", "பக்கம்3", "----", "- 12 -", "1/2/2024", "P.T.O.", "overt", "An answer", "part b", "total"]
    assert values(spark, sheets.is_noise, some) == [True, False, True, False, True, True, True, True, True, False, False, True, True]
    assert values(spark, sheets.is_skipped, ["--", "---", "***", "7", "contd", "total", "Roll 5"]) == [False, True, True, False, False, False, True]


def test_continuation(spark):
    assert values(spark, sheets.continues, ["and so", "And", "(see)", "தமிழ்", "1. x", "a) x", ""]) == [True, False, True, True, False, False, False]


def test_split_block(spark):
    some = ["Why so?\nAnswer: because\nof it", "Say it.\nFirst\nSecond", "One\nஏன் two\nthree", "One\ntwo", "Why? Because. Yes", "alone", ""]
    assert [tuple(x) for x in values(spark, sheets.split_block, some)] == [
        ("Why so?", "because of it"), ("Say it.", "First Second"), ("One ஏன் two", "three"), ("One", "two"), ("Why", "Because Yes"), ("", "alone"), ("", ""),
    ]


def test_repairs(spark):
    assert values(spark, sheets.from_romanised, ["Kural and kurals", "thirukkural NEER"]) == ["குறள் and kurals", "திருக்குறள் நீர்"]
    assert values(spark, sheets.respelled, ["தமிழனாடு"]) == ["தமிழ்நாடுு"]
    assert values(spark, sheets.repaired, ["  soooo §good  தமிழ்abc ", None, ""]) == ["soo good தமிழ் abc", "", ""]


def test_images(spark, tmp_path):
    for name, content in (("b.png", b"img"), ("a.pdf", b"p1|p2"), ("bad.png", b"bad"), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(content)

    def recognise(image, hints):
        if image == b"bad":
            raise RuntimeError("unreadable")
        return [(0, "hello", 0.5), (0, image.decode(), 0.0), (1, "ok", 1.0)]

    rows = images.folder_text(spark, str(tmp_path), recognise, lambda pdf: pdf.split(b"|")).collect()
    assert [(r.path.rsplit("/", 1)[1], r.page, r.full_text, list(r.blocks), r.confidence, r.word_count) for r in rows if not r.error] == [
        ("a.pdf", 1, "hello p1\nok", ["hello p1"], 0.75, 3), ("a.pdf", 2, "hello p2\nok", ["hello p2"], 0.75, 3), ("b.png", 1, "hello img\nok", ["hello img"], 0.75, 3),
    ]
    assert [r.error for r in rows if r.error] == ["RuntimeError: unreadable"]


def test_subjects(spark, tmp_path):
    assert subjects.resolve(" Tamil ") == ("data/tamil_tamil.json", ["ta"])
    assert subjects.resolve("maths", "English") == ("data/maths_english.json", ["en"])
    for wrong in (("art", None), ("maths", None), ("maths", "x")):
        with pytest.raises(ValueError):
            subjects.resolve(*wrong)
    assert subjects.routes(spark).count() == 8
    with pytest.raises(FileNotFoundError):
        subjects.subject_bank(spark, f"file://{tmp_path}", "tamil")
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "question_bank.json").write_text('[{"question": "q", "model_answer": "m"}]')
    bank, path = subjects.subject_bank(spark, f"file://{tmp_path}", "tamil")
    assert path == "data/question_bank.json" and bank.first().question == "q"


def test_sheet_blocks(spark):
    """Numbers within a line start blocks too (after "Q", what follows the number stays, as in the reference); the rules of evaluate.questions and blocks on short lines."""
    from markwright.operators import evaluate, records

    cases = {
        "name x\nQ1. What is it? Ans: water 2) Why so\n\nbecause. Q 3: how": [("1", ". What is it? Ans: water "), ("2", " Why so\nbecause. "), ("3", ": how")],
        "கேள்வி 4 abc வினா 5 def": [("4", " abc "), ("5", " def")],
        "x12. no, 13. yes": [("13", " yes")],
        "no numbers 7 here": [],
    }
    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, t string")
    got = [[(b.qno, b.block.strip()) for b in r.b] for r in df.select("k", sheets.sheet_blocks(F.col("t")).alias("b")).orderBy("k").collect()]
    assert got == [[(n, b.strip()) for n, b in want] for want in cases.values()]
    lines = ["1. What is", "it", "2. ab", "3. .....!", "4. why so"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "paper int, line_pos int, line string")
    assert [(r.block, r.question) for r in evaluate.questions(rows, "paper").orderBy("block").collect()] == [(1, "What is it"), (4, "why so")]
    answers = spark.createDataFrame([(1, k, x) for k, x in enumerate(["1", "x", "ab", "-", "2", "cd"])], "paper int, line_pos int, line string")
    opens = F.col("line").rlike("^[0-9]")
    assert [r.text for r in records.blocks(answers, "paper", opens, least=2).orderBy("block").collect()] == ["1 ab", "2 cd"]
