"""Lines to records: blocks, dedup, merging, gaps, order. Order always comes from a position column."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sheets import answer_number, is_noise
from ..functions.text import WHITE, WS, canonical_qno, clean_line, collapse

#: Every line end that Unicode knows, a return with its line feed being one.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85" + chr(0x2028) + chr(0x2029) + "]"


def lines(sheets: DataFrame, key: str, text: str, empty: bool = False) -> DataFrame:
    """key, line_pos, line: cleaned lines, those that are empty only if `empty`. Null texts have none."""
    found = sheets.select(key, F.posexplode(F.split(text, LINE_END, -1)).alias("line_pos", "line")).withColumn("line", clean_line(F.col("line")))
    return found if empty else found.where("line != ''")


def diagnosed(sheets: DataFrame, key: str, text: str, most: int = 40) -> DataFrame:
    """key, line_no, kind, qno, shown: what each of the first `most` lines of an answer sheet is taken for (blank, noise,
    number or answer), its question number, and the start of what follows the number (40 characters) or of the answer (60)."""
    found = lines(sheets, key, text, empty=True).where(F.col("line_pos") < most).withColumn("n", answer_number(F.col("line")))
    kind = F.when(F.col("line") == "", "blank").when(is_noise(F.col("line")), "noise").when(F.col("n.qno").isNotNull(), "number").otherwise("answer")
    shown = F.when(F.col("kind") == "number", F.substring("n.rest", 1, 40)).when(F.col("kind") == "answer", F.substring("line", 1, 60)).otherwise("")
    return found.withColumn("kind", kind).select(key, (F.col("line_pos") + 1).alias("line_no"), "kind", F.when(F.col("kind") == "number", F.col("n.qno")).alias("qno"), shown.alias("shown"))


def blocks(rows: DataFrame, key: str, opens: Column, least: int = 0) -> DataFrame:
    """key, block, text: a line for which `opens` is true starts a block, later lines belong to it, lines before the first go,
    and so do later lines of under `least` characters (2 on answer sheets)."""
    numbered = rows.withColumn("block", F.count(F.when(opens, 1)).over(W.partitionBy(key).orderBy("line_pos")))
    numbered = numbered.where(F.coalesce(opens, F.lit(False)) | (F.length("line") >= least)) if least else numbered
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_pos", "line"))), lambda x: x["line"]), " ")
    return numbered.where("block > 0").groupBy(key, "block").agg(collapse(joined).alias("text"))


def sheet_lines(text: Column) -> Column:
    """Array of struct pos, line: the cleaned lines of a text that aren't empty; pos counts the empty ones too."""
    every = F.transform(F.split(text, LINE_END, -1), lambda x, k: F.struct(k.alias("pos"), clean_line(x).alias("line")))
    return F.filter(every, lambda x: x["line"] != "")


def openings(lines: str, opens: Callable[[Column], Column]) -> Column:
    """The indices of the elements of the array `lines` that open a block."""
    return F.filter(F.transform(lines, lambda x, k: F.when(opens(x), k)), lambda k: k.isNotNull())


def block_at(lines: str, at: str, p: Column, k: Column) -> Column:
    """The elements of the k-th block, which the p-th element opens."""
    return F.slice(lines, p + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - p)


def sheet_blocks(sheets: DataFrame, key: str, text: str, opens: Callable[[Column], Column], least: int = 0) -> DataFrame:
    """key, block, text, as `lines` and `blocks` give them, from one pass over each sheet's array of lines: nothing is exploded but
    the finished blocks, and nothing is shuffled. opens: a condition on a line (struct pos, line)."""
    held = sheets.select(key, sheet_lines(F.col(text)).alias("_lines")).withColumn("_at", openings("_lines", opens))
    kept = lambda x, k: (k == 0) | (F.length(x["line"]) >= least)
    one = lambda p, k: F.filter(block_at("_lines", "_at", p, k), kept) if least else block_at("_lines", "_at", p, k)
    joined = F.transform("_at", lambda p, k: collapse(F.array_join(F.transform(one(p, k), lambda x: x["line"]), " ")))
    return held.select(key, F.posexplode(joined).alias("block", "text")).withColumn("block", F.col("block") + 1)


def extracted_answers(sheets: DataFrame, key: str, text: str, expected: str | None = None, least: int = 2) -> DataFrame:
    """key, place, qno, answer: the numbered answers of each sheet in the order of their numbers (`sort_key`; place from 1).

    A state machine over the array of a sheet's lines, with nothing exploded but the answers and nothing shuffled: noise goes, a
    line with a number opens an answer, lines before the first and later ones of under `least` characters go. Answers that repeat a
    number are joined in order. Numbers without an answer get an empty one: those of the array column `expected` that aren't there,
    as they are, or without it the whole numbers between the least and the greatest. Numbers have three digits at most, which
    bounds what is compared within a sheet. Null and empty sheets have no answers."""
    named = F.transform(F.filter(sheet_lines(F.col(text)), lambda x: ~is_noise(x["line"])), lambda x: F.struct(x["line"].alias("line"), answer_number(x["line"]).alias("n")))
    held = sheets.select(key, *([F.col(expected).alias("_expected")] if expected else []), named.alias("_lines"))
    held = held.withColumn("_at", openings("_lines", lambda x: x["n"]["qno"] != ""))
    parts = lambda p, k: F.filter(F.transform(block_at("_lines", "_at", p, k), lambda x, j: F.when(j == 0, x["n"]["rest"]).when(F.length(x["line"]) >= least, x["line"]).otherwise("")), lambda x: x != "")
    answer = lambda p, k: F.regexp_replace(F.array_join(parts(p, k), " "), f"[{WS}]{{2,}}", " ")
    held = held.withColumn("_found", F.transform("_at", lambda p, k: F.struct(F.get("_lines", p)["n"]["qno"].alias("qno"), F.btrim(answer(p, k), F.lit(WHITE)).alias("answer"))))
    held = held.withColumn("_names", F.array_distinct(F.transform("_found", lambda x: x["qno"])))
    same = lambda q: F.filter(F.transform(F.filter("_found", lambda x: x["qno"] == q), lambda x: x["answer"]), lambda a: a != "")
    merged_ = F.transform("_names", lambda q: F.struct(q.alias("qno"), F.array_join(same(q), " ").alias("answer")))
    whole = F.transform(F.filter("_names", lambda q: q.rlike("^[0-9]+$")), lambda q: q.cast("int"))
    held = held.withColumn("_merged", merged_).withColumn("_whole", whole)
    if expected:
        gaps = F.filter(F.coalesce("_expected", F.array().cast("array<string>")), lambda q: ~F.array_contains("_names", q))
    else:
        gaps = F.when(F.size("_whole") > 0, F.transform(F.array_except(F.sequence(F.array_min("_whole"), F.array_max("_whole")), "_whole"), lambda q: q.cast("string"))).otherwise(F.array().cast("array<string>"))
    held = held.withColumn("_all", F.concat("_merged", F.transform(gaps, lambda q: F.struct(q.alias("qno"), F.lit("").alias("answer")))))
    ordered = F.array_sort(F.transform("_all", lambda x, k: F.struct(sort_key(x["qno"]).alias("by"), k.alias("k"), x.alias("x"))))
    return held.select(key, F.posexplode(ordered).alias("place", "o")).select(key, (F.col("place") + 1).alias("place"), "o.x.qno", "o.x.answer")


def first_of(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(value, pos).alias(value), F.min(pos).alias(pos))


def last_of(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, pos).alias(value), F.min(pos).alias(pos))


def longest_of(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """The longest value, the earlier of equals, at the first position."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(F.length(value), -F.col(pos))).alias(value), F.min(pos).alias(pos))


def merged(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Values that aren't empty, joined by a space in order, at the first position."""
    parts = F.array_sort(F.collect_list(F.when(F.col(value) != "", F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["v"]), " ").alias(value), F.min(pos).alias(pos))


def missing_numbers(rows: DataFrame, key: str, number: str) -> DataFrame:
    """key, number: the numbers between a group's smallest and largest that it lacks. Each gap between neighbours is listed on
    its own, so a group needs no array of its whole span."""
    following = F.lead(number).over(W.partitionBy(key).orderBy(number))
    gaps = rows.select(key, number).distinct().withColumn("_next", following).where(F.col("_next") > F.col(number) + 1)
    return gaps.select(key, F.explode(F.sequence(F.col(number) + 1, F.col("_next") - 1)).alias(number))


def missing_expected(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(found, keys, "left_anti")


#: Roman numbers that count as such, and the letters of Tamil parts in their order.
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii")
TAMIL_PARTS = "அஆஇஈඋஊ"


def sort_key(qno: Column) -> Column:
    """A struct to order question numbers by, a leading Q aside: whole numbers and a number with a letter after a stop or space
    (kind 0), single letters (1), roman numbers of several letters (2), Tamil letters (3), the rest by their text (4)."""
    bare = F.regexp_replace(qno, "^[Qq]", "")
    both = r"^([0-9]+)(?:[.\s]([a-zA-Z]))?$"
    number, letter = F.regexp_extract(bare, both, 1), F.lower(F.regexp_extract(bare, both, 2))
    roman, tamil = F.array_position(F.array(*map(F.lit, ROMAN)), F.lower(bare)), F.instr(F.lit(TAMIL_PARTS), bare)
    kind = F.when(number != "", 0).when(bare.rlike("^[a-zA-Z]$"), 1).when(roman > 0, 2).when(tamil > 0, 3).otherwise(4)
    value = F.when(kind == 0, number.cast("decimal(38,0)")).when(kind == 2, roman).when(kind == 3, tamil).otherwise(F.lit(0))
    code = F.when(kind == 0, F.ascii(letter)).when(kind == 1, F.ascii(F.lower(bare))).otherwise(F.lit(0))
    return F.struct(kind.alias("kind"), value.cast("decimal(38,0)").alias("number"), code.alias("letter"), F.when(kind == 4, bare).otherwise("").alias("text"))


def question_answers(questions: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match: keys, question, answer, status, side, pos. Questions come first in paper order; answers without a
    question are invalid, in sheet order."""
    q = questions.select(*keys, "question", F.col("pos").alias("q_pos"))
    a = answers.select(*keys, "answer", F.col("pos").alias("a_pos"))
    status = F.when(F.col("q_pos").isNull(), "invalid").when(F.coalesce("answer", F.lit("")) != "", "attempted").otherwise("unattempted")
    side = F.when(F.col("q_pos").isNull(), 1).otherwise(0)
    return q.join(a, keys, "full_outer").select(*keys, F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), status.alias("status"), side.alias("side"), F.coalesce("q_pos", "a_pos").alias("pos"))


def mapped(questions: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """key, qno, question, answer, status, side, pos: questions matched with answers by their numbers in one form. Of questions
    that repeat a number the first counts, answers that repeat one are joined in order; records without a number go.
    questions: key, qno, question, pos; answers: key, qno, answer, pos. Texts are trimmed, null is empty."""
    tidy = lambda rows, c: rows.withColumn("qno", canonical_qno(F.col("qno"))).where("qno != ''").withColumn(c, F.trim(F.coalesce(c, F.lit(""))))
    q = first_of(tidy(questions, "question"), [key, "qno"], "question", "pos")
    return question_answers(q, merged(tidy(answers, "answer"), [key, "qno"], "answer", "pos"), [key, "qno"])
