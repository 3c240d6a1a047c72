"""Whole evaluations out of the scoring functions, and their console form. Models are columns the caller gives."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fuzzy, scoring, sheets, text, vectors

#: From which similarity of sounds a missing keyword counts.
SOUNDS_ALIKE = 0.70


def question_lines(rows: DataFrame, key: str) -> DataFrame:
    """key, block, line_pos, line: the lines of `rows` (key, line_pos, line) that belong to a numbered question, skipped ones
    gone. A line of three characters at most goes unless it continues; a longer one goes while nothing of its block is kept."""
    found = rows.where(~sheets.is_skipped(F.col("line"))).withColumn("_n", sheets.paper_number(F.col("line")))
    order = W.partitionBy(key).orderBy("line_pos")
    found = found.withColumn("block", F.count("_n.qno").over(order)).where("block > 0")
    found = found.withColumn("line", F.col("_n.rest")).withColumn("_sure", F.when(F.col("_n.qno").isNotNull(), F.col("line") != "").otherwise(sheets.continues(F.col("line"))))
    earlier = F.max("_sure").over(W.partitionBy(key, "block").orderBy("line_pos").rowsBetween(W.unboundedPreceding, -1))
    kept = F.col("_sure") | (F.col("_n.qno").isNull() & (F.length("line") > 3) & F.coalesce(earlier, F.lit(False)))
    return found.withColumn("_kept", kept).where("_kept").select(key, "block", "line_pos", "line")


def questions(rows: DataFrame, key: str) -> DataFrame:
    """key, block, question: the lines of `question_lines` joined; texts too short or of punctuation only are no questions."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_pos", "line"))), lambda x: x["line"]), " ")
    return question_lines(rows, key).groupBy(key, "block").agg(F.trim(joined).alias("question")).where(sheets.is_question(F.col("question")))


def with_sounds(base: Column, weights: Column, found: Column, sounds: Column) -> Column:
    """The keyword score `base` (0 to 10), plus weight times similarity of sounds of each missing keyword that sounds alike."""
    gains = F.transform(F.arrays_zip(weights.alias("w"), found.alias("f"), sounds.alias("s")), lambda x: F.when((x["f"] < fuzzy.FULL) & (x["s"] >= SOUNDS_ALIKE), x["w"] * x["s"]).otherwise(0.0))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return F.when((add(gains) == 0) | (add(weights) <= 0), base).otherwise(F.round(scoring.at_most(base + 10 * add(gains) / add(weights), 10.0), 2))


def sounds(rows: DataFrame, keywords: str = "keywords", answer: str = "answer") -> DataFrame:
    """`rows` with sounds: the ratio of each keyword (array of words) with the answer, both in their phonetic form."""
    held = rows.withColumn("_k", F.transform(keywords, lambda k: F.lower(sheets.phonetic(k)))).withColumn("_a", F.lower(sheets.phonetic(F.col(answer))))
    return held.withColumn("sounds", fuzzy.ratios("_k", "_a")).drop("_k", "_a")


def contradiction(answer: Column, model: Column, judge: Callable[[Column, Column], Column] | None = None) -> Column:
    """How much an answer contradicts the model answer, 0 to 1, by `judge`; 0 if there is none, a text is blank or it fails (null)."""
    if judge is None:
        return F.lit(0.0)
    blank = (text.word_count(answer) == 0) | (text.word_count(model) == 0)
    judged = judge(answer, model)
    return F.when(blank | judged.isNull(), 0.0).otherwise(scoring.clamp(judged, 0.0, 1.0))


def single_answers(rows: DataFrame, semantic: Column, judge=None) -> DataFrame:
    """`rows` (answer, model_answer, keywords of word and weight, max_marks) with score_out_of_10, scaled_marks, matched and
    missing. `semantic` (0 to 10) comes from an embedding model. No concepts; length is judged by ten marks. A tenth
    of `semantic` is the confidence: answers that are irrelevant by it or have under three words get no marks and miss all
    keywords, partial ones get 2.0 at most."""
    rows = rows.withColumn("_clean", text.preprocess(sheets.repaired(F.col("answer"))))
    words = F.transform("keywords", lambda k: k["word"])
    rows = rows.withColumn("_words", words).withColumn("_plain", F.transform("_words", text.preprocess))
    rows = rows.withColumn("_found", fuzzy.ratios("_plain", "_clean"))
    n = text.word_count(F.col("_clean"))
    band = scoring.band(semantic / 10, n)
    none = scoring.no_marks(band)
    keyword = scoring.rounded(fuzzy.keyword_score(F.transform("keywords", lambda k: k["weight"]), F.col("_found")), 2)
    raw = scoring.raw_score(semantic, keyword, F.lit(0.0), contradiction(F.col("_clean"), F.col("model_answer"), judge))
    marks = scoring.rounded(scoring.banded_marks(raw, scoring.length_adjustment(scoring.length_factor(n, F.lit(10))), band), 2)
    out = rows.withColumn("score_out_of_10", marks).withColumn("scaled_marks", scoring.rounded(F.col("score_out_of_10") / 10 * F.col("max_marks"), 2))
    out = out.withColumn("matched", F.when(none, F.array().cast("array<string>")).otherwise(fuzzy.matched(F.col("_words"), F.col("_found"))))
    out = out.withColumn("missing", F.when(none, F.col("_words")).otherwise(fuzzy.missing(F.col("_words"), F.col("_found"))))
    return out.drop("_clean", "_words", "_plain", "_found")


@lru_cache(maxsize=1024)
def _model_bag(model: str):
    return vectors.bags([model.split()])[0]


@F.pandas_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("found", T.ArrayType(T.DoubleType())), T.StructField("flags", T.ArrayType(T.BooleanType())), T.StructField("similarity", T.DoubleType())]))
def looked_through(keywords: pd.Series, concepts: pd.Series, answer: pd.Series, model: pd.Series) -> pd.DataFrame:
    """What reads all of an answer (cleaned, like `model`), at one go: its number of words, the ratios of keywords, which concepts
    are covered and the similarity with the model answer by `vectors`, if there is one."""
    out = [None] * len(answer)
    keys = [(tuple(ks) if ks is not None else (), tuple(map(tuple, gs)) if gs is not None else ()) for ks, gs in zip(keywords, concepts, strict=True)]
    answers, models = list(answer), list(model)
    for (ks, groups), places in fuzzy.alike(keys, answers):
        texts = [answers[at] for at in places]
        words = [x.split() for x in texts]
        found = fuzzy._ratios_many(ks, texts, words)
        flags = fuzzy._covered_many(groups, texts, words, [dict(zip(ks, x, strict=True)) for x in found])
        bags = vectors.bags(words) if any(models[at] for at in places) else words
        for at, w, x, hits, bag in zip(places, words, found, flags, bags, strict=True):
            out[at] = (len(w), x, hits, vectors.likeness(bag, _model_bag(models[at])) if models[at] else None)
    return pd.DataFrame(out, columns=["n", "found", "flags", "similarity"], index=answer.index)


def final(rows: DataFrame, judge=None) -> DataFrame:
    """`rows` with the 21 columns of a whole evaluation. Taken: answer, model_answer, similarity (cosine of the two texts' vectors; if
    there is no such column it is added, by `vectors`), keywords (word, weight), concepts (groups of synonyms), max_marks.

    Under three words: zeros, all keywords missing and all concepts missed. A confidence below 0.20: the same, but semantic_score
    and confidence stay. From 0.20 to 0.35: final_marks are 2.0 at most. Decimals are rounded by `scoring.rounded`, when they are
    given out: contradiction and confidence count unrounded. A null similarity: the answer can't be evaluated, scores and marks
    that follow from it are null, and feedback says so."""
    rows = rows.withColumn("student_answer_clean", text.preprocess(F.col("answer"))).withColumn("_model", text.preprocess(F.col("model_answer")))
    rows = rows.withColumn("_words", F.transform("keywords", lambda k: k["word"])).withColumn("_labels", F.transform(F.filter("concepts", lambda g: F.size(g) > 0), lambda g: g[0]))
    given = "similarity" in rows.columns
    seen = looked_through(F.transform("_words", text.preprocess), "concepts", "student_answer_clean", F.lit(None).cast("string") if given else F.col("_model"))
    rows = rows.withColumn("_seen", seen).withColumns({"_n": F.col("_seen.n"), "_found": F.col("_seen.found"), "_flags": F.col("_seen.flags"), **({} if given else {"similarity": F.col("_seen.similarity")})})
    sure = scoring.clamp(F.col("similarity").cast("double"), 0.0, 1.0)
    rows = rows.withColumn("_band", scoring.band(sure, F.col("_n"))).drop("_seen")
    none, empty = scoring.no_marks(F.col("_band")), F.col("_band") == "empty"
    no_words = F.array().cast("array<string>")
    zero = lambda c: F.when(none, 0.0).otherwise(c)

    def put(to: DataFrame, **given) -> DataFrame:
        """`to` with each column (value, digits): the value goes into a column first, as `scoring.rounded` names it many times."""
        to = to.withColumns({f"_{k}": c for k, (c, _) in given.items()})
        return to.withColumns({k: scoring.rounded(F.col(f"_{k}"), digits) for k, (_, digits) in given.items()}).drop(*(f"_{k}" for k in given))

    factor, adjustment = F.col("_factor"), F.col("_adjustment")
    out = rows.withColumn("_factor", scoring.length_factor(F.col("_n"), F.col("max_marks"))).withColumn("_adjustment", scoring.length_adjustment(factor)).withColumn("_against", zero(contradiction(F.col("student_answer_clean"), F.col("_model"), judge)))
    out = put(out, semantic_score=(F.when(empty, 0.0).otherwise(sure * 10), 2), confidence=(F.when(empty, 0.0).otherwise(sure), 4), keyword_score=(zero(fuzzy.keyword_score(F.transform("keywords", lambda k: k["weight"]), F.col("_found"))), 2),
              concept_score=(zero(fuzzy.concept_score(F.col("_flags"))), 2), contradiction_score=(F.col("_against"), 4))
    out = put(out, raw_score=(zero(scoring.raw_score(F.col("semantic_score"), F.col("keyword_score"), F.col("concept_score"), F.col("_against"))), 4), length_factor=(zero(factor), 4), length_adjustment=(zero(adjustment), 4))
    out = put(out, final_marks=(scoring.banded_marks(F.col("raw_score"), adjustment, F.col("_band")), 2))
    out = put(out, final_score=(scoring.scaled(F.col("final_marks"), F.col("max_marks")), 4)).withColumn("rounded_score", scoring.at_most(scoring.half_step(F.col("final_score")), F.col("max_marks").cast("double")))
    out = out.withColumn("matched_keywords", F.when(none, no_words).otherwise(fuzzy.matched(F.col("_words"), F.col("_found")))).withColumn("missing_keywords", F.when(none, F.col("_words")).otherwise(fuzzy.missing(F.col("_words"), F.col("_found"))))
    labelled = lambda hit: F.transform(F.filter(F.arrays_zip(F.col("concepts").alias("g"), F.col("_flags").alias("f")), lambda x: (x["f"] == F.lit(hit)) & (F.size(x["g"]) > 0)), lambda x: x["g"][0])
    out = out.withColumn("covered_concepts", F.when(none, no_words).otherwise(labelled(True))).withColumn("missed_concepts", F.when(none, F.col("_labels")).otherwise(labelled(False)))
    lines = scoring.feedback(F.col("_band"), F.col("_against"), factor, F.col("semantic_score"), sure, F.col("missed_concepts"), F.col("missing_keywords"), F.size("_words"))
    out = out.withColumn("feedback", lines).withColumn("semantic_weight", F.lit(scoring.W_SEMANTIC)).withColumn("keyword_weight", F.lit(scoring.W_KEYWORD))
    out = out.withColumn("is_irrelevant", F.col("_band") == "irrelevant").withColumn("is_partially_relevant", F.col("_band") == "partial")
    return out.drop("_model", "_words", "_labels", "_n", "_band", "_found", "_flags", "_against", "_factor", "_adjustment")


def separate_uploads(questions: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, question, answer, status, pos. Each question row, repeats too, carries the last answer with its number; answers
    without a question, repeats too, are skipped. Numbers without text are no numbers. Both sides: qno, pos and their text."""
    canonical = text.canonical_qno(F.col("qno"), whole=True)
    q, a = (side.withColumn("qno", canonical).where("qno != ''") for side in (questions, answers))
    by = [*keys, "qno"]
    last = a.groupBy(*by).agg(F.max_by("answer", "pos").alias("answer"))
    asked = q.join(last, by, "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    asked = asked.select(*by, "question", "answer", F.when(text.word_count(F.col("answer")) > 0, "evaluated").otherwise("no_answer").alias("status"), "pos")
    stray = a.join(q, by, "left_anti").select(*by, F.lit("").alias("question"), "answer", F.lit("skipped").alias("status"), "pos")
    return asked.unionByName(stray)


def totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total_marks, max_total_marks, percentage, and a count of each status, from scaled_marks, max_marks, status."""
    counted = [F.count_if(F.col("status") == s).alias(s) for s in ("evaluated", "no_answer", "skipped", "error")]
    sums = rows.groupBy(*keys).agg(F.round(F.sum("scaled_marks"), 2).alias("total_marks"), F.round(F.sum("max_marks"), 2).alias("max_total_marks"), *counted)
    return sums.withColumn("percentage", F.when(F.col("max_total_marks") > 0, F.round(F.col("total_marks") / F.col("max_total_marks") * 100, 1)).otherwise(0.0))


def observed(rows: DataFrame, score: str = "rounded_score") -> tuple[DataFrame, Observation]:
    """`rows` of whole evaluations, and an observation of them that the first job which reads them fills: n, mean, low, high and
    deviation (of the population) of the score, n_irrelevant, n_partial, n_contradicting (0.5 or more) and n_unevaluable (null score).
    No second pass over the rows is needed. `Observation.get` waits for that job."""
    seen, c = Observation(), F.col(score)
    counted = {"n_irrelevant": F.col("is_irrelevant"), "n_partial": F.col("is_partially_relevant"), "n_contradicting": F.col("contradiction_score") >= 0.5, "n_unevaluable": c.isNull()}
    figures = [F.count("*").alias("n"), F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"), F.stddev_pop(c).alias("deviation")]
    return rows.observe(seen, *figures, *(F.count_if(x).alias(k) for k, x in counted.items())), seen


def console(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """line: each row as a block of "label : value" lines, labels padded to 38; a null value as "-"."""
    return rows.select(F.concat_ws("\n", *(F.concat(F.lit(f"  {label:<38}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c, label in labels.items())).alias("line"))
