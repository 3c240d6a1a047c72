"""The scoring formula, step by step, as Catalyst expressions. All scores are doubles; lists are arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
W_SEMANTIC, W_KEYWORD, W_CONCEPT, W_CONTRADICTION = 0.5, 0.25, 0.25, 0.5
IRRELEVANT, PARTLY = 0.20, 0.35
PARTIAL_CAP = 2.0
LEAST_WORDS = 3
WORDS_PER_MARK, LENGTH_SHARE, LENGTH_FLOOR, LENGTH_REST = 15, 0.35, 0.85, 0.15


def at_most(c: Column, top) -> Column:
    """The smaller of two; null for a null `c`, which Spark's least would pass over."""
    return F.when(c.isNotNull(), F.least(c, top if isinstance(top, Column) else F.lit(top)))


def clamp(c: Column, low: float, high: float) -> Column:
    """`c` within bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def rounded(c: Column, digits: int) -> Column:
    """`c` (doubles of up to some millions) at `digits` decimals by its exact binary value, ties to the even digit: 2.675 is below
    its tie and gives 2.67, 7.125 is its tie and gives 7.12. Spark's round takes the shortest decimal text of a double instead.

    The product with the power of ten is exact as p + error: c is cut in two, whose products need no rounding."""
    m, size = F.lit(10.0**digits), F.abs(c)
    p, high = size * m, F.floor(size * 2.0**26) / 2.0**26
    below = F.floor(p)
    rest = (p - below - 0.5) + ((high * m - p) + (size - high) * m)
    up = (rest > 0) | ((rest == 0) & (below % 2 == 1))
    return F.signum(c) * (below + F.when(up, 1).otherwise(0)) / m


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors: their dot product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def relevance(confidence: Column) -> Column:
    """The band of a confidence; "unevaluable" where there is none."""
    return F.when(confidence.isNull(), "unevaluable").when(confidence < IRRELEVANT, "irrelevant").when(confidence < PARTLY, "partial").otherwise("relevant")


def band(confidence: Column, words: Column) -> Column:
    """The band of relevance of an answer; "empty" if it has fewer than LEAST_WORDS words."""
    return F.when(words < LEAST_WORDS, "empty").otherwise(relevance(confidence))


def no_marks(band: Column) -> Column:
    return band.isin("empty", "irrelevant")


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.75, "High").when(c >= 0.45, "Medium").otherwise("Low")


def length_factor(words: Column, max_marks: Column) -> Column:
    return F.when(words <= 0, 0.0).otherwise(at_most(words / (F.lit(LENGTH_SHARE) * WORDS_PER_MARK * F.greatest(max_marks, F.lit(1))), 1.0))


def length_adjustment(factor: Column) -> Column:
    return at_most(LENGTH_FLOOR + LENGTH_REST * factor, 1.0)


def raw_score(semantic: Column, keyword: Column, concept: Column, contradiction: Column) -> Column:
    return clamp((W_SEMANTIC * semantic + W_KEYWORD * keyword + W_CONCEPT * concept) * (1 - W_CONTRADICTION * contradiction), 0.0, 10.0)


def final_marks(raw: Column, adjustment: Column, partly: Column) -> Column:
    marks = raw * adjustment
    return clamp(F.when(partly, at_most(marks, PARTIAL_CAP)).otherwise(marks), 0.0, 10.0)


def banded_marks(raw: Column, adjustment: Column, band: Column) -> Column:
    """Final marks by the answer's band: none for empty and irrelevant ones, PARTIAL_CAP at most for partial ones. Those that
    can't be evaluated, for want of a confidence or of a part of the raw score, have null marks."""
    return F.when(no_marks(band), 0.0).when(band == "unevaluable", F.lit(None).cast("double")).otherwise(final_marks(raw, adjustment, band == "partial"))


def scaled(marks: Column, max_marks: Column) -> Column:
    return at_most(marks * max_marks / 10, max_marks.cast("double"))


def half_step(c: Column) -> Column:
    """To halves, ties to the even half."""
    return F.rint(c * 2) / 2


def percentage(total: Column, most: Column) -> Column:
    return F.when(most > 0, 100 * total / most).otherwise(F.lit(0.0))


def older_weights(n_keywords: Column) -> Column:
    """Semantic and keyword weight of the older formula."""
    return F.when(n_keywords > 8, F.array(F.lit(0.6), F.lit(0.4))).otherwise(F.array(F.lit(0.7), F.lit(0.3)))


def confidence_adjustment(marks: Column, confidence: Column) -> Column:
    return clamp(marks * (0.8 + 0.2 * confidence), 0.0, 10.0)


def feedback(band: Column, contradiction: Column, factor: Column, semantic: Column, confidence: Column, missed: Column, missing: Column, n_keywords: Column) -> Column:
    """Lines of feedback, as an array: one line for answers that are off, else a line for each weakness, else praise."""
    named = lambda a, n: F.concat(F.array_join(F.slice(a, 1, n), ", "), F.when(F.size(a) > n, " and more").otherwise(""))
    weak = F.filter(
        F.array(
            F.when(contradiction >= 0.5, F.concat(F.lit("The answer contradicts the model answer ("), F.format_number(contradiction, 2), F.lit(")."))),
            F.when(factor < 0.35, F.lit("The answer is too short.")),
            F.when(semantic < 6.0, F.lit("The meaning differs from the model answer.")),
            F.when(confidence < 0.45, F.lit("The match with the model answer is uncertain.")),
            F.when(F.size(missed) > 0, F.concat(F.lit("Concepts not covered: "), named(missed, 4))),
            F.when(F.size(missing) > 0, F.concat(F.when(F.size(missing) >= 0.5 * n_keywords, "Many keywords are missing: ").otherwise("Keywords to add: "), named(missing, 5))),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        F.when(band == "empty", F.array(F.lit("There is no answer.")))
        .when(band == "unevaluable", F.array(F.lit("The answer could not be evaluated.")))
        .when(band == "irrelevant", F.array(F.lit("The answer isn't about the question.")))
        .when(band == "partial", F.array(F.lit("The answer is about the question in part only.")))
        .when(F.size(weak) == 0, F.array(F.lit("Good answer.")))
        .otherwise(weak)
    )
