"""Quality rules: base rules, and robust multivariate outliers by minimum-covariance-determinant (MCD) estimates.

DataFrame functions only. For each group of language and source, for each language and for all documents, the estimate seeks
the share SHARE of documents whose
statistics have the covariance of the least determinant. From two starts (sum and largest of the distances from the median in
units of the median absolute deviation) STEPS concentration steps follow: take the documents of the smallest distances, set
mean and covariance anew, measure distances again. The start that ends with the smaller determinant counts. Every group is
judged by its own estimate, blended with its language's and that of all by n / (n + PRIOR), so no verdict depends on which side
of a limit the size of its group is. A document is
rejected if its squared Mahalanobis distance passes CUT, the 1 - TAIL quantile of chi-square, the covariance being scaled to
be right for normal data.

Documents are read once, into a narrow table of statistics. A step is two aggregations over it with partial sums on the map
side: mean and covariance, and a percentile of distances in fixed classes (1/50 of their logarithm), so buffers are bounded and
reruns agree. Tables of groups are broadcast where they are few; else large groups are, and only rows of the others are shuffled. The statistics are compared by 64-bit hashes of word triples within a document only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, let, read, settle, spread_join

SHARE = 0.75
STEPS = 4
TAIL = 1e-6
#: How many documents a group's own estimate needs to weigh as much as that of its language (and a language's, as that of all).
PRIOR = 60
#: Estimates (30 numbers a group) are broadcast up to this many groups, some 10 MB; beyond it only large groups are.
FEW_GROUPS = 20_000
#: The transformed statistics, and the least standard deviation that each is taken to have.
FLOORS = {"size": 0.3, "word_length": 0.3, "symbols": 0.06, "repeats": 0.1, "lines": 0.6}
P = len(FLOORS)
X = [f"x{i}" for i in range(P)]


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, h = k / 2, x / 2
    if h <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return low


CUT = chi2_quantile(1 - TAIL, P)
SCALE = SHARE / chi2_cdf(chi2_quantile(SHARE, P), P + 2)


def repeated(words: Column) -> Column:
    """How many words stand in a window of three words that the array holds twice or more."""

    def of(w):
        windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        again = lambda s: F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
        places = let(F.sort_array(windows), lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"])))
        steps = let(places, lambda p: F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(words, of)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) of whole texts; null: empty."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    both = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated(w).alias("r")))
    return docs.select(
        "doc_id", "lang", "source", both.alias("w"),
        F.length(F.translate(text, SPACES, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", *(F.col(a).cast("long").alias(b) for a, b in (("w.n", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_dup_lines", "n_dup_lines"), ("w.r", "n_repeat_words"))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """Log size, mean word length, roots of the shares of symbols and repeats, log repeated lines: steadier than the counts."""
    return [F.log1p("n_words"), F.try_divide("word_chars", "n_words"), F.sqrt(F.try_divide("n_symbols", "word_chars")), F.sqrt(F.try_divide("n_repeat_words", "n_words")), F.log1p("n_dup_lines")]


def _level(d2: Column) -> Column:
    return F.round(50 * F.log(d2 + 1e-6)).cast("long")


def _cholesky(t: DataFrame) -> DataFrame:
    """Adds l_i_j, the factor of the covariance c_i_j (with the floors on its diagonal), and log_det."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}") + (list(FLOORS.values())[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            t = t.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return t.withColumn("log_det", sum((2 * F.log(f"l_{i}_{i}") for i in range(P)), F.lit(0.0)))


def _distance() -> Column:
    """Squared Mahalanobis distance of x_i from m_i by forward substitution."""
    y: list[Column] = []
    for i in range(P):
        v = F.col(X[i]) - F.col(f"m_{i}")
        for k in range(i):
            v = v - F.col(f"l_{i}_{k}") * y[k]
        y.append(v / F.col(f"l_{i}_{i}"))
    return sum((v * v for v in y), F.lit(0.0))


def _per_group(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """`rows` with the columns of their group (`g`, of `n` rows; once for each row of `groups`): broadcast if `few`, else only the
    large groups are."""
    return rows.join(F.broadcast(groups), "g").drop("n") if few else spread_join(rows, groups, "g", "n", "inner")


def mcd(rows: DataFrame) -> DataFrame:
    """g -> n, m_i, c_i_j: number of rows, location and scatter of each group g of `rows` (g, x0..; settled)."""
    fine = [F.round(100 * F.col(x)) for x in X]
    middle = rows.groupBy("g").agg(F.count("*").alias("n"), *(F.percentile(v, 0.5).alias(f"m_{i}") for i, v in enumerate(fine)))
    middle = settle(middle.select("g", "n", *((F.col(f"m_{i}") / 100).alias(f"m_{i}") for i in range(P))))
    few = middle.count() <= FEW_GROUPS
    off = _per_group(rows, middle, few).select("g", *(F.round(100 * F.abs(F.col(x) - F.col(f"m_{i}"))).alias(x) for i, x in enumerate(X)))
    spread = off.groupBy("g").agg(*(F.percentile(x, 0.5).alias(f"s_{i}") for i, x in enumerate(X)))
    spread = spread.select("g", *(F.greatest(0.014826 * F.col(f"s_{i}"), F.lit(f)).alias(f"s_{i}") for i, f in enumerate(FLOORS.values())))
    starts = F.explode(F.array(F.lit("sum"), F.lit("max"))).alias("s")
    estimate = settle(middle.join(spread, "g").select("g", "n", starts, *(f"m_{i}" for i in range(P)), *(f"s_{i}" for i in range(P))))

    z = [((F.col(x) - F.col(f"m_{i}")) / F.col(f"s_{i}")) ** 2 for i, x in enumerate(X)]
    d2 = F.when(F.col("s") == "sum", sum(z[1:], z[0])).otherwise(F.greatest(*z))
    for _ in range(STEPS):
        near = _per_group(rows, estimate, few).groupBy("g", "s").agg(F.percentile(_level(d2), SHARE).alias("upto"))
        limits = estimate.join(near, ["g", "s"])
        inside = _per_group(rows, limits if few else settle(limits), few).where(_level(d2) <= F.col("upto"))
        moments = inside.groupBy("g", "s").agg(*(F.avg(x).alias(f"m_{i}") for i, x in enumerate(X)), *((F.covar_pop(X[i], X[j]) * SCALE).alias(f"c_{i}_{j}") for i in range(P) for j in range(i + 1)))
        estimate = settle(_cholesky(middle.select("g", "n").join(moments, "g")))
        d2 = _distance()
    kept = [c for c in estimate.columns if c[:2] in ("m_", "c_")]
    return estimate.groupBy("g", "n").agg(F.min_by(F.struct(*kept), F.struct("log_det", "s")).alias("e")).select("g", "n", "e.*")


def blended(found: DataFrame, groups: DataFrame) -> DataFrame:
    """g0 -> n, m_i, l_i_j for `groups` (g0 and its pools g1, g2, all in `found`): location and scatter of a group weigh n / (n + PRIOR)
    beside its language's, and these in the same way beside those of all."""
    names = [c for c in found.columns if c not in ("g", "n")]
    level = lambda k: found.select(F.col("g").alias(f"g{k}"), (F.col("n") / (F.col("n") + PRIOR)).alias(f"w{k}"), *(F.col(c).alias(f"{c}_of{k}") for c in names), *(["n"] if k == 0 else []))
    t = groups.join(level(0), "g0").join(level(1), "g1").join(level(2).drop("w2"), "g2")
    mix = lambda w, own, other: F.col(w) * own + (1 - F.col(w)) * other
    t = t.select("g0", "n", *(mix("w0", F.col(f"{c}_of0"), mix("w1", F.col(f"{c}_of1"), F.col(f"{c}_of2"))).alias(c) for c in names))
    return _cholesky(t).drop("log_det")


def judge(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, the counts of statistics(), base_failed, distance (squared; null without a verdict), kept.

    Estimates come from the documents that pass the base rules: one for each language and source (null is a value of its own),
    however few they are, drawn towards that of the language and that of all the more the fewer there are (`blended`). Rows that
    repeat an id each get a row and count."""
    rows = statistics(docs).withColumn("base_failed", base_failed())
    levels = (F.to_json(F.struct(F.lit(k).alias("pool"), *c)) for k, c in enumerate((["lang", "source"], ["lang"], [])))
    rows = settle(rows.select(*(g.alias(f"g{k}") for k, g in enumerate(levels)), "*", *(v.cast("double").alias(x) for v, x in zip(vector(), X, strict=True))))
    passed = rows.where("NOT base_failed")
    pools = settle(passed.select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *X))
    own = settle(blended(settle(mcd(pools)), passed.select("g0", "g1", "g2").distinct()).withColumnRenamed("g0", "g"))
    few = own.count() <= FEW_GROUPS
    plain = [c for c in rows.columns if c not in ("g1", "g2")]
    judged = _per_group(passed.select(*plain).withColumnRenamed("g0", "g"), own, few).withColumn("distance", _distance())
    failed = rows.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    columns = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance"]
    out = judged.select(*columns).unionByName(failed.select(*columns))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its statistics and verdicts. Null texts have no words and fail the base rules; other columns are not read."""
    return judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
