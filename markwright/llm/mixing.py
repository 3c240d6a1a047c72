"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per source, targets are set from weights, and a document of a source with the repetition rate r (its
target / its size) is emitted floor(r) times, plus once more if a coin seeded by its id falls below r - floor(r). Coins of
texts of very unequal sizes may leave a source far from its target, so the threshold of its coins isn't r - floor(r) itself but
the coin nearest to it in words: in the order of their coins, texts are copied as long as the middle of the text lies within
the words that are to be copied. That is off by half a text at most (texts of one id count as one), and the more texts a
source has, the nearer is its threshold to r - floor(r).
The table of sources is small beside the documents (one row a source); it is joined without a hint, so that Spark
broadcasts it only below its own size threshold and else splits the hot source's partition (adaptive skew join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, free_name, read, settle, with_sums

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> also target. All sizes together are shared by weight, dealt to the sources in the order of
    their code points (null last). No target passes `most` times its source's size; what is over goes to the others by
    weight, until none is above. With sources in the order of cap / weight, those before the first that the remaining
    share leaves below its cap stand at their cap, the rest get the share. Sources of size 0 get 0."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_level = W.orderBy(F.col("level"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    t = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    t = t.withColumn("level", F.col("cap") / F.col("weight"))
    t = t.select(
        "*",
        (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left_weight"),
    )
    t = t.withColumn("share", F.when(F.col("left") < F.col("level") * F.col("left_weight"), F.col("left") / F.col("left_weight")))
    share = F.min("share").over(every)  # of the first one below its cap: the share only grows from there
    first = F.first("share", ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    share = F.coalesce(first, share)
    return t.select("source", "source_size", F.when(share.isNull() | (F.col("level") <= share), F.col("cap")).otherwise(share * F.col("weight")).alias("target"))


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1), from 52 bits of the MD5 of the id and the seed."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rate_of(target: Column, source_size: Column) -> Column:
    return F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))


def thresholds(per: DataFrame, coins: DataFrame, most: int = MOST) -> DataFrame:
    """`per` (source, source_size, target; settled) with `floor`, the copies of every document of the source, and `below`, the
    largest coin that gives one more (null: none). coins: source, coin, size of each document.

    Sums over all documents in the order of source and coin are made in ranges (`with_sums`), so a hot source is spread."""
    each = coins.groupBy("source", "coin").agg(F.sum("size").alias("size"))
    summed = settle(with_sums(each, ["source", "coin"], {"upto": F.col("size")}))
    starts = summed.groupBy("source").agg(F.min(F.col("upto") - F.col("size")).alias("start"))
    rate = rate_of(F.col("target"), F.col("source_size"))
    p = per.join(starts.withColumnRenamed("source", "start_of"), F.col("source").eqNullSafe(F.col("start_of")))
    p = settle(p.select("source", "source_size", "target", "start", F.least(F.floor(rate), F.lit(most)).cast("long").alias("floor"), ((rate - F.floor(rate)) * F.col("source_size")).alias("more")))
    chosen = summed.join(p.select(F.col("source").alias("key"), "start", "more"), F.col("source").eqNullSafe(F.col("key")))
    chosen = chosen.where((F.col("more") > 0) & ((2 * (F.col("upto") - F.col("start")) - F.col("size")).cast("double") <= 2 * F.col("more")))
    chosen = chosen.groupBy("source").agg(F.max("coin").alias("below"))
    return p.join(chosen.withColumnRenamed("source", "key"), F.col("source").eqNullSafe(F.col("key")), "left").select("source", "source_size", "target", "floor", "below")


def copies_of(floor: Column, toss: Column, below: Column, most: int) -> Column:
    return F.least(floor + F.coalesce(toss <= below, F.lit(False)).cast("long"), F.lit(most)).cast("long")


def plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row for each document: doc_id, source, size (words), source_size, target, copies.

    A null text has size 0; a null source is a source of its own; rows that repeat an id share its coin. Empty in, empty out."""
    sized = settle(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), coin(F.col("doc_id"), seed).alias("coin")))
    per = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    per = settle(thresholds(per, sized, most))
    joined = sized.alias("d").join(per.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return joined.select("doc_id", "d.source", "size", "source_size", "target", copies_of(F.col("floor"), F.col("coin"), F.col("below"), most).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of `docs`, with all its columns, as many times as its source's rate and its coin say.

    The texts are neither shuffled nor sorted: only the table of sources is joined to them, and sums are made of sizes and
    coins. Nulls, repeats and empty tables as in `plan`; names of columns may clash with none of the operator's own."""
    sized = settle(docs.select("source", n_words(F.col("text")).alias("size"), coin(F.col("doc_id"), seed).alias("coin")))
    per = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    key, floor, below, times = free_name(docs, "mix_source", "mix_floor", "mix_below", "mix_copy")
    per = settle(thresholds(per, sized, most)).select("source", "floor", "below").toDF(key, floor, below)
    joined = docs.join(per, docs["source"].eqNullSafe(per[key])).withColumn(times, copies_of(F.col(floor), coin(F.col("doc_id"), seed), F.col(below), most).cast("int"))
    return joined.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the mix over all `documents`; taken is size times copies. Nulls, repeats and empty tables as in `plan`."""
    p = plan(read(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
l AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, CAST(3 * source_size AS DOUBLE) / weight AS level FROM w),
b AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER q, 0) AS left_, sum(weight) OVER () - coalesce(sum(weight) OVER q, 0) AS left_weight
  FROM l WINDOW q AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(left_ / left_weight, level) AS share FROM b WHERE left_ < level * left_weight),
t AS (SELECT source, source_size, CASE WHEN share IS NULL OR level <= share THEN cap ELSE share * weight END AS target FROM b, f),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST(CAST('0x' || md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':{SEED}')[1:13] AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT source, coin, sum(size) AS size, any_value((rate - floor(rate)) * source_size) AS more FROM r GROUP BY source, coin),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY coin) AS upto FROM e),
h AS (SELECT source, max(coin) AS below FROM o WHERE more > 0 AND CAST(2 * upto - size AS DOUBLE) <= 2 * more GROUP BY source)
SELECT doc_id, size, source_size, target, size * CAST(least(floor(rate) + CASE WHEN coin <= below THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM r LEFT JOIN h ON r.source IS NOT DISTINCT FROM h.source
"""
