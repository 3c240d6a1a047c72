"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each step looks at more of a text and only at the groups that the step before left with two texts or more. Texts are never
shuffled: only lengths, hashes and ids are. Group tables have one row a group, made by partial aggregation on the map side,
so a group of a third of all rows costs a row a task; where each row gets its group, large groups go to their rows instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, read, settle, spread_join

PREFIX = 64


def normal(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def groups(docs: DataFrame, all_hashes: bool = False) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after normal(). keep_id: the smallest id of those with an equal text (null only if all
    are null). kept: this row has it; rows that repeat both id and text are one document and share the verdict. group_size
    counts rows. text_sha256 is null where a shorter look settled that the text is alone, unless `all_hashes`.
    Null and empty texts are equal to each other; an empty table gives an empty one; other columns are not read."""
    text = normal(F.col("text"))
    length, prefix = F.octet_length(text).alias("n"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("p")
    short = settle(docs.select(length, prefix))
    lengths = short.groupBy("n").count().where("count > 1").select("n")
    prefixes = settle(short.join(lengths, "n", "left_semi").groupBy("n", "p").count().where("count > 1").select("n", "p"))

    rows = docs.select("doc_id", length, prefix, "text")
    found = prefixes.withColumn("again", F.lit(True))
    digest = sha256(normal(F.col("text")))
    if prefixes.count() <= BROADCAST_ROWS:  # the lookup goes to the texts
        rows = rows.join(F.broadcast(found), ["n", "p"], "left")
        rows = rows.select("doc_id", "again", (digest if all_hashes else F.when(F.col("again"), digest)).alias("text_sha256"))
    else:  # or the hashes to the lookup
        rows = rows.select("doc_id", "n", "p", digest.alias("text_sha256")).join(found, ["n", "p"], "left")
        rows = rows.select("doc_id", "again", F.col("text_sha256") if all_hashes else F.when(F.col("again"), F.col("text_sha256")).alias("text_sha256"))
    rows = settle(rows)
    equal = rows.where("again").groupBy("text_sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("members")).where("members > 1")
    out = spread_join(rows, settle(equal.withColumn("size", F.col("members"))), "text_sha256", "size")
    keep = F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("first_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("members", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """`docs`, all columns, without the rows whose text an earlier id has; of rows that repeat id and text one stays.

    Only copies are looked up: ids with their hash. The texts are not shuffled while that table is small; beyond
    BROADCAST_ROWS an anti join deals them out by id, once."""
    found = settle(groups(docs))
    copies = found.where("group_size > 1")
    text, mark = free_name(docs, "dedup_sha256", "dedup_drop")
    gone = copies.where("NOT kept").select(F.col("doc_id").alias(mark), F.col("text_sha256").alias(text)).distinct()
    small = gone.count() <= BROADCAST_ROWS
    on = docs["doc_id"].eqNullSafe(gone[mark]) & (sha256(normal(docs["text"])) == gone[text])
    out = docs.join(F.broadcast(gone) if small else gone, on, "left_anti")
    again = copies.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select(F.col("doc_id").alias(mark), F.col("text_sha256").alias(text))
    if again.isEmpty():
        return out
    both = out.join(again, out["doc_id"].eqNullSafe(again[mark]) & (sha256(normal(out["text"])) == again[text]), "left")
    one = both.where(F.col(text).isNotNull()).dropDuplicates([mark, text])
    return both.where(F.col(text).isNull()).select(*docs.columns).union(one.select(*docs.columns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equals. Null texts count as empty, of equal ids the rows stay apart, empty tables give none."""
    return groups(read(spark, sf_dir, "documents"), all_hashes=True)


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
