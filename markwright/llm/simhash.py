"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, cut into two segments of 32. If two fingerprints differ in 2 bits or fewer, then either their
first segments differ in at most one bit, or their second segments are equal. So each fingerprint stands in a table under
both its segments, is looked up under its second segment and under the Hamming ball of radius 1 around its first, and what
the tables return is verified by the whole distance. (Of two first segments one bit apart, the one with the bit unset finds
the other.) More bits apart take more, shorter segments of radius 0 or 1 by the same rule.

Equal fingerprints are one row from the start. A segment value that more than HOT fingerprints share isn't joined pair by
pair: the fingerprints that such a lookup touches each list the 65 points of their whole ball of radius 1, and two at most
two bits apart have a point in common, so hanging each point's fingerprints on its smallest one gives the same components
in rows proportional to fingerprints. Links form components by star steps (components.py), never on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read, settle, spread_join
from .components import components

HOT = 256
SHINGLE = 3
AT_ONCE = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bit i is set if it is in over half of the XXH64 (seed 42) of all shingles of `width` words, repeats included.
    A-Z are lower-cased, words are runs without white space; fewer words than `width` make one shingle, none gives 0."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII spaces, nothing else
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        here = words[at : min(n, at + AT_ONCE) + width - 1]
        count = min(n, at + AT_ONCE) - at
        rolled = [here[k : k + count] for k in range(min(width, len(here)))]
        h = np.array([digest(b" ".join(s), 42) for s in zip(*rolled, strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * int(ones[i]) > n)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for each row. Null and empty texts have fingerprint 0."""

    def work(rows):
        for doc_id, text in rows:
            fp = fingerprint(text, width)
            yield doc_id, fp - (1 << 64) if fp >> 63 else fp

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, fp long")


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """u, v: links that give the components of "2 or fewer bits apart" among the distinct longs `fp`.

    All pairs at that distance, except that around segment values shared by more than `hot` fingerprints each point of a
    ball gives links to its smallest member only."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    table = F.array(F.struct(F.lit(0).alias("s"), high.alias("v")), F.struct(F.lit(1).alias("s"), low.alias("v")))
    entries = fps.select("fp", F.explode(table).alias("e")).select("fp", "e.s", "e.v")
    bits = F.array(*(F.lit(1 << i).cast("long") for i in range(32)))
    ball = F.transform(F.filter(bits, lambda b: high.bitwiseAND(b) == 0), lambda b: F.struct(F.lit(0).alias("s"), high.bitwiseOR(b).alias("v"), F.lit(False).alias("own")))
    own = F.array(F.struct(F.lit(0).alias("s"), high.alias("v"), F.lit(True).alias("own")), F.struct(F.lit(1).alias("s"), low.alias("v"), F.lit(True).alias("own")))
    lookups = fps.select("fp", F.explode(F.concat(own, ball)).alias("e")).select(F.col("fp").alias("q"), "e.s", "e.v", "e.own")

    crowded = settle(entries.groupBy("s", "v").count().where(F.col("count") > hot).select("s", "v"))
    none = crowded.isEmpty()
    if not none:
        touched = settle(lookups.join(crowded, ["s", "v"], "left_semi").select(F.col("q").alias("fp")).union(entries.join(crowded, ["s", "v"], "left_semi").select("fp")).distinct())
        entries, lookups = entries.join(crowded, ["s", "v"], "left_anti"), lookups.join(crowded, ["s", "v"], "left_anti")
    found = lookups.join(entries, ["s", "v"]).where((F.col("q") < F.col("fp")) | ~F.col("own"))
    out = found.where((distance("q", "fp") <= 2) & (F.col("q") != F.col("fp"))).select(F.col("q").alias("u"), F.col("fp").alias("v"))
    if none:
        return out
    points = F.concat(F.array(F.col("fp")), F.transform(F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64))), lambda i: F.col("fp").bitwiseXOR(i)))
    spread = touched.select("fp", F.explode(points).alias("point"))
    least = spread.groupBy("point").agg(F.min("fp").alias("first"))
    star = spread.join(least, "point").where("fp != first")
    return out.union(star.where(distance("fp", "first") <= 2).select(F.col("first").alias("u"), F.col("fp").alias("v")))


def classes(docs: DataFrame, width: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach, itself included.

    One row for each row of `docs`. Null and empty texts share fingerprint 0 and link like others. Rows that repeat an id or
    a text are alike. A component whose ids are all null has a null component_id. An empty table gives an empty one."""
    rows = settle(fingerprints(docs, width))
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("size")))
    roots = components(links(distinct.select("fp"), hot)).withColumnRenamed("node", "fp")
    of = settle(distinct.join(roots, "fp", "left").select("fp", "first_id", "size", F.coalesce("root", "fp").alias("root")))
    least = settle(of.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("k")))
    ids = settle(spread_join(of, least, "root", "k").select("fp", "component_id", "size"))
    return spread_join(rows, ids, "fp", "size").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id it is linked to. Null and empty texts have the fingerprint zero, linked like any other."""
    return classes(read(spark, sf_dir, "documents"))
