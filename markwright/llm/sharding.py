"""Minimax contiguous sharding: atomic groups in order, cut so that the largest shard is as small as it can be.

A capacity is feasible if shards, each filled with as many whole groups as it takes, cover all groups. The smallest such
capacity is found by binary search. Every check is a chain of lookups "last group end at or before x" in the running sums
of sizes, so the driver needs the sums near the cuts alone. It first gets the largest group end in each of BLOCKS equal
ranges of bytes. Between two known ends an unknown one may lie: taking the lower end or x itself bounds the true chain on
both sides, and so the capacity. Ranges that a chain within these bounds can hit are cut into BLOCKS finer ranges and asked
for again, until none is open; the answer is exact. Cuts are then moved among the known ends so that shards below that capacity
are near equal too (`even`), without asking again. The driver holds some 10 x BLOCKS numbers however many groups there are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, settle, spread_join, with_sums
from .exact_dedup import sha256

BLOCKS = 20_000


def greedy(ends: list[int], open_after: dict[int, int], capacity: int, shards: int, hopeful: bool) -> list[int]:
    """Where each shard ends, from 0. ends: sorted known group ends. open_after: ends after which unknown ones may come."""
    at, out = 0, []
    for _ in range(shards):
        x = at + capacity
        k = bisect_right(ends, x) - 1
        to = ends[k] if k >= 0 else 0
        if hopeful and to < x and to in open_after and k + 1 < len(ends):
            to = min(x, ends[k + 1] - 1)
        at = to
        out.append(at)
        if at >= ends[-1]:
            break
    return out


def smallest(ends: list[int], open_after, shards: int, low: int, hopeful: bool) -> int:
    """Binary search of the least capacity that covers all of `ends`."""
    high = ends[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, open_after, mid, shards, hopeful)[-1] >= ends[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def even(ends: list[int], shards: int, capacity: int) -> list[int]:
    """Where each shard ends, from 0, with shards of at most `capacity` (which must suffice) of near equal sizes: each shard is
    filled to the known end nearest to an equal share of what is left, the lower of two, but at least so far that the shards
    after it can take the rest, and no further than the capacity. ends: sorted known group ends."""
    least = [ends[-1]]
    for _ in range(shards - 1):
        x = least[-1] - capacity
        least.append(0 if x <= 0 else ends[bisect_left(ends, x)])
    at, out = 0, []
    for left, low in zip(range(shards, 0, -1), reversed(least), strict=True):
        a, b = bisect_left(ends, max(low, at)), bisect_right(ends, at + capacity)
        want = at + (ends[-1] - at) / left
        k = min(max(bisect_left(ends, want), a), b)
        at = min([at] * (low <= at) + ends[max(a, k - 1) : min(b, k + 1)], key=lambda e: (abs(e - want), e))
        out.append(at)
    return out


def cuts(group_ends: DataFrame, shards: int, largest: int, total: int, blocks: int = BLOCKS) -> list[int]:
    """The group end at which each shard ends, each as far as the smallest capacity allows. group_ends: `end`, the running sum at each group's end, all different."""
    ends, capacity = search(group_ends, shards, largest, total, blocks)
    return greedy(ends, {}, capacity, shards, hopeful=False)


def search(group_ends: DataFrame, shards: int, largest: int, total: int, blocks: int = BLOCKS) -> tuple[list[int], int]:
    """Known group ends, those of the greedy chain among them, and the smallest capacity that `shards` shards can have."""
    known: set[int] = set()
    unknown: dict[int, int] = {}  # known end -> the next known end, where more ends lie between
    asked = [(0, total)]
    while asked:
        # one job: the smallest and largest end, and the number of ends, in each block of each open range
        share = max(16, blocks // len(asked))
        ranges = group_ends.sparkSession.createDataFrame([(i, a, b, -(-(b - a) // share)) for i, (a, b) in enumerate(asked)], "i long, a long, b long, step long")
        inside = group_ends.join(F.broadcast(ranges), (F.col("end") > F.col("a")) & (F.col("end") <= F.col("b")))
        block = F.floor((F.col("end") - F.col("a") - 1) / F.col("step")).alias("block")
        got = inside.groupBy("i", block).agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count("*").alias("n")).collect()
        for a, _ in asked:
            unknown.pop(a, None)
        known |= {int(r[k]) for r in got for k in ("low", "high")}
        unknown |= {int(r["low"]): int(r["high"]) for r in got if r["n"] > 2}
        ends = sorted(known)
        least = max(largest, -(-total // shards))
        low = smallest(ends, unknown, shards, least, hopeful=True)
        high = smallest(ends, unknown, shards, least, hopeful=False)
        # the j-th lookup of the chain falls between these two
        first = [0, *greedy(ends, unknown, low, shards, hopeful=False)]
        last = [0, *greedy(ends, unknown, high, shards, hopeful=True)]
        hit: dict[int, int] = {}
        for j in range(max(len(first), len(last))):
            x0, x1 = first[min(j, len(first) - 1)] + low, last[min(j, len(last) - 1)] + high
            for k in range(max(0, bisect_right(ends, x0) - 1), bisect_right(ends, x1)):
                if ends[k] in unknown:
                    hit[ends[k]] = unknown[ends[k]]
        asked = sorted(hit.items())
    return ends, low


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row for each document: doc_id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32, shard, slot.

    Groups (equal texts; null is a text of its own kind, equal to the empty one) stay whole, in the order of their smallest
    id, documents in a group by id. The largest shard is as small as contiguous shards of whole groups allow, and within that the others are filled evenly. slot counts
    within a shard from 0. Rows that repeat an id stand next to each other. With fewer groups than shards some are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settle(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), sha256(text).alias("key")))
    multi = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
    multi = settle(multi)
    largest, total = multi.agg(F.max("bytes"), F.sum("bytes")).first()
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    shared = settle(multi.where("n > 1").select("key", "first_id", "n"))
    placed = spread_join(rows, shared, "key", "n").select("doc_id", "size", "text_crc32", "key", F.coalesce("first_id", "doc_id").alias("first_id"))
    order = ["first_id", "key", "doc_id"]
    summed = settle(with_sums(placed, order, {"upto": F.col("size"), "place": F.lit(1)}))
    ends = settle(summed.groupBy("key").agg(F.max("upto").alias("end")).select("end"))
    known, capacity = search(ends, shards, largest, total)
    at = even(known, shards, capacity)
    shard = sum(((F.col("upto") > F.lit(c)).cast("int") for c in at[:-1]), F.lit(0))
    out = summed.withColumn("shard", shard)
    starts = out.groupBy("shard").agg((F.min("place")).alias("start"))  # at most `shards` rows
    return out.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") - F.col("start")).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard by the law `bytes`; equal texts go together. Null texts have no bytes; other columns are not read."""
    out = assign(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
