"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts here: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A small side is broadcast up to this many rows of a few numbers each; beyond it Spark shuffles.
BROADCAST_ROWS = 50_000
#: Groups that are broadcast to their rows: this many at most, of HOT_ROWS rows at least.
HOT_GROUPS, HOT_ROWS = 10_000, 100
#: Rows in an Arrow batch, at most: a batch of Spark's 10,000 is tens of MB of texts for each task, in the JVM and in Python.
ARROW_ROWS = 1_000
#: 64-bit words of a filter of keys (`maybe_in`), at most: some MB to broadcast, whatever the number of keys.
FILTER_WORDS = 1 << 17


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else, on a local master only, one of our own."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='markwright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder as Parquet and read again: later jobs neither recompute it nor depend on the
    executors that made it. Shuffle files that only it needed can go."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/markwright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Shuffle files whose DataFrames the program has let go of are removed now: Spark's cleaner follows the references, which
    the driver else collects only as its memory fills, on its own time and not with the disk's. Nothing depends on it but the
    disk's use; PySpark has no public call for it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_late(spark: SparkSession, pause: float = 1.0) -> None:
    """`release` between large shuffles: Spark's listeners hold a query's plan until they are done with its last events, so
    what one collection right after it misses goes in another after `pause` seconds."""
    release(spark)
    time.sleep(pause)
    release(spark)


def maybe_in(rows: DataFrame, keys: DataFrame, on: str, mark: str) -> DataFrame:
    """`rows` with the boolean `mark`: false only where no row of `keys` has its value of `on` (not null on either side).

    The values' hashes set bits in a table of FILTER_WORDS words at most, which is broadcast; rows that hit a bit by chance
    are marked too, so what is marked still needs its join, and what isn't needs no shuffle."""
    at, word, bits = free_name(rows, "filter_at", "filter_word", "filter_bits")
    place = F.pmod(F.xxhash64(on), F.lit(64 * FILTER_WORDS))
    set_ = keys.select(place.alias(at)).select(F.shiftright(at, 6).alias(word), F.expr(f"shiftleft(1L, CAST({at} & 63 AS INT))").alias(bits))
    table = set_.groupBy(word).agg(F.bit_or(bits).alias(bits))
    found = rows.withColumn(at, place).withColumn(word, F.shiftright(at, 6)).join(F.broadcast(table), word, "left")
    return found.select(*rows.columns, F.coalesce(F.expr(f"getbit({bits}, CAST({at} & 63 AS INT)) = 1"), F.lit(False)).alias(mark))


def listed_join(rows: DataFrame, lists: DataFrame, on: str, how: str, broadcast: bool) -> DataFrame:
    """`rows` (long, costly to shuffle) joined to `lists` (settled; `on`, then a list) "left" or "inner"; no null in `on`.
    broadcast: `lists` go to the rows. Else only rows that `maybe_in` marks are shuffled."""
    if broadcast:
        return rows.join(F.broadcast(lists), on, how).select(*rows.columns, *(c for c in lists.columns if c != on))
    more, (mark,) = [c for c in lists.columns if c != on], free_name(rows, "listed")
    marked = maybe_in(rows, lists, on, mark)
    out = marked.where(mark).join(lists, on, how).select(*rows.columns, *more)
    if how == "inner":
        return out
    return out.unionByName(marked.where(~F.col(mark)).select(*rows.columns, *(F.lit(None).cast(lists.schema[c].dataType).alias(c) for c in more)))


def spread_join(rows: DataFrame, groups: DataFrame, on: str, size: str, how: str = "left") -> DataFrame:
    """`rows` joined to `groups` (one row for each value of `on`, with `size`, how many of `rows` have it), without the size.

    The rows of a large group are not gathered in one task: groups of over a HOT_GROUPS-th of all rows (HOT_ROWS at least), of
    which there are fewer than HOT_GROUPS, are broadcast; only rows of smaller groups are shuffled. `rows` and `groups` are
    read twice, so settle them first."""
    total, most = groups.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    limit, names, kept = max(HOT_ROWS, total // HOT_GROUPS), rows.columns, [c for c in groups.columns if c not in (on, size) and how != "left_semi"]
    if most <= limit:
        return rows.join(groups, on, how).select(*names, *kept)
    hot = groups.where(F.col(size) > limit)
    of_hot = rows.join(F.broadcast(hot), on, "left_semi" if how == "left_semi" else "inner").select(*names, *kept)
    cold = rows.join(F.broadcast(hot.select(F.col(on).alias("_hot"))), F.col(on) == F.col("_hot"), "left_anti")
    return of_hot.unionByName(cold.join(groups.where(F.col(size) <= limit), on, how).select(*names, *kept))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_sums(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """`rows` with, under each name of `sums`, the sum of its expression up to this row in the order of `order`, over all
    rows. Range-partitioned: sums within a partition, plus the totals of the partitions before it (as many rows as there
    are partitions, so these may go to one task and be broadcast). `rows` should have no tie in `order` that matters."""
    from pyspark.sql import Window as W

    spread = rows.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    spread = settle(spread.select("*", *(e.cast("long").alias(f"_v_{k}") for k, e in sums.items()), F.spark_partition_id().alias("_part")))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = spread.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums))
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = spread.select(*rows.columns, "_part", *(F.sum(f"_v_{k}").over(within).alias(f"_s_{k}") for k in sums))
    return summed.join(F.broadcast(offsets), "_part").select(*rows.columns, *((F.col(f"_s_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums))


def let(value: Column, body) -> Column:
    """`body(v)` with v bound to `value`, which is computed once for each row however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores in front until no column of `df` has it, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def map_rows(df: DataFrame, work, schema, at_once: int = 256) -> DataFrame:
    """`work` takes an iterator over a partition's rows (tuples) and yields tuples of `schema` (DDL or a StructType); Arrow
    carries both.

    At most `at_once` rows are Python objects at a time on either side, so memory follows the longest texts, not a partition.
    The session's Arrow batches are set to ARROW_ROWS rows (a lower limit stays), and a worker hands back what it freed."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(limit)) <= ARROW_ROWS:
        conf.set(limit, ARROW_ROWS)

    def run(batches):
        import pyarrow as pa

        def rows():
            for b in batches:
                for at in range(0, b.num_rows, at_once):
                    yield from zip(*(c.to_pylist() for c in b.slice(at, at_once).columns), strict=True)
                b = None  # before the next one is read

        def packed(full):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*full, strict=True), arrow, strict=True)], schema=arrow)

        full = []
        for row in work(rows()):
            full.append(row)
            if len(full) == at_once:
                yield packed(full)
                full = []
        if full:
            yield packed(full)
        full = None
        pa.default_memory_pool().release_unused()  # the worker stays, idle, beside those of later stages

    return df.mapInArrow(run, schema)
