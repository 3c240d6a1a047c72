"""A Merkle manifest of a dataset, with proofs by coordinate lookup.

Rows are leaves, one binary tree a language, whose roots (subroots) are the leaves of one more tree. Leaves are ranked by a
range-partitioned sum, so no language is gathered in a task. Nodes are made LEVELS levels at a time: a task row holds up to
2 ** LEVELS neighbours and gives all nodes above them, and all nodes are written as one table of coordinates (tree, level,
index). A proof is looked up there: a leaf's index and its group's size say which sibling it needs on each level, these
coordinates are exploded and joined to the table, ordered by level, concatenated and folded. Lower nodes, which few leaves ask
for, are joined by a shuffle. Of the upper ones, which many ask for, there are some ten thousand at most (UPPER), whatever the
input, and they are broadcast. The path from a subroot to the root is looked up once a language and joined to its rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read, settle, spread_join, with_sums

LEVELS = 10
UPPER = 4096
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TOP = -1


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(**fields: Column) -> Column:
    """SHA-256 (32 bytes) of a row's fields: `-` for null, else length in bytes, `:`, value."""
    return F.unhex(F.sha2(F.concat(*(_field(fields[c]) for c in FIELDS)), 256))


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of `n` leaves: the bits of n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def joined(*nodes: bytes) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()


def node_table(leaves: DataFrame) -> DataFrame:
    """tree, level, idx, node of all nodes over `leaves` (settled; tree, n, idx from 0 up to n - 1, node), leaves included."""
    at = leaves.select("tree", height(F.col("n")).alias("h"), "idx", "node")
    highest = at.agg(F.max("h")).first()[0] or 0
    table = [at.select("tree", F.lit(0).alias("level"), "idx", "node")]
    for base in range(0, highest, LEVELS):

        def work(rows, base=base):
            for tree, h, part, row in rows:
                first = part << LEVELS
                for level in range(base + 1, min(base + LEVELS, h) + 1):
                    row, first = [joined(*row[k : k + 2]) for k in range(0, len(row), 2)], first >> 1
                    for k, node in enumerate(row):
                        yield tree, h, level, first + k, node

        parts = at.where(F.col("h") > base).groupBy("tree", "h", F.shiftright("idx", LEVELS).alias("part"))
        rows = parts.agg(F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("r")).select("tree", "h", "part", F.transform("r", lambda x: x["node"]).alias("row"))
        made = settle(map_rows(rows, work, "tree long, h int, level int, idx long, node binary", 8))
        table.append(made.select("tree", "level", "idx", "node"))
        at = made.where(F.col("level") == base + LEVELS).select("tree", "h", "idx", "node")
    out = table[0]
    for more in table[1:]:
        out = out.unionByName(more)
    return out


def siblings(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """pos, level, node: the siblings on the way up of each of `rows` (pos, tree, n, idx), `total` rows in all trees."""
    levels = F.when(F.col("n") > 1, F.sequence(F.lit(0), height(F.col("n")) - 1))
    wanted = rows.select("pos", "tree", "n", F.col("idx").alias("own"), F.explode(levels).alias("level")).select("pos", "tree", "level", F.expr("shiftright(own, level) ^ 1").alias("idx"), F.expr("shiftright(n - 1, level)").alias("last"))
    wanted = wanted.where("idx <= last").drop("last")
    upper, on = (total // UPPER).bit_length(), ["tree", "level", "idx"]
    low = wanted.where(F.col("level") < upper).join(nodes.where(F.col("level") < upper), on)
    high = wanted.where(F.col("level") >= upper).join(F.broadcast(nodes.where(F.col("level") >= upper)), on)
    return low.unionByName(high).select("pos", "level", "node")


def path() -> Column:
    """The nodes of a group in the order of their levels; level -1 is no node."""
    return F.transform(F.sort_array(F.collect_list(F.when(F.col("level") >= 0, F.struct("level", "node")))), lambda x: x["node"])


def folded(start: bytes, path: list[bytes], idx: int, n: int) -> bytes:
    """The root from a leaf, its index, the number of leaves and its siblings from the lowest."""
    at, last, k = start, n - 1, 0
    while last > 0:
        if idx ^ 1 > last:
            at = joined(at)
        else:
            at, k = joined(path[k], at) if idx & 1 else joined(at, path[k]), k + 1
        idx, last = idx >> 1, last >> 1
    return at


@dataclass
class Manifest:
    root: bytes
    #: key, tree, n, subroot, top (the subroot's siblings): one row a language, "-" or "=" and the language
    groups: DataFrame
    #: pos, key, tree, idx, n, leaf and the other columns of the rows
    leaves: DataFrame
    nodes: DataFrame
    rows: int


def manifest(rows: DataFrame) -> Manifest:
    """The manifest of `rows` (lang, doc_id, leaf (binary) and others, which are kept): trees, subroots and root.

    Null languages and ids come first; rows of one language and id are ordered by their leaves, so repeated rows are leaves of
    their own side by side. The root of no rows is the hash of nothing."""
    keyed = rows.withColumn("key", F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), "lang"))).drop("lang")
    placed = settle(with_sums(keyed, ["key", "doc_id", "leaf"], {"pos": F.lit(1)}))
    groups = settle(placed.groupBy("key").agg(F.min("pos").alias("start"), F.count("*").alias("n")))
    groups = settle(with_sums(groups, ["start"], {"tree": F.lit(1)}).withColumn("tree", F.col("tree") - 1).withColumn("size", F.col("n")))
    leaves = settle(spread_join(placed, groups, "key", "size").withColumn("idx", F.col("pos") - F.col("start")).drop("start"))
    nodes = node_table(leaves.select("tree", "n", "idx", F.col("leaf").alias("node")))
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tops = nodes.where("idx = 0").join(groups.select("tree", "key", "n", height(F.col("n")).alias("level")), ["tree", "level"])
    tops = settle(tops.select("key", F.col("tree").alias("pos"), F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(count).cast("long").alias("n"), "node", F.col("n").alias("rows")))
    above = node_table(tops.select("tree", "n", "idx", "node"))
    at = tops.withColumn("level", F.lit(-1)).select("pos", "level", "node", F.struct("key", "rows").alias("of")).unionByName(siblings(tops, above, count).withColumn("of", F.lit(None).cast("struct<key: string, rows: bigint>")))
    paths = at.groupBy("pos").agg(F.max("of").alias("of"), F.max(F.when(F.col("level") < 0, F.col("node"))).alias("subroot"), path().alias("top"))
    found = settle(paths.select(F.col("of.key").alias("key"), F.col("pos").alias("tree"), F.col("of.rows").alias("n"), "subroot", "top"))
    root = above.orderBy(F.desc("level")).limit(1).select("node").first()
    return Manifest(bytes(root[0]) if root else joined(), found, leaves, nodes, total)


def proofs(m: Manifest) -> DataFrame:
    """The leaves with path (siblings from the lowest up to the subroot), subroot, top, and tree (the subroot's index)."""
    own = spread_join(m.leaves, m.groups.select("key", "subroot", "top", F.col("n").alias("size")), "key", "size")
    kept = [c for c in own.columns if c != "pos"]
    at = own.select("pos", F.lit(-1).alias("level"), F.lit(None).cast("binary").alias("node"), F.struct(*kept).alias("own"))
    found = siblings(m.leaves.select("pos", "tree", "n", "idx"), m.nodes, m.rows)
    whole = at.unionByName(found, allowMissingColumns=True).groupBy("pos").agg(F.first("own", ignorenulls=True).alias("own"), path().alias("path"))
    return whole.select("own.*", "path")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of `documents`, every row proved, some after tampering with n_chars (where 7 divides the id's CRC-32).

    Nulls count as `-`; a null n_chars can't be tampered with and rows without an id aren't. Repeated rows are leaves side by
    side. An empty table gives an empty one; other columns are not read."""
    docs = read(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in FIELDS}
    forged = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf_of(**fields | {"n_chars": F.try_add("n_chars", F.lit(1))}))
    m = manifest(docs.select("doc_id", "lang", leaf_of(**fields).alias("leaf"), forged.alias("forged")))
    groups, root = m.groups.count(), m.root

    def work(rows):
        for doc_id, leaf, other, tree, idx, n, subroot, top, path in rows:
            end = folded(folded(other or leaf, path, idx, n), top, tree, groups)
            yield doc_id, leaf.hex(), subroot.hex(), root.hex(), joined(*path, *top).hex(), end.hex(), end == root

    rows = proofs(m).select("doc_id", "leaf", "forged", "tree", "idx", "n", "subroot", "top", "path")
    return map_rows(rows, work, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


CRC = "xor(list_reduce([4294967295] || list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, y: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
_F = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_F.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_HALVED = "list_transform(range(0, len(l), 2), lambda j: sha256(l[j + 1] || coalesce(l[j + 2], '')))"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, CASE WHEN {CRC.format("doc_id")} % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} END AS forged FROM documents),
i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM d),
t AS (SELECT lang, 0 AS level, list(leaf ORDER BY k) AS l FROM i GROUP BY lang UNION ALL SELECT lang, level + 1, {_HALVED} FROM t WHERE len(l) > 1),
s AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS q FROM t WHERE len(l) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY q) AS l FROM s UNION ALL SELECT level + 1, {_HALVED} FROM u WHERE len(l) > 1),
p AS (SELECT i.lang, i.k, list(CASE WHEN l[xor(k >> level, 1) + 1] IS NULL THEN 'N' WHEN (k >> level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(l[xor(k >> level, 1) + 1], '') ORDER BY level) AS path FROM i JOIN t ON i.lang IS NOT DISTINCT FROM t.lang WHERE len(l) > 1 GROUP BY i.lang, i.k),
w AS (SELECT s.q, list(CASE WHEN l[xor(q >> level, 1) + 1] IS NULL THEN 'N' WHEN (q >> level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(l[xor(q >> level, 1) + 1], '') ORDER BY level) AS path FROM s, u WHERE len(l) > 1 GROUP BY s.q),
f AS (SELECT i.*, s.subroot, coalesce(p.path, []) || coalesce(w.path, []) AS path, (SELECT l[1] FROM u WHERE len(l) = 1) AS root
 FROM i JOIN s ON i.lang IS NOT DISTINCT FROM s.lang LEFT JOIN p ON i.lang IS NOT DISTINCT FROM p.lang AND i.k = p.k LEFT JOIN w ON w.q = s.q),
g AS (SELECT *, list_reduce([coalesce(forged, leaf)] || path, lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g
"""
