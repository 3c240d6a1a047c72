"""The prefix trie of conversations, as the Cartesian tree over the LCP array of the sorted conversations.

A turn's name is 16 bytes of a hash of role and text, a conversation's key the names of its turns in order. Keys are sorted
by range, so that every range partition is a block of the sorted list, and each conversation gets the number of turns that it
shares with the one before (LCP). A node of depth d opens at conversation i if lcp[i] < d <= length[i] and ends before the
next smaller value: the next conversation with lcp < d. Each block finds these ends and the openings (previous smaller values)
with one stack, where equal LCPs fall into one node and every depth between two of them gets a node of its own. What is open
at a block's edge is settled by the blocks' minima: a node of depth d that a block inherits was opened in the nearest block
before it whose minimum is below d. Blocks send such nodes as fragments, a row for each block and depth, which are added up.

All figures of a node are sums, a minimum or a list over its interval of conversations. A conversation ends a leaf if the next
one shares fewer turns than it has. Tokens saved below a node of depth d are the sum, over all its conversations but the first,
of the words of the shared turns from d on: W(lcp) - W(d - 1), W being the words of a conversation's first turns.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, map_rows, parts, read, settle, spread_join, with_sums
from .merkle import CRC

NAME = 16
CHUNK = 9  # turns are packed 2 ** CHUNK at a time, then by conversation
BLOCK_TURNS = 200_000
GROUP, MOST = 20, 4


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, key (binary, NAME bytes a turn), words (array<long>): each conversation c as the first h turns of conversation
    c - c % 20 and its own after its first h, h being the CRC-32 of c modulo 4.

    Turns are ordered by number, null first, those of equal number by the hash of their contents; repeated rows are turns of
    their own. Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out. A key stands
    in one row, texts don't: 16 bytes a turn. Other columns are not read."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    name = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * NAME)
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", name.alias("name"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    placed = settle(with_sums(turns, ["conv_id", "turn", "name"], {"pos": F.lit(1)}))
    sizes = settle(placed.groupBy("conv_id").agg(F.min("pos").alias("start"), F.count("*").alias("n")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).alias("h")
    of = sizes.select("conv_id", "start", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), h)
    of = settle(of.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0)))))
    own = spread_join(placed, of.select("conv_id", "start", "h", "m", F.col("n").alias("size")), "conv_id", "size").withColumn("k", F.col("pos") - F.col("start"))
    firsts = own.where((F.col("conv_id") % GROUP == 0) & (F.col("k") < MOST - 1)).select(F.col("conv_id").alias("base"), F.col("k").alias("d"), "name", "words")
    heads = of.select("conv_id", "base", "h").join(firsts, "base").where("d < h").select("conv_id", "d", "name", "words")
    rest = own.where("k >= h").select("conv_id", (F.col("m") + F.col("k") - F.col("h")).alias("d"), "name", "words")
    chunks = heads.unionByName(rest).groupBy("conv_id", F.shiftright("d", CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("d", "name", "words"))).alias("r"))
    chunks = chunks.select("conv_id", "chunk", F.array_join(F.transform("r", lambda x: x["name"]), "").alias("names"), F.transform("r", lambda x: x["words"]).alias("words"))
    none = of.select("conv_id", F.lit(-1).cast("long").alias("chunk"), F.lit("").alias("names"), F.array().cast("array<bigint>").alias("words"))
    whole = chunks.unionByName(none).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "names", "words"))).alias("c"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("c", lambda x: x["names"]), "")).alias("key"), F.flatten(F.transform("c", lambda x: x["words"])).alias("words"))


def shared(a: bytes, b: bytes) -> int:
    """The number of names that two keys begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // NAME
    low, high = 0, n // NAME  # names before low agree, those up to high don't all
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * NAME : mid * NAME] == b[low * NAME : mid * NAME] else (low, mid)
    return low


def _blocks(rows):
    """Sorted conv_id, key, words of a partition -> block, place in it, conv_id, length, LCP (null for the first), words, and
    the key of the first and last."""
    from pyspark import TaskContext

    block, held, last, at = TaskContext.get().partitionId(), None, None, 0
    for conv_id, key, words in rows:
        if held:
            yield *held, None
        lcp = None if last is None else shared(last, key)
        held, edge = (block, at, conv_id, len(key) // NAME, lcp, words), key if last is None else None
        if edge is not None:
            yield *held, edge
            held = None
        last, at = key, at + 1
    if at == 1:
        return
    if held:
        yield *held, last


def _edges(rows):
    """Keys of the blocks' first and last conversations, in order -> block, LCP of its first with the one before it."""
    before = None
    for block, at, key in rows:
        if at == 0:
            yield block, -1 if before is None else shared(before, key)
        before = key


class Node:
    """A node on the stack. first: the words of its conversations' turns above it; own: those of the turns that the conversation
    which opened it shares with the one before, 0 if an earlier block opened it."""

    __slots__ = ("children", "depth", "ends", "first", "leaves", "least", "n", "opened", "own", "pending", "total")

    def __init__(self, depth: int, opened: bool, first: int, own: int):
        self.depth, self.opened, self.first, self.own = depth, opened, first, own
        self.n = self.children = self.leaves = self.total = 0
        self.least, self.ends, self.pending = None, [], []

    def figures(self) -> tuple[int, int, int, int]:
        return self.n, self.children, self.leaves, self.total - self.own - (self.n - self.opened) * self.first


RESOLVED, WAITING, FRAGMENT = 0, 1, 2
FOUND = "kind int, conv_id long, depth long, parent_conv_id long, parent string, node string, block long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def listed(ends: list[int]) -> str:
    return ",".join(map(str, ends))


class Sweep:
    """The stack over one block; gives rows of FOUND. first: LCP of each block's first conversation with the one before it,
    least: each block's minimum, both in the order of blocks; place: this block's place in it."""

    def __init__(self, place: int, first: list[int], least: list[int], words: list[int]):
        self.place, self.after = place, first[place + 1] if place + 1 < len(first) else -1
        self.opener, k = [0] * (first[place] + 1), place - 1
        for d in range(first[place], -1, -1):  # the previous smaller minimum
            while least[k] >= d:
                k -= 1
            self.opener[d] = k
        sums = [0, *accumulate(words)]
        self.stack = [Node(d, False, sums[max(d - 1, 0)], 0) for d in range(first[place] + 1)]
        self.length = None  # of the last conversation

    def name(self, x: Node) -> str:
        return f"{self.place if x.opened else self.opener[x.depth]}:{x.depth}"

    def row(self, conv_id: int, length: int, lcp: int, words: list[int]):
        yield from self.closed(lcp)
        sums = [0, *accumulate(words)]
        own, stack = sums[max(lcp, 0)], self.stack
        for d in range(lcp + 1, length + 1):
            if stack:
                stack[-1].children += 1
            stack.append(Node(d, True, sums[max(d - 1, 0)], own))
        top, self.length = stack[-1], length
        top.n, top.total = top.n + 1, top.total + own
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        top.ends.append(conv_id)

    def pop(self) -> tuple[Node, Node | None]:
        x, up = self.stack.pop(), self.stack[-1] if self.stack else None
        if up:
            up.n, up.leaves, up.total = up.n + x.n, up.leaves + x.leaves, up.total + x.total
            up.least = x.least if up.least is None else min(up.least, x.least)
        return x, up

    def fragment(self, x: Node, up: Node | None):
        parent = self.name(up) if x.opened and up else None
        return FRAGMENT, x.least, x.depth, None, parent, self.name(x), self.place, *x.figures(), listed(x.ends)

    def closed(self, lcp: int):
        """Nodes deeper than `lcp`, which the next conversation shares, end."""
        if self.length is not None:
            self.stack[-1].leaves += lcp < self.length
        while self.stack and self.stack[-1].depth > lcp:
            x, up = self.pop()
            if not x.opened:
                yield self.fragment(x, up)
                continue
            own = (x.least, x.depth), (*x.figures(), hashlib.sha256(listed(x.ends).encode()).hexdigest())
            for (least, depth), rest in x.pending:
                yield RESOLVED, least, depth, x.least, None, None, self.place, *rest
            if up is None:
                yield RESOLVED, *own[0], None, None, None, self.place, *own[1]
            elif up.opened:
                up.pending.append(own)
            else:
                yield WAITING, *own[0], None, self.name(up), None, self.place, *own[1]

    def end(self):
        yield from self.closed(self.after)
        while self.stack:
            x, up = self.pop()
            for (least, depth), rest in x.pending:
                yield WAITING, least, depth, None, self.name(x), None, self.place, *rest
            yield self.fragment(x, up)


def sweeps(places: dict[int, int], first: list[int], least: list[int]):
    def work(rows):
        held, now = None, None
        for block, _, conv_id, length, lcp, words in rows:
            if block != held:
                if now:
                    yield from now.end()
                held, now = block, Sweep(places[block], first, least, words)
                lcp = first[places[block]]
            yield from now.row(conv_id, length, lcp, words)
        if now:
            yield from now.end()

    return work


def _whole(rows):
    """Fragments by node and block -> whole nodes: node, conv_id, depth, parent, figures, digest of the ends."""
    held = None
    for node, _, least, depth, parent, *figures, ends in rows:
        if held != node:
            if held is not None:
                yield held, low, at, up, *sums, digest.hexdigest()
            held, low, at, up, sums, digest, some = node, least, depth, parent, [0] * 4, hashlib.sha256(), False
        low, sums = min(low, least), [a + b for a, b in zip(sums, figures, strict=True)]
        if ends:
            digest.update(("," * some + ends).encode())
            some = True
    if held is not None:
        yield held, low, at, up, *sums, digest.hexdigest()


FIGURES = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def trie(paths: DataFrame) -> DataFrame:
    """conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: the nodes
    of the trie of `paths` (conv_id, key, words; one row a conversation).

    Conversations without turns are members of the root only. No conversations give no nodes, not even the root."""
    spark = paths.sparkSession
    paths = settle(paths)
    turns = paths.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
    n = max(parts(spark), -(-turns // BLOCK_TURNS))
    ordered = paths.select("conv_id", "key", "words").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    ranked = settle(map_rows(ordered, _blocks, "block long, at long, conv_id long, length int, lcp int, words array<long>, edge binary"))
    edges = ranked.where("edge IS NOT NULL").select("block", "at", "edge").repartition(1).sortWithinPartitions("block", "at")
    first = dict(map(tuple, map_rows(edges, _edges, "block long, lcp int").collect()))  # a row a block, as below
    within = dict(map(tuple, ranked.groupBy("block").agg(F.min("lcp")).collect()))
    order = sorted(first)
    least = [first[b] if within[b] is None else min(first[b], within[b]) for b in order]
    work = sweeps({b: k for k, b in enumerate(order)}, [first[b] for b in order], least)
    found = ranked.drop("edge").repartition(n, "block").sortWithinPartitions("block", "at")
    found = settle(map_rows(found, work, FOUND))
    pieces = found.where(F.col("kind") == FRAGMENT).select("node", "block", "conv_id", "depth", "parent", *FIGURES, "ends")
    pieces = pieces.repartition(parts(spark), "node").sortWithinPartitions("node", "block")
    wide = settle(map_rows(pieces, _whole, "node string, conv_id long, depth long, parent string, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"))
    waiting = found.where(F.col("kind") == WAITING).select("conv_id", "depth", "parent", *FIGURES, "ends")
    waiting = settle(waiting.unionByName(wide.drop("node")))
    above = wide.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    columns = ["conv_id", "depth", "parent_conv_id", *FIGURES, F.col("ends").alias("ends_sha256")]
    return found.where(F.col("kind") == RESOLVED).select(*columns).unionByName(spread_join(waiting, above, "parent", "size").select(*columns))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all `conversations`, rebuilt: a row a node. Nulls, repeats and ties as in `rebuilt`, empty tables as in `trie`."""
    return trie(rebuilt(read(spark, sf_dir, "conversations")))


SQL = rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, {CRC.format("c")} % 4 AS h FROM t GROUP BY c),
m AS (SELECT n.c, n.h, least(n.h, coalesce(b.n, 0)) AS m FROM n LEFT JOIN n b ON b.c = n.c - n.c % 20),
r AS (SELECT m.c, t.k + 1 AS d, role, text FROM m JOIN t ON t.c = m.c - m.c % 20 AND t.k < m.h UNION ALL SELECT m.c, m.m + t.k - m.h + 1, role, text FROM m JOIN t ON t.c = m.c AND t.k >= m.h),
x AS (SELECT c, d, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS p, len(regexp_extract_all(text, '[^ 	-]+')) AS w FROM r UNION ALL SELECT c, 0, '', 0 FROM m),
l AS (SELECT *, max(d) OVER (PARTITION BY c) AS last, lag(p) OVER (PARTITION BY c ORDER BY d) AS up FROM x),
v AS (SELECT d, p, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = last), '') AS ends FROM l GROUP BY d, p),
k AS (SELECT d - 1 AS d, up AS p, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL),
f AS (SELECT v.*, coalesce(k.n, 0) AS n_children FROM v LEFT JOIN k USING (d, p)),
s AS (SELECT a.d, a.p, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, CAST(sum((f.n_convs - 1) * f.w) AS BIGINT) AS saved FROM f JOIN x a ON a.c = f.conv_id AND a.d <= f.d GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s USING (d, p) LEFT JOIN v u ON u.d = f.d - 1 AND u.p = f.up
"""
