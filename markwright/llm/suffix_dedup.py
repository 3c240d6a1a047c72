"""Suffix-array dedup: bytes of 100-byte strings that also start earlier go, the first copy stays.

A suffix counts as a repeat if its longest previous factor is 100 bytes or more, so suffixes are compared up to that length. Their
order is that of 96-bit names of these 100 bytes, not of the bytes: any order that puts equal ones side by side will do. In this
order, a suffix's previous and next smaller positions are the nearest suffixes on either side that start earlier in the corpus; one
of them shares 100 bytes with it if any earlier one does (`longest_previous`).

Sorting every suffix would write some thirty times the texts, so they are sorted in two steps.

1. Segments. Of the 53 strings of GRAM bytes within a window of 100, the one with the least hash (the first of these) owns the
window. Neighbouring windows mostly have the same owner: such a segment, 27 windows on average, has a name, made of its owner's
hash and its first and last window's. Segments are sorted like suffixes. One that starts earlier elsewhere is a repeat, all its
windows. Equal windows have equal owners, so what is left to find is in segments of different names whose owners are equal.
2. Windows. These segments' windows, each a suffix cut at 100 bytes, are sorted one by one.

Tasks send packed arrays: a batch of texts has one row for each range of names. Of one name a batch sends the first place only (it
knows that the later ones are repeats), so a passage in a third of all documents costs one entry a batch. An owner with FEW or more
segments of different names in one batch is one that needs step 2; its segments go there directly and only one entry says so to
other batches.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import listed_join, map_rows, parts, read, release_late, settle

WINDOW, GRAM = 100, 48
BATCH_BYTES = 1 << 19
BUCKET_BYTES = 4 << 20
FEW = 4
BROADCAST_BYTES = 1 << 20
NULL_ID = -(1 << 63)
ODD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
PLACES = ["docs", "tags", "places", "spans"]
KINDS = {"docs": "i8", "tags": "u4", "places": "u4", "spans": "u1", "keys": "u8", "names": "u8", "open": "u1", "ends": "u4"}


def _mix(x):
    """A bijective scrambling of unsigned 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Polynomial hashes (modulo 2 ** 64, of scrambled bytes) of all substrings of the lengths asked for, by doubling."""

    def __init__(self, data, base: int):
        import numpy as np

        table = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        self.base, self.of = base, {1: table[data]}

    def __call__(self, n: int):
        import numpy as np

        if n not in self.of:
            a = 1 << (n - 1).bit_length() - 1  # the largest power of two below n
            x, y = self(a), self(n - a)
            m = len(y) - a
            self.of[n] = x[:m] * np.uint64(pow(self.base, n - a, 1 << 64)) + y[a:]
        return self.of[n]


def owners(h):
    """For each window, the position of the string of GRAM bytes in it whose hash is least, the first of these."""
    import numpy as np

    bits = np.uint64(max(1, len(h).bit_length()))
    low = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    width, span = 1, WINDOW - GRAM + 1
    least = low
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = span - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def longest_previous(order, rank, names):
    """A mask: suffixes whose longest previous factor has full length. order: their suffix order; rank: their positions in
    the corpus; names: arrays, all equal for equal suffixes. The longest common prefix of neighbours is full or not, so within an
    interval of full ones the previous (next) smaller position exists if the least one before (after) is smaller."""
    import numpy as np

    n = len(order)
    if not n:
        return np.zeros(0, bool)
    full = np.ones(n - 1, bool)
    for x in names:
        full &= x[order[1:]] == x[order[:-1]]
    interval = np.r_[0, np.cumsum(~full)]
    most = int(rank.max()) + 2

    def smaller(r, k):  # of an earlier one of the same interval, which have falling offsets
        shifted = r - k * most
        least = np.r_[np.iinfo(np.int64).max, np.minimum.accumulate(shifted)[:-1]]
        return least < shifted

    r, out = rank[order], np.zeros(n, bool)
    before, after = smaller(r, interval), smaller(r[::-1], interval[-1] - interval[::-1])[::-1]
    inside = np.r_[False, full]  # the one before shares its interval
    within = np.r_[full, False]
    out[order] = (before & inside) | (after & within)
    return out


class Batch:
    """Some BATCH_BYTES of texts. at: where each piece starts; doc, tag, offset: whose it is and where in it."""

    def __init__(self, pieces: list):
        import numpy as np

        self.data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
        sizes = np.array([len(p[3]) for p in pieces], np.int64)
        self.at = np.cumsum(sizes) - sizes
        self.ends = self.at + sizes
        self.doc, self.tag, self.offset = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.uint32), np.array([p[2] for p in pieces], np.int64)
        self.extra = [p[4] for p in pieces]
        by = np.lexsort((self.tag, self.doc))  # pieces of one document share their rank
        new = np.r_[False, (self.doc[by][1:] != self.doc[by][:-1]) | (self.tag[by][1:] != self.tag[by][:-1])]
        self.rank = np.empty(len(by), np.int64)
        self.rank[by] = np.cumsum(new)

    def place(self, start):
        """Of windows: the index of their piece, the offset in its text, their position in the order of the corpus."""
        import numpy as np

        piece = np.searchsorted(self.at, start, "right") - 1
        offset = start - self.at[piece] + self.offset[piece]
        order = np.lexsort((offset, self.rank[piece]))
        rank = np.empty(len(order), np.int64)
        same = np.r_[False, (offset[order][1:] == offset[order][:-1]) & (self.rank[piece][order][1:] == self.rank[piece][order][:-1])]
        rank[order] = np.cumsum(~same)
        return piece, offset, rank


def tag_of(text: bytes) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(text)


def batches(rows):
    """doc_id, text, extra -> Batch. Long texts are cut into pieces that overlap by a window less a byte."""
    pieces, total = [], 0
    for doc_id, text, *extra in rows:
        data = (text or "").encode()
        if len(data) < WINDOW:
            continue
        doc, tag = NULL_ID if doc_id is None else doc_id, tag_of(data)
        for at in range(0, len(data) - WINDOW + 1, BATCH_BYTES):
            piece = data[at : at + BATCH_BYTES + WINDOW - 1]
            pieces.append((doc, tag, at, piece, extra))
            total += len(piece)
            if total >= BATCH_BYTES:
                yield Batch(pieces)
                pieces, total = [], 0
    if pieces:
        yield Batch(pieces)


def deal(columns: dict, by, buckets: int, known):
    """Rows bucket, then a binary for each of `columns`: entries by the range that `by` is in; those in `known` (a mask) go anywhere."""
    import numpy as np

    b = ((by >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    for here, flag in ((np.flatnonzero(~known), 0), (np.flatnonzero(known), 1)):
        if flag:
            spread = [(int(by[p[0]] % np.uint64(buckets)), p) for p in np.split(here, range(4096, len(here), 4096)) if len(p)]
        else:
            here = here[np.argsort(b[here], kind="stable")]
            cut = np.flatnonzero(np.diff(b[here])) + 1
            spread = [(int(b[p[0]]), p) for p in np.split(here, cut) if len(p)]
        for bucket, p in spread:
            yield bucket, bool(flag), *(x[p].astype(KINDS[c]).tobytes() for c, x in columns.items())


def packed(columns: list[str]) -> str:
    return "bucket long, known boolean, " + ", ".join(f"{c} binary" for c in columns)


SEGMENTS, WINDOWS = [*PLACES, "keys", "names", "open"], [*PLACES, "keys", "ends"]


def segments(buckets: int):
    def work(rows):
        import numpy as np

        for b in batches(rows):
            h = _mix(Hashes(b.data, ODD[0])(GRAM))
            own = owners(h)
            valid = np.zeros(len(b.data) + 1, np.int8)
            valid[b.at] += 1
            valid[b.ends - WINDOW + 1] -= 1
            start = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
            o = own[start]
            cut = np.flatnonzero((o[1:] != o[:-1]) | (np.diff(start) > 1)) + 1
            low, high = start[np.r_[0, cut]], start[np.r_[cut - 1, len(start) - 1]]
            q, w = o[np.r_[0, cut]], Hashes(b.data, ODD[1])(WINDOW)
            names = _mix(_mix(w[low] + np.uint64(1)) + w[high] * np.uint64(ODD[0]) + ((high - low) * 256 + (q - low)).astype(np.uint64))
            keys = _mix(h[q] + np.uint64(ODD[0]))  # the least hashes are small numbers
            piece, offset, rank = b.place(low)
            columns = {"docs": b.doc[piece], "tags": b.tag[piece], "places": offset, "spans": high - low + 1, "keys": keys, "names": names}
            order = np.lexsort((names, keys))
            again = longest_previous(order, rank, (keys, names))
            # names a key has in this batch, each counted at its first place
            kept = order[~again[order]]
            k = keys[kept]
            new = np.r_[True, (k[1:] != k[:-1])]
            runs = np.flatnonzero(new)
            count = np.repeat(np.diff(np.r_[runs, len(k)]), np.diff(np.r_[runs, len(k)]))
            state = np.zeros(len(keys), np.uint8)  # 1: other batches should know, 2: to step 2 at once
            state[kept[count >= FEW]] = 2
            state[kept[runs][count[runs] >= FEW]] = 1
            direct = state == 2
            yield from deal(columns | {"open": state}, keys, buckets, again | direct)

    return work


def _reduce(columns: list[str], judge):
    def run(table):
        import numpy as np
        import pyarrow as pa

        def joined(rows, name):
            return np.frombuffer(b"".join(rows[name].to_pylist()), KINDS[name])

        known = table["known"].to_pylist()
        both = [table.filter(pa.array([x is flag for x in known], pa.bool_())) for flag in (False, True)]
        x, rest = ({c: joined(t, c) for c in columns} for t in both)
        kind = judge(x)
        state = rest.get("open", np.zeros(len(rest["docs"]), np.uint8))
        take = np.flatnonzero(kind)
        out = {c: np.concatenate([x[c][take], rest[c]]) for c in PLACES}
        span = out["places"].astype(np.int64) << 8 | out["spans"]
        return pa.table({"doc": out["docs"], "tag": out["tags"].astype(np.int64), "span": span, "open": np.concatenate([kind[take] == 2, state == 2])})

    return run


def _ranked(x):
    """The entries' positions in the order of the corpus."""
    import numpy as np

    order = np.lexsort((x["places"], x["tags"], x["docs"]))
    new = np.r_[False, np.any([x[c][order][1:] != x[c][order][:-1] for c in ("places", "tags", "docs")], axis=0)] if len(order) else np.zeros(0, bool)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def judge_segments(x):
    """1: the segment starts earlier too; 2: its key has other names, and it is the first place of its own."""
    import numpy as np

    order = np.lexsort((x["names"], x["keys"]))
    again = longest_previous(order, _ranked(x), (x["keys"], x["names"]))
    kind = again.astype(np.uint8)
    kept = order[~again[order]]
    k = x["keys"][kept]
    runs = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[runs, len(k)])
    many = np.repeat((sizes > 1) | (np.maximum.reduceat(x["open"][kept], runs) > 0 if len(k) else False), sizes)
    kind[kept[many]] = 2
    return kind


def judge_windows(x):
    import numpy as np

    return longest_previous(np.lexsort((x["ends"], x["keys"])), _ranked(x), (x["keys"], x["ends"])).astype(np.uint8)


def windows(buckets: int):
    def work(rows):
        import numpy as np

        for b in batches(rows):
            wanted = np.zeros(len(b.data) + 1, np.int32)
            for k, ((spans,),) in enumerate(zip(b.extra, strict=True)):
                s = np.asarray(spans, np.int64)
                low, high = (s >> 8) - b.offset[k], (s >> 8) + (s & 255) - b.offset[k]
                low, high = np.maximum(low, 0), np.minimum(high, b.ends[k] - b.at[k] - WINDOW + 1)
                ok = low < high
                np.add.at(wanted, b.at[k] + low[ok], 1)
                np.add.at(wanted, b.at[k] + high[ok], -1)
            at = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
            if not len(at):
                continue
            keys, ends = (_mix(Hashes(b.data, base)(WINDOW)[at]) for base in ODD)
            ends = ends.astype(np.uint32)
            piece, offset, rank = b.place(at)
            columns = {"docs": b.doc[piece], "tags": b.tag[piece], "places": offset, "spans": np.ones(len(at), np.uint8), "keys": keys, "ends": ends}
            yield from deal(columns, keys, buckets, longest_previous(np.lexsort((ends, keys)), rank, (keys, ends)))

    return work


FOUND = "doc long, tag long, span long, open boolean"


def _gathered(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("doc", "tag").agg(F.collect_list("span").alias(name))


def _with_lists(docs: DataFrame, lists: DataFrame, name: str, how: str) -> DataFrame:
    """doc_id (NULL_ID for null), text, the list. Lists of up to BROADCAST_BYTES in all go to the texts; more are shuffled,
    with the texts that have one (and few others) only. A row takes the lists of its id and of its text's tag."""
    size = lists.agg(F.sum(F.size(name) * 8 + 24)).first()[0] or 0
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")
    lists = lists.withColumnRenamed("doc", "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("tag", name)).alias(name))
    return listed_join(rows, lists, "doc_id", how, size <= BROADCAST_BYTES)


def _own(rows):
    """Rows with the list of their own tag (None if there is none)."""
    for doc_id, text, lists in rows:
        found = None
        if lists:
            tag = tag_of((text or "").encode())
            found = next((x for t, x in (x.values() for x in lists) if t == tag), None)
        yield doc_id, text, found


def _merged(rows):
    """Lists of window spans -> the bytes they cover, as start, end, start, end and so on, touching ones in one."""
    import numpy as np

    for doc, tag, spans in rows:
        s = np.sort(np.asarray(spans, np.int64))
        low, high = s >> 8, (s >> 8) + (s & 255) - 1 + WINDOW
        top = np.maximum.accumulate(high)
        cut = np.flatnonzero(low[1:] > top[:-1]) + 1
        yield doc, tag, np.stack([low[np.r_[0, cut]], top[np.r_[cut - 1, len(top) - 1]]], axis=1).ravel().tolist()


def removed(docs: DataFrame) -> DataFrame:
    """doc, tag, cuts (array<long>: start and end of each run of bytes that goes). Texts without one have no row; the id of null
    ids is NULL_ID, before all others."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts(spark), -(-size // BUCKET_BYTES))
    first = map_rows(docs, segments(buckets), packed(SEGMENTS), 64).groupBy("bucket").applyInArrow(_reduce(SEGMENTS, judge_segments), FOUND)
    first = settle(first)
    release_late(spark)
    lists = settle(_gathered(first.where("open"), "spans"))

    def step_2(rows):
        yield from windows(buckets)((i, t, s) for i, t, s in _own(rows) if s)

    second = map_rows(_with_lists(docs, lists, "spans", "inner"), step_2, packed(WINDOWS), 64).groupBy("bucket").applyInArrow(_reduce(WINDOWS, judge_windows), FOUND)
    second = settle(second)
    release_late(spark)
    all_ = first.where("NOT open").unionByName(second)
    return settle(map_rows(_gathered(all_, "spans"), _merged, "doc long, tag long, cuts array<long>", 64))


def kept_bytes(data: bytes, cuts: list[int] | None) -> bytes:
    if not cuts:
        return data
    edges = [0, *cuts, len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def strip(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary: the bytes that stay), n_bytes, n_removed, n_spans (runs of removed bytes).

    Cuts may fall within a character, so what stays is binary. Null texts are empty; texts under 100 bytes stay whole. Null ids
    come first. Rows that repeat id and text are one document, and all stay as the first does; different texts under one id are
    documents of their own, in the order of a hash. An empty table gives an empty one; other columns are not read."""

    def work(rows):
        for doc_id, text, cuts in _own(rows):
            data, n = (text or "").encode(), sum(cuts[1::2]) - sum(cuts[::2]) if cuts else 0
            yield None if doc_id == NULL_ID else doc_id, kept_bytes(data, cuts), len(data), n, len(cuts or ()) // 2

    return map_rows(_with_lists(docs, removed(docs), "cuts", "left"), work, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`strip` of `documents`, with a digest of what stays in its place; nulls, repeats and empty tables as there."""
    rows = strip(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5_number(x[2 * p + 1:2 * p + 200]) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS p FROM d)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS place FROM w) WHERE place > 1),
g AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
c AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda i: x[CASE WHEN i = 0 THEN 1 ELSE 2 * b[i] + 1 END:CASE WHEN i = len(a) THEN 2 * n ELSE 2 * a[i + 1] END]), '') END)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
