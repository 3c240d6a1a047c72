"""Substring dedup by recompression.

Words are symbols. Three rounds of pair compression follow: a round splits the symbols into left and right ones by a bit of
their name's hash, and joins each left symbol with a right one after it under a new name, the hash of both names. Names
are functions of content, so all documents name the same thing alike without a dictionary of names. Equal symbols are
on the same side and never pair, so a run of one word stays a run of one-word symbols; it isn't made one symbol, as a name for
a run of any length could swallow a window, and its parts have equal keys and are merged below. Why repeats are found: after three
rounds a symbol has 8 words at most, and whether one starts at p depends on the words p-5 to p+4 alone. A 20-word window has
8 positions with 6 words of the window on both sides, so one of them starts a symbol, at the same place in every copy of the
window. The key of such a start (an anchor) is a hash of the words p-6 to p+6: every repeated window shares an anchor's key.

Stage 1 groups the keys of all anchors and finds those that occur twice. Stage 2 takes the windows with a shared anchor in
those 8 positions, 128-bit hashes of all their words, and finds for each the first place; windows elsewhere are removed.
Stage 3 drops the words they cover. Tasks send packed arrays: a batch of documents has one row for each bucket of keys. Of
one key a batch sends one place; the batch itself knows the rest of its places are shared (stage 1) or, not being its first,
removed (stage 2), and deals these out evenly. So a passage in a third of all documents costs a bucket one entry a batch.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import listed_join, map_rows, parts, read, release_late, settle

WINDOW = 20
ROUNDS = 3
SIDE = 6  # words on either side of an anchor in its key; 20 - 2 * 6 = 8 = 2 ** ROUNDS
BATCH_WORDS = 500_000
BUCKET_BYTES = 8 << 20
KNOWN = 300_000
BROADCAST_BYTES = 8 << 20
NULL_ID = -(1 << 63)


def _mix(x):
    """A bijective scrambling of 64-bit arrays (the finaliser of a 64-bit hash)."""
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """Two 64-bit names for each word, kept in arrays for the words met so far (anew at KNOWN of them)."""

    def __init__(self):
        self.start()

    def start(self):
        import numpy as np

        self.of: dict[bytes, int] = {}
        self.names = np.zeros((1024, 2), np.uint64)

    def __call__(self, words: list[bytes]):
        import numpy as np
        import xxhash

        of = self.of
        if new := [w for w in set(words) if w not in of]:
            if len(of) + len(new) > KNOWN:
                self.start()
                of, new = self.of, list(set(words))
            at = len(of)
            of.update(zip(new, range(at, at + len(new)), strict=True))
            while len(self.names) < len(of):
                self.names = np.vstack([self.names, np.zeros_like(self.names)])
            self.names[at : len(of)] = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, new)), np.uint64).reshape(-1, 2)
        return self.names[np.fromiter(map(of.__getitem__, words), np.int64, len(words))]


def symbol_starts(names, doc):
    """Positions where symbols start after ROUNDS rounds. names: of the words of several documents; doc: of which document."""
    import numpy as np

    start, sym = np.arange(len(names)), names
    for r in range(ROUNDS):
        right = (_mix(sym + np.uint64(r + 1)) >> np.uint64(63)).astype(bool)
        pair = np.zeros(len(sym), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (doc[start[:-1]] == doc[start[1:]])
        after = np.flatnonzero(pair) + 1
        sym = sym.copy()
        sym[after - 1] = _mix(sym[after - 1] * np.uint64(0x9E3779B97F4A7C15) + _mix(sym[after] + np.uint64(r)))
        stays = np.ones(len(sym), bool)
        stays[after] = False
        start, sym = start[stays], sym[stays]
    return start


def rolled(names, at, width: int, base: int):
    """A hash of the `width` names from each position in `at`."""
    import numpy as np

    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = h * np.uint64(base) + names[at + k]
    return _mix(h)


def batches(rows, more: bool):
    """Documents in batches of some BATCH_WORDS words: ids, the place of each word (document, position), names, extras."""
    import numpy as np

    words = Words()
    ids, names, sizes, extras, total = [], [], [], [], 0

    def packed():
        size = np.array(sizes, np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        return np.array(ids, np.int64), doc, np.arange(len(doc)) - first[doc], np.concatenate(names), size, first, extras

    for doc_id, text, *extra in rows:
        w = (text or "").encode().split()
        if len(w) < WINDOW:
            continue
        ids.append(NULL_ID if doc_id is None else doc_id)
        names.append(words(w))
        sizes.append(len(w))
        extras.append(extra)
        total += len(w)
        if total >= BATCH_WORDS:
            yield packed()
            ids, names, sizes, extras, total = [], [], [], [], 0
    if total:
        yield packed()


PACKED = "bucket long, keys binary, more binary, docs binary, places binary"


def deal(buckets: int, keys, more, doc, place, known):
    """Rows of PACKED: entries by their key's bucket; those in `known` (a mask) need no key and go anywhere, evenly."""
    import numpy as np

    here = np.flatnonzero(~known)
    # a bucket is a range of keys: the high bits, scaled
    b = ((keys[here] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(b, kind="stable")
    here, b = here[order], b[order]
    cut = np.flatnonzero(np.diff(b)) + 1
    for part, one in zip(np.split(here, cut), b[np.concatenate([[0], cut])] if len(b) else (), strict=False):
        yield int(one), keys[part].tobytes(), more[part].tobytes() if more is not None else b"", doc[part].tobytes(), place[part].tobytes()
    rest = np.flatnonzero(known)
    first = int(keys[0] % np.uint64(buckets)) if len(keys) else 0
    for k, at in enumerate(range(0, len(rest), 4096)):
        part = rest[at : at + 4096]
        yield (first + k) % buckets, b"", b"", doc[part].tobytes(), place[part].tobytes()


def anchors(buckets: int):
    def work(rows):
        import numpy as np

        for ids, doc, pos, names, size, _, _ in batches(rows, False):
            at = symbol_starts(names[:, 0], doc)
            at = at[(pos[at] >= SIDE) & (pos[at] + SIDE < size[doc[at]])]
            if not len(at):
                continue
            keys = rolled(names[:, 0], at - SIDE, 2 * SIDE + 1, 0xD1342543DE82EF95)
            order = np.argsort(keys, kind="stable")
            again = np.zeros(len(at), bool)  # a later place of a key of this batch
            again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
            more = np.zeros(len(at), np.uint8)  # a first place whose key comes again in this batch
            more[order[:-1]] = (keys[order[1:]] == keys[order[:-1]]) & ~again[order[:-1]]
            place = pos[at].astype(np.uint32)
            # back in the order of the text, where ids and places compress well
            yield from deal(buckets, keys, more, ids[doc[at]], place, again)

    return work


def windows(buckets: int):
    def work(rows):
        import numpy as np

        for ids, doc, pos, names, size, first, extras in batches(rows, True):
            wanted = np.zeros(len(doc) + 1, np.int64)  # +1 where a stretch of window starts begins, -1 after it
            for k, (found,) in enumerate(extras):
                p = np.asarray(found, np.int64)
                p = p[p < size[k]]
                low, high = np.maximum(p - (WINDOW - SIDE - 1), 0), np.minimum(p - SIDE, size[k] - WINDOW)
                ok = low <= high
                np.add.at(wanted, first[k] + low[ok], 1)
                np.add.at(wanted, first[k] + high[ok] + 1, -1)
            at = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
            if not len(at):
                continue
            keys, more = rolled(names[:, 0], at, WINDOW, 0xD1342543DE82EF95), rolled(names[:, 1], at, WINDOW, 0xAF251AF3B0F025B5)
            place, own = pos[at].astype(np.uint32), ids[doc[at]]
            yield from deal(buckets, keys, more, own, place, later(keys, more, own, place))

    return work


def later(keys, more, doc, place):
    """A mask: entries that are after the first (by doc, then place) of their key."""
    import numpy as np

    order = np.lexsort((place, doc, more, keys))
    k, m, d, p = keys[order], more[order], doc[order], place[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    out = np.zeros(len(k), bool)
    out[order] = (d != d[head]) | (p != p[head])
    return out


def _reduce(judge):
    """Groups of PACKED -> doc_id, place: what `judge(keys, more, doc, place)` marks, and all entries without keys."""

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def joined(name, kind, rows):
            return np.frombuffer(b"".join(rows[name].to_pylist()), kind)

        has = pc.greater(pc.binary_length(table["keys"]), 0)
        keyed, rest = table.filter(has), table.filter(pc.invert(has))
        keys, doc, place = joined("keys", np.uint64, keyed), joined("docs", np.int64, keyed), joined("places", np.uint32, keyed)
        more = joined("more", np.uint8 if judge is shared else np.uint64, keyed)
        mark = judge(keys, more, doc, place)
        doc, place = np.concatenate([doc[mark], joined("docs", np.int64, rest)]), np.concatenate([place[mark], joined("places", np.uint32, rest)])
        return pa.table({"doc_id": doc, "place": place.astype(np.int32)})

    return run


def shared(keys, more, doc, place):
    """A mask: entries whose key occurs again, in another batch or (more) in their own."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = more.astype(bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def gathered(packed: DataFrame, judge) -> DataFrame:
    """doc_id, places (array<int>) of what `judge` marks."""
    found = packed.groupBy("bucket").applyInArrow(_reduce(judge), "doc_id long, place int")
    return settle(found.groupBy("doc_id").agg(F.collect_list("place").alias("places")))


def joined(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """doc_id (NULL_ID for null), text, places. Lists of up to BROADCAST_BYTES in all go to the texts; more are shuffled, with
    the texts that have one (and few others) only."""
    size = lists.agg(F.sum(F.size("places") * 4 + 16)).first()[0] or 0
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")
    return listed_join(rows, lists, "doc_id", how, size <= BROADCAST_BYTES)


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, places: starts of the windows of WINDOW words that also start earlier (a smaller id, or earlier in the same
    document). Documents without such windows have no row; the id of null ids is NULL_ID, before all others."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts(docs.sparkSession), -(-size // BUCKET_BYTES))
    common = gathered(map_rows_large(docs, anchors(buckets)), shared)
    release_late(docs.sparkSession)  # what a stage has shuffled goes before the next one shuffles
    found = gathered(map_rows_large(joined(docs, common, "inner"), windows(buckets)), later)
    release_late(docs.sparkSession)
    return found


def map_rows_large(df: DataFrame, work) -> DataFrame:
    return map_rows(df, work, PACKED, 64)


def kept_words(text: str | None, places) -> tuple[list[bytes], int]:
    """The words that no removed window covers, and the number of all words."""
    words = (text or "").encode().split()
    if not places:
        return words, len(words)
    covered = bytearray(len(words))
    done = 0
    for p in sorted(places):
        a, b = max(p, done), min(p + WINDOW, len(words))
        if a < b:
            covered[a:b] = b"\1" * (b - a)
            done = b
    return [w for w, c in zip(words, covered, strict=True) if not c], len(words)


def strip(docs: DataFrame) -> DataFrame:
    """doc_id, text: the words that stay, joined by one space; n_words, n_removed.

    Null and empty texts have no words and give the empty text. Windows are judged on the input. Rows that repeat an id count
    as one document: of equal ones all windows first found there stay; of different texts under one id, places found in one
    are taken from all. Texts under 20 words stay whole. An empty table gives an empty one; other columns are not read."""

    def work(rows):
        for doc_id, text, places in rows:
            kept, n = kept_words(text, places)
            yield None if doc_id == NULL_ID else doc_id, b" ".join(kept).decode(), n, n - len(kept)

    return map_rows(joined(docs, removed(docs), "left"), work, "doc_id long, text string, n_words long, n_removed long")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`strip` of all `documents`, with a digest of the words that stay; nulls, repeats and empty tables as there."""
    docs = read(spark, sf_dir, "documents")

    def work(rows):
        for doc_id, text, places in rows:
            kept, n = kept_words(text, places)
            yield None if doc_id == NULL_ID else doc_id, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return map_rows(joined(docs, removed(docs), "left"), work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM d),
p AS (SELECT doc_id, pos AS p0, sha256(array_to_string(list(word) OVER o, ' ')) AS k, count(*) OVER o AS n FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, p0, row_number() OVER (PARTITION BY k ORDER BY doc_id, p0) AS place FROM p WHERE n = 20),
c AS (SELECT DISTINCT doc_id, unnest(range(p0, p0 + 20)) AS pos FROM f WHERE place > 1),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM w ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
