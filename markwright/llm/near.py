"""Near duplicates on five-word shingles, similarity 0.8 or more, by long SimHash fingerprints and multi-index hashing.

Fingerprints. A 64-bit fingerprint of five-word shingles puts texts of similarity 0.8 up to 14 bits apart, too far for
lookups. Here it has 256 bits and is taken over a text's distinct word pairs, of which scattered edits change fewer, and it
is cut into eight segments of 32 bits. Each text lists, for each segment, the points of the Hamming ball of radius 1 around
its value, so two texts whose values of some segment are at most two bits apart meet in a point. An edit in one place changes
as many word pairs as shingles but leaves one end of the text as it was, so the ends are segments too, with a ball of radius
0: the first and the last q words, q being the largest power of two in half the text, its half and its quarter (LEAST_PART
words at least). Texts with one contiguous edit always share one of them. Edits at both ends leave the middle, so runs of
words that begin where the text itself says are points as well: of all places a run can begin at, the one whose first words
have the smallest hash, by ANCHORS hashes. A run has about a tenth of the text's words: numbers of shingles are cut into classes
by the similarity, a text lists runs for its class and the next one, and two texts of similarity 0.8 have one class in common.

Comparison. In each point every text is compared with the point's first one: by the complete distance (RADIUS bits) and a
bound on the similarity from the parity bits of their sets, which no similar pair fails, then by the exact Jaccard
similarity of their sets of shingle hashes. That is one pair for a text and point at most, however many
meet. Components are formed, and a point of two texts, or whose texts are in one component, is done with. Texts of other points
are joined exactly (set_join): two sets of similarity 0.8 share one of their rarest shingles, so only texts that do
are compared, and only across components. So no pair of texts that meet is left uncompared, and no point's pairs are listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, map_rows, parts, settle, spread_join
from .components import components

WIDTH, SEGMENTS, RADIUS, LEAST_PART = 5, 8, 60, 8
ANCHORS, ANCHOR_SHARE = 4, 10
WORDS = [f"b{k}" for k in range(SEGMENTS // 2)]
PARITY = [f"x{k}" for k in range(8)]
AT_ONCE = 1 << 15


def _mix(x):
    """A bijective scrambling of unsigned 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes, width: int):
    """The sorted distinct 64-bit hashes of all runs of `width` words (fewer words: the whole sequence; none: none)."""
    import numpy as np

    width = min(width, len(hashes))
    if not width:
        return np.zeros(0, np.uint64)
    n, out = len(hashes) - width + 1, np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out + np.uint64(0x9E3779B97F4A7C15)) ^ hashes[k : k + n]
    return np.unique(_mix(out))


def word_hashes(text: str | None):
    """XXH64 of each word, A-Z lower-cased, words being runs without the six ASCII spaces."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in (text or "").encode().lower().split()], np.uint64)


def set_hash(found) -> int:
    """A signed hash of a whole set of shingles."""
    import numpy as np
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes()) if len(found) else 0).view(np.int64))


def parity(found) -> list[int]:
    """512 bits as eight signed numbers: whether the number of shingles that fall on a bit is odd. A shingle that one of two
    sets lacks turns one bit over, so two sets differ in at least as many shingles as bits."""
    import numpy as np

    odd = np.bincount((_mix(found + np.uint64(7)) >> np.uint64(55)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def may_match(u: str, v: str):
    """False only for sets that can't reach 0.8, from their sizes and parity bits, in columns that begin with these names: at
    0.8 the smaller set has 0.8 of the larger one's size, and a ninth of both sizes' sum, at most, is in one set only."""
    differing = sum(F.bit_count(F.col(f"{u}_{x}").bitwiseXOR(F.col(f"{v}_{x}"))) for x in PARITY)
    n = F.col(f"{u}_n"), F.col(f"{v}_n")
    return (10 * F.least(*n) >= 8 * F.greatest(*n)) & (9 * differing <= n[0] + n[1])


def ends(hashes) -> list[int]:
    """Hashes of the first and last q words, for the three values of q; bit 62 tells them from points of segments."""
    import xxhash

    out, q = [], 1 << max(0, (len(hashes) // 2).bit_length() - 1)
    for size in (q, q // 2, q // 4):
        if size >= LEAST_PART:
            out += [xxhash.xxh64_intdigest(part.tobytes(), side) >> 2 | 1 << 62 for side, part in enumerate((hashes[:size], hashes[-size:]))]
    return out


def anchors(hashes, n: int) -> list[int]:
    """Hashes of runs that begin at content-defined places, for a text with these words and `n` shingles; marked as `ends` are."""
    import math

    import numpy as np
    import xxhash

    level = int(math.log(n, 1.25) + 1e-9) if n else 0
    lengths = {k: max(LEAST_PART, int(1.25**k / ANCHOR_SHARE)) for k in (level, level + 1)}
    starts, width, out = np.zeros(len(hashes), np.uint64), min(4, len(hashes)), []
    for k in range(width):
        starts[: len(hashes) - width + 1] = _mix(starts[: len(hashes) - width + 1] + np.uint64(0x9E3779B97F4A7C15)) ^ hashes[k : len(hashes) - width + 1 + k]
    for seed in range(ANCHORS):
        by = _mix(starts + np.uint64((seed + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        for k, size in lengths.items():
            if size <= len(hashes):
                at = int(by[: len(hashes) - size + 1].argmin())
                out.append(xxhash.xxh64_intdigest(hashes[at : at + size].tobytes(), 1000 * (k + 1) + seed) >> 2 | 1 << 62)
    return out


def fingerprint(hashes) -> list[int]:
    """The 256 bits as four signed numbers."""
    import numpy as np

    pairs, ones = shingles(hashes, 2), np.zeros(32 * SEGMENTS, np.int64)
    for at in range(0, len(pairs), AT_ONCE):
        h = pairs[at : at + AT_ONCE]
        long = np.stack([_mix(h + np.uint64(k * 0xD1342543DE82EF95 % (1 << 64))) for k in range(len(WORDS))], axis=1)
        ones += np.unpackbits(long.view(np.uint8).reshape(len(h), -1), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(pairs)).view("<i8").tolist()


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    def work(rows):
        for doc_id, text in rows:
            hashes = word_hashes(text)
            found = shingles(hashes, width)
            yield doc_id, set_hash(found), len(found), *fingerprint(hashes), *parity(found), [*ends(hashes), *anchors(hashes, len(found))]

    return map_rows(docs.select("doc_id", "text"), work, f"doc_id long, sig long, n long, {', '.join(f'{b} long' for b in (*WORDS, *PARITY))}, ends array<long>")


def meetings(nodes: DataFrame) -> DataFrame:
    """u, v, third: each text v that meets others in a point, with the point's first (smallest) text u, for each point;
    third: at least one other text comes between them."""
    halves = [h for b in WORDS for h in (F.col(b).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(b, 32))]
    base = F.array(*(h.bitwiseOR(F.lit(s << 32).cast("long")) for s, h in enumerate(halves)))
    masks = F.array(*(F.lit(m).cast("long") for m in (0, *(1 << i for i in range(32)))))
    points = nodes.where("n > 0").select("sig", "ends", F.explode(base).alias("at"), (F.col("at") < 1 << 32).alias("once"))
    own = F.when(F.col("once"), F.col("ends")).otherwise(F.array().cast("array<long>"))
    points = points.select("sig", F.explode(F.concat(own, F.transform(masks, lambda m: F.col("at").bitwiseXOR(m)))).alias("p"))
    ordered = points.select("p", "sig").repartition(parts(nodes.sparkSession), "p").sortWithinPartitions("p", "sig")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last = first = count = None  # of the point that the last batch ended in
        for b in batches:
            if not b.num_rows:
                continue
            p, sig = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            firsts, sizes = sig[starts].copy(), np.diff(np.r_[starts, len(p)])
            rank = np.arange(len(p)) - np.repeat(starts, sizes)
            if last is not None and p[0] == last:
                firsts[0] = first
                rank[: sizes[0]] += count
            u = np.repeat(firsts, sizes)
            if len(i := np.flatnonzero(u != sig)):
                yield pa.RecordBatch.from_arrays([pa.array(c[i]) for c in (u, sig, rank > 1)], names=["u", "v", "third"])
            last, first, count = p[-1], firsts[-1], int(rank[-1]) + 1

    return ordered.mapInArrow(run, "u long, v long, third boolean")


def _counted(pairs: DataFrame, of: DataFrame, end: str) -> DataFrame:
    """`of` for the texts in the column `end`, with _rows, in how many pairs: one text may be in a great share of them."""
    return settle(pairs.groupBy(end).agg(F.count("*").alias("_rows")).join(of, end))


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of distinct u, v (settled): those whose complete distance, numbers of shingles and parity bits allow the similarity."""
    side = lambda end: nodes.select(F.col("sig").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("n", *WORDS, *PARITY)))
    apart = sum(F.bit_count(F.col(f"u_{b}").bitwiseXOR(F.col(f"v_{b}"))) for b in WORDS)
    both = spread_join(pairs, _counted(pairs, side("u"), "u"), "u", "_rows", "inner").join(side("v"), "v")
    return both.where((apart <= RADIUS) & may_match("u", "v")).select("u", "v")


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """sig, held (array of shingle hashes), parity bits of the `wanted` (settled, distinct sig). Texts are not shuffled where few are wanted;
    one row of each set is found by the smallest id with that set."""
    few = wanted.count() <= BROADCAST_ROWS
    ids = wanted.join(nodes.select("sig", "first_id"), "sig")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("first_id"))).select("sig", "text")

    def work(rows):
        import numpy as np

        for sig, text in rows:
            found = shingles(word_hashes(text), width)
            if set_hash(found) == sig:  # rows may repeat an id with another text
                yield sig, found.view(np.int64).tolist(), *parity(found)

    return settle(map_rows(texts, work, f"sig long, held array<long>, {', '.join(f'{x} long' for x in PARITY)}", 16).dropDuplicates(["sig"]))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct u, v (settled) those whose sets (settled) have a Jaccard similarity of 0.8 or more."""
    side = lambda end: sets.select(F.col("sig").alias(end), F.col("held").alias(f"{end}_held"))
    both = spread_join(pairs, _counted(pairs, side("u"), "u"), "u", "_rows", "inner").join(side("v"), "v")
    shared = F.size(F.array_intersect("u_held", "v_held"))
    return both.where(10 * shared >= 8 * (F.size("u_held") + F.size("v_held") - shared)).select("u", "v")


def _rooted(rows: DataFrame, roots: DataFrame, end: str) -> DataFrame:
    return rows.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))


def set_join(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """u, v: all pairs of `sets` (sig, held; settled) of similarity 0.8 or more that are in different components.

    Shingles are ordered from the rarest. Of two such sets of n and m shingles, one of the first n - 0.8 n + 1 of one is among
    the first m - 0.8 m + 1 of the other, and from the first that they share on enough must be left on both sides. Shingles of
    one set only come first, so a set with over a fifth of these has no partner and lists nothing."""
    held = sets.select("sig", F.size("held").alias("n"), F.explode("held").alias("h"))
    counts = settle(held.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").withColumn("times", F.col("k")))
    shared = spread_join(held, counts, "h", "k", "inner")
    ranked = shared.groupBy("sig", "n").agg(F.sort_array(F.collect_list(F.struct("times", "h"))).alias("a"))
    need = F.ceil(F.col("n") * 8 / 10).cast("int")
    listed = ranked.where(F.size("a") >= need).select("sig", "n", F.posexplode(F.slice("a", F.lit(1), F.size("a") - need + 1)).alias("k", "e"), F.size("a").alias("in_a"))
    keys = _rooted(listed.select("sig", "n", (F.col("n") - F.col("in_a") + F.col("k")).alias("at"), F.col("e.h").alias("h")), roots, "sig")
    keys = settle(keys.join(sets.select("sig", *PARITY), "sig"))
    # of each shingle's texts, those of the component with most are not compared with each other
    per = keys.groupBy("h", "sig_root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("sig_root", F.struct("c", "sig_root")).alias("main"), F.count("*").alias("roots"))
    open_ = settle(per.where("roots > 1").select("h", "main"))
    x = keys.join(open_, "h").where("sig_root != main").select("h", *(F.col(c).alias(f"u_{c}") for c in ("sig", "n", "at", "sig_root", *PARITY)))
    y = keys.select("h", *(F.col(c).alias(f"v_{c}") for c in ("sig", "n", "at", "sig_root", *PARITY)))
    left = F.least(F.col("u_n") - F.col("u_at"), F.col("v_n") - F.col("v_at"))
    fits = (F.col("u_sig_root") != F.col("v_sig_root")) & may_match("u", "v") & (18 * left >= 8 * (F.col("u_n") + F.col("v_n")))
    pairs = x.join(y, "h").where(fits).select(F.least("u_sig", "v_sig").alias("u"), F.greatest("u_sig", "v_sig").alias("v")).distinct()
    return _similar(settle(pairs), sets)


def links(nodes: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """u, v: verified links whose components are those of the similarity among the sets `nodes` that meet."""
    met = settle(meetings(nodes).groupBy("u", "v").agg(F.max("third").alias("third")))
    pairs = settle(_close(met.select("u", "v"), nodes))
    wanted = settle(pairs.select(F.col("u").alias("sig")).union(pairs.select("v")).distinct())
    found = settle(_similar(pairs, sets_of(wanted, nodes, docs, width)))
    roots = settle(components(found))
    # all points of one first text are taken together: done with if no third text is in them or all are in one component
    per = _rooted(met, roots, "v").groupBy("u").agg(F.count("*").alias("k"), F.max("third").alias("third"), F.min("v_root").alias("low"), F.max("v_root").alias("high"))
    open_ = settle(_rooted(per, roots, "u").where("third AND (low != high OR low != u_root)").select("u", "k"))
    wanted = settle(spread_join(met, open_, "u", "k", "left_semi").select(F.col("v").alias("sig")).union(open_.select("u")).distinct())
    return found.union(set_join(sets_of(wanted, nodes, docs, width), roots))


def classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that links of similarity 0.8 reach, itself included; a row for each row.

    Null and empty texts have no shingles and form one class. Texts of fewer than `width` words are one shingle. Rows with
    equal sets of shingles are one class. A class whose ids are all null has a null component_id. An empty table gives an
    empty one; other columns are ignored."""
    rows = settle(signatures(docs, width))
    nodes = settle(rows.groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("size"), *(F.min(c).alias(c) for c in ("n", *WORDS, *PARITY, "ends"))))
    of = settle(_rooted(nodes.select("sig", "first_id", "size"), components(links(nodes, docs, width)), "sig"))
    ids = settle(spread_join(of, settle(of.groupBy("sig_root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("k"))), "sig_root", "k"))
    return spread_join(rows.select("doc_id", "sig"), ids.select("sig", "component_id", "size"), "sig", "size").select("doc_id", "component_id")


def drop_near(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """`docs`, all columns, with one document of each class of `classes`: the one with the smallest id.

    Rows that repeat the id of the one that stays all stay, as do rows with a null id. The ids that go are broadcast while
    they are few (counted); beyond BROADCAST_ROWS an anti join deals the texts out by id, once."""
    gone = settle(classes(docs, width).where("doc_id != component_id").select("doc_id").distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(*docs.columns)
