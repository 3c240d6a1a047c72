"""Matching questions to the bank: exact text first, then nearest neighbours."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import IRRELEVANT, PARTLY
from ..functions.text import WS, ZERO_WIDTH, exact_key, preprocess

BANDS = ("irrelevant", "partial", "relevant")
BLOCK = 512
#: A character of which something is left when a text is cleaned, whatever stands around it.
SAYING = f"[^{WS}{ZERO_WIDTH}|_.]"
#: Keywords and bytes of them in one automaton.
BANK_WORDS, BANK_BYTES = 200_000, 16 << 20
AT_ONCE = 256


def keyed(rows: DataFrame) -> DataFrame:
    """`rows` with key, the SHA-256 of the question's text key (null for null and empty questions), and says, whether anything is
    left of it when it is cleaned, instead of question: what is joined and shuffled later holds no texts."""
    q = F.col("question")
    key = F.when(q != "", F.coalesce(F.sha2(exact_key(q).cast("binary"), 256), F.lit("")))
    says = q.rlike(SAYING) | (preprocess(q) != "")  # the second part is for the few texts that the first one leaves open
    return rows.withColumns({"key": key, "says": F.coalesce(says, F.lit(False))}).drop("question")


def exact(questions: DataFrame, bank: DataFrame, others: bool = False) -> DataFrame:
    """q_id, bank_pos: of the bank's entries with the same text key, the first (`others`: the first that isn't q_id itself). Null
    and empty questions match nothing.

    What is shuffled is the SHA-256 of a key, not the key; it can't be null, so no filter computes it a second time. Of a key
    tasks send the first two entries at most, so a common text gathers nowhere."""
    hashed = lambda rows: rows.where("question != ''").withColumn("key", F.coalesce(F.sha2(exact_key(F.col("question")).cast("binary"), 256), F.lit("")))
    return _same(hashed(questions), hashed(bank), others)


def _same(questions: DataFrame, bank: DataFrame, others: bool) -> DataFrame:
    """`exact` by keys that are there."""
    entries = bank.select("key", "bank_pos")
    if not others:
        return questions.select("q_id", "key").join(entries.groupBy("key").agg(F.min("bank_pos").alias("bank_pos")), "key").select("q_id", "bank_pos")
    two = entries.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy("bank_pos"))).where("k <= 2")
    two = two.groupBy("key").agg(F.min("bank_pos").alias("first"), F.max(F.when(F.col("k") == 2, F.col("bank_pos"))).alias("next"))
    found = questions.select("q_id", "key").join(two, "key")
    return found.select("q_id", F.when(F.col("first") == F.col("q_id"), F.col("next")).otherwise(F.col("first")).alias("bank_pos")).where("bank_pos IS NOT NULL")


def bank_match(questions: DataFrame, bank: DataFrame, threshold: float = 0.75, margin: float = 0.08, others: bool = False) -> DataFrame:
    """q_id, bank_pos, score, how: the bank entry with the same text (score 1); for the other questions the nearest by cosine, if
    it reaches `threshold` and is `margin` above the second. Questions without either have a null bank_pos; those without a vector,
    or of which nothing is left when it is cleaned, have a null score too. `others`: no question matches the entry of its own number.
    questions: q_id, question, vector; bank: bank_pos, question, vector."""
    return keyed_match(keyed(questions), keyed(bank), threshold, margin, others)


def keyed_match(questions: DataFrame, bank: DataFrame, threshold: float = 0.75, margin: float = 0.08, others: bool = False) -> DataFrame:
    """`bank_match` of rows of `keyed`."""
    same = _same(*(side.where("key IS NOT NULL") for side in (questions, bank)), others).select("q_id", "bank_pos", F.lit(1.0).alias("score"), F.lit("exact").alias("how"))
    rest = questions.join(same, "q_id", "left_anti")
    found = with_margin(nearest(rest.where("says").select("q_id", "vector"), bank.where("says").select("bank_pos", "vector"), others), threshold, margin)
    taken = F.col("verdict") == "accepted"
    near = rest.select("q_id").join(found, "q_id", "left").select("q_id", F.when(taken, F.col("bank_pos")).alias("bank_pos"), "score", F.when(taken, "nearest").otherwise("none").alias("how"))
    return same.unionByName(near)


def packed(rows: DataFrame, key: str, vector: str, prefix: str) -> DataFrame:
    """Blocks of up to BLOCK vectors of one size, in the order of their keys (integers), as packed arrays. Null vectors, and those
    with a null in them, are in none."""
    whole = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()) & F.col(key).isNotNull())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keys, vectors = b.column(0).to_numpy(), b.column(1)
            sizes, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == size)
                at = at[np.argsort(keys[at], kind="stable")]
                for k in range(0, len(at), BLOCK):
                    part = at[k : k + BLOCK]
                    data = flat[starts[part][:, None] + np.arange(size)]
                    yield pa.RecordBatch.from_pylist([{f"{prefix}_size": int(size), f"{prefix}_keys": keys[part].tobytes(), f"{prefix}_data": data.tobytes()}])

    return whole.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, f"{prefix}_size long, {prefix}_keys binary, {prefix}_data binary")


def by_blocks(queries: DataFrame, bank: DataFrame, judge, schema: str) -> DataFrame:
    """What `judge(query keys, bank keys, scores)` gives (columns of `schema`) for each pair of a block of queries (q_id, vector)
    and a block of the bank (bank_pos, vector). Scores are the cosines of unit vectors, to 12 decimals, so that equal vectors
    have equal ones wherever they stand in a block. Blocks are paired, not rows, and each pair is one matrix product."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for q_size, q_keys, q_data, b_size, b_keys, b_data in zip(*batch.columns, strict=True):
                if q_size.as_py() != b_size.as_py():
                    continue
                size, (q, b) = q_size.as_py(), (np.frombuffer(x.as_buffer(), np.int64) for x in (q_keys, b_keys))
                left, right = (np.frombuffer(x.as_buffer(), np.float64).reshape(-1, size) for x in (q_data, b_data))
                found = judge(q, b, np.round(left @ right.T, 12))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names)

    return packed(queries, "q_id", "vector", "q").crossJoin(packed(bank, "bank_pos", "vector", "b")).mapInArrow(run, schema)


#: Cells of the index at most; a number of vectors has its square root of cells. Also how many vectors are sampled for it.
CELLS = 4096
#: What is not near a unit vector is in no cell and compared with everything.
NO_CELL = -1
#: Vectors of the bank that a task holds, and how many of them are compared at a time.
HELD, AT_A_TIME = 1 << 15, 4096
#: How far products of unit vectors of 32 bits may be off, and how many pairs are looked at again at a time.
SLACK, AGAIN = 1e-5, 1 << 16


def _vectors(batch):
    """For each size of vectors in a batch (key, vector): the size, the rows' places, keys and matrix."""
    import numpy as np

    keys, vectors = batch.column(0).to_numpy(), batch.column(1)
    sizes, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        at = at[np.argsort(keys[at], kind="stable")]
        yield int(size), at, keys[at], flat[starts[at][:, None] + np.arange(size)]


def _odd(matrix):
    """Of each row whether it isn't a unit vector."""
    import numpy as np

    with np.errstate(over="ignore"):
        return ~(np.abs((matrix * matrix).sum(axis=1) - 1) <= 1e-6)


def _angles(matrix, centres):
    """Of each row the angle with each centre."""
    import numpy as np

    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        lengths = np.linalg.norm(matrix, axis=1)[:, None] * np.linalg.norm(centres, axis=1)
        return np.arccos(np.clip(matrix @ centres.T / lengths, -1.0, 1.0))


def _whole(rows: DataFrame, key: str) -> DataFrame:
    held = rows.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()) & F.col(key).isNotNull())
    return held.select(F.col(key).cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"))


def sampled(bank: DataFrame) -> tuple[int, dict]:
    """How many vectors the bank has, and about CELLS of them (all, if there are no more), drawn by chance: by size, the keys and a
    matrix, unit vectors only. Nothing but these goes to the driver."""
    import numpy as np

    whole, found = _whole(bank, "bank_pos"), {}
    n = whole.count()
    rows = (whole if n <= CELLS else whole.where(F.rand(1) < CELLS / n)).collect()
    rows.sort(key=lambda r: r.key * 0x9E3779B97F4A7C15 % 2**64)
    for r in rows:
        v = np.array(r.vector)
        if len(v) and not _odd(v[None, :])[0]:
            keys, vectors = found.setdefault(len(v), ([], []))
            keys.append(r.key)
            vectors.append(v)
    return n, {size: (np.array(keys, np.int64), np.stack(vectors)) for size, (keys, vectors) in found.items()}


def centres_of(bank: DataFrame, cells: int | None = None) -> dict:
    """By size, the vectors that the cells lie around: of about n vectors `cells` (the root of n, CELLS at most) of the sample."""
    return _centres(*sampled(bank), cells)


def _centres(n: int, sample: dict, cells: int | None) -> dict:
    k, all_ = cells or min(CELLS, max(1, round(n**0.5))), sum(len(keys) for keys, _ in sample.values()) or 1
    return {size: vectors[: max(1, round(k * len(vectors) / all_))] for size, (_, vectors) in sample.items()}


def _shares(sample: dict, centres: dict) -> dict:
    """By size and cell, where the cell's vectors lie on a line of all, from 0 to 1, as the sample has them."""
    import numpy as np

    counts = {}
    for size, (_, vectors) in sample.items():
        near = _angles(vectors, centres[size]).argmin(axis=1)
        counts |= {(size, cell): int(c) + 1 for cell, c in enumerate(np.bincount(near, minlength=len(centres[size])))}
    ends = np.cumsum([0, *counts.values()]) / (sum(counts.values()) or 1)
    return {k: (ends[i], ends[i + 1]) for i, k in enumerate(counts)}


def in_cells(bank: DataFrame, centres: dict, shares: dict | None = None, parts: int = 1) -> DataFrame:
    """cell, size, keys, data, angle, part: the bank's vectors in packed blocks of up to BLOCK of one cell, with the largest angle to
    its centre. Blocks go to `parts` parts of about one size, by the shares of their cells; a large cell has several parts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for size, _, keys, data in _vectors(batch):
                cell, angle = np.full(len(keys), NO_CELL), np.zeros(len(keys))
                if size in centres:
                    angles, odd = _angles(data, centres[size]), _odd(data)
                    cell = np.where(odd, NO_CELL, angles.argmin(axis=1))
                    angle = np.where(odd, 0.0, angles.min(axis=1))
                order = np.argsort(cell, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    low, high = (shares or {}).get((size, int(cell[part[0]])), (0.0, 1.0))
                    for k in range(0, len(part), BLOCK):
                        of = part[k : k + BLOCK]
                        at = low + (high - low) * (int(keys[of[0]]) * 0x9E3779B97F4A7C15 % 2**64 / 2**64)
                        yield pa.RecordBatch.from_pylist([{"cell": int(cell[of[0]]), "size": size, "keys": keys[of].tobytes(), "data": data[of].tobytes(), "angle": float(angle[of].max()), "part": min(int(at * parts), parts - 1)}])

    return _whole(bank, "bank_pos").mapInArrow(run, "cell long, size long, keys binary, data binary, angle double, part long")


def _asking(queries: DataFrame, sample: dict, others: bool) -> DataFrame:
    """size, keys, data, low: queries (q_id, vector) in packed blocks of up to BLOCK, each with the second best score it has in the
    sample (which is of the bank), so that no lower one can be among its best two."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for size, _, keys, data in _vectors(batch):
                for k in range(0, len(keys), BLOCK):
                    q, left = keys[k : k + BLOCK], data[k : k + BLOCK]
                    low = np.full(len(q), -np.inf)
                    if size in sample and len(sample[size][0]) > 1:
                        scores = left @ sample[size][1].T
                        if others:
                            scores[q[:, None] == sample[size][0][None, :]] = -np.inf
                        low = np.partition(scores, -2, axis=1)[:, -2] - 1e-9 * np.maximum(1.0, np.linalg.norm(left, axis=1))
                    yield pa.RecordBatch.from_pylist([{"size": size, "keys": q.tobytes(), "data": left.tobytes(), "low": low.tobytes()}])

    return _whole(queries, "q_id").mapInArrow(run, "size long, keys binary, data binary, low binary")


class Held:
    """The vectors of one size that a task holds, in the order of their cells; blocks: (cell, keys, data, angle) in that order."""

    def __init__(self, size: int, blocks: list, centres: dict):
        import numpy as np

        self.keys = np.concatenate([np.frombuffer(b[1], np.int64) for b in blocks])
        self.exact = np.concatenate([np.frombuffer(b[2], np.float64).reshape(-1, size) for b in blocks])
        cells, counts = np.array([b[0] for b in blocks]), np.array([len(b[1]) // 8 for b in blocks])
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        ends = np.cumsum(counts)
        self.first, self.end = (ends - counts)[starts], ends[np.r_[starts[1:], len(cells)] - 1]
        self.cell, self.radius = cells[starts], np.maximum.reduceat([b[3] for b in blocks], starts)
        self.centres = centres[size][self.cell] if size in centres else np.zeros((len(self.cell), size))
        self.odd = int(self.end[0]) if self.cell[0] == NO_CELL else 0  # so many stand first
        with np.errstate(over="ignore"):
            self.rough = self.exact.astype(np.float32)
            self.longest = max(1.0, np.linalg.norm(self.exact[: self.odd], axis=1).max(initial=0.0))

    def best_two(self, q, left, low, others: bool):
        """q, bank keys, scores, products: of each query the best two entries (of equal scores the first), unless its low rules them out;
        products: how many pairs each query's block was compared on."""
        import numpy as np

        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # rows, entries, scores
        odd, low, made = _odd(left), low.copy(), np.zeros(len(q), np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            nearer = np.cos(np.maximum(0.0, _angles(left, self.centres) - self.radius)) + SLACK  # more than lengths may be off
            asks = odd[:, None] | (self.cell == NO_CELL) | (nearer >= low[:, None])
            rough, slack = left.astype(np.float32), SLACK * np.maximum(1.0, np.linalg.norm(left, axis=1)) * self.longest
        if asks.mean() > 0.5:  # then cells don't save as much as large products
            spans = [(a, b, None) for start, end in ((0, self.odd), (self.odd, len(self.keys))) for a in range(start, end, AT_A_TIME) for b in [min(a + AT_A_TIME, end)]]
        else:
            spans = [(a, min(a + AT_A_TIME, end), c) for c, (start, end) in enumerate(zip(self.first, self.end, strict=True)) for a in range(start, end, AT_A_TIME)]
        for a, b, c in spans:
            of = np.arange(len(q)) if c is None else np.flatnonzero(asks[:, c])
            if not len(of):
                continue
            made[of] += b - a
            with np.errstate(over="ignore", invalid="ignore"):
                scores = left[of] @ self.exact[a:b].T if a < self.odd or odd[of].any() else rough[of] @ self.rough[a:b].T
            near = np.flatnonzero(scores.max(axis=1) >= low[of] - slack[of])
            if not len(near):
                continue
            of, scores = of[near], scores[near]
            if others:
                scores[q[of][:, None] == self.keys[None, a:b]] = -np.inf
            least = low[of] - slack[of]
            if (scores >= least[:, None]).sum() > 16 * len(of):
                least = np.maximum(least, np.partition(scores, max(-2, -scores.shape[1]), axis=1)[:, max(-2, -scores.shape[1])] - 2 * slack[of])
            rows, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            for k in range(0, len(rows), AGAIN):
                r, e = of[rows[k : k + AGAIN]], a + at[k : k + AGAIN]
                value = np.round(np.einsum("ij,ij->i", left[r], self.exact[e]), 12)
                r, e, value = (np.concatenate(x) for x in zip(best, (r, e, value), strict=True))
                order = np.lexsort((self.keys[e], -value, r))
                r, e, value = r[order], e[order], value[order]
                new = np.r_[True, r[1:] != r[:-1]]
                second = np.r_[False, new[:-1]] & ~new
                best = tuple(x[new | second] for x in (r, e, value))
                low[r[second]] = np.maximum(low[r[second]], value[second] - slack[r[second]] * 1e-4)
        return q[best[0]], self.keys[best[1]], best[2], made[best[0]]


def candidates(queries: DataFrame, bank: DataFrame, others: bool = False, cells: int | None = None) -> DataFrame:
    """q_id, bank_pos, score, products: entries among which the best two of each query are.

    The bank lies in parts of about HELD vectors; a task holds one of them and lets all queries pass in blocks, so two rows at most come
    from a query and part. Within a part vectors lie in cells around some of the bank's: by the triangle inequality no entry of a cell
    is nearer than the angle to its centre less its radius, so cells whose bound is below the second best score that a query has
    already are passed over. What is left is compared by products of 32 bits, and what these can't rule out by such of 64. This is
    exact; how much cells save depends on the vectors: with far neighbours only, as of random ones, the bound excludes little."""
    n, sample = sampled(bank)
    centres, cores = _centres(n, sample, cells), bank.sparkSession.sparkContext.defaultParallelism
    parts = max(1, round(n / HELD), min(2 * cores, round(n / BLOCK)))
    none = lambda kind: F.lit(None).cast(kind)
    held = in_cells(bank, centres, _shares(sample, centres), parts).select("part", F.lit(0).alias("kind"), "size", "cell", "keys", "data", "angle", none("binary").alias("low"))
    asking = _asking(queries, sample, others).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(1).alias("kind"), "size", none("long").alias("cell"), "keys", "data", none("double").alias("angle"), "low")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        part, blocks, ready = None, {}, {}
        for batch in batches:
            for at, kind, size, cell, keys, data, angle, low in zip(*batch.columns, strict=True):
                if at.as_py() != part:
                    part, blocks, ready = at.as_py(), {}, {}
                size = size.as_py()
                if kind.as_py() == 0:
                    blocks.setdefault(size, []).append((cell.as_py(), keys.as_py(), data.as_py(), angle.as_py()))
                    continue
                if size in blocks:
                    ready[size] = Held(size, blocks.pop(size), centres)
                if size in ready:
                    q, bound = np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(low.as_buffer(), np.float64)
                    found = ready[size].best_two(q, np.frombuffer(data.as_buffer(), np.float64).reshape(-1, size), bound, others)
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["q_id", "bank_pos", "score", "products"])

    dealt = held.unionByName(asking).repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "kind", "size", "cell")
    return dealt.mapInArrow(run, "q_id long, bank_pos long, score double, products long")


def nearest(queries: DataFrame, bank: DataFrame, others: bool = False) -> DataFrame:
    """q_id, bank_pos, score, second: the entry of the highest cosine, the earlier of equals, and the next best score (0 if none).

    queries: q_id, vector; bank: bank_pos, vector. Queries and entries without a whole vector match nothing; with `others` none
    matches the entry of its own number. Scores are the cosines of unit vectors, to 12 decimals, so that equal vectors have equal ones
    wherever they stand. Two rows come from a query and part of the bank at most."""
    scored = candidates(queries, bank, others).drop("products")
    best = scored.withColumn("k", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "bank_pos"))).where("k <= 2")
    return best.groupBy("q_id").agg(F.min_by("bank_pos", "k").alias("bank_pos"), F.min_by("score", "k").alias("score"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("score"))), F.lit(0.0)).alias("second"))


def bands(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """q_id, band, n: how many entries of the bank are in each band of relevance of each query; bands without any are left out."""

    def counted(q, b, scores):
        import numpy as np

        s = np.round(scores, 6)
        low, high = (s < IRRELEVANT).sum(axis=1), (s >= PARTLY).sum(axis=1)
        return [q, low, len(b) - low - high, high]

    n = by_blocks(queries, bank, counted, "q_id long, irrelevant long, partial long, relevant long").groupBy("q_id").agg(*(F.sum(c).alias(c) for c in BANDS))
    return n.select("q_id", F.explode(F.array(*(F.struct(F.lit(c).alias("band"), F.col(c).alias("n")) for c in BANDS))).alias("x")).where("x.n > 0").select("q_id", "x.band", "x.n")


def with_margin(found: DataFrame, threshold: float = 0.75, margin: float = 0.08) -> DataFrame:
    """Adds verdict: accepted, ambiguous (too near the second) or below."""
    verdict = F.when(F.col("score") < threshold, "below").when(F.col("score") - F.col("second") < margin, "ambiguous").otherwise("accepted")
    return found.withColumn("verdict", verdict)


def coverage(answers: DataFrame, bank: DataFrame, cuts: int | None = None) -> DataFrame:
    """item_id, doc_id, n_keywords, n_found: for each answer (doc_id, body) and entry (item_id, kws) how many of the entry's
    keywords, repeats counted, the body holds as substrings; pairs without any are left out.

    The bank is cut into parts of some BANK_WORDS keywords and BANK_BYTES bytes (counted), by a hash of the entries' numbers; an
    entry stays whole. Each part becomes one automaton that every task builds, and reads a body once whatever the number of
    keywords; nothing is paired or shuffled. A bank of one part, as most are, reads the bodies once."""
    sizes = bank.agg(F.coalesce(F.sum(F.greatest(F.size("kws"), F.lit(1))), F.lit(0)), F.coalesce(F.sum(F.octet_length(F.array_join("kws", ""))), F.lit(0))).first()
    n = cuts or max(1, -(-sizes[0] // BANK_WORDS), -(-sizes[1] // BANK_BYTES))
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    out = None
    for k in range(n):
        entries = [(r.item_id, [k for k in r.kws or () if k is not None], len(r.kws or ())) for r in bank.where(part == k).select("item_id", "kws").collect()]
        if entries or out is None:
            found = _covered(answers, entries)
            out = found if out is None else out.unionByName(found)
    return out


def _covered(answers: DataFrame, entries: list) -> DataFrame:
    """`coverage` for entries (item_id, keywords, their number with nulls) on the driver."""

    def run(batches):
        from collections import Counter

        import ahocorasick
        import pyarrow as pa

        holders = {}
        for at, (_, kws, _) in enumerate(entries):
            for k in kws:
                holders.setdefault(k, []).append(at)
        always, machine = holders.pop("", []), ahocorasick.Automaton()
        for k, ats in holders.items():
            machine.add_word(k, (k, ats))
        machine.make_automaton()
        for b in batches:
            for start in range(0, b.num_rows, AT_ONCE):
                out = []
                for doc_id, body in zip(*(c.to_pylist() for c in b.slice(start, AT_ONCE).columns), strict=True):
                    if body is None:
                        continue
                    counts = Counter(always)
                    for _, ats in ({k: ats for _, (k, ats) in machine.iter(body)} if len(machine) else {}).items():
                        counts.update(ats)
                    out += [(entries[at][0], doc_id, entries[at][2], n) for at, n in counts.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["item_id", "doc_id", "n_keywords", "n_found"])

    return answers.select("doc_id", "body").mapInArrow(run, "item_id long, doc_id long, n_keywords long, n_found long")
