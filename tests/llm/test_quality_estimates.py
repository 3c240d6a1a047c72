"""The estimates of quality rules against the same definition in numpy, on every document of the smallest tables."""

import numpy as np

from markwright.llm import quality
from markwright.llm.quality import CUT, FLOORS, P, PRIOR, SCALE, SHARE, STEPS

D = "/root/testdata/sf0.001"
FLOOR = np.array(list(FLOORS.values()))


def half_up(x):
    return np.floor(np.asarray(x) + 0.5)


def level(d2):
    return half_up(50 * np.log(d2 + 1e-6))


def distances(x, m, c):
    y = x - m
    return np.einsum("ij,ij->i", y @ np.linalg.inv(c + np.diag(FLOOR**2)), y)


def mcd(x):
    middle = np.median(half_up(100 * x), axis=0) / 100
    spread = np.maximum(0.014826 * np.median(half_up(100 * np.abs(x - middle)), axis=0), FLOOR)
    z, ends = ((x - middle) / spread) ** 2, []
    for k, d2 in enumerate((z.max(1), z.sum(1))):
        for _ in range(STEPS):
            inside = x[level(d2) <= np.percentile(level(d2), 100 * SHARE)]
            m, c = inside.mean(0), SCALE * np.cov(inside.T, bias=True).reshape(P, P)
            d2 = distances(x, m, c)
        ends.append((np.linalg.slogdet(c + np.diag(FLOOR**2))[1], k, m, c))
    return len(x), *min(ends, key=lambda e: e[:2])[2:]


def expected(rows):
    """doc_id -> distance, for rows of statistics that pass the base rules."""
    n = np.array([[r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] for r in rows], float).T
    x = np.array([np.log1p(n[0]), n[1] / n[0], np.sqrt(n[2] / n[1]), np.sqrt(n[4] / n[0]), np.log1p(n[3])]).T
    pools = [[(r.lang, r.source) for r in rows], [r.lang for r in rows], [0] * len(rows)]
    of = lambda k, name: x[[p == name for p in pools[k]]]
    whole, out = mcd(x), {}
    for own in dict.fromkeys(pools[0]):
        m, c = whole[1:]
        for size, m1, c1 in (mcd(of(1, own[0])), mcd(of(0, own))):
            w = size / (size + PRIOR)
            m, c = w * m1 + (1 - w) * m, w * c1 + (1 - w) * c
        here = [k for k, p in enumerate(pools[0]) if p == own]
        out |= dict(zip((rows[k].doc_id for k in here), distances(x[here], m, c), strict=True))
    return out


def test_distances_are_those_of_numpy(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = quality.judge(docs.unionByName(docs.limit(5))).collect()  # five rows that repeat
    assert len(got) == docs.count() + 5
    want = expected([r for r in got if not r.base_failed])
    assert len(want) > 50
    for r in got:
        assert (r.distance is None) == r.base_failed == (r.doc_id not in want)
        if r.distance is not None:
            assert abs(r.distance - want[r.doc_id]) <= 1e-6 * (1 + want[r.doc_id])
            assert r.kept == (want[r.doc_id] <= CUT)
        else:
            assert not r.kept


def test_same_estimates_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    few = {r.doc_id: r.distance for r in quality.judge(docs).collect()}
    monkeypatch.setattr(quality, "FEW_GROUPS", 0)
    many = {r.doc_id: r.distance for r in quality.judge(docs).collect()}
    assert few.keys() == many.keys()
    assert all((few[k] is None) == (many[k] is None) and (few[k] is None or abs(few[k] - many[k]) < 1e-6 * (1 + few[k])) for k in few)
