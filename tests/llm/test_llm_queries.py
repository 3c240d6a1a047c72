"""The opN_ queries against DuckDB where there is SQL, else against the operators' own outputs."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from markwright.llm import common, near, pii, queries, quality, toxicity

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(name, spark, duck):
    out = queries.QUERIES[name](spark, D)
    want = duck.execute(queries.SQL[name]).fetchall()
    names = [x[0] for x in duck.description]
    assert sorted(names) == sorted(out.columns) and want
    plain = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(v) for v in r) for r in out.select(*names).collect()) == sorted(tuple(plain(v) for v in r) for r in want)


def test_sharding_columns(spark, duck):
    text = dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    rows = queries.QUERIES["op3_sharding"](spark, D).collect()
    assert {r.doc_id for r in rows} == text.keys() and len(rows) == len(text)
    shard_of = {}
    for r in rows:
        b = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "bytes", None) and 0 <= r.shard < 40
        assert shard_of.setdefault(b, r.shard) == r.shard


def test_pii_columns(spark, duck):
    for r in queries.QUERIES["op7_pii"](spark, D).collect():
        t = duck.execute("SELECT coalesce(text, '') FROM documents WHERE doc_id = ?", [r.doc_id]).fetchone()[0]
        found = [x for x in pii.spans_of(t)]
        base = [f"{k}:{a}:{b}" for k, a, b, _ in found if k != "iban"]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in found) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)


def test_quality_columns(spark, duck):
    import re

    for r in queries.QUERIES["op6_quality"](spark, D).collect():
        t = duck.execute("SELECT coalesce(text, '') FROM documents WHERE doc_id = ?", [r.doc_id]).fetchone()[0]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines) == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words)) and not (r.base_failed and r.kept)
    assert quality.P == 5


def test_spread_join(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"g{k % 40}" if k % 2 else None) for k in range(900)], "id int, g string")
    groups = rows.where("g IS NOT NULL").groupBy("g").count().selectExpr("g", "count AS n", "concat(g, '!') AS more")
    for how in ("left", "inner"):
        got = sorted((r.id, r.more) for r in common.spread_join(rows, groups, "g", "n", how).collect())
        assert got == sorted((r.id, f"{r.g}!" if r.g else None) for r in rows.collect() if r.g or how == "left")
    few = groups.where("g IN ('hot', 'g9')")
    assert sorted(r.id for r in common.spread_join(rows, few, "g", "n", "left_semi").collect()) == sorted(r.id for r in rows.collect() if r.g in ("hot", "g9"))


def test_near_contiguous_edits(spark):
    """One block of a text replaced, removed or put in, at a similarity just over 0.8: all pairs are found."""
    r, rows = random.Random(5), []
    for n in (60, 150, 700):
        size = int((n - 4) / 9) - 4
        for k in range(20):
            base = [f"w{r.randint(0, 3000)}" for _ in range(n)]
            at, block = r.randint(0, n - size), [f"z{r.random()}" for _ in range(size)]
            other = [base[:at] + block + base[at + size :], base[:at] + base[at + size :], base[:at] + block + base[at:]][k % 3]
            sets = [set(near.shingles(near.word_hashes(" ".join(w)), 5).tolist()) for w in (base, other)]
            assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    got = {x.doc_id: x.component_id for x in near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def edited(kind, base, size, r):
    """`base` with `size` words edited."""
    new, n, a, b = (lambda k: [f"z{r.random()}" for _ in range(k)]), len(base), (size + 1) // 2, size // 2
    c, mid = max(1, size // 3), n // 2
    if kind == "scattered":
        gone = set(random.Random(n).sample(range(n), size))
        return [f"z{r.random()}" if k in gone else w for k, w in enumerate(base)]
    return {
        "both ends replaced": lambda: new(a) + base[a : n - b] + new(b),
        "both ends longer": lambda: new(a) + base + new(b),
        "both ends shorter": lambda: base[a : n - b],
        "ends and middle": lambda: new(c) + base[c:mid] + new(c) + base[mid + c : n - c] + new(c),
    }[kind]()


def test_near_other_edits(spark):
    """Pairs just over 0.8 with edits at both ends, in three places or anywhere: at least 0.97 of each kind are found, no link is made up."""
    r, rows, kinds = random.Random(9), [], []
    for kind in ("both ends replaced", "both ends longer", "both ends shorter", "ends and middle", "scattered"):
        for n in (60, 150, 400, 1000):
            for _ in range(60):
                base, other = [f"w{r.randint(0, 3000)}" for _ in range(n)], None
                for size in range(1, n):
                    w = edited(kind, base, size, r)
                    sets = [set(near.shingles(near.word_hashes(" ".join(x)), 5).tolist()) for x in (base, w)]
                    if 10 * len(sets[0] & sets[1]) < 8 * len(sets[0] | sets[1]):
                        break
                    other = w
                if other:
                    rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
                    kinds.append(kind)
    got = {x.doc_id: x.component_id for x in near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c in (i, i - i % 2) for i, c in got.items())
    found = [got[2 * k + 1] == 2 * k for k in range(len(kinds))]
    for kind in set(kinds):
        of = [f for f, k in zip(found, kinds, strict=True) if k == kind]
        assert len(of) > 150 and sum(of) >= 0.97 * len(of)


def test_chain_hands_on_unseen_odds():
    """The odds of a fold come from features and weights that its rows and labels had no part in."""
    r = np.random.default_rng(0)
    words = [f"f{k}" for k in range(40)]
    rows = [(k, np.sort(r.choice(40, 8, replace=False)).astype(np.int32).tobytes(), np.ones(8, np.uint8).tobytes(), 20, [0.0] * toxicity.N_FIGURES, int(r.integers(2)), int(r.integers(2))) for k in range(200)]
    a = toxicity.Chain(("one", "two")).fit(rows, words)
    turned = [(*x[:5], 1 - x[5], x[6]) if x[0] % toxicity.FOLDS == 0 else x for x in rows]  # other labels of fold 0 only
    b = toxicity.Chain(("one", "two")).fit(turned, words)
    of_0 = np.arange(200) % toxicity.FOLDS == 0
    assert np.allclose(a.unseen[0][of_0], b.unseen[0][of_0]) and not np.allclose(a.unseen[0][~of_0], b.unseen[0][~of_0])
