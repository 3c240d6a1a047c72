"""Nearest neighbours in cells and vectors of texts against plain numpy; matches by text, with null, empty and equal questions."""

import hashlib
import math

import numpy as np
import pytest

from markwright.functions import vectors
from markwright.operators import match

V = "bank_pos long, vector array<double>"


def brute(queries, bank, others=False):
    out = {}
    for q, v in queries:
        scores = sorted(((-round(float(np.dot(v, w)), 12), b) for b, w in bank if v and w and len(v) == len(w) and not (others and b == q)))
        if scores:
            out[q] = (scores[0][1], round(-scores[0][0], 9), round(-scores[1][0], 9) if len(scores) > 1 else 0.0)
    return out


def clustered(seed, n, size=16, spread=0.05):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, size))
    v = centres[r.integers(0, 12, n)] + spread * r.normal(size=(n, size))
    return [(k, list(map(float, x / np.linalg.norm(x)))) for k, x in enumerate(v)]


@pytest.mark.parametrize("others", [False, True])
def test_nearest(spark, others):
    bank = clustered(1, 600)
    bank += [(900 + k, bank[5][1]) for k in range(3)] + [(910, [0.3] * 16), (911, [1.0, 0.0]), (912, []), (913, [0.6, 0.8])]  # equal, not of length 1, other sizes
    queries = bank[::20] + bank[-7:] + [(2000, [0.0] * 16), (2001, [0.0, 1.0]), (2002, [1.0] * 5)]
    q = spark.createDataFrame([*queries, (3000, None), (None, bank[0][1])], V).withColumnRenamed("bank_pos", "q_id")
    b = spark.createDataFrame([*bank, (3001, None), (None, bank[1][1])], V).repartition(3)
    got = {r.q_id: (r.bank_pos, round(r.score, 9), round(r.second, 9)) for r in match.nearest(q, b, others).collect()}
    assert got == brute(queries, bank, others)


def test_cells_save_pairs(spark):
    """Vectors in groups: all nearest ones are found on a small part of the pairs."""
    bank = clustered(2, 3000)
    b = spark.createDataFrame(bank, V)
    q = b.where("bank_pos % 20 = 0").withColumnRenamed("bank_pos", "q_id")
    made = match.candidates(q, b, cells=40)
    products = made.groupBy("q_id").max("score").count() and sum(r.products for r in made.dropDuplicates(["q_id", "bank_pos"]).select("products").collect())
    got = {r.q_id: (r.bank_pos, round(r.score, 9), round(r.second, 9)) for r in match.nearest(q, b).collect()}
    assert got == brute(bank[::20], bank) and products
    blocks = match.in_cells(b, match.centres_of(b, 40))
    assert sum(len(r["keys"]) // 8 for r in blocks.collect()) == 3000


def test_empty_bank(spark):
    none = spark.createDataFrame([], V)
    some = spark.createDataFrame([(1, [1.0])], V)
    assert match.nearest(some.withColumnRenamed("bank_pos", "q_id"), none).collect() == []
    assert match.nearest(none.withColumnRenamed("bank_pos", "q_id"), some).collect() == []


def test_matches_by_text(spark):
    """White space within counts, that at the ends and final stops don't; empty questions match nothing."""
    b = spark.createDataFrame([(1, "a b?"), (2, "A B"), (3, "a  b"), (4, ""), (5, None), (6, " x\t")], "bank_pos long, question string")
    q = spark.createDataFrame([(1, " a b."), (3, "a  b"), (4, ""), (5, None), (9, "X!"), (2, "a b")], "q_id long, question string")
    assert {r.q_id: r.bank_pos for r in match.exact(q, b).collect()} == {1: 1, 2: 1, 3: 3, 9: 6}
    assert {r.q_id: r.bank_pos for r in match.exact(q, b, others=True).collect()} == {1: 2, 2: 1, 9: 6}


def test_whole_match(spark):
    """Questions without a vector, or of rules only, stay, without a match."""
    s = "q_id long, question string, vector array<double>"
    q = spark.createDataFrame([(1, "one", [1.0, 0.0]), (2, "two", None), (3, "___", [1.0, 0.0]), (4, "", [0.0, 1.0])], s)
    b = spark.createDataFrame([(11, "uno", [1.0, 0.0]), (12, "TWO.", None), (13, "...", [0.0, 1.0])], s.replace("q_id", "bank_pos"))
    got = {r.q_id: (r.bank_pos, r.score, r.how) for r in match.bank_match(q, b).collect()}
    assert got == {1: (11, 1.0, "nearest"), 2: (12, 1.0, "exact"), 3: (None, None, "none"), 4: (None, None, "none")}


def bag(text):
    v = np.zeros(vectors.WIDTH)
    for w in (text or "").lower().split():
        h = hashlib.md5(w.encode()).hexdigest()
        v[int(h[:2], 16)] += 1 if int(h[2], 16) % 2 == 0 else -1
    return v


def test_text_vectors(spark):
    texts = {1: "The cat  sat", 2: "the CAT", 3: "", 4: None, 5: "é ñ é", 6: "far away " * 900}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    got = {r.k: np.array(r.vector) for r in vectors.text_vectors(df, "k", "t").collect()}
    assert sorted(got) == [1, 2, 5, 6]
    for k, v in got.items():
        assert np.allclose(v, bag(texts[k]) / np.linalg.norm(bag(texts[k])))
    rows = spark.createDataFrame([(1, 2, texts[1]), (2, 2, texts[2]), (3, 2, ""), (5, 2, texts[5]), (7, 9, "x"), (8, 3, "x")], "d long, k long, a string")
    sims = {r.d: r.similarity for r in vectors.similarities(rows, "d", "a", df, "k", "t").collect()}
    assert math.isclose(sims[2], 1.0) and math.isclose(sims[1], got[1] @ got[2]) and math.isclose(sims[5], got[5] @ got[2], abs_tol=1e-12)
    assert (sims[3], sims[7], sims[8]) == (None, None, None)


def test_ratios_are_those_of_difflib(spark):
    """Every window by difflib itself, long texts in several steps, keywords of several words and odd ones."""
    import random
    from difflib import SequenceMatcher

    from markwright.functions import fuzzy

    r = random.Random(4)
    word = lambda n=9: "".join(r.choice("abcdeñ") for _ in range(r.randrange(1, n)))

    def plain(keyword, text):
        keyword, words = keyword or "", (text or "").split()
        if keyword in (text or ""):
            return 1.0
        n = len(keyword.split())
        found = [SequenceMatcher(None, keyword, " ".join(words[k : k + size])).ratio() for size in {n, max(1, n - 1), n + 1} - {0} for k in range(len(words) - size + 1)]
        return max(found, default=0.0)

    for case in range(300):
        text = " ".join(word() for _ in range(r.choice([0, 1, 5, 40]))) if case else " ".join(word() for _ in range(2500))
        if case % 9 == 1:
            text += " " + word(400) + " " + "y" * 250
        keywords = [" ".join(word() for _ in range(r.randrange(4))) for _ in range(3)] + ["", None, " ", "x" * 70, word(90)]
        assert fuzzy._ratios(keywords, text) == [plain(k, text) for k in keywords]
    assert fuzzy._ratios(["a"], None) == [0.0] and fuzzy._ratios([], "a") == []


@pytest.mark.parametrize("others", [False, True])
def test_rows_a_part(spark, others, monkeypatch):
    """Two rows at most come from a query and part of the bank, however many cells there are and blocks its tasks read; the best two
    are the right ones in several parts too, with vectors that are equal, not of length 1 or of another size."""
    monkeypatch.setattr(match, "HELD", 400)
    r = np.random.default_rng(7)
    v = r.normal(size=(2400, 24)).astype(np.float32).astype(float)
    bank = [(k, list(map(float, x / np.linalg.norm(x)))) for k, x in enumerate(v)]
    bank += [(5000 + k, bank[20 * k][1]) for k in range(30)] + [(6000 + k, bank[40][1]) for k in range(700)] + [(7000, [2.0] * 24), (7001, [0.0] * 24), (7002, [0.6, 0.8]), (7003, [1e3] + [0.0] * 23)]
    b = spark.createDataFrame(bank, V).repartition(12)
    queries = bank[::20] + bank[-4:]
    q = spark.createDataFrame(queries, V).withColumnRenamed("bank_pos", "q_id")
    made = match.candidates(q, b, others, cells=50)
    most = made.groupBy("q_id").count().agg({"count": "max"}).first()[0]
    assert most <= 2 * round(len(bank) / 400)
    got = {x.q_id: (x.bank_pos, round(x.score, 9), round(x.second, 9)) for x in match.nearest(q, b, others).collect()}
    assert got == brute(queries, bank, others)


def test_keys_without_texts(spark):
    """Texts are read for their key and for whether they say anything before any join; what says nothing is what cleaning empties."""
    from markwright.functions import text
    from markwright.plans.queries import QUERIES

    cases = ["", None, " \t", "...", "..", "||", "|", "__ ...", ". . .", "..||.", "a", " ñ", "|_|", "​　", "....|", "  \n. "]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, question string")
    want = {r.k: r.c != "" for r in rows.select("k", text.preprocess(rows.question).alias("c")).collect()}
    got = {r.k: (r.says, r.key is None) for r in match.keyed(rows).collect()}
    assert got == {k: (want[k], not cases[k]) for k in want}
    plan = QUERIES["bank_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Project [" in line and "vector" in line]
    assert joins and not any("question" in line or "text" in line for line in joins)
