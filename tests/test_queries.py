"""Each query with SQL gives the rows that DuckDB gives for its SQL; each query without gives rows."""

import os

import duckdb
import pytest

from markwright.plans.queries import QUERIES, SQL

D = os.environ.get("MARKWRIGHT_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(found, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in found)


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, duck):
    out = QUERIES[name](spark, D)
    got = out.collect()
    columns = sorted(out.columns)
    if name not in SQL:
        assert got
        return
    want = duck.execute(SQL[name]).fetchall()
    names = [x[0] for x in duck.description]
    assert sorted(names) == columns
    assert want
    assert rows([r.asDict() for r in got], columns) == rows([dict(zip(names, r, strict=True)) for r in want], columns)


def test_all_keywords_are_scored(spark):
    """Every long word of a bank entry is a keyword of its answers, not a prefix of them."""
    bank = {r.item_id: list(dict.fromkeys(w for w in r.text.lower().split(" ") if len(w) > 6)) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()}
    assert max(map(len, bank.values())) > 6
    answers = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["fuzzy_keywords"](spark, D).collect()}
    concepts = {r.doc_id: r.concept_score for r in QUERIES["concept_score"](spark, D).collect()}
    scored = {r.doc_id: r for r in QUERIES["score_answers"](spark, D).collect()}
    assert found.keys() == concepts.keys() == scored.keys() == answers.keys()
    for i, r in found.items():
        keywords = bank[i % len(bank)]
        assert sorted(x for x in (r.matched + ", " + r.missing).split(", ") if x) == sorted(keywords)
        assert scored[i].feedback == "There is no answer." or scored[i].keyword == r.keyword_score
        plain = " ".join(answers[i].lower().split())
        sure = sum(k[:5] in plain for k in keywords)
        assert concepts[i] >= round(10 * sure / len(keywords), 2) - 0.01 if keywords else concepts[i] == 0
        assert not keywords or abs(concepts[i] * len(keywords) / 10 - round(concepts[i] * len(keywords) / 10)) < 0.01 * len(keywords)


def test_marks_by_relevance(spark):
    """No marks below a confidence of 0.20 or under three words, 2.0 of ten at most up to 0.35."""
    n_words = {r.doc_id: len(r.text.split()) for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = QUERIES["score_answers"](spark, D).collect()
    assert len(rows) == len(n_words)
    assert any(r.keyword < 2 for r in rows) and any(2 <= r.keyword < 3.5 for r in rows) and any(r.keyword >= 3.5 for r in rows)
    for r in rows:
        if r.keyword < 2 or n_words[r.doc_id] < 3:
            assert (r.raw, r.marks, r.rounded) == (0.0, 0.0, 0.0)
        elif r.keyword < 3.5:
            assert 0 < r.marks <= 2.0 and r.raw > 0
