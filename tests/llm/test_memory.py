"""What a Python worker holds at a time, and what is shuffled."""

import sys

from pyspark.sql import functions as F

from markwright.llm import bpe, common, substring_dedup, suffix_dedup
from markwright.llm.common import map_rows


def test_arrow_batches_are_small(spark):
    import pyarrow as pa

    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('ten bytes ', 100) AS text")
    sizes = lambda: [r.n for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    try:
        spark.conf.set(limit, 10_000)
        rows = map_rows(docs, lambda rows: ((i, len(t)) for i, t in rows), "doc_id long, n int")
        assert sorted(map(tuple, rows.collect())) == [(k, 1000) for k in range(4000)]
        assert sum(sizes()) == 4000 and max(sizes()) <= 1000  # before, one of 4,000
        spark.conf.set(limit, 7)  # a lower one stays
        map_rows(docs, lambda rows: rows, "doc_id long, text string")
        assert spark.conf.get(limit) == "7"
    finally:
        spark.conf.set(limit, before)


def test_kept_encodings_are_compact():
    codec = bpe.codec()
    words = [f"qx{k}zj{k * k}" for k in range(2000)]
    text = " ".join(words)
    ids = codec.encode(text)
    assert codec.decode(ids).decode() == text and codec.encode(text) == ids  # the second time from what is kept
    held = sum(sys.getsizeof(v) + (sum(map(sys.getsizeof, v)) if isinstance(v, list) else 0) for v in codec.known.values())
    assert len(codec.known) > 1000 and held < 64 * len(codec.known)


def test_texts_without_a_list_are_not_shuffled(spark, monkeypatch):
    docs = spark.range(0, 2000, 1, 1).selectExpr("IF(id = 5, NULL, id) AS doc_id", "concat('text ', id) AS text")
    places = spark.createDataFrame([(7, [1, 2]), (suffix_dedup.NULL_ID, [3]), (99999, [4])], "doc_id long, places array<int>")
    spans = places.selectExpr("doc_id AS doc", "doc_id % 3 AS tag", "CAST(places AS array<long>) AS spans")
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 0)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else Spark puts small partitions together
    try:
        for join, name in ((lambda how: substring_dedup.joined(docs, places, how), "places"), (lambda how: suffix_dedup._with_lists(docs, spans, "spans", how), "spans")):
            rows = join("left").withColumn("part", F.spark_partition_id()).collect()
            assert sorted((r.doc_id, r.text) for r in rows) == sorted((suffix_dedup.NULL_ID if k == 5 else k, f"text {k}") for k in range(2000))
            assert {r.doc_id: len(r[name]) for r in rows if r[name] is not None} == {7: 2 if name == "places" else 1, suffix_dedup.NULL_ID: 1}
            assert len({r.part for r in rows if r[name] is None}) == 1  # of one partition before; shuffled, they are in all
            assert sorted(r.doc_id for r in join("inner").collect()) == [suffix_dedup.NULL_ID, 7]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_filter_of_many_keys(spark, monkeypatch):
    rows = spark.range(-3000, 3000).selectExpr("id", "-id AS filter_at")
    keys = spark.range(-3000, 3000).where("id % 7 = 0")
    for words in (1 << 17, 40, 1):  # bits for all, for some of the keys, for few
        monkeypatch.setattr(common, "FILTER_WORDS", words)
        got = {r.id: (r.filter_at, r.m) for r in common.maybe_in(rows, keys, "id", "m").collect()}
        assert len(got) == 6000 and all(v[0] == -k and (v[1] or k % 7) for k, v in got.items())
        assert words < 1 << 17 or sum(m for _, m in got.values()) < 900  # 857 or 858 are keys
