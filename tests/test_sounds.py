"""Phonetic forms by hand-made cases, and the sounds bonus on them; coverage by a bank in parts."""

from pyspark.sql import functions as F

from markwright.functions import sheets
from markwright.operators import evaluate, match


def test_phonetic_forms(spark):
    cases = {
        "தமிழ்": "tamizh", "அம்மா": "ammA", "க": "ka", "க்": "k", "கி": "ki", "கை": "kai", "கொ": "ko", "கோ": "kO", "கௌ": "kau", "க\u0bc6\u0bd7": "kau", "க\u0bc6\u0bbe": "ko", "க\u0bc7\u0bbe": "kO", "இந்தியா": "intiyA",
        "ஔவை": "auvai", "ஃ": "H", "abc க d": "abc ka d", "plain": "plain", "": "", "ங்ஞ": "~N~na", "ழளறன": "zhaLaRana",
    }
    df = spark.createDataFrame([*cases.items(), (None, None)], "t string, want string")
    for r in df.select("t", "want", sheets.phonetic(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_sounds_bonus(spark):
    """A keyword spelled otherwise that sounds alike counts; the column comes from the texts."""
    df = spark.createDataFrame([(["நன்றி", "மரம்"], "நண்றி சொன்னார்")], "keywords array<string>, answer string")
    r = evaluate.sounds(df).first()
    assert r.sounds[0] >= 0.7 > r.sounds[1]
    got = evaluate.sounds(df).select(evaluate.with_sounds(F.lit(0.0), F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0)), F.col("sounds")).alias("s")).first().s
    assert got == round(10 * r.sounds[0] / 2, 2)


def test_coverage_in_parts(spark):
    """The same counts whatever the number of parts, and no pairing of texts with entries."""
    bank = spark.createDataFrame([(k, [f"w{k}", "all", None, f"w{k}"][: k % 5]) for k in range(40)] + [(99, None), (98, [""])], "item_id long, kws array<string>")
    texts = spark.createDataFrame([(1, "w1 w22 all"), (2, ""), (3, None), (4, "w7w8w9"), (4, "all")], "doc_id long, body string")
    rows = lambda n: sorted(map(tuple, match.coverage(texts, bank, n).collect()))
    assert rows(None) == rows(1) == rows(7) and len(rows(None)) > 40
    plan = match.coverage(texts, bank, 4)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    none = bank.limit(0)
    assert match.coverage(texts, none).collect() == []
