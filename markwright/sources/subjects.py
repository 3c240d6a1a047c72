"""Which question bank and language hints belong to a subject and medium."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bank import read_bank

# Subjects that are languages, subjects taught in a medium, and the hints of each language.
LANGUAGES, CONTENT, HINTS = ("tamil", "english"), ("science", "social", "maths"), {"tamil": "ta", "english": "en"}


def routes(spark: SparkSession) -> DataFrame:
    """subject, medium, path, hint: the eight combinations, to be joined to requests."""
    both = [(s, s) for s in LANGUAGES] + [(s, m) for s in CONTENT for m in LANGUAGES]
    return spark.createDataFrame([(s, m, f"data/{s}_{m}.json", HINTS[m]) for s, m in both], "subject string, medium string, path string, hint string")


def resolve(subject: str, medium: str | None = None) -> tuple[str, list[str]]:
    """(path of the bank, hints). A language's medium is itself; unknown subjects and media are ValueErrors."""
    s, m = (subject or "").strip().lower(), (medium or "").strip().lower()
    if s not in LANGUAGES + CONTENT:
        raise ValueError(f"unknown subject {subject!r}")
    m = s if s in LANGUAGES else m
    if m not in LANGUAGES:
        raise ValueError(f"subject {s!r} needs a medium, one of {LANGUAGES}")
    return f"data/{s}_{m}.json", [HINTS[m]]


def subject_bank(spark: SparkSession, root: str, subject: str, medium: str | None = None, fallback: str = "data/question_bank.json") -> tuple[DataFrame, str]:
    """(bank, its path under `root`): the subject's own bank, else the general one, else FileNotFoundError."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in (resolve(subject, medium)[0], fallback):
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        if at.getFileSystem(conf).exists(at):
            return read_bank(spark, f"{root}/{path}"), path
    raise FileNotFoundError(f"no question bank for {subject!r} under {root}")
