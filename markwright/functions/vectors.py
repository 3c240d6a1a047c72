"""Vectors of texts without a model: hashed bags of words, as Catalyst expressions and, for what runs in Python anyway, in Python."""

from functools import lru_cache
from hashlib import md5
from itertools import chain
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import preprocess

WIDTH = 256


def place(word: Column) -> Column:
    """Struct at, sign: the place a word counts in (the first byte of its MD5) and whether it adds or takes away (the next digit)."""
    digest = F.md5(word.cast("binary"))
    at = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")
    return F.struct(at.alias("at"), F.when(F.conv(F.substring(digest, 3, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1).alias("sign"))


def sparse(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, v: the signed counts of the words of each text (white space collapsed, lower case) by place, without zeros.

    Each task adds up a text's words by place before anything is shuffled, so a text sends WIDTH rows at most. Rows that share a
    key count as one text. Null and blank texts have no rows."""
    words = F.filter(F.split(preprocess(F.col(text)), " "), lambda w: w != "")
    placed = rows.select(key, F.explode(words).alias("w")).select(key, place(F.col("w")).alias("p"))
    return placed.groupBy(key, F.col("p.at").alias("at")).agg(F.sum("p.sign").alias("v")).where("v != 0")


def dense(found: DataFrame, key: str) -> DataFrame:
    """key, vector (array<double> of WIDTH, of length 1) from `sparse`. Texts whose words cancel out, or without words, have none."""
    entries = F.map_from_entries(F.collect_list(F.struct("at", F.col("v").cast("double"))))
    whole = found.groupBy(key).agg(entries.alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return whole.select(key, F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.col("norm")).alias("vector"))


def text_vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, vector: the hashed bag of words of each text, scaled to length 1."""
    return dense(sparse(rows, key, text), key)


def similarities(rows: DataFrame, key: str, text: str, other: DataFrame, to: str, other_text: str) -> DataFrame:
    """key, similarity: the cosine of each row's text with that of the row of `other` it names in the column `to`; null where one
    of them has no vector. rows: key (unique), to, text; other: to (unique), other_text.

    Only places that both texts use are joined, and a text's numbers never become an array."""
    mine, theirs = sparse(rows, key, text), sparse(other, to, other_text).select(to, "at", F.col("v").alias("u"))
    norm = lambda found, by, name: found.groupBy(by).agg(F.sqrt(F.sum(F.col(name) * F.col(name))).alias(f"{name}_norm"))
    links = rows.select(key, to)
    shared = mine.join(links, key).join(theirs, [to, "at"]).groupBy(key).agg(F.sum(F.col("v") * F.col("u")).alias("dot"))
    out = links.join(norm(mine, key, "v"), key, "left").join(norm(theirs, to, "u"), to, "left").join(shared, key, "left")
    both = F.col("v_norm").isNotNull() & F.col("u_norm").isNotNull()
    return out.select(key, F.when(both, F.coalesce("dot", F.lit(0)) / (F.col("v_norm") * F.col("u_norm"))).alias("similarity"))


#: Longer words are not kept.
KEPT_WORD = 64


def _code(word: str) -> int:
    """`place` of a word, as twice the place and one for words that take away."""
    digest = md5(word.encode()).digest()
    return 2 * digest[0] + (digest[1] >> 4 & 1)


_kept_code = lru_cache(maxsize=1 << 16)(_code)


def bags(words: list[list[str]]):
    """The signed counts of each text's words by place, a row (of WIDTH integers) a text."""
    import numpy as np

    names = dict.fromkeys(chain.from_iterable(words))
    codes = np.fromiter((_kept_code(w) if len(w) <= KEPT_WORD else _code(w) for w in names), np.int64, len(names))
    index, many = dict(zip(names, range(len(names)), strict=True)), np.array([len(ws) for ws in words], np.int64)
    at = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64, int(many.sum()))
    counts = np.bincount(np.repeat(np.arange(len(words)), many) * 2 * WIDTH + codes[at], minlength=2 * WIDTH * len(words)).reshape(-1, WIDTH, 2)
    return counts[:, :, 0] - counts[:, :, 1]


def likeness(one, other) -> float | None:
    """The cosine of two rows of `bags`, as `similarities` has it; None where one of them is all zeros."""
    norms = [sqrt(int(x @ x)) for x in (one, other)]
    return int(one @ other) / (norms[0] * norms[1]) if all(norms) else None
