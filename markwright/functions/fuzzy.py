"""Fuzzy keyword and concept coverage. Substrings are found by Catalyst; the rest runs as one Arrow batch function."""

from difflib import SequenceMatcher
from functools import lru_cache
from math import nextafter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FULL, PART, CONCEPT = 0.75, 0.40, 0.70


def matching(a: str, b: str, most: int = 64) -> int:
    """How many characters of two texts match as difflib counts them: the longest common block (of equal ones the first in `a`,
    then in `b`), and the same again on both sides of it. For short texts, in which a search for a piece of one in the other is
    cheap; difflib treats `b` from 200 characters on in another way. most: no more match, whatever their places."""
    n = len(a)
    for size in range(min(n, len(b), most), 0, -1):
        for i in range(n - size + 1):
            if a[i : i + size] in b:
                j, most = b.index(a[i : i + size]), most - size
                if not most:
                    return size
                left = matching(a[:i], b[:j], most) if i and j else 0
                i, j = i + size, j + size
                return size + left + (matching(a[i:], b[j:], most - left) if i < n and j < len(b) and most > left else 0)
    return 0


def similarity(a: str, b: str, most: int = 64) -> float:
    """difflib's ratio of two texts."""
    if len(a) > 64 or len(b) > 128:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * matching(a, b, most) / (len(a) + len(b)) if a or b else 1.0


@lru_cache(maxsize=256)
def _letters_of(keywords: tuple[str, ...]):
    """The codes of the letters of some keywords, in order; for each keyword the places of each letter, one bit each (none in the
    last column, for other letters); the keywords' lengths and numbers of spaces."""
    import numpy as np

    alphabet = sorted(set("".join(keywords)) - {" "})
    bits = np.uint32 if max(map(len, keywords)) <= 32 else np.uint64
    masks = np.zeros((len(keywords), len(alphabet) + 1), bits)
    for k, word in enumerate(keywords):
        for at, c in enumerate(word[:63]):
            if c != " ":
                masks[k, alphabet.index(c)] |= bits(1 << at)
    return _codes("".join(alphabet)), masks, np.array([len(k) for k in keywords]), np.array([k.count(" ") for k in keywords])


def _codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _search(pieces: list[tuple[int, list[str]]], sizes: dict[int, list[int]], keywords: list[str], best) -> None:
    """Raises `best`, a row of ratios of the keywords for each text, by the windows of each size, for the keywords listed under it.
    pieces: words of texts with the texts' rows, those of one text together.

    The longest common subsequence of each keyword with each distinct word comes first, all at once, one bit for a letter of a keyword
    (up to 63). A window shares no more letters in order than its words do in all, which bounds its ratio; those that may still be
    better than the best are bounded by their own longest common subsequence and compared from the highest bound down."""
    import numpy as np

    known, masks, n, spaces = _letters_of(tuple(keywords))
    words, many = [w for _, ws in pieces for w in ws], [len(ws) for _, ws in pieces]
    if not words:
        return
    row, piece = np.repeat([r for r, _ in pieces], many), np.repeat(np.arange(len(pieces)), many)
    names = sorted(dict.fromkeys(words), key=len, reverse=True)
    distinct = dict(zip(names, range(len(names)), strict=True))
    at = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    starts = np.cumsum(lengths) - lengths
    codes = _codes("".join(names))
    if len(known):
        place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        letters = np.where(known[place] == codes, place, len(known))
    else:
        letters = np.zeros(len(codes), np.int64)
    rows = np.array(sorted({k for ks in sizes.values() for k in ks}))
    own = np.ascontiguousarray(masks[rows].T)  # a row a letter, a column a keyword
    rest = np.full((len(names), len(rows)), np.iinfo(own.dtype).max, own.dtype)
    longer = len(names) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")  # how many words have more letters
    for k, some in enumerate(longer):
        r = rest[:some]
        shared = r & own[letters[starts[:some] + k]]
        rest[:some] = (r + shared) | (r - shared)
    in_order = np.bitwise_count(~rest).astype(np.int32)
    long = n[rows] > 63
    in_order[:, long] = np.minimum(n[rows][long][None, :], lengths[:, None])
    row_of = {int(k): r for r, k in enumerate(rows)}
    new_row = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    ratio_of: dict[tuple[int, str], float] = {}
    for size, named in sizes.items():
        count = len(words) - size + 1
        if size > max(many):
            continue
        of, named = np.array([row_of[k] for k in named]), np.array(named)
        if size == 1:
            bound = (2.0 * in_order[:, of] / (lengths[:, None] + n[named]))[at]
        else:
            total = sum(lengths[at][k : k + count] for k in range(size)) + size - 1
            longest = (n[named] * (2.0 / np.maximum(best[:, named], 1e-9) - 1)).max(axis=1) + 1e-6  # longer windows are below all bests
            inner = np.flatnonzero((total <= longest[row[:count]]) & (piece[:count] == piece[size - 1 :]))
            each, total = in_order[:, of], total[inner]
            most = sum(each[at[inner + k]] for k in range(size)) + np.minimum(spaces[named], size - 1)
            bound = 2.0 * most / (total[:, None] + n[named])

        def look(ws, which, value, most):
            """Compares windows from the highest bound down, as long as one is above the best of its text and keyword."""
            found, order = best.tolist(), np.argsort(-value, kind="stable")
            for r, k, w, v, m in zip(*(x[order].tolist() for x in (row[ws], named[which], ws, value, most)), strict=True):  # noqa: B023
                if v > found[r][k]:
                    window = words[w] if size == 1 else " ".join(words[w : w + size])  # noqa: B023
                    if (k, window) not in ratio_of:
                        ratio_of[k, window] = similarity(keywords[k], window, m)
                    if ratio_of[k, window] > found[r][k]:
                        found[r][k] = best[r, k] = ratio_of[k, window]

        if size == 1:  # a first ratio, which rules most out
            top = np.maximum.reduceat(bound, new_row, axis=0)
            text = np.repeat(np.arange(len(new_row)), np.diff(np.r_[new_row, len(words)]))
            ws, which = np.nonzero((bound == top[text]) & (bound > best[row][:, named]))
            first = np.unique(text[ws] * len(named) + which, return_index=True)[1]
            ws, which = ws[first], which[first]
            look(ws, which, bound[ws, which], in_order[at[ws], of[which]])
        ws, which = np.nonzero(bound > best[row if size == 1 else row[inner]][:, named])
        if size == 1:
            look(ws, which, bound[ws, which], in_order[at[ws], of[which]])
        elif len(ws):
            most, total, ws = most[ws, which], total[ws], inner[ws]
            column, width = of[which], len(rows)
            state, flat, none = rest[at[ws], column], own.ravel(), len(known) * width
            for k in range(1, size):
                word = at[ws + k]
                first, left = starts[word], lengths[word]
                for t in range(int(left.max())):
                    shared = state & flat.take(np.where(t < left, letters.take(first + t, mode="clip") * width, none) + column)
                    state = (state + shared) | (state - shared)
            whole = np.bitwise_count(~state).astype(np.int64) + np.minimum(spaces[named], size - 1)[which]
            most = np.where(n[named][which] > 63, most, np.minimum(most, whole))
            value = 2.0 * most / (total + n[named][which])
            still = value > best[row[ws], named[which]]
            look(ws[still], which[still], value[still], most[still])


#: Words of texts that are searched at a time, and words times keywords.
STEP, PAIRS = 1024, 160_000
#: Characters of texts that are held as words at a time.
AT_ONCE = 1 << 20


def _ratios_of(keywords, texts: list[str], words: list[list[str]], best) -> None:
    """Raises `best`, a row for each text of the ratios that keywords have at least: to 1 where the text holds the keyword, else to
    the ratio of the most similar window. Keywords that have 1 already are not looked for. words: those of each text."""
    for r, text in enumerate(texts):
        best[r] = [1.0 if has < 1 and k in text else has for k, has in zip(keywords, best[r].tolist(), strict=True)]
    sizes = {}
    for k, word in enumerate(keywords):
        if (best[:, k] < 1).any():
            n = len(word.split())
            for size in {n, max(1, n - 1), n + 1} - {0}:
                sizes.setdefault(size, []).append(k)
    if not sizes:
        return
    open_, held, n, most = (best < 1).any(axis=1).tolist(), [], 0, max(STEP, PAIRS // len(keywords))
    for r, ws in enumerate(words):
        for at in range(0, len(ws) if open_[r] else 0, most):
            held.append((r, ws[at : at + most + max(sizes) - 1]))
            n += len(held[-1][1])
            if n >= most:
                _search(held, sizes, keywords, best)
                held, n = [], 0
    if held:
        _search(held, sizes, keywords, best)


def _ratios(keywords, text: str | None) -> list[float]:
    """The ratio of each keyword: 1 if the text holds it, else that of the most similar window."""
    return _ratios_many(keywords, [text or ""], [(text or "").split()])[0]


def _ratios_many(keywords, texts: list[str], words: list[list[str]]) -> list[list[float]]:
    import numpy as np

    best = np.zeros((len(texts), len(keywords)))
    _ratios_of([k or "" for k in keywords], texts, words, best)
    return best.tolist()


def alike(keys: list, texts: list[str]):
    """(key, places): the places of each of `keys`, as rows with the same keywords are searched together, much of the work being the
    keywords' own; some AT_ONCE characters of their texts at a time."""
    found = {}
    for at, key in enumerate(keys):
        found.setdefault(key, []).append(at)
    for key, places in found.items():
        held, n = [], 0
        for at in places:
            held.append(at)
            n += len(texts[at])
            if n >= AT_ONCE:
                yield key, held
                held, n = [], 0
        if held:
            yield key, held


def ratio(keyword: str | None, text: str | None) -> float:
    """1 if the text holds the keyword; else the best similarity with a window of as many words, one fewer or one more."""
    return _ratios([keyword], text)[0]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def ratios(keywords: pd.Series, text: pd.Series) -> pd.Series:
    """The ratio of each keyword of a row's array with the row's text."""
    texts, out = [t or "" for t in text], [None] * len(text)
    for ks, places in alike([tuple(ks) if ks is not None else () for ks in keywords], texts):
        own = [texts[at] for at in places]
        for at, found in zip(places, _ratios_many(ks, own, [t.split() for t in own]), strict=True):
            out[at] = found
    return pd.Series(out, index=text.index, dtype=object)


def keyword_score(weights, found):
    """0 to 10: weight times ratio where the ratio is PART or more, over all weights; no keywords: 0."""
    gained = F.aggregate(F.zip_with(weights, found, lambda w, r: F.when(r >= PART, w * r).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, 10 * gained / total).otherwise(F.lit(0.0))


def matched(keywords, found):
    return F.transform(F.filter(F.arrays_zip(keywords.alias("k"), found.alias("r")), lambda x: x["r"] >= FULL), lambda x: x["k"])


def missing(keywords, found):
    return F.transform(F.filter(F.arrays_zip(keywords.alias("k"), found.alias("r")), lambda x: x["r"] < FULL), lambda x: x["k"])


#: The number just below CONCEPT.
BELOW = nextafter(CONCEPT, 0.0)


def _covered_many(groups, texts: list[str], words: list[list[str]], known: list[dict[str, float]]) -> list[list[bool]]:
    """Of each text for each group of synonyms, whether one of them has a ratio of CONCEPT or more. known: ratios of some keywords with
    each text. Only groups that are not settled by these, or by a synonym in the text itself, are searched for, and only from CONCEPT on."""
    import numpy as np

    groups = [[s for s in g if s] for g in groups]
    names = list(dict.fromkeys(s for g in groups for s in g))
    place = {s: k for k, s in enumerate(names)}
    best, out = np.ones((len(texts), len(names))), []
    for r, (text, has) in enumerate(zip(texts, known, strict=True)):
        out.append([any(has.get(s, 0.0) >= CONCEPT or s in text for s in g) for g in groups])
        best[r, [place[s] for g, hit in zip(groups, out[r], strict=True) if not hit for s in g if s not in has]] = BELOW
    open_ = best < 1
    _ratios_of(names, texts, words, best)
    close = open_ & (best >= CONCEPT)
    for r in np.flatnonzero(close.any(axis=1)):
        out[r] = [hit or any(close[r, place[s]] for s in g) for g, hit in zip(groups, out[r], strict=True)]
    return out


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def covered(concepts: pd.Series, text: pd.Series) -> pd.Series:
    """Of each group of synonyms, whether the text holds one of them, nearly."""
    texts, out = [t or "" for t in text], [None] * len(text)
    for groups, places in alike([tuple(map(tuple, gs)) if gs is not None else () for gs in concepts], texts):
        own = [texts[at] for at in places]
        for at, found in zip(places, _covered_many(groups, own, [t.split() for t in own], [{}] * len(own)), strict=True):
            out[at] = found
    return pd.Series(out, index=text.index, dtype=object)


def concept_score(flags):
    return F.when(F.size(flags) > 0, 10 * F.size(F.filter(flags, lambda x: x)) / F.size(flags)).otherwise(F.lit(0.0))
