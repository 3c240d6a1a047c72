"""Operators against brute force, on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest

from markwright.llm import bpe, exact_dedup, mixing, near, pii, quality, sharding, simhash, substring_dedup, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(7)
    some = [" ".join(r.choice(["ab", "the", "of", "xyz", "Q", "é", "la"]) for _ in range(r.randint(0, 90))) for _ in range(60)]
    passage = " ".join(f"p{k}" for k in range(25))
    some += [f"start {k} {passage} end {k}" for k in range(5)] + [some[3]] * 4 + [some[3].replace(" ", "\n\t")]
    some += [None, None, "", " \t\n", "x" * 30_000, "w " * 20_000, "mail a.b@c.de tel +1 (017) 555-7713 host 10.0.0.255 card 4845168114407329 iban DE89370400440532013000"]
    return list(enumerate(some)) + [(3, some[3])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", "en", "clash", 1.0, 2) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n string, p double, size int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -5")


def words(t):
    return WORD.findall(t or "")


def test_mixing(docs, empty):
    rows = mixing.plan(docs).collect()
    assert len(rows) == len(texts())
    sizes = {}
    for r in rows:
        assert r.copies <= 3
        sizes[r.source] = (r.source_size, r.target)
    assert sorted(r.size for r in rows) == sorted(len(words(t)) for _, t in texts())
    total = sum(s for s, _ in sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1] * len(order), strict=False))
    open_, target, left = set(order), {}, total
    while True:  # share, cap, share again what is over
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > 3 * sizes[s][0]]
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        for s in over:
            target[s] = 3 * sizes[s][0]
            left -= target[s]
            open_.remove(s)
    assert all(abs(target[s] - sizes[s][1]) < 1e-6 for s in order)
    taken, most = dict.fromkeys(order, 0), dict.fromkeys(order, 0)
    by_id = {}
    for r in rows:
        taken[r.source] += r.size * r.copies
        by_id[r.source, r.doc_id] = by_id.get((r.source, r.doc_id), 0) + r.size
        most[r.source] = max(most[r.source], by_id[r.source, r.doc_id])
        rate = target[r.source] / sizes[r.source][0] if sizes[r.source][0] else 0
        assert r.copies in (int(rate), int(rate) + 1)
    assert all(2 * abs(taken[s] - target[s]) <= most[s] + 1e-6 for s in order)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.plan(empty).count() == 0


def test_exact_dedup(docs, empty, monkeypatch):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in texts():
        groups.setdefault(norm(t), []).append(i)
    for bound in (50_000, -1):
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", bound)
        got = exact_dedup.groups(docs, all_hashes=True).collect()
        want = [(i, min(g := groups[norm(t)]), len(g), i == min(g), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in texts()]
        assert sorted(map(tuple, got)) == sorted(want)
        kept = exact_dedup.deduplicate(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("shards", [1, 6, 200])
def test_sharding(docs, empty, shards):
    first, size = {}, {}
    for i, t in sorted(texts(), key=lambda x: x[0]):
        first.setdefault(t or "", i)
        size[t or ""] = size.get(t or "", 0) + len((t or "").encode()) + 16
    ordered = [size[t] for t in sorted(first, key=first.get)]

    def need(c):
        n, s = 1, 0
        for x in ordered:
            n, s = (n + 1, x) if s + x > c else (n, s + x)
        return n

    best = next(c for c in range(max(ordered), sum(ordered) + 1) if need(c) <= shards)
    rows = sharding.assign(docs, shards).collect()
    load, slots = {}, {}
    for r in rows:
        load[r.shard] = load.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(load.values()) == best and len(rows) == len(texts())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(empty).count() == 0


def test_sharding_even_sizes():
    r = random.Random(3)
    for _ in range(300):
        sizes, shards = [r.choice((1, 5, 60)) for _ in range(r.randint(1, 60))], r.randint(1, 12)
        ends = np.cumsum(sizes).tolist()
        capacity = sharding.smallest(ends, {}, shards, max(max(sizes), -(-ends[-1] // shards)), False)
        at = sharding.even(ends, shards, capacity)
        loads = np.diff([0, *at])
        assert len(at) == shards and at[-1] == ends[-1] and set(at) <= {0, *ends}
        assert loads.min() >= 0 and loads.max() == capacity
    ends = np.cumsum([10] * 41 + [30]).tolist()
    assert sorted(np.diff([0, *sharding.even(ends, 4, 150)]).tolist()) == [110, 110, 110, 110]


def test_sharding_cuts_small_blocks(spark):
    sizes = np.random.default_rng(1).integers(1, 500, 3000)
    ends = spark.createDataFrame([(int(e),) for e in np.cumsum(sizes)], "end long")
    exact = sharding.cuts(ends, 7, int(sizes.max()), int(sizes.sum()))
    assert sharding.cuts(ends, 7, int(sizes.max()), int(sizes.sum()), 40) == exact


def fingerprint(t, width):
    import xxhash

    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [256, 1])
def test_simhash(docs, empty, hot):
    fp = {i: fingerprint(t, 3) for i, t in texts()}
    root = {i: i for i in fp}
    for _ in fp:
        for i in fp:
            root[i] = min(root[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 2)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.classes(docs, hot=hot).collect()}
    assert got == {i: (fp[i], root[i]) for i in fp}
    assert simhash.classes(empty).count() == 0


def test_quality_counts_and_verdict(docs, empty, spark):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in texts():
        w = words(t)
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {g for g in three if three.count(g) > 1} if len(three) < 500 else set(three)
        cover = {k + j for k, g in enumerate(three) if g in again for j in range(3)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), len(cover))
    assert quality.judge(empty).count() == 0
    r = random.Random(1)
    good = [(k, " ".join(f"w{r.randint(0, 999)}" for _ in range(r.randint(80, 300)))) for k in range(120)]
    junk = [(1000 + k, " ".join(f"w{r.randint(0, 999)}###$$" for _ in range(150))) for k in range(5)]
    df = spark.createDataFrame([(i, t, "en", None) for i, t in good + junk], "doc_id long, text string, lang string, source string")
    kept = {x.doc_id for x in quality.judge(df).where("kept").collect()}
    assert kept == {i for i, _ in good}


def test_quality_small_groups_are_judged(spark):
    """Groups too small for an estimate get that of their language, then that of all; every document past the base rules has a distance."""
    r = random.Random(2)
    good = lambda: " ".join(f"w{r.randint(0, 999)}" for _ in range(r.randint(80, 300)))
    bad = lambda: " ".join(f"w{r.randint(0, 999)}###$$" for _ in range(150))
    rows = [(k, good(), "en", "big") for k in range(80)] + [(100 + k, good(), "en", f"rare{k % 9}") for k in range(27)] + [(200 + k, good(), "xx", None) for k in range(5)]
    junk = [(1000, bad(), "en", "rare1"), (1001, bad(), "xx", None), (1002, bad(), "en", "big"), (1003, bad(), None, "only"), (1004, "short", "en", "rare1"), (1005, "short", "yy", "none")]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality.judge(df).collect()}
    assert len(got) == len(rows + junk)
    assert all((x.distance is None) == x.base_failed for x in got.values())
    assert {i for i, x in got.items() if x.kept} == {i for i, *_ in rows}
    few = {x.doc_id: x for x in quality.judge(df.where("source = 'rare2'")).collect()}
    assert len(few) == 3 and all(x.distance is not None and x.kept for x in few.values())


def test_chi_square():
    assert abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality.chi2_cdf(7.0, 7) - 0.5711) < 1e-3


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_pii(docs, empty):
    r = random.Random(2)
    for _ in range(5000):
        t = "".join(r.choice("a@.1 2-b_+(5)") for _ in range(r.randint(0, 40)))
        assert [x[:3] for x in pii.spans_of(t) if x[0] != "iban"] == base_spans(t)
    got = pii.find(docs).collect()
    kinds = [s.kind for x in got for s in x.spans]
    assert len(got) == len(texts()) and {"email", "ip", "card", "phone", "iban"} <= set(kinds)
    assert "[email]" in str(pii.redact(docs).where("text LIKE 'mail%'").collect()) and pii.redact(docs).columns == docs.columns
    assert pii.find(empty).count() == 0


def test_bpe(docs, empty):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(docs)
    want = sorted((i, own.encode_ordinary(t or "")) for i, t in texts())
    assert sorted((r.doc_id, list(r.ids)) for r in encoded.collect()) == want
    assert sorted((r.doc_id, r.text) for r in bpe.decode(encoded).collect()) == sorted((i, t or "") for i, t in texts())
    assert bpe.digests(empty).count() == 0


def test_warc(spark):
    page = "<p>" + "a" * 200
    rows = [(1, "http://A.b.org/x?y#z", page), (2, None, page), (3, "u\r\n: v", None), (4, "http://b.org", "short"), (5, "http://b.org", "short"), (1, "http://A.b.org/x?y#z", page), (None, "x", "é" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_back(df, warc.index(warc.write(df))).collect())
    b = lambda h: (h or "").encode()
    assert got == sorted((str(i), len(b(h)), hashlib.sha256(b(h)).hexdigest(), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, h in rows)
    assert warc.url_key("https://u@A.b.org:443/c?d#e") == "org,b,a)/c?d"
    none = df.where("page_id < 0")
    assert warc.read_back(none, warc.index(warc.write(none))).count() == 0


def test_warc_repeated_ids(spark):
    """Records that share id and URL key but not text all come back, once each, over blocks of the index too."""
    rows = [(7, "http://a.b", f"text {k}") for k in range(2 * warc.BLOCK + 3)] + [(None, None, f"none {k}") for k in range(4)] + [(6, "http://a.b", "six"), (8, "http://a.b", "eight"), (7, "http://a.c", "other")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((str(r.page_id), r.payload_digest) for r in warc.read_back(df, warc.index(warc.write(df))).collect())
    assert got == sorted((str(i), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows)


def test_substring_dedup(docs, empty):
    first, gone = {}, {}
    for i, t in sorted(set(texts()), key=lambda x: x[0]):
        w = words(t)
        for p in range(len(w) - 19):
            if first.setdefault(k := tuple(w[p : p + 20]), (i, p)) != (i, p):
                gone.setdefault(i, set()).update(range(p, p + 20))
    got = sorted((r.doc_id, r.text, r.n_words, r.n_removed) for r in substring_dedup.strip(docs).collect())
    want = sorted((i, " ".join(x for k, x in enumerate(words(t)) if k not in gone.get(i, ())), len(words(t)), len(gone.get(i, ()))) for i, t in texts())
    assert got == want and sum(x[3] for x in got) > 100
    assert substring_dedup.strip(empty).count() == 0


def test_toxicity(spark, empty):
    r = random.Random(3)
    common = [f"w{k}" for k in map(chr, range(97, 123))]
    bad = lambda k: k % 5 == 0
    text = lambda k: " ".join([r.choice(common) for _ in range(40)] + (["grimble", "snortwad"] if bad(k) else []))
    rows = [(k, text(k)) for k in range(600)]
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2), int(bad(k))) for k in range(400)] + [(None, 1, 1), (5000, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, toxicity.chain_labels(labels))
    found = {x.doc_id for x in toxicity.score(df, model).where("rejected").collect()}
    assert found == {k for k in range(600) if bad(k)}  # 400 to 599 were not in the labels
    assert toxicity.clean(df, model).count() == 602 - len(found)
    none = toxicity.fit(df, toxicity.chain_labels(labels.where("doc_id < 0")))
    assert toxicity.score(df, none).where("rejected").count() == 0
    assert toxicity.score(empty.select("doc_id", "text"), model).count() == 0


def near_texts():
    r = random.Random(11)
    make = lambda n: [r.choice("abcdefghijklmnop") + str(r.randint(0, 400)) for _ in range(n)]
    out = []
    for _ in range(12):
        base = make(r.randint(60, 300))
        out.append(base)
        for _ in range(4):
            w = list(base)
            for at in r.sample(range(len(w)), r.randint(1, max(1, len(w) // 40))):
                w[at] = "changed" + str(r.random())
            out.append(w)
    crowd = make(150)
    out += [crowd[:k] + [f"other{k}"] + crowd[k + 1 :] for k in range(5, 125, 2)]
    half = crowd[:75] + make(75)
    out += [half, half[:20] + ["again"] + half[21:], ["a", "b"], ["A", "b"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "f"], make(4000)]
    return [" ".join(w) for w in out] + [None, "", " \t", " ".join(crowd).upper()]


def test_near_against_all_pairs(spark):
    some = near_texts()
    docs = spark.createDataFrame([(k, t, "clash", 1, True) for k, t in enumerate(some)] + [(None, some[0], "x", 1, True), (None, "no one else has this text here", "x", 1, True)], "doc_id long, text string, sig string, p int, deep boolean").repartition(3)

    def held(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [held(t) for t in some]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = near.classes(docs).collect()
    assert len(got) == len(some) + 2
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {k: find(k) for k in range(len(some))}
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == [0, None]
    kept = near.drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [k for k in range(len(some)) if find(k) == k]
    assert near.classes(docs.where("doc_id < -5")).count() == 0


def test_toxicity_fit_does_not_depend_on_partitions(spark):
    from markwright.llm import toxicity

    rows = [(k, f"{'bad' if k % 3 == 0 else 'good'} word number {k // 6}") for k in range(60)]
    docs = spark.createDataFrame(rows * 2 + [(k + 100, t) for k, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0 if k % 3 == 0 else 1, int(k % 3 == 0)) for k in [*range(60), *range(100, 160)]], "doc_id long, quality int, toxic int")
    a, b = (toxicity.fit(docs.repartition(n), toxicity.chain_labels(labels)) for n in (1, 7))
    assert all(p == q and (v == w).all() for (p, v), (q, w) in zip(a.models, b.models, strict=True))
