"""The trie, suffix dedup and manifest against brute force on small tables, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from markwright.llm import merkle, prefix_trie, suffix_dedup


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# Prefix trie


def brute_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = sha(f"{len(role.encode())}:{role}{text}")[:32]
            turns.setdefault(c, []).append(((turn is not None, turn or 0, tie), (role, text)))
    turns = {c: [x for _, x in sorted(t)] for c, t in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    words = {p: len(p[-1][1].split()) if p else 0 for p in nodes}
    below = {p: [q for q in nodes if q[: len(p)] == p] for p in nodes}
    children = {p: [q for q in below[p] if len(q) == len(p) + 1] for p in nodes}
    return sorted(
        (min(cs), len(p), min(nodes[p[:-1]]) if p else -1, len(cs), len(children[p]), sum(not children[q] for q in below[p]),
         sum((len(nodes[q]) - 1) * words[q] for q in below[p]), sha(",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(p))))))
        for p, cs in nodes.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "conv_id long, turn long, role string, text string, pos long, key long")
    out = prefix_trie.trie(prefix_trie.rebuilt(df))
    assert out.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.collect())


def test_trie(spark):
    r = random.Random(1)
    texts = ["a b", "c", "", None, "d e f", "a  b", "long " * 500]
    rows = [(c, r.choice([None, *range(4)]), r.choice(["u", "s", None]), r.choice(texts[: r.choice([1, 2, 7])])) for c in [*range(70), *range(200, 215)] for _ in range(r.randrange(7))]
    rows += [(c, t, "u", "same") for c in range(300, 340) for t in range(5)]  # whole copies
    rows += rows[:30] + [(None, 1, "u", "x"), (400, 0, "u", "one"), (19 + 500, 0, "u", "alone")]
    rows += [(600 + c, t, "u", str(t)) for c in range(3) for t in range(1500 - c)]  # long ones, packed in several pieces
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_small(spark):
    assert trie_rows(spark, []) == []
    for rows in ([(1, None, None, None)], [(20, 0, "u", "x y")], [(20, 0, "u", "x y"), (21, 0, "u", "x y")]):
        assert trie_rows(spark, rows) == brute_trie(rows)


def test_blocks_of_every_size():
    """One sweep over all conversations or blocks of any size: the same nodes."""
    r = random.Random(2)
    convs = sorted((tuple(r.choice("ab") for _ in range(r.randrange(6))), c) for c in range(60))
    key = lambda p: b"".join(x.encode() * prefix_trie.NAME for x in p)
    nodes = {}
    for p, c in convs:
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    want = sorted((min(cs), len(p), len(cs)) for p, cs in nodes.items())
    for size in (1, 2, 3, 7, 60):
        blocks = [convs[k : k + size] for k in range(0, 60, size)]
        lcp = [-1] + [prefix_trie.shared(key(a[0]), key(b[0])) for a, b in zip(convs, convs[1:])]
        first = [lcp[k] for k in range(0, 60, size)]
        least = [min(lcp[k : k + size]) for k in range(0, 60, size)]
        rows = ((b, k, c, len(p), lcp[b * size + k], [1] * len(p)) for b, block in enumerate(blocks) for k, (p, c) in enumerate(block))
        found = list(prefix_trie.sweeps({b: b for b in range(len(blocks))}, first, least)(rows))
        pieces = sorted(((x[5], x[6], x[1], x[2], x[4], *x[7:]) for x in found if x[0] == prefix_trie.FRAGMENT), key=lambda x: x[:2])
        whole = list(prefix_trie._whole(pieces))
        assert sorted([(x[1], x[2], x[7]) for x in found if x[0] != prefix_trie.FRAGMENT] + [(x[1], x[2], x[4]) for x in whole]) == want


# Suffix dedup


def brute_suffixes(docs):
    seen, out = set(), []
    texts = sorted({(i is not None, i or 0, suffix_dedup.tag_of((t or "").encode()), t or "") for i, t in docs})
    gone = {}
    for has, i, _, t in texts:
        data = t.encode()
        cover = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(w)
        gone[has, i, t] = cover
    for i, t in docs:
        data, cover = (t or "").encode(), gone[i is not None, i or 0, t or ""]
        runs = sum(bool(c) and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        out.append((-1 if i is None else i, len(data), sum(cover), runs, sha(bytes(b for b, c in zip(data, cover) if not c))))
    return sorted(out)


def planted(seed: int, n: int):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(r.choice([25, 30, 60, 200]))) for _ in range(6)]
    edge = passages[0][:99], passages[0][:100]
    docs = []
    for i in range(n):
        parts = [r.choice([*passages, *edge, word(), " ".join(word() for _ in range(40))]) for _ in range(r.randrange(6))]
        docs.append((i, r.choice([" ", "", "\n"]).join(parts)))
    docs += [(n + k, docs[k][1]) for k in range(3)] + [(n + 10, None), (n + 11, ""), (None, passages[1]), (5, passages[2]), docs[4], docs[4]]
    docs += [(n + 12, "x" * 450), (n + 13, "xy" * 300), (n + 14, passages[3][:50] + passages[3][60:])]
    r.shuffle(docs)
    return docs


def test_suffixes(spark):
    docs = planted(1, 120)
    df = spark.createDataFrame([(*d, "t", 1) for d in docs], "doc_id long, text string, tag string, spans int")
    out = suffix_dedup.strip(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in out) == brute_suffixes(docs)
    empty = suffix_dedup.strip(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]


@pytest.mark.parametrize("size", [150, 1000, 20_000])
def test_suffixes_in_pieces(monkeypatch, size):
    """Texts cut into small pieces and batches, in one process: the same bytes go."""
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", size)
    docs = planted(2, 60)

    def reduced(rows, columns, judge):
        schema = pa.schema([("bucket", pa.int64()), ("known", pa.bool_()), *((c, pa.binary()) for c in columns)])
        rows, out = list(rows), []
        for bucket in {x[0] for x in rows}:
            of = [x for x in rows if x[0] == bucket]
            out += suffix_dedup._reduce(columns, judge)(pa.table([list(c) for c in zip(*of)], schema=schema)).to_pylist()
        return out

    first = reduced(suffix_dedup.segments(3)(docs), suffix_dedup.SEGMENTS, suffix_dedup.judge_segments)
    key = lambda i, t: (suffix_dedup.NULL_ID if i is None else i, suffix_dedup.tag_of((t or "").encode()))
    opened, gone = {}, {}
    for x in first:
        (opened if x["open"] else gone).setdefault((x["doc"], x["tag"]), []).append(x["span"])
    again = [(i, t, opened[key(i, t)]) for i, t in docs if key(i, t) in opened]
    for x in reduced(suffix_dedup.windows(3)(iter(again)), suffix_dedup.WINDOWS, suffix_dedup.judge_windows):
        gone.setdefault((x["doc"], x["tag"]), []).append(x["span"])
    cuts = {(d, t): c for d, t, c in suffix_dedup._merged((d, t, s) for (d, t), s in gone.items())}
    out = []
    for i, t in docs:
        data, c = (t or "").encode(), cuts.get(key(i, t), [])
        out.append((-1 if i is None else i, len(data), sum(c[1::2]) - sum(c[::2]), len(c) // 2, sha(suffix_dedup.kept_bytes(data, c))))
    assert sorted(out) == brute_suffixes(docs)


# Manifest


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def proof(levels, k):
    return [(level[k >> d ^ 1] if k >> d ^ 1 < len(level) else None, k >> d & 1) for d, level in enumerate(levels[:-1])]


def brute_manifest(docs):
    leaf = lambda d, more=0: sha("".join(map(field, (d[0], d[3], d[2], d[4] if d[4] is None else d[4] + more, d[1]))))
    groups = {}
    for d in docs:
        groups.setdefault((d[2] is not None, (d[2] or "").encode()), []).append(((d[0] is not None, d[0] or 0, leaf(d)), d))
    keys = sorted(groups)
    trees = {k: tree([x[0][2] for x in sorted(groups[k], key=lambda x: x[0])]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for q, key in enumerate(keys):
        for k, (_, d) in enumerate(sorted(groups[key], key=lambda x: x[0])):
            path = proof(trees[key], k) + proof(top, q)
            at = leaf(d, int(d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0))
            for s, side in path:
                at = sha(at if s is None else s + at if side else at + s)
            out.append((str(d[0]), leaf(d), trees[key][-1][0], top[-1][0], sha("".join(s for s, _ in path if s)), at, at == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 3, 40, 2100])
def test_manifest(spark, tmp_path, n):
    r = random.Random(n)
    docs = [(i, r.choice(["é x", "", None, "y" * 3000]), r.choice(["en", "de", None, "", "ñ"]) if n < 100 else "en", r.choice(["s", None]), r.choice([None, 3])) for i in range(n)]
    if n == 40:
        docs += docs[:3] + [(None, "a", "en", None, 1), (None, None, None, None, None), (-5, "b", "en", "s", 2)]
    spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, pos long, key long").write.parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op13_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((str(x[0]), *x[1:]) for x in out.collect()) == brute_manifest(docs)
