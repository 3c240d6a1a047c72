"""The pipeline's stages against their parts, and run() against plain Python, on the smallest tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp
    from markwright.llm.common import read

    d = "/root/testdata/sf0.001"
    docs = columns = read(spark, d, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5] > 0
    again = cp.run(spark, d).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, docs.collect()))


def planted(d, folder):
    """The smallest documents, plus empty, null and repeated rows, copies, near copies and columns that clash with the operators' own."""
    import duckdb
    import pandas as pd

    docs = duckdb.sql(f"SELECT * FROM '{d}/documents.parquet' ORDER BY doc_id").df()
    rows = docs.to_dict("records")
    long = [r for r in rows if len((r["text"] or "").split()) > 60][:12]
    more = [(r["text"].replace(" ", " \t"), r["source"]) for r in long[:4]]
    for k, r in enumerate(long[4:]):
        words = r["text"].split()
        words[len(words) // (k + 2)] = f"other{k}"
        more.append((" ".join(words), r["source"]))
    more += [(None, "s"), ("", None), (" \n", None), ("A b", "s"), ("a B", None), ("word " * 5000, "s")]
    rows += [{"doc_id": 10_000 + k, "text": t, "lang": "en", "source": s, "n_chars": len(t or "")} for k, (t, s) in enumerate(more)]
    rows.append(rows[0])
    out = pd.DataFrame(rows).assign(size=1, n="clash", sig=2.5, copies=None)
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST(copies AS VARCHAR) AS copies) FROM out) TO '{folder}/documents.parquet'")
    duckdb.sql(f"COPY (SELECT * FROM '{d}/labels.parquet') TO '{folder}/labels.parquet'")
    return [(r["doc_id"], r["text"], r["source"]) for r in rows]


def plain_mix(rows):
    """doc_id of each copy, text: shares by weight, capped at three times a source, and a coin for each id."""
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, [s for s in order if sizes[s]], sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > 3 * sizes[s]]
        target |= {s: 3 * sizes[s] if over else weight[s] * share for s in over or open_}
        left -= sum(3 * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in over] if over else []
    coin = lambda i: int(hashlib.md5(f"{i}:mix-1".encode()).hexdigest()[:13], 16) / 2**52
    gone = dict.fromkeys(sizes, 0)
    for i, t, s in sorted(rows, key=lambda r: coin(r[0])):
        rate, n = target.get(s, 0) / sizes[s] if sizes[s] else 0, len(WORD.findall(t or ""))
        more = (rate - int(rate)) * sizes[s]
        yield from [(i, t)] * (int(rate) + (more > 0 and gone[s] + n / 2 <= more))
        gone[s] += n


def test_run_against_plain_python(spark, tmp_path):
    """run() on whole texts against loops over all rows and all pairs; only the classifier's odds are the operator's own."""
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline as cp
    from markwright.llm import bpe, toxicity
    from markwright.llm.common import read

    rows, d = planted("/root/testdata/sf0.001", tmp_path), str(tmp_path)
    model = toxicity.fit(read(spark, d, "documents"), toxicity.chain_labels(read(spark, d, "labels")))
    clean = [r for r in rows if model.predict(r[1])[-1] < toxicity.CUT]
    first = {}
    for r in clean:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        first[key] = min(first.get(key, r), r, key=lambda x: x[0])
    left = sorted(first.values(), key=lambda r: r[0])

    def held(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, root = [held(r[1]) for r in left], list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    one = [r for k, r in enumerate(left) if root[k] == k]
    assert len(rows) > len(clean) > len(left) > len(one) + 5

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in plain_mix(one):
        ids = own.encode_ordinary(t or "")
        packed = b"".join(n.to_bytes(4, "little") for n in ids)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = cp.run(spark, d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
