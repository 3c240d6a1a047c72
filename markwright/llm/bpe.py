"""Byte-level BPE, encoding and decoding, in two tiers.

A pre-token that is in the vocabulary is resolved by one probe of a minimal perfect hash (hash and displace: keys in
buckets, each with the displacement that puts its keys on free slots; n slots for n keys; the key stored in the slot is
compared). A miss is merged from its bytes: a doubly linked list of pieces and a heap of (rank, place) for neighbours whose
join is in the vocabulary, so a piece of n bytes takes O(n log n) however long it is. Results of either tier are kept for
the next time in a dictionary that starts anew at CACHE entries (some 60 MB).

The vocabulary is of fixed size (50,256 entries, about 1 MB); it is read on the driver and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, read

CACHE = 400_000
LOAD = 4


def _hash(key: bytes, buckets: int) -> tuple[int, int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    return (h & 0xFFFFFFFF) % buckets, (h >> 32) & 0xFFFFFFFF, (h >> 64) & 0xFFFFFFFF


class PerfectHash:
    """bytes -> rank for a fixed set of keys; None for anything else."""

    def __init__(self, ranks: dict[bytes, int]):
        n = self.n = len(ranks)
        self.buckets = max(1, -(-n // LOAD))
        by: list[list] = [[] for _ in range(self.buckets)]
        for key, rank in ranks.items():
            b, f, g = _hash(key, self.buckets)
            by[b].append((f, g, key, rank))
        self.shift = array("q", [0]) * self.buckets
        self.keys: list[bytes] = [b""] * n
        self.ranks = array("q", [-1]) * max(n, 1)
        for b in sorted(range(self.buckets), key=lambda b: -len(by[b])):
            s = 0
            while by[b]:
                p, q = divmod(s, n)
                slots = {(f + p * g + q) % n for f, g, _, _ in by[b]}
                if len(slots) == len(by[b]) and all(self.ranks[x] < 0 for x in slots):
                    break
                s += 1
            self.shift[b] = s
            for f, g, key, rank in by[b]:
                at = (f + (s // n) * g + s % n) % n
                self.keys[at], self.ranks[at] = key, rank

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        b, f, g = _hash(key, self.buckets)
        s = self.shift[b]
        at = (f + (s // self.n) * g + s % self.n) % self.n
        return self.ranks[at] if self.ranks[at] >= 0 and self.keys[at] == key else None


def merged(piece: bytes, rank_of) -> list[int]:
    """Ranks of `piece` after merging, again and again, the neighbours of the lowest rank, the leftmost first.

    rank_of: bytes -> rank or None, here the vocabulary as a plain dictionary's get."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here any more
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, to = pop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != to:
            continue  # one of the two has changed since
        end[i], end[mid] = to, 0
        if to < n:
            before[to] = i
            if (r := rank_of(piece[i : end[to]])) is not None:
                push(heap, (r, i, end[to]))
        if (p := before[i]) >= 0 and (r := rank_of(piece[p:to])) is not None:
            push(heap, (r, p, to))
    out, i = [], 0
    while i < n:
        out.append(rank_of(piece[i : end[i]]))
        i = end[i]
    return out


class Codec:
    """encode(text) -> ids and decode(ids) -> bytes. pattern: pre-tokens; \\s in it is Unicode's White_Space."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table = PerfectHash(ranks)
        self.pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.ranks = ranks
        self.bytes_of = {r: k for k, r in ranks.items()}
        self.known: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "find": None}

    def __setstate__(self, state):
        import regex

        self.__dict__.update(state)
        self.find = regex.compile(self.pattern).finditer

    def piece(self, token: str) -> bytes:
        """The ids as an array's bytes, which take a third of a list's memory."""
        raw = token.encode()
        rank = self.table.get(raw)
        ids = array("I", [rank] if rank is not None else merged(raw, self.ranks.get)).tobytes()
        if len(self.known) >= CACHE:
            self.known.clear()
        if len(token) <= 64:
            self.known[token] = ids
        return ids

    def encode(self, text: str) -> array:
        ids, known, piece = array("I"), self.known, self.piece
        for m in self.find(text):
            t = m[0]
            ids.frombytes(known.get(t) or piece(t))
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    import pickle

    import public_tokenizers

    made = Codec(load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN)
    return pickle.loads(pickle.dumps(made))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) for each document. A null text is empty and has no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def work(rows):
        c = shared.value
        for doc_id, text in rows:
            yield doc_id, c.encode(text or "").tolist()

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, ids array<int>", 64)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text for each row of doc_id, ids; null ids give the empty text, bytes that are not UTF-8 are replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec(path))

    def work(rows):
        c = shared.value
        for doc_id, ids in rows:
            yield doc_id, c.decode(ids or ()).decode("utf-8", "replace")

    return map_rows(encoded.select("doc_id", "ids"), work, "doc_id long, text string", 64)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes, decodes what came out, and returns digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def work(rows):
        import sys

        c = shared.value
        for doc_id, text in rows:
            ids = c.encode(text or "")
            back = c.decode(ids)
            if sys.byteorder == "big":
                ids.byteswap()
            yield doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests. Null texts are empty; rows that repeat are encoded each."""
    return digests(read(spark, sf_dir, "documents"))
