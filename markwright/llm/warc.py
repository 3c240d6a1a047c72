"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members, a record each, to the shared folder, under a name of its own; only
files named in rows of tasks that ended well are ever read, so tasks can be run again. Index: captures are sorted over all
tasks by reversed-host URL key and page id; each partition writes an index file of compressed blocks of BLOCK lines, followed
by a directory of the blocks' first keys. A table of one row for each index file is all the driver holds. Reading: a key is
searched by bisection among the files, then in the file's directory, then in the block; the record's range is read by
offset and length. Lookups in bulk come in key order, so blocks are decompressed once, and ranges are read in file order.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, parts, read, settle, shared_dir, spread_join

LEAST_PAYLOAD = 100
BLOCK = 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
NULL_ID = -(1 << 63)


def url_key(url: str | None) -> str:
    """Host names reversed and comma-joined, lower case, then the path and query: http://a.b.org/c?d -> org,b,a)/c?d.

    Scheme, user, default port and fragment go; a null or empty URL has the key ")/"."""
    rest = (url or "").strip().partition("#")[0]
    scheme, found, after = rest.partition("://")
    rest, scheme = (after, scheme.lower()) if found else (rest, "")
    cut = min((k for k in (rest.find("/"), rest.find("?")) if k >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, _, port = host.partition(":")
    if port and port != {"http": "80", "https": "443"}.get(scheme):
        name, tail = name, f":{port}"
    else:
        tail = ""
    return ",".join(reversed(name.split("."))) + tail + ")" + (path if path.startswith("/") else f"/{path}")


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own. Line breaks in the URL are percent-encoded."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is None:
        body = HTTP + payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {len(payload)}"]
        body = HTTP
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a gzip member; the length and the digest that the headers state are checked."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != headers["WARC-Payload-Digest"][7:]:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} isn't what was written")
    return headers, payload


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives all rows of page_id, url, html; returns the captures: page_id, key, file, at, length.

    Payload: html in UTF-8, null as empty. Of equal payloads of LEAST_PAYLOAD bytes or more the smallest page_id is a
    response, the others are revisits of it; rows that repeat that id are responses too. A null page_id counts as the
    smallest number. An empty table gives none."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/markwright-warc/{uuid.uuid4().hex}"
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.coalesce("page_id", F.lit(NULL_ID)).alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = rows.where(F.octet_length("payload") >= LEAST_PAYLOAD)
    first = settle(large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id", "n"))
    rows = spread_join(rows, first, "digest", "n").select("page_id", "url", "payload", "digest", F.when(F.col("first_id") != F.col("page_id"), F.col("first_id")).alias("refers_to"))

    def work(rows):
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for page_id, url, payload, digest, refers_to in rows:
                if out is None:
                    store, path = _fs(folder)
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                raw = record(page_id, url, payload, digest, refers_to)
                out.write(raw)
                yield page_id, url_key(url), f"{folder}/{name}", at, len(raw)
                at += len(raw)
        finally:
            if out is not None:
                out.close()

    return settle(map_rows(rows, work, "page_id long, key string, file string, at long, length long"))


def index(captures: DataFrame, folder: str | None = None) -> list[tuple]:
    """Writes the index of `captures`; returns (first key, its page_id, file, start and length of its directory) for each file."""
    folder = folder or f"{shared_dir(captures.sparkSession)}/markwright-index/{uuid.uuid4().hex}"
    ordered = captures.repartitionByRange(parts(captures.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")

    def work(rows):
        out, directory, lines, at, name = None, [], [], 0, f"{uuid.uuid4().hex}.idx"

        def flush():
            nonlocal at
            raw = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            out.write(raw)
            directory.append([*lines[0][:2], at, len(raw)])
            at += len(raw)
            lines.clear()

        for key, page_id, *place in rows:
            if out is None:
                store, path = _fs(folder)
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            lines.append([key, page_id, *place])
            if len(lines) == BLOCK:
                flush()
        if out is not None:
            if lines:
                flush()
            raw = zlib.compress(json.dumps(directory).encode())
            out.write(raw)
            out.close()
            yield *directory[0][:2], f"{folder}/{name}", at, len(raw)

    made = map_rows(ordered.select("key", "page_id", "file", "at", "length"), work, "key string, page_id long, file string, at long, length long")
    return sorted(tuple(r) for r in settle(made).collect())


class Index:
    """find(key, page_id) -> (file, at, length) of each record that was written under both."""

    def __init__(self, files: list[tuple]):
        self.files, self.firsts = files, [x[:2] for x in files]
        self.directory = lru_cache(4)(lambda *x: json.loads(zlib.decompress(self._range(*x))))
        self.block = lru_cache(16)(lambda *x: [json.loads(line) for line in zlib.decompress(self._range(*x)).decode().split("\n")])

    @staticmethod
    def _range(file: str, at: int, length: int) -> bytes:
        store, path = _fs(file)
        with store.open_input_file(path) as f:
            return f.read_at(length, at)

    def find(self, key: str, page_id: int):
        """Equal keys are in one file, as it is one range of keys, but they can begin at a block's end and go over several blocks."""
        if (k := bisect_right(self.firsts, (key, page_id)) - 1) < 0:
            return
        _, _, file, at, length = self.files[k]
        blocks = self.directory(file, at, length)
        for b in range(max(0, bisect_left(blocks, [key, page_id], key=lambda x: x[:2]) - 1), len(blocks)):
            if blocks[b][:2] > [key, page_id]:
                return
            lines = self.block(file, *blocks[b][2:])
            for i in range(bisect_left(lines, [key, page_id], key=lambda x: x[:2]), len(lines)):
                if lines[i][:2] != [key, page_id]:
                    return
                yield tuple(lines[i][2:])


def read_back(wanted: DataFrame, files: list[tuple]) -> DataFrame:
    """Of each row of page_id, url: page_id, payload_bytes, payload_digest, record_type, refers_to, from index and archive.

    `files` is a row for each index file, so it is as small as the number of partitions. A page that isn't there has no row;
    rows that share page_id and URL key get every record written under these, once."""
    session = wanted.sparkSession
    shared = session.sparkContext.broadcast(files)

    def keys(rows):
        for page_id, url in rows:
            yield (NULL_ID if page_id is None else page_id), url_key(url)

    def look(rows):
        found, last = Index(shared.value), None
        for page_id, key in rows:
            if (page_id, key) != last:
                yield from found.find(key, page_id)
            last = page_id, key

    def ranges(rows):
        name, handle = None, None
        for file, at, length in rows:
            if file != name:
                store, path = _fs(file)
                if handle:
                    handle.close()
                name, handle = file, store.open_input_file(path)
            headers, payload = parse(handle.read_at(length, at))
            refers = headers.get("WARC-Refers-To")
            page = int(headers["WARC-Record-ID"][10:-1])
            size = int(headers["X-Payload-Length"]) if refers else len(payload)
            digest = headers["WARC-Payload-Digest"][7:]
            yield None if page == NULL_ID else page, size, digest, headers["WARC-Type"], None if not refers or int(refers[10:-1]) == NULL_ID else int(refers[10:-1])

    asked = map_rows(wanted.select("page_id", "url"), keys, "page_id long, key string")
    asked = asked.repartitionByRange(parts(session), "key", "page_id").sortWithinPartitions("key", "page_id")
    places = map_rows(asked, look, "file string, at long, length long")
    places = places.repartitionByRange(parts(session), "file", "at").sortWithinPartitions("file", "at")
    return map_rows(places, ranges, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", 64)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record, found again by the index and read back. Null html is empty; rows that share id and URL all come back."""
    pages = read(spark, sf_dir, "pages")
    return read_back(pages, index(write(pages)))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
