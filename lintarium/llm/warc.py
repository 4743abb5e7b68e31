"""WARC archives with a two-level capture index: sorted keys in compressed blocks, and a sparse directory of blocks."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintarium.llm.common import partitions, scratch, ship, text_of, written

#: Lines of an index block; bytes after which a task begins another archive.
BLOCK_LINES, ARCHIVE_BYTES = 1024, 1 << 30
DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL = "-"
#: What the name of an index file's own directory ends in.
SPARSE = ".blocks"


def surt(url: str | None) -> str:
    """The key of a URL: host reversed and lower-cased, then path and query; scheme, user, default port and fragment go.

    White space and control characters are percent-encoded; null or empty gives ``-``; what isn't a URL with a host
    is kept as it is.
    """
    if not url:
        return NO_URL
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        host, port = None, None
    if not host:
        return _plain(url)
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return _plain(",".join(reversed(host.lower().split("."))) + port + ")" + rest)


def _plain(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f\x85\xa0  ]", lambda m: quote(m[0]), text)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member of its own, so that it can be read by offset and length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}:{revisit}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_plain(url or 'urn:none')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {_REVISIT}", f"X-Refers-To-Page-Id: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict:
    """Headers and payload of one record; of a response, length and digest are taken from the payload itself."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(named["Content-Length"])]
    if len(block) != int(named["Content-Length"]):
        raise ValueError("a record is cut short")
    out = {"page_id": int(named["X-Page-Id"]) if named["X-Page-Id"].strip() else None, "url": named["WARC-Target-URI"], "record_type": named["WARC-Type"], "refers_to": None, "payload": None}
    out["payload_digest"], out["payload_bytes"] = named["WARC-Payload-Digest"].removeprefix("sha1:"), int(named["X-Payload-Length"])
    if out["record_type"] == "revisit":
        out["refers_to"] = int(named["X-Refers-To-Page-Id"])
        return out
    out["payload"] = block.partition(b"\r\n\r\n")[2]
    if digest_of(out["payload"]) != out["payload_digest"] or len(out["payload"]) != out["payload_bytes"]:
        raise ValueError("a payload doesn't have its digest")
    return out


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/*(?=[^/])", "file:///", uri) if ":" in uri else f"file://{uri}")


class _Reader:
    """Range reads, with the last file kept open."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.name:
            store, path = _store(uri)
            self.name, self.file = uri, store.open_input_file(path)
        self.file.seek(offset)
        return self.file.read(length)


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for every page and returns the captures (key, file, offset, length).

    Of equal payloads of at least ``least`` bytes the smallest id is the response and the others are revisits of it;
    smaller payloads are all responses. Null html is the empty payload. Repeated rows of the smallest id are all
    responses; rows without an id are responses where their group has no id, else revisits. Archives get names of
    their own in each attempt of a task, and only those of attempts that succeeded are in what is returned, so a lost
    executor leaves at most files that nothing names.
    """
    spark = pages.sparkSession
    ship(spark)
    html = F.encode(text_of(pages, html_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), html.alias("_html")).withColumn("_sha", F.sha1("_html"))
    groups = rows.where(F.octet_length("_html") >= least).groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    groups = written(groups.select(F.col("_sha").alias("_s"), "_first"), "warc-copies")
    marked = rows.join(groups, F.col("_sha") == F.col("_s"), "left").select("_id", "_url", "_html", "_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        store.create_dir(f"{at}/warc", recursive=True)
        name, out, offset = "", None, 0
        for b in batches:
            keys, files, offsets, lengths = [], [], [], []
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or offset > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"warc/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                revisit = first is not None and page_id != first
                data = record(page_id, url, payload, digest_of(payload), first, revisit, date)
                out.write(data)
                keys.append(surt(url))
                files.append(name)
                offsets.append(offset)
                lengths.append(len(data))
                offset += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return written(marked.mapInArrow(run, "key string, file string, offset bigint, length bigint"), "captures")


def write_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts captures by key into compressed blocks and returns the directory: a row for each block, with its key range.

    Ranges are parted by key, file and offset, so that one key with very many captures is spread over files too. Each
    range is one index file, and beside it lies the sparse directory of its blocks. Captures without a URL have the key
    ``-``, repeated captures keep a line each, and an empty table gives no file and an empty directory.
    """
    ship(captures.sparkSession)
    order = ("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        store.create_dir(f"{at}/index", recursive=True)
        name, out, offset, held, sparse = f"index/{uuid.uuid4().hex}.cdx.gz", None, 0, [], []

        def block(rows: list[tuple]) -> tuple:
            nonlocal out, offset
            out = out or store.open_output_stream(f"{at}/{name}", compression=None)
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = z.compress("".join(f"{k}\t{f}\t{o}\t{n}\n" for k, f, o, n in rows).encode()) + z.flush()
            out.write(data)
            offset += len(data)
            sparse.append(f"{rows[0][0]}\t{rows[-1][0]}\t{offset - len(data)}\t{len(data)}\n")
            return rows[0][0], rows[-1][0], name, offset - len(data), len(data), len(rows)

        def table(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], names=["first", "last", "file", "offset", "length", "n"])

        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns))
            full = len(held) // lines * lines
            yield table([block(held[i : i + lines]) for i in range(0, full, lines)])
            held = held[full:]
        if held:
            yield table([block(held)])
        if out is not None:
            out.close()
            with store.open_output_stream(f"{at}/{name}{SPARSE}", compression=None) as f:
                f.write("".join(sparse).encode())

    ranged = captures.select("key", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.mapInArrow(run, "first string, last string, file string, offset bigint, length bigint, n bigint"), "directory")


def lookup(keys: DataFrame, folder: str, directory: DataFrame) -> DataFrame:
    """Records of all captures of the keys in column ``key``: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Keys are made distinct. The key range of each index file, one small row a file, goes to all workers and says in which
    files a key can be; keys are dealt out by file, and there the file's sparse directory is read and searched by
    halving, then each block that holds a key, by range. Records are read by offset in file order. What is sent out has
    a row for each index file, not for each block. Keys without a capture give nothing, and neither do null keys.
    """
    spark: SparkSession = keys.sparkSession
    ship(spark)
    keys = keys.select("key").where("key is not null").distinct()
    columns = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    # As many rows as the index has ranges; neighbours share a key at most.
    top = sorted((r["first"], r["last"], r["file"]) for r in directory.groupBy("file").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect())
    if not top:
        return spark.createDataFrame([], columns)
    sent = spark.sparkContext.broadcast(top)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, names = zip(*sent.value)
        for b in batches:
            hits = [(k, names[i]) for k in b.column(0).to_pylist() for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in hits], pa.string()), pa.array([f for _, f in hits], pa.string())], names=["key", "file"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at, last, sorted_keys, rest = _Reader(), None, None, [], []
        firsts, lasts, places = (), (), ()
        for b in batches:
            out = []
            for key, file in zip(*(c.to_pylist() for c in b.columns)):
                if file != at:
                    at = file
                    store, path = _store(f"{folder}/{file}{SPARSE}")
                    with store.open_input_file(path) as f:
                        rows = [x.split("\t") for x in f.read().decode().split("\n")[:-1]]
                    firsts, lasts, places = [x[0] for x in rows], [x[1] for x in rows], [(int(x[2]), int(x[3])) for x in rows]
                for offset, length in places[bisect.bisect_left(lasts, key) : bisect.bisect_right(firsts, key)]:
                    if (file, offset) != last:
                        last = (file, offset)
                        rows = zlib.decompress(reader.read(f"{folder}/{file}", offset, length), 31).decode().split("\n")[:-1]
                        sorted_keys, rest = zip(*(x.split("\t", 1) for x in rows))
                    out += [rest[i].split("\t") for i in range(bisect.bisect_left(sorted_keys, key), bisect.bisect_right(sorted_keys, key))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([int(x[1]) for x in out], pa.int64()), pa.array([int(x[2]) for x in out], pa.int64())], names=["file", "offset", "length"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        for b in batches:
            for i in range(0, b.num_rows, 256):
                out = [parse(reader.read(f"{folder}/{f}", o, n)) for f, o, n in zip(*(c.to_pylist() for c in b.slice(i, 256).columns))]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in kinds.items()], names=list(kinds))

    # The numbers of partitions are given, as pointers are small but what they lead to isn't. Keys of one index file, of which
    # there are as many as ranges, are read by one task, or by several where the file has many.
    found = keys.mapInArrow(files, "key string, file string")
    pointers = found.repartitionByRange(partitions(spark), "file", "key").sortWithinPartitions("file", "key").mapInArrow(lines, "file string, offset bigint, length bigint")
    return pointers.repartitionByRange(partitions(spark), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(records, columns)


def keys_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The index key of every URL."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column(0).to_pylist()], pa.string())], names=["key"])

    return pages.select(F.col(url_col).cast("string").alias("_url")).mapInArrow(run, "key string")


def archive(pages: DataFrame, folder: str | None = None, least: int = 0, **names) -> tuple[str, DataFrame]:
    """Writes archives and index under a folder (a new one in the shared folder if none is named): (folder, directory)."""
    folder = folder or scratch(pages.sparkSession, "archive")
    return folder, write_index(write_archives(pages, folder, least, **names), folder)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder, directory = archive(pages)
    return lookup(keys_of(pages), folder, directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# The digest in base 32: five bits at a time out of the hexadecimal SHA-1.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(('0x' || substr(s || '00', CAST(5 * i // 4 + 1 AS INTEGER), 3)) AS INTEGER) // CAST(pow(2, 7 - 5 * i % 4) AS INTEGER)) % 32 + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
