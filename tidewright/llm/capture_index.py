"""WARC archives with a two-level capture index.

Pages become WARC records, each a gzip member of its own, in archive files of a shared folder; a page whose payload an earlier one
has becomes a revisit. Every record has an index line: its reversed-host URL key, date, and where it lies. Lines are range-sorted
by key and packed into compressed blocks (first level); a sparse directory keeps first and last key, place and length of each
block (second level). A lookup finds the index file by its bounds, searches that file's directory by bisection, reads the block's
byte range, and then the byte range of each record found.

Tasks write files under names of their own attempt; what is in an archive is said by the tables of lines and blocks alone, which
Spark commits. A lost or repeated task leaves at most a file that no line names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import dealt

LINES = 500  # index lines of a block
ROLL = 1 << 30  # bytes after which a task opens a new archive
READ_BYTES = 8 << 20  # of payloads that go on together
KEYS = 1_000_000  # wanted keys that search one directory together, about
DATE = "1970-01-01T00:00:00Z"  # of records, where pages have none
LINE = "key string, line string"
BLOCK = "part string, first_key string, last_key string, offset long, length long, n int"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _safe(text: str) -> str:
    """Blanks, control and non-ASCII characters as percent escapes, so that a line or header is one ASCII word."""
    return "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in text.encode("utf-8", "surrogatepass"))


def url_key(url: str | None) -> str:
    """Reversed host, a bracket, then path and query: ``com,example)/a?b``; a fragment, user and default port go, null is a dash."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return _safe(url) if url else "-"
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut], rest[cut:].partition("#")[0]
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    numeric = host.replace(".", "").isdigit()
    turned = host if numeric else ",".join(reversed(host.split(".")))
    port = "" if port in ("", {"http": "80", "https": "443"}.get(scheme.lower())) else f":{port}"
    return _safe(f"{turned}{port}){path or '/'}")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head only, with the digest and length of the payload that it stands for."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'-' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", _safe(url)))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def _parsed(raw: bytes) -> dict:
    """Fields and payload of one record; raises where its lengths or digest do not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = fields["WARC-Type"] == "response"
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n" or (whole and (len(payload) != length or _digest(payload) != digest)):
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    named = lambda key: None if fields.get(key) in (None, "<urn:page:->") else int(fields[key][10:-1])
    return {
        "page_id": named("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": named("WARC-Refers-To"),
        "payload_bytes": length, "payload_digest": digest, "payload": payload if whole else None,
    }


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, given as URI or absolute path."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else pafs.FileSystem.from_uri(f"file://{folder}")


class _Appended:
    """A file of this task attempt, opened with its first bytes."""

    def __init__(self, folder: str, ending: str):
        self.fs, self.base = _files(folder)
        self.ending, self.out, self.at, self.name = ending, None, 0, ""

    def add(self, data: bytes) -> int:
        if self.out is None:
            self.fs.create_dir(self.base, recursive=True)
            self.name, self.at = uuid.uuid4().hex + self.ending, 0
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.out = None


def _batch(schema: str, rows: list) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    typed = [f.strip().split(" ") for f in schema.split(",")]
    cols = list(zip(*rows)) if rows else [[] for _ in typed]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, typed)], [n for n, _ in typed])


def _archive(folder: str):
    """Write records; yield their index lines when the file is complete."""

    def run(batches):
        out, lines = _Appended(folder, ".warc.gz"), []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(3)] + [batch.column(3).cast(pa.binary()).to_pylist()]
            for page_id, refers_to, url, html in zip(*cols):
                payload = html or b""
                member = gzip.compress(_record(page_id, url, payload, refers_to), 6, mtime=0)
                at = out.add(member)
                key = url_key(url)
                lines.append((key, f"{key} 19700101000000 {json.dumps({'length': len(member), 'offset': at, 'filename': out.name})}"))
                if out.at >= ROLL:
                    out.close()
            if len(lines) >= 20_000:
                out.close()  # lines go on once their file is whole
                yield _batch(LINE, lines)
                lines = []
        out.close()
        yield _batch(LINE, lines)

    return run


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to, url, html): the smallest page_id with the same payload of at least ``min_bytes``, null for that page itself.

    Equal payloads have one SHA-256. Copies are counted by (payload, salt) before they meet, and pages look up their payload
    by the same pair, so that a payload that a third of all pages share is spread over tasks.
    """
    salts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    salt = F.pmod(F.xxhash64("page_id"), F.lit(salts))
    rows = pages.select("page_id", "url", "html").withColumn("__sha", F.when(F.octet_length(payload) >= min_bytes, F.sha2(payload, 256))).withColumn("__salt", salt)
    parts = rows.filter("__sha is not null").groupBy("__sha", "__salt").agg(F.min("page_id").alias("__least"), F.count("*").alias("__n"))
    many = parts.groupBy("__sha").agg(F.min("__least").alias("__first"), F.sum("__n").alias("__all")).filter("__all > 1 and __first is not null")
    found = parts.join(many, "__sha").select("__sha", "__salt", "__first")  # at most ``salts`` rows a payload
    again = F.when(~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first"))
    return rows.join(found, ["__sha", "__salt"], "left").select("page_id", again.alias("refers_to"), "url", "html")


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, lines: int = LINES) -> None:
    """Write ``pages`` (page_id, url, html) as archives and their index into the new ``folder``, which all executors share.

    Below it: ``warc`` the archives, ``cdx`` the index files, and the tables ``lines`` and ``directory``. A null html is an empty payload,
    a null url a record without target, under the key ``-``; rows that repeat a page_id are records of their own, and those that repeat
    the smallest page_id of a payload are all responses. Empty tables give empty archives. Other columns are ignored.
    """
    with_originals(pages, min_bytes).mapInArrow(_archive(f"{folder}/warc"), LINE).write.parquet(f"{folder}/lines")
    written = pages.sparkSession.read.parquet(f"{folder}/lines")
    ordered = written.repartitionByRange("key", "line").sortWithinPartitions("key", "line")
    ordered.mapInArrow(_blocks(f"{folder}/cdx", lines), BLOCK).write.parquet(f"{folder}/directory")


def _blocks(folder: str, most: int):
    """Pack sorted lines into compressed blocks of one index file; yield the directory."""

    def run(batches):
        out, rows, held = _Appended(folder, ".cdx.gz"), [], []

        def flush():
            data = gzip.compress("\n".join(line for _, line in held).encode(), 6, mtime=0)
            at = out.add(data)
            rows.append((out.name, held[0][0], held[-1][0], at, len(data), len(held)))
            held.clear()

        for batch in batches:
            for pair in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist()):
                held.append(pair)
                if len(held) == most:
                    flush()
        if held:
            flush()
        out.close()
        yield _batch(BLOCK, rows)

    return run


def _search(keys: pa.Table, directory: pa.Table) -> pa.Table:
    """The blocks of one index file in which wanted keys may lie, found by bisection, each with its keys."""
    blocks = sorted(zip(*(directory.column(c).to_pylist() for c in ("offset", "length", "first_key", "last_key"))))
    firsts, lasts = [b[2] for b in blocks], [b[3] for b in blocks]
    wanted: dict[int, list[str]] = {}
    for key in keys.column("key").to_pylist():
        for b in range(bisect_left(lasts, key), bisect_right(firsts, key)):
            wanted.setdefault(b, []).append(key)
    part = directory.column("shelf")[0].as_py() if len(directory) else ""
    cols = [[part] * len(wanted), [blocks[b][0] for b in wanted], [blocks[b][1] for b in wanted], list(wanted.values())]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())))], ["part", "offset", "length", "keys"])


def _range(fs: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)


def _read(folder: str, payloads: bool):
    """Blocks with their wanted keys to records."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        fs, base = _files(folder)
        rows, size = [], 0
        for batch in batches:
            for part, offset, length, keys in zip(*(batch.column(c).to_pylist() for c in ("part", "offset", "length", "keys"))):
                lines = [x.split(" ", 2) for x in _range(fs, f"{base}/cdx/{part}", offset, length).decode().split("\n")]
                wanted, found = [x[0] for x in lines], []
                for key in keys:
                    found += [json.loads(x[2]) for x in lines[bisect_left(wanted, key) : bisect_right(wanted, key)]]
                for at in sorted(found, key=lambda x: (x["filename"], x["offset"])):
                    record = _parsed(_range(fs, f"{base}/warc/{at['filename']}", at["offset"], at["length"]))
                    record["payload"] = record["payload"] if payloads else None
                    rows.append(tuple(record.values()))
                    size += len(record["payload"] or b"") + 200
                    if size >= READ_BYTES:
                        yield _batch(RECORD, rows)
                        rows, size = [], 0
        yield _batch(RECORD, rows)

    return run


def captures(spark: SparkSession, folder: str, wanted: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archive in ``folder`` whose url has the key of one of the urls in ``wanted`` (url), each once.

    Columns page_id, url (as in the record, escaped), record_type, refers_to, payload_bytes, payload_digest, payload (null for
    revisits). Urls without a capture give nothing; a null url asks for records without target. Urls that repeat, or that
    differ in what a key leaves out, are asked for once. Lengths and digests are checked on reading.
    """
    directory = spark.read.parquet(f"{folder}/directory")
    bounds = directory.groupBy("part").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"))
    bounds = sorted(tuple(r) for r in bounds.select("first", "last", "part").collect())  # one row for each index file, as many as sort ranges
    firsts, lasts, parts = ([b[i] for b in bounds] for i in range(3))

    def keyed(batches):
        for batch in batches:
            yield _batch("key string", [(url_key(u),) for u in batch.column("url").to_pylist()])

    def routed(batches):
        for batch in batches:
            rows = [(key, parts[p]) for key in batch.column("key").to_pylist() for p in range(bisect_left(lasts, key), bisect_right(firsts, key))]
            yield _batch("key string, part string", rows)

    keys = wanted.select("url").mapInArrow(keyed, "key string").distinct().mapInArrow(routed, "key string, part string")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = keys.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    spread = keys.groupBy("part").agg(F.ceil(F.count("*") / KEYS).alias("searches"))
    keys = keys.join(spread, "part").select(F.col("part").alias("shelf"), F.pmod("salt", "searches").alias("salt"), "key")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("searches") - 1)).alias("salt")
    shelves = directory.join(spread, "part").select(F.col("part").alias("shelf"), every, "offset", "length", "first_key", "last_key")
    hits = keys.groupBy("shelf", "salt").cogroup(shelves.groupBy("shelf", "salt")).applyInArrow(_search, "part string, offset long, length long, keys array<string>")
    return dealt(hits, "part", "offset").mapInArrow(_read(folder, payloads), RECORD)
