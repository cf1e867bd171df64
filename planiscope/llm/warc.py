"""A deterministic sharded WARC writer and its reader.

Records are sorted by range: exact quantiles of the ids, weighed by bytes and so a function of the data alone, cut the
order of ids into shards, and each shard is one task. It writes gzip members in that order, rolls to a new file at a compressed
size, writes under temporary names, renames when a file is whole, and gives its files to the manifest, which is committed
last and by rename too. A task that runs again writes the same bytes to the same names. Readers take the files that the
manifest names, check digests, and check that what a revisit names was read.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_shard, commit_file, discard, numbered, shard_bounds, shared_dir, stored

#: Payloads from this size on are recorded once and revisited after that.
REVISIT_BYTES = 100
#: Compressed size at which a file ends, and uncompressed size that a shard should have.
ROLL_BYTES = 32 << 20
SHARD_BYTES = 32 << 20

_BASE = "http://www.iana.org/time-zones"  # namespace of record ids
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def name_of(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, _BASE + '#' + '/'.join(map(str, parts)))}>"


def record(name: str, page_id: int | None, url: str, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; payload None makes a revisit of the response with that digest, the page refers_to."""
    revisit = payload is None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {name_of('response', digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _gzip(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _clean(url: str | None) -> str:
    """A header value: control characters would end the line, so they are percent-encoded; null is empty."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


class _Roller:
    """Files of one shard: <folder>/part-<shard>-<number>.warc.gz, each under a temporary name until it is whole."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.number, self.out, self.done = shard, roll, 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temp = f"{self.root}/_temporary-{self.name}-{uuid.uuid4().hex}"
            self.out, self.size, self.count, self.sum = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)
        self.count += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            commit_file(self.fs, self.temp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.count, self.size, self.sum.hexdigest()))
            self.out, self.number = None, self.number + 1


def write(pages: DataFrame, folder: str, date: str | None = None, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row to `folder` and commit its manifest; returns the manifest (file, records, bytes, sha256).

    Payload: the html in UTF-8, null as empty. Of the rows with one payload of REVISIT_BYTES or more that of the smallest
    id is a response, the others revisit it; rows that share that smallest id are ordered by url, and rows without an id
    come before all ids: where one holds the payload it is the response, and revisits of it name no page. Rows that are
    alike in everything are records of their own. Equal input gives equal files. Other columns are left out. A shard
    holds some `shard_bytes` of payload and one record more at most; the driver gets a bound for every shard.
    """
    spark = pages.sparkSession
    date = date or datetime.datetime(2000, 1, 1, tzinfo=datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows, _ = numbered(rows, "page_id", "html", ties=[F.col("url"), F.sha2("html", 256)])
    narrow = stored(rows.select("uid", "page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("size")), "digests")
    bounds = shard_bounds(narrow.select("uid", "size"), shard_bytes)
    large = narrow.filter(F.col("size") >= REVISIT_BYTES)
    # written first, so that a payload of very many pages is a skewed join, whose partitions Spark splits
    first = stored(large.groupBy("digest").agg(F.min(F.struct("uid", "page_id")).alias("m"), F.count("*").alias("n")).filter("n > 1"), "first")
    again = large.join(first, "digest").filter(F.col("uid") != F.col("m.uid"))
    null = lambda kind: F.lit(None).cast(kind)
    hints = again.select("uid", F.lit(0).alias("kind"), F.col("m.page_id").alias("page_id"), null("string").alias("url"), null("string").alias("html"))
    both = hints.unionByName(rows.select("uid", F.lit(1).alias("kind"), "page_id", "url", "html"))
    dealt = by_shard(both, bounds).sortWithinPartitions("uid", "kind")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, hint, like, k = None, (), (), 0
        for batch in batches:
            for uid, kind, page_id, url, html, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    hint = (uid, page_id)
                    continue
                out = out or _Roller(folder, shard, roll_bytes)
                payload = html.encode()
                digest, revisit = hashlib.sha256(payload).hexdigest(), hint[:1] == (uid,)
                k = k + 1 if (page_id, url, digest) == like else 0  # tells rows that are alike apart
                like = (page_id, url, digest)
                name = name_of("response", digest) if not revisit and len(payload) >= REVISIT_BYTES else name_of(page_id, url, digest, shard, k)
                out.add(_gzip(record(name, page_id, _clean(url), None if revisit else payload, digest, len(payload), hint[1] if revisit else None, date)))
        if out is not None:
            out.close()
        cols = zip(*out.done, strict=True) if out is not None else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "records", "bytes", "sha256"])

    manifest = stored(dealt.select("uid", "kind", "page_id", "url", "html", "shard").mapInArrow(task, "file string, records long, bytes long, sha256 string"), "manifest")
    discard(narrow, first)
    temp = f"{root}/_temporary-manifest-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:  # one line per file
        for r in manifest.orderBy("file").toLocalIterator():
            f.write((json.dumps(r.asDict()) + "\n").encode())
    commit_file(fs, temp, f"{root}/MANIFEST.jsonl")
    return manifest


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file of gzip members."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:  # in pieces, as what follows the member is copied
            if at >= len(view):
                raise ValueError("a member ends early")
            piece = view[at : at + (1 << 15)]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        f = io.BytesIO(b"".join(parts))
        if not f.readline().startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := f.readline().rstrip(b"\r\n")) != b"":
            key, _, value = line.partition(b": ")
            head[key.decode()] = value.decode()
        yield head, f.read(int(head["Content-Length"]))


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """A row per record of the files that the manifest names, with its payload if asked (null for revisits).

    Every digest is recomputed. A revisit's length and digest come from its header, and must be those of the response
    that it names, read in the same archive. What differs is an error; so is a file that the manifest names and that is
    not there.
    """
    names = spark.read.schema("file string, records long, bytes long, sha256 string").json(f"{folder}/MANIFEST.jsonl")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    files = names.join(files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"), "file", "left")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, name string, refers string"

    def parsed(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not content.is_valid:
                    raise ValueError(f"{file} is missing")
                yield _records(content.as_py(), payload)

    found = files.select("file", "content")
    narrow = stored(found.mapInArrow(lambda it: parsed(it, False), schema), "records")
    responses = narrow.filter("record_type = 'response'").select(F.col("name").alias("refers"), F.struct("page_id", "payload_bytes", "payload_digest").alias("named"))
    wrong = narrow.filter("record_type = 'revisit'").join(responses, "refers", "left").filter(~F.struct(F.col("refers_to").alias("page_id"), "payload_bytes", "payload_digest").eqNullSafe(F.col("named")))
    if bad := wrong.select("name").head(1):
        raise ValueError(f"what {bad[0][0]} revisits is not in the archive")
    if not payload:
        return narrow.drop("name", "refers")
    return found.mapInArrow(lambda it: parsed(it, True), schema + ", payload binary").drop("name", "refers")


def _records(content: bytes, payload: bool) -> pa.RecordBatch:
    rows = []
    for head, block in parse(content):
        if "sha256:" + hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"]:
            raise ValueError(f"block digest of {head['WARC-Record-ID']}")
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
        body = block.partition(b"\r\n\r\n")[2]
        if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(head["X-Payload-Length"])):
            raise ValueError(f"payload digest of {head['WARC-Record-ID']}")
        number = lambda key, head=head: int(head[key]) if head.get(key, "None") not in ("", "None") else None
        row = (number("X-Page-Id"), head["WARC-Target-URI"], int(head["X-Payload-Length"]), digest, kind, number("X-Refers-To-Page"), head["WARC-Record-ID"], head.get("WARC-Refers-To"))
        rows.append((*row, body if kind == "response" else None) if payload else row)
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("name", pa.string()), ("refers", pa.string())]
    fields += [("payload", pa.binary())] * payload
    columns = zip(*rows, strict=True) if rows else ([],) * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def archive(pages: DataFrame, folder: str | None = None, payload: bool = True, **options) -> DataFrame:
    """Write the pages to a new archive in the shared folder, or to `folder`, and read it back."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, **options)
    return read(spark, folder, payload)
