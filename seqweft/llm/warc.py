"""Web archives written in deterministic shards, and read back.

Pages are dealt to shards by ranges of their id, sorted, and written as gzip members of WARC records. A
shard rolls to its next file once the packed size passes a limit. Headers, digests and record names follow
from the content alone, so any attempt at a task writes the same bytes: each writes under a name of its
own and renames at the end, and the list of files that Spark commits with the finished tasks is the
manifest which readers follow. Of records with equal payloads only the one with the least id holds it.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.llm.common import borders, part_of
from seqweft.session import scratch_path

MANIFEST = "shard int, number int, file string, bytes long, records long, first_id long, last_id long, sha1 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, sound boolean"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FLAG, PAGE = 0, 1
READ_AT_ONCE = 1 << 20


def store_of(uri: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("/", "file:")) else posixpath.abspath(uri))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member. `refers_to` makes it a revisit, which keeps the response's head only."""
    target = urllib.parse.quote(url or "", safe="%/:=&?~#+!$,;'@()*[]|^`{}\\\"<>-._ ")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_name(page_id, target, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    top = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(top + block + b"\r\n\r\n") + packer.flush()


class Roll:
    """The files of one shard, one open at a time."""

    def __init__(self, folder: str, shard: int, limit: int) -> None:
        self.fs, self.folder = store_of(folder)
        self.shard, self.limit, self.number, self.out = shard, limit, 0, None

    def add(self, page_id: int | None, data: bytes) -> list[tuple]:
        done = self.close() if self.out and self.size + len(data) > self.limit else []
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.draft = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.draft, compression=None)
            self.size = self.records = 0
            self.sha1, self.first = hashlib.sha1(), page_id
        self.out.write(data)
        self.sha1.update(data)
        self.size += len(data)
        self.records += 1
        self.last = page_id
        return done

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        self.out.close()
        self.fs.move(self.draft, f"{self.folder}/{self.name}")
        row = (self.shard, self.number, self.name, self.size, self.records, self.first, self.last, self.sha1.hexdigest())
        self.out, self.number = None, self.number + 1
        return [row]


def writer(folder: str, limit: int, least: int, date: str):
    columns = [c.split()[0] for c in MANIFEST.split(", ")]

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll, said, before = None, None, None
        for frame in frames:
            rows = []
            for part, page_id, kind, sha1, first, url, html in zip(*[frame[c] for c in ("part", "page_id", "kind", "sha1", "first", "url", "html")], strict=True):
                page_id, first = (None if pd.isna(x) else int(x) for x in (page_id, first))
                if roll is None or roll.shard != part:
                    rows += roll.close() if roll else []
                    roll, said, before = Roll(folder, int(part), limit), None, None
                if kind == FLAG:
                    said = (page_id, sha1, first)
                    continue
                payload = (html or "").encode("utf-8", "replace")
                refers = None
                if len(payload) >= least and page_id is not None:
                    if said is not None and said[:2] == (page_id, sha1) and said[2] != page_id:
                        refers = said[2]
                    elif before == (page_id, sha1):
                        refers = page_id
                before = (page_id, sha1)
                rows += roll.add(page_id, record(page_id, url, payload, digest_of(payload), refers, date))
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"first_id": "Int64", "last_id": "Int64"})
        if roll and (rows := roll.close()):
            yield pd.DataFrame(rows, columns=columns).astype({"first_id": "Int64", "last_id": "Int64"})

    return write


def write_archives(
    pages: DataFrame, folder: str, parts: int | None = None, limit: int = 64 << 20, least: int = 0, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Writes `page_id`, `url` and `html` as archives into `folder`; gives the manifest, stored beside them.

    A null html is an empty payload, a null url an empty target. Of equal payloads of at least `least` bytes
    the record with the least id is the response, others revisit it; a repeated id revisits itself. Records
    with a null id are responses and sort first. Other columns are left out. An empty table has an empty
    manifest. The bytes depend on rows and parameters only; `limit` is the packed size at which files roll
    (a single larger record has a file of its own). Drafts of lost attempts stay behind under hidden names.
    """
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, inner = store_of(folder)
    fs.create_dir(inner, recursive=True)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    cuts = borders(rows.select("page_id", "url"), F.col("page_id"), parts)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series([part_of(cuts, None if pd.isna(i) else int(i)) for i in ids], dtype="int32")

    sha1 = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    keys = rows.select("page_id", sha1.alias("sha1"))
    firsts = keys.groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    flags = keys.join(firsts, "sha1").where("page_id > first")
    none = lambda t: F.lit(None).cast(t)
    left = flags.select("page_id", F.lit(FLAG).alias("kind"), "sha1", "first", none("string").alias("url"), none("string").alias("html"))
    right = rows.select("page_id", F.lit(PAGE).alias("kind"), sha1.alias("sha1"), none("long").alias("first"), "url", "html")
    both = left.unionByName(right).withColumn("part", part("page_id"))
    ordered = both.repartition(parts, "part").sortWithinPartitions("part", "page_id", "sha1", "kind", "url")
    manifest = f"{folder.rstrip('/')}/manifest"
    ordered.mapInPandas(writer(folder, limit, least, date), MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def unpacked(stream) -> Iterator[bytes]:
    """The records of a file of gzip members, one at a time."""
    data, ended, unpack, out = b"", False, None, []
    while True:
        if not data and not ended:
            data = stream.read(READ_AT_ONCE)
            ended = not data
        if not data:
            if unpack is not None:
                raise ValueError("the archive ends inside a record")
            return
        unpack = unpack or zlib.decompressobj(31)
        out.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack, out = None, []


def parsed(raw: bytes, payloads: bool) -> tuple:
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
    digest, response = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
    sound = lines[0].encode() == VERSION and fields["WARC-Block-Digest"] == f"sha1:{digest_of(block)}" and rest[len(block) :] == b"\r\n\r\n"
    sound = sound and (not response or (len(payload) == length and digest_of(payload) == digest))
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return number("X-Page-ID"), length, digest, fields["WARC-Type"], number("X-Refers-To-Page-ID"), fields["WARC-Target-URI"], payload if payloads and response else None, sound


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """All records of the files in the folder's manifest, with digests checked (`sound`).

    `payloads` adds the payloads of responses; revisits have none. Files are read one record at a time.
    """
    columns = [c.split()[0] for c in RECORDS.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, inner = store_of(folder)
        framed = lambda rows: pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
        for frame in frames:
            for name in frame["file"]:
                rows, held = [], 0
                with fs.open_input_stream(f"{inner}/{name}", compression=None) as stream:
                    for raw in unpacked(stream):
                        rows.append(parsed(raw, payloads))
                        held += len(raw) if payloads else 500
                        if held > 8 << 20:
                            yield framed(rows)
                            rows, held = [], 0
                if rows:
                    yield framed(rows)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    files = manifest.select("file").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return files.mapInPandas(read, RECORDS)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return scratch_path(spark, "archives")
