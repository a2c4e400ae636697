"""WARC archives as a Spark data source.

``spark.write.format("warc")`` stores one record per row in rolling ``.warc.gz`` (one gzip member per record) or
``.warc`` files; ``spark.read.format("warc")`` reads them back. The reader plans partitions over whole files, takes
equality predicates on ``record_type`` and on the header columns, reads a record's headers first, and passes over the
payload of a record that no predicate wants or when the option ``payload`` is ``false`` (a seek in plain files).

Defined results: a null payload is stored as an empty one; a null id gives a record without page id; an empty table
gives an empty archive folder; columns other than those of ``RECORDS`` are refused by Spark at the write.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

from storyflow.llm.common import Scratch, uri

RECORDS = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Header that carries each column. Fixed values of the archive format.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def render(row) -> bytes:
    """One record. A revisit keeps the HTTP head, whose Content-Length is the full payload's, without the payload."""
    payload = bytes(row.payload or b"")
    size = len(payload) if row.payload_length is None else row.payload_length
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if row.record_type != "revisit":
        block += payload
    head = ["WARC/1.1"] + [f"{h}: {' '.join(str(row[c]).split())}" for c, h in HEADERS.items() if row[c] is not None]
    if row.record_type == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    """Each attempt writes files under hidden names; the commit gives those of successful tasks their final names."""

    def __init__(self, options: dict):
        self.path = uri(options["path"])
        self.packed = options.get("compression", "gzip") == "gzip"
        self.limit = int(options.get("maxFileBytes", 256 << 20))

    def write(self, rows: Iterator) -> Written:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for row in rows:
            if out is None:
                files.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                out, size = where.open_output_stream(f"{root}/_{files[-1]}", compression=None), 0
            data = render(row)
            data = gzip.compress(data, 1, mtime=0) if self.packed else data
            out.write(data)
            size += len(data)
            if size >= self.limit:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        for message in messages:
            for name in message.files if message else []:
                where.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages: list) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for name in message.files if message else []:
                where.delete_file(f"{root}/_{name}")


class Files(InputPartition):
    def __init__(self, names: list):
        super().__init__(tuple(names))


def headers_of(stream) -> dict | None:
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def records(stream, wanted: dict, payload: bool, seekable: bool) -> Iterator[tuple]:
    """Rows of ``RECORDS`` whose header columns equal ``wanted``."""
    while (head := headers_of(stream)) is not None:
        left = int(head.get("content-length", 0))
        row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        body = size = None
        if all(row[c] == v for c, v in wanted.items()):
            if "http" in head.get("content-type", ""):
                while left > 0 and (line := stream.readline(left)):
                    left -= len(line)
                    if line in (b"\r\n", b"\n"):
                        break
                    if line.lower().startswith(b"content-length:"):
                        size = int(line.split(b":")[1])
            size = left if size is None else size
            if payload and row["record_type"] != "revisit":
                body, left = stream.read(left), 0
            yield (*row.values(), size, body)
        if seekable:
            stream.seek(left, io.SEEK_CUR)
        else:
            while left > 0 and (passed := stream.read(min(left, 1 << 20))):
                left -= len(passed)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = uri(options["path"])
        self.payload = options.get("payload", "true").lower() == "true"
        self.target = int(options.get("partitionBytes", 128 << 20))
        self.wanted: dict = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and self.wanted.get(f.attribute[0], f.value) == f.value:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self):
        where, root = fs.FileSystem.from_uri(self.path)
        infos = [] if where.get_file_info(root).type == fs.FileType.NotFound else where.get_file_info(fs.FileSelector(root))
        groups, size = [[]], 0
        for info in sorted((i for i in infos if i.is_file and not i.base_name.startswith(("_", ".")) and ".warc" in i.base_name), key=lambda i: -i.size):
            if groups[-1] and size + info.size > self.target:
                groups.append([])
                size = 0
            groups[-1].append(info.path)
            size += info.size
        return [Files(g) for g in groups]

    def read(self, partition):
        where, _ = fs.FileSystem.from_uri(self.path)
        for name in partition.value:
            with where.open_input_file(name) as raw:
                packed = name.endswith(".gz")
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if packed else io.BufferedReader(raw, 1 << 18)
                yield from records(stream, self.wanted, self.payload, not packed)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return RECORDS

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows of ``RECORDS`` for (page_id, url, html): of equal payloads of ``least_bytes`` or more, the smallest page id is the
    response and the others revisit it; shorter ones are all responses.

    Payloads meet by SHA-1 in an aggregate, and only the (page, response) pairs of revisits join the pages again, on
    page and digest: a payload that a third of all pages share moves once per task. Rows that repeat the smallest id
    itself are all responses; a null id comes after every other.
    """
    slim = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("body")).select("page_id", F.sha1("body").alias("sha"), F.octet_length("body").alias("size"))
    first = slim.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha", "first")
    # Stored before the join, so that adaptive execution can split a payload that very many pages share.
    first = Scratch(pages.sparkSession, "warc").keep(first, "first").df
    # A null id is written as no id; -1 is not taken for it, because it may be a real one.
    again = slim.join(first, "sha").where("page_id is null or page_id <> first").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first").distinct()
    body = F.coalesce("html", F.lit("")).cast("binary")
    full = pages.select("page_id", "url", body.alias("body")).withColumn("sha", F.sha1("body"))
    joined = full.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return joined.select(
        F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>")).alias("record_id"), F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"), urn(F.col("first")).alias("refers_to"), F.col("sha").alias("payload_digest"), F.octet_length("body").cast("long").alias("payload_length"),
        F.when(F.col("first").isNull(), F.col("body")).otherwise(F.lit(b"")).alias("payload"))


@F.udf(StringType(), useArrow=True)
def base32_of_hex(digest):
    return None if digest is None else "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "gzip") -> None:
    register(pages.sparkSession)
    page_records(pages, least_bytes).withColumn("payload_digest", base32_of_hex("payload_digest")).write.format("warc").mode("append").option("compression", compression).save(path)


@F.udf(StringType(), useArrow=True)
def digest_column(payload):
    return None if payload is None else digest_of(bytes(payload))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page, length, digest and kind of every archived record; a response's digest is taken from the payload as read."""
    register(spark)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    rows = spark.read.format("warc").load(path)
    return rows.select(
        number("record_id").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.coalesce(digest_column("payload"), F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files in the shared folder and read them back."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archive")
    write_pages(pages, path)
    return read_pages(pages.sparkSession, path)
