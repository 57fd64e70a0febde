"""WARC archives: writing, monolithic-gzip normalising with a sidecar index, reading (operator 3).

Records are first written by Spark's text sink, which gives one gzip stream per
file.  The normaliser inflates each file's stream once, from start to end,
and rewrites every record as a gzip member of its own.  A last pass reads the
archives back, member by member, and writes the sidecar: archive, offset and
length of each record with what it says.

All files go through Spark's own readers and committers, so any store that
Spark reaches will do and a lost executor leaves no half-written archive.
The text sink ends each row with a separator; it is NUL, which is the last
byte of any gzip member of under 16 MiB.  A larger record is followed
by an empty member, which ends so too.

Equal payloads: the record with the smallest page_id is a response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import drop, new_path, only, prepare, save

END = b"\r\n\r\n"
RECORDS_PER_FILE = 20_000
BATCH_BYTES = 8 << 20
_INDEX = "archive string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{name}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """A WARC record without the blank lines that end it. first: the page whose equal payload it revisits, or None."""
    name = digest(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, name)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{name}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    block = _HTTP % len(payload)
    if first is None:
        block += payload
    else:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(first, name)}", f"X-Refers-To-Page: {first}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + END + block


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the HTTP payload of a record."""
    head, _, block = raw.partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, block[: int(fields["content-length"])].partition(END)[2]


def _write(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, firsts = (batch.column(c).to_pylist() for c in ("page_id", "url", "first"))
            html = batch.column("html").cast(pa.large_binary())
            made, size = [], 0
            for i, (page, url, first) in enumerate(zip(ids, urls, firsts, strict=True)):
                made.append(record(page, url, html[i].as_py() or b"", first, date))
                size += len(made[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])
                    made, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    return run


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of one inflated stream, each without its end, by their Content-Length."""
    have = bytearray()
    for chunk in chunks:
        have += chunk
        while True:
            cut = have.find(END)
            if cut < 0:
                break
            length = next(int(x.split(b":", 1)[1]) for x in bytes(have[:cut]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
            size = cut + len(END) + length
            if len(have) < size + len(END):
                break
            yield bytes(have[:size])
            del have[: size + len(END)]
    if have:
        raise ValueError("the stream ends within a record")


def inflate(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """All members of a gzip file, a piece at a time."""
    z = zlib.decompressobj(wbits=31)
    todo = memoryview(raw)
    while len(todo):
        part, todo = todo[:step], todo[step:]
        while part:
            yield z.decompress(part)
            part = z.unused_data
            if z.eof:
                z = zlib.decompressobj(wbits=31)


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, wbits=31)
    return z.compress(raw) + z.flush()


_EMPTY = member(b"")


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            made, size = [], 0
            for r in records_of(inflate(batch.column("content")[i].as_py())):
                m = member(r + END)
                if m[-1]:
                    m += _EMPTY
                made.append(m[:-1])  # the sink's separator is the last byte
                size += len(m)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])


def members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each member that has any."""
    at, whole = 0, memoryview(raw)
    while at < len(whole):
        z = zlib.decompressobj(wbits=31)
        out, end = [], at
        while not z.eof:
            part = whole[end : end + (1 << 16)]
            if not part:
                raise ValueError("the archive ends within a member")
            out.append(z.decompress(part))
            end += len(part)
        end -= len(z.unused_data)
        if content := b"".join(out):
            yield at, end - at, content
        at = end


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in _INDEX.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            rows, path = [], batch.column("path")[i].as_py()
            for offset, length, content in members(batch.column("content")[i].as_py()):
                f, payload = parse(content)
                number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                if f["warc-type"] == "response":
                    n, name = len(payload), digest(payload)
                    if f["warc-payload-digest"] != f"sha1:{name}":
                        raise ValueError(f"{path} at {offset}: the payload isn't what its digest says")
                else:
                    n, name = number("x-payload-length"), f["warc-payload-digest"].removeprefix("sha1:")
                rows.append((path, offset, length, number("x-page-id"), f.get("warc-target-uri"), n, name, f["warc-type"], number("x-refers-to-page")))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def normalise(spark: SparkSession, source: str, to: str, pattern: str = "*.gz") -> None:
    """Rewrite gzip WARC files, however compressed, as archives of one member per record, named *.warc.gz."""
    prepare(spark)
    _files(spark, source, pattern).mapInArrow(_normalise, "value binary").select(F.col("value").cast("string")).write.text(to, lineSep="\x00")
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    fs = path(to).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(path(f"{to}/part-*.txt")):  # a rename for each archive
        at = f.getPath()
        fs.rename(at, path(at.getParent(), at.getName().removesuffix(".txt") + ".warc.gz"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, from reading every archive member by member; payloads are checked against their digests."""
    prepare(spark)
    return _files(spark, path, "*.warc.gz").mapInArrow(_read, _INDEX)


def write_archives(pages: DataFrame, to: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Write pages as normalised archives at ``to`` and their index as Parquet at ``to``-index; returns the index.

    pages: page_id (a whole number), url, html; more columns are ignored.  A null html is an empty payload, a null url
    has no target URI.  Rows that share the smallest page_id of equal payloads are all
    responses.  A row with a null page_id is a revisit if another row of that payload has one, else a response.
    An empty table gives no records.
    """
    spark = pages.sparkSession
    prepare(spark)
    pages = only(pages, ("page_id", "bigint"), ("url", "string"), ("html", "string"))
    key = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    firsts = pages.groupBy(key.alias("k")).agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1 and least is not null").select("k", "least")
    firsts = save(firsts, "firsts")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    rows = pages.withColumn("k", key).join(firsts, "k", "left").select("page_id", "url", "html", first.alias("first"))
    mono = new_path(spark, "mono")
    text = rows.mapInArrow(_write(date), "value binary").select(F.col("value").cast("string"))
    text.write.option("maxRecordsPerFile", records_per_file).text(mono, compression="gzip", lineSep="\r\n\r\n")
    normalise(spark, mono, to)
    drop(mono, firsts)
    index = read_archives(spark, to)
    index.write.parquet(f"{to}-index")
    return spark.read.schema(index.schema).parquet(f"{to}-index")
