"""WARC archives, compressed with Zstandard: a writer and a reader.

An archive begins with a skippable frame that holds a dictionary (https://iipc.github.io/warc-specifications, the Zstandard
extension); after it comes one frame per record. The reader takes the dictionary from there, finds each frame's end from its
block headers, decodes it by itself, and checks the record: version line, mandatory headers, Content-Length, HTTP headers, block
and payload digests where the record has them. Header names count in any case. A record that fails raises ValueError with its
archive and place, since a wrong archive must not pass for a shorter one. Records other than responses and revisits (warcinfo,
request, metadata and the like) are checked the same way and then passed over.

A null html is an empty payload, a null url an empty one. Each input row gives a record, repeated rows too. A payload of any
length is one record, held in memory as such. An empty table writes no archive. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, new_path, small_batches

#: Fixed values of the formats.
SKIPPABLE_DICTIONARY, FRAME = 0x184D2A5D, 0xFD2FB528
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never revisits. An archive is closed once it has so many bytes.
LEAST, ARCHIVE_BYTES = 1000, 32 << 20
MANDATORY = ("WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length")
LEVEL = 3
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(kind: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit has the HTTP headers but no payload; its digest is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    digest = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{urn(page_id)}>", "WARC-Date": "2020-01-01T00:00:00Z", "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(payload)}
    if kind == "revisit":
        head |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": f"<{urn(refers_to)}>"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": len(block)}).items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def urn(page_id: int | None) -> str:
    """A page's record id: its number as UUID, or a random one where it is null."""
    return (uuid.uuid4() if page_id is None else uuid.UUID(int=page_id % (1 << 64))).urn


def number(record_id: str) -> int | None:
    try:
        n = uuid.UUID(record_id.strip("<>")).int
    except ValueError:
        raise ValueError(f"a record id that is no UUID: {record_id[:60]!r}") from None
    return None if n >= 1 << 64 else n - (1 << 64) * (n >> 63)


@functools.lru_cache(maxsize=1)
def dictionary() -> bytes:
    """A dictionary of what all records here share; raw content, so that nothing needs training."""
    sample = record("response", 1, "https://www.example.com/index.html?page=1", b"<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><title></title></head><body><p></p></body></html>", None)
    return record("revisit", 1, "http://www.example.org/", b"", 2) + sample


def archive_start() -> bytes:
    d = dictionary()
    return struct.pack("<II", SKIPPABLE_DICTIONARY, len(d)) + d


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its headers."""
    if at + 5 > len(data) or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError(f"no Zstandard frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    size = (1 if single else 0, 2, 4, 8)[flags >> 6]
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size
    while True:
        if pos + 3 > len(data):
            raise ValueError(f"the frame at byte {at} is cut short")
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise ValueError(f"the frame at byte {at} is cut short")
    return pos


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, decoded frame by frame."""
    view, at, decoder = memoryview(data), 0, zstandard.ZstdDecompressor()
    if len(data) >= 8 and (head := struct.unpack_from("<II", data))[0] == SKIPPABLE_DICTIONARY:
        raw, at = bytes(view[8 : 8 + head[1]]), 8 + head[1]
        if len(raw) != head[1]:
            raise ValueError("the dictionary is cut short")
        if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may be compressed itself
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    while at < len(data):
        end = frame_end(view, at)
        try:
            yield decoder.decompressobj().decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise ValueError(f"the frame at byte {at} can't be decoded: {e}") from e
        at = end


def fields_of(lines: list[str]) -> dict[str, str]:
    """Header fields by name in lower case; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"a header line without a name: {line[:60]!r}")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def numbered(value: str, name: str) -> int:
    if not (value.isascii() and value.isdigit()):
        raise ValueError(f"{name} is no number: {value[:60]!r}")
    return int(value)


def sha1_of(fields: dict[str, str], name: str) -> bytes | None:
    """The digest of that header, in base 32 or 16; null where there is none."""
    if name.lower() not in fields:
        return None
    kind, _, value = fields[name.lower()].partition(":")
    try:
        if kind.lower() != "sha1":
            raise ValueError
        return bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        raise ValueError(f"{name} is no SHA-1 digest: {fields[name.lower()][:60]!r}") from None


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None] | None:
    """page_id, bytes and SHA-1 of the full payload, type, page_id that it refers to; null for other kinds of record.

    Raises ValueError if anything is amiss.
    """
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = fields_of(lines[1:])
    if missing := [x for x in MANDATORY if x.lower() not in fields]:
        raise ValueError(f"headers are missing: {missing}")
    n = numbered(fields["content-length"], "Content-Length")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, the record has {len(rest) - 4}")
    block, kind = rest[:n], fields["warc-type"].lower()
    if (said := sha1_of(fields, "WARC-Block-Digest")) is not None and hashlib.sha1(block).digest() != said:
        raise ValueError("the block's digest differs")
    if kind not in ("response", "revisit"):
        return None
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise ValueError("the block has no HTTP headers")
    inner = fields_of(http.decode("latin-1").split("\r\n")[1:])
    own, said = hashlib.sha1(payload).digest(), sha1_of(fields, "WARC-Payload-Digest")
    length = numbered(inner["content-length"], "the HTTP Content-Length") if "content-length" in inner else None
    if kind == "response":
        if length not in (None, len(payload)) or said not in (None, own):
            raise ValueError("the payload differs from its length or digest")
        return number(fields["warc-record-id"]), len(payload), own.hex(), kind, None
    if said is None or length is None or "warc-refers-to" not in fields:
        raise ValueError("a revisit without payload digest, length or WARC-Refers-To")
    return number(fields["warc-record-id"]), length, said.hex(), kind, number(fields["warc-refers-to"])


def put(uri: str, data: bytes) -> None:
    """Writes a whole file at a URI, of the local file system or any that pyarrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload and refers_to: null for responses.

    Of equal payloads of at least ``least`` bytes that with the largest page_id is the response (all rows of that id, if it
    repeats; null ids count as smallest, and payloads with null ids only are all responses); the others revisit it. A null
    html is an empty payload. The digests are counted first, with partial sums; only repeated ones are joined back.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.when(F.length("payload") >= least, F.sha1("payload")))
    repeated = cut(base.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("best")).where("n > 1").drop("n"), "digests")
    joined = base.join(repeated, "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best")).alias("refers_to"))


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of roles() as archives in the folder. Returns a table of those that count: archive, records, bytes.

    A task that is run again writes archives of other names; only those of the attempt that succeeded are in the table.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        name, k = f"{folder}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}", 0
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=True, write_checksum=True)
        buffer, n, size = [], 0, 0

        def closed() -> pa.RecordBatch:
            data = archive_start() + b"".join(buffer)
            put(to := f"{name}-{k:05d}.warc.zst", data)
            return pa.RecordBatch.from_arrays([pa.array([to]), pa.array([n], pa.int64()), pa.array([len(data)], pa.int64())], ["archive", "records", "bytes"])

        for b in batches:
            for page, url, payload, refers in zip(*(b.column(i).to_pylist() for i in range(4))):
                kind = "response" if refers is None else "revisit"
                buffer.append(coder.compress(record(kind, page, url.replace("\r", "%0D").replace("\n", "%0A"), payload, refers)))
                n, size = n + 1, size + len(buffer[-1])
                if size >= archive_bytes:
                    yield closed()
                    buffer, n, size, k = [], 0, 0, k + 1
        if n:
            yield closed()

    return cut(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, records long, bytes long"), "archives")


def read(spark: SparkSession, folder: str, archives: DataFrame | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every response and revisit of the archives in the folder.

    archives: the table of write(); without it all files count. Spark's own reader brings the files to the executors. An archive
    is read whole into memory (write() closes one at ARCHIVE_BYTES), and its rows go on in thousands.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.col("path"), F.col("content"))
    if archives is not None:
        files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(archives.select(F.element_at(F.split("archive", "/"), -1).alias("file")), "file", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                rows, n = [], 0
                try:
                    for n, raw in enumerate(records(content.as_py()), 1):
                        if (row := parsed(raw)) is not None:
                            rows.append(row)
                        if len(rows) == 1000:
                            yield batch(rows)
                            rows = []
                except ValueError as e:
                    raise ValueError(f"{path}: record {n}: {e}") from e
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.select("path", "content").mapInArrow(run, RECORDS)


def dangling(found: DataFrame) -> DataFrame:
    """The revisits of read() whose response isn't among its rows, by page_id and digest."""
    there = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return found.where("record_type = 'revisit'").join(there, ["refers_to", "payload_digest"], "left_anti")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives of the pages in the shared folder and reads them back. A revisit without its response is an error."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    archives = write(roles(pages, id_col, url_col, html_col), folder)
    if archives.isEmpty():
        return spark.createDataFrame([], RECORDS)
    found = cut(read(spark, folder, archives), "records")
    if (lost := dangling(found).first()) is not None:
        raise ValueError(f"a revisit without its response: {lost}")
    return found
