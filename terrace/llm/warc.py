"""WARC archives of Zstandard frames: a writer that marks repeated payloads as revisits, and a reader.

An archive begins with a skippable frame that holds the Zstandard dictionary; then each record is one frame. The reader
takes the dictionary from that leading frame, decodes frame by frame, and checks of each record the version line, the
mandatory headers, that Content-Length is the block's length, the record's two line ends, and block and payload digests.

A payload's first record (the smallest id) is a response, further ones of at least `least_bytes` are revisits that
refer to it. Equal payloads are found by their SHA-256 and length: only these are grouped, with Spark's partial
aggregation, so that a payload on a third of all pages makes one row per partition; payloads move once, by page.

Defined cases: a null payload counts as empty; null ids come last, so a payload whose ids are all null has responses
only; rows that repeat an id have a record each, of the same type; an empty table gives no archive and an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import cut, pieces, shared_folder, text_of
from terrace.llm.files import reading, writing

#: A payload that more than this part of the pages have is hot.
HOT_SHARE = 1000
#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Every record has this date unless the caller gives another, so that archives are the same each time.
DATE = "2020-01-01T00:00:00Z"
#: Words of markup that most pages share; a raw-content dictionary.
DICTIONARY = (
    b'WARC/1.1\r\nWARC-Type: response\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:x-page:\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: https://'
    b'\r\nContent-Type: application/http; msgtype=response\r\nWARC-Block-Digest: sha1:\r\nWARC-Payload-Digest: sha1:\r\nContent-Length: '
    b'HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: \r\n\r\n<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>'
    b'</title></head><body><nav><ul><li><a href="/"></a></li></ul></nav><div class=""></div><article><h1></h1><p></p></article></body></html>\r\n\r\n'
)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """A response with HTTP head and payload, or a revisit with the HTTP head alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    payload_digest = digest(payload)
    if kind == "response":
        block += payload
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")] if kind == "revisit" else []),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"", block, b"", b""])


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; ValueError where it isn't valid."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not found or version not in (b"WARC/1.0", VERSION):
        raise ValueError("no WARC record")
    headers = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line!r}")
        headers[name.strip().lower()] = value.strip()
    if absent := [x for x in MANDATORY if x not in headers]:
        raise ValueError(f"headers missing: {absent}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length is not the block's length")
    block = rest[:-4]
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError("the block's digest differs")
    return headers, block


def http_parts(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Length and digest of the full payload, and the payload where the record has it."""
    head, found, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.lower().split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)
    if not found or not fields.get(b"content-length", b"").isdigit():
        raise ValueError("no HTTP response")
    length, said = int(fields[b"content-length"]), headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "revisit":
        if payload or not said:
            raise ValueError("a revisit has a digest and no payload")
        return length, said, None
    if len(payload) != length or said not in ("", digest(payload)):
        raise ValueError("the payload's length or digest differs")
    return length, digest(payload), payload


class ArchiveWriter:
    def __init__(self, out, dictionary: bytes = DICTIONARY, level: int = 3):
        self.out = out
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)

    def add(self, data: bytes) -> None:
        self.out.write(self.compressor.compress(data))


def read_archive(file, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records' bytes, one frame at a time; holds one record and one piece of the file."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the dictionary's frame is missing")
    dictionary = file.read(size)
    if dictionary[:4] == ZSTD_FRAME:  # the dictionary may itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    frame, out, data = reader.decompressobj(), [], file.read(piece)
    while data:
        out.append(frame.decompress(data))
        if frame.eof:
            yield b"".join(out)
            data, frame, out = frame.unused_data or file.read(piece), reader.decompressobj(), []
        else:
            data = file.read(piece)
    if out:
        raise ValueError("the last frame is cut off")


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """_id, _payload, _first: the smallest id with an equal payload. pages: _id, _payload."""
    shape = [F.sha2(F.col("_payload").cast("binary"), 256).alias("_sha"), F.octet_length("_payload").alias("_bytes")]
    ids = cut(pages.select("_id", *shape))
    groups = ids.filter(F.col("_bytes") >= least_bytes).groupBy("_sha", "_bytes").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    # A payload with more than a thousandth of the pages is hot: there are fewer than a thousand such, which are broadcast.
    groups, least = cut(groups), max(1, ids.count() // HOT_SHARE)
    hot, keys = F.broadcast(groups.filter(F.col("_n") > least)), ["_sha", "_bytes"]
    met = ids.join(hot, keys).unionByName(ids.join(hot, keys, "left_anti").join(groups.filter(F.col("_n") <= least), keys))
    # Pages meet their type by id.
    repeated = cut(met.select("_id", "_first", "_sha").distinct())
    mine = pages.withColumn("_sha", shape[0])
    return mine.join(repeated.withColumnRenamed("_id", "_of").withColumnRenamed("_sha", "_of_sha"), (F.col("_id").eqNullSafe(F.col("_of"))) & (F.col("_sha") == F.col("_of_sha")), "left").drop("_of", "_of_sha", "_sha")


def write_archives(pages: DataFrame, folder: str, id_col: str, uri_col: str, payload_col: str, scheme: str, least_bytes: int = 0) -> DataFrame:
    """Writes an archive per partition and returns the manifest: path, records. A record's id is `scheme` and the row's id."""
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId():06d}.warc.zst"
        batches = (b for b in pieces(batches) if b.num_rows)
        batch, records = next(batches, None), 0
        if batch is None:
            return
        with writing(path, context.taskAttemptId()) as out:
            archive = ArchiveWriter(out)
            while batch is not None:
                for row in zip(*(batch[c].to_pylist() for c in ("_id", "_uri", "_payload", "_first")), strict=True):
                    own, uri, payload, first = row
                    again = first is not None and first != own
                    own = str(uuid.uuid5(uuid.NAMESPACE_URL, uri or "")) if own is None else f"{scheme}{own}"
                    archive.add(record("revisit" if again else "response", own, uri or "about:blank", payload, f"{scheme}{first}" if again else None))
                    records += 1
                batch = next(batches, None)
        yield pa.RecordBatch.from_pylist([{"path": path, "records": records}], schema)

    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.regexp_replace(F.col(uri_col), r"[\x00-\x20]", "%20").alias("_uri"), text_of(payload_col).alias("_payload"))
    typed = with_types(rows.select("_id", F.col("_payload"), "_uri"), least_bytes)
    return cut(typed.select("_id", "_uri", F.col("_payload").cast("binary").alias("_payload"), "_first").mapInArrow(write, "path string, records long"))


def read_archives(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives in the column path: record_id, record_type, refers_to, target_uri, payload_bytes, payload_digest and, if asked for, payload."""
    columns = ["record_id", "record_type", "refers_to", "target_uri", "payload_bytes", "payload_digest", *(["payload"] if payloads else [])]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(columns)]
    schema = pa.schema(list(zip(columns, kinds, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows, held = [], 0
                with reading(path) as file:
                    for data in read_archive(file):
                        headers, block = parse(data)
                        length, said, payload = http_parts(headers, block)
                        ids = (headers[k].strip("<>") if k in headers else None for k in ("warc-record-id", "warc-type", "warc-refers-to", "warc-target-uri"))
                        rows.append((*ids, length, said, *([payload] if payloads else [])))
                        held += len(payload or b"") if payloads else 0
                        if len(rows) >= 4096 or held > 1 << 25:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    sql = "record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string" + (", payload binary" if payloads else "")
    return paths.select("path").repartition(max(1, paths.count()), "path").mapInArrow(read, sql)


def archived_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", scheme: str = "urn:x-page:", least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in a shared folder and reads them back: id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    records = read_archives(write_archives(pages, folder, id_col, uri_col, payload_col, scheme, least_bytes))
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(scheme) + 1}) AS bigint)")
    return records.select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
