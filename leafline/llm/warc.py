"""Dictionary-compressed WARC archives, written and read back through Spark's own file sources."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path

#: Fixed values of the format: an empty skippable frame, and the magic number of the frame that holds a dictionary.
EMPTY_FRAME = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
DICTIONARY_MAGIC = 0x184D2A5D
CRLF = b"\r\n"

#: Partitions that the pages of one payload are dealt to.
SALTS = 16
LEVEL = 3
DICTIONARY_BYTES = 32 << 10
#: An archive is closed once its frames have so many bytes; a record is never parted.
ARCHIVE_BYTES = 32 << 20
#: Records of an archive that its dictionary is built from: their count and bytes at most.
SAMPLE_RECORDS = 400
SAMPLE_BYTES = 2 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(page_id, url, digest: str, payload: bytes, n_bytes: int, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit carries the digest and the length of its payload, not the payload."""
    clean = lambda x: str(x).replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        *([f"WARC-Target-URI: {clean(url)}"] if url is not None else []),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        f"WARC-Payload-Length: {n_bytes}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    return CRLF.join(x.encode("utf-8", "surrogatepass") for x in head) + CRLF * 2 + payload + CRLF * 2


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(CRLF * 2)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary of ``samples``; of few or uniform ones, their tail as a raw dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b" "


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == struct.pack("<I", 0xEC30A437)
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO if trained else zstandard.DICT_TYPE_RAWCONTENT)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for r in zip(*(batch.column(c) for c in ("page_id", "url", "sha1", "html", "n_bytes", "refers_to")), strict=True):
            page_id, url, sha1, html, n_bytes, refers_to = (x.as_py() for x in r)
            payload = (html or "").encode("utf-8", "surrogatepass")
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            yield warc_record(page_id, url, digest, b"" if refers_to is not None else payload, n_bytes, "revisit" if refers_to is not None else "response", refers_to)


def _archives(records: Iterator[bytes], archive_bytes: int) -> Iterator[bytes]:
    """Whole archives: a dictionary frame, built from the archive's first records, then a frame a record until the size is reached."""
    while True:
        waiting, size = [], 0
        for record in records:
            waiting.append(record)
            size += len(record)
            if len(waiting) >= SAMPLE_RECORDS or size >= min(SAMPLE_BYTES, archive_bytes):
                break
        if not waiting:
            return
        raw = build_dictionary(waiting)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw))
        squeezed = zstandard.ZstdCompressor(level=19).compress(raw)
        out = [struct.pack("<II", DICTIONARY_MAGIC, len(squeezed)) + squeezed]
        held = len(out[0])
        for part in (waiting, records):
            for record in part:
                out.append(packer.compress(record))
                held += len(out[-1])
                if part is records and held >= archive_bytes:
                    break
            if held >= archive_bytes:
                break
        yield b"".join(out)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a WARC record for each row of ``pages`` (page_id, url, html) to archives under ``path``.

    An archive is a file of Zstandard frames: first a skippable frame with the
    (compressed) dictionary that was built from the archive's own first records, then
    a frame for each record. It is closed when it has ``archive_bytes``, or with its partition, so a task holds one
    archive at most, writes as many as its rows fill, and a reader's row is no larger; a payload
    is stored once, and its revisits are dealt to ``SALTS`` partitions. Spark's text writer puts one archive in a file and an empty skippable frame
    after it, so the files are valid streams that any Hadoop file system can hold.

    Of pages with equal payloads of ``min_bytes`` or more, the one with the largest
    page_id is a response and the others are revisits that refer to it; rows that
    repeat that page_id are responses too. A page_id is a whole number. Null html counts as an empty payload and
    reads back as one; a null page_id is smaller than any other. Extra columns are
    ignored; an empty table writes no archive.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("n_bytes"), F.sha1(html.cast("binary")).alias("sha1"))
    firsts = rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1 and winner is not null").select("sha1", "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    marked = rows.join(firsts, ["sha1", "salt"], "left").withColumn("refers_to", F.when(F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))).drop("winner", "salt")
    marked = marked.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive in _archives(_records(batches), archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["archive"])

    archives = marked.mapInArrow(run, "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME.decode("latin1")).option("compression", "none").text(path)


def iter_frames(data: bytes) -> Iterator[bytes]:
    """The records of one archive, decompressed one after the other."""
    view, at, plain = memoryview(data), 0, None
    while at < len(view):
        (magic,) = struct.unpack_from("<I", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (n,) = struct.unpack_from("<I", view, at + 4)
            if magic == DICTIONARY_MAGIC:
                body = bytes(view[at + 8 : at + 8 + n])
                plain = zstandard.ZstdDecompressor(dict_data=_dictionary(zstandard.ZstdDecompressor().decompress(body)))
            at += 8 + n
            continue
        stream = (plain or zstandard.ZstdDecompressor()).decompressobj()
        parts, pos = [], at
        while not stream.eof and pos < len(view):
            parts.append(stream.decompress(view[pos : pos + (1 << 16)]))
            pos += 1 << 16
        at = min(pos, len(view)) - len(stream.unused_data)
        yield b"".join(parts)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0):
            rows: list[tuple] = []
            held = 0
            for record in iter_frames(archive.as_buffer()):
                fields, payload = parse_record(record)
                number = lambda x: None if x in (None, "<urn:page:None>") else int(x[len("<urn:page:") : -1])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = fields["WARC-Type"]
                if kind == "response" and base32_sha1(payload) != digest:
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
                rows.append((number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, int(fields["WARC-Payload-Length"]), digest, number(fields.get("WARC-Refers-To")), payload.decode("utf-8", "surrogatepass") if kind == "response" else None))
                held += len(payload)
                if held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_READ.names, r, strict=True)) for r in rows], schema=_READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, html of every record under ``path``.

    Digests of responses are verified; html is null for revisits.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string")


def op9_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, count(*) OVER (PARTITION BY coalesce(html, '')) AS n,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS winner
  FROM pages
), h AS (
  SELECT *, sha1(body) AS hex FROM p
), g AS (
  SELECT *, list_transform(range(0, 4), lambda i: CAST('0x' || substr(hex, CAST(1 + 10 * i AS BIGINT), 10) AS BIGINT)) AS words FROM h
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((words[1 + j // 8] >> CAST(35 - 5 * (j % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM g
"""
