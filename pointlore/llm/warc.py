"""WARC archives in seekable Zstandard bundles.

Each task packs its rows into bundles of bounded size. A bundle is a file of independent Zstandard
frames with a few records each, then a skippable frame that maps record ids to (frame, offset in the
frame, length), then the seek table of the Zstandard seekable format. A reader of one record thus
decompresses one frame.

Of records with equal payloads the one with the largest id is the response and the others revisit it,
where the payload has at least ``revisit_from`` bytes. A null payload is empty; a null URL is the empty
URI; rows that repeat the largest id are all responses, and rows that repeat an id write records of one
record id; a null id stays null and is never referred to while its payload has another id. An empty
table gives an empty archive. Extra columns are ignored.
"""

import base64
import hashlib
import io
import json
import re
import struct
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_in, probably_in, shared_dir, stage, table, with_groups

SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, b"\xb1\xea\x92\x8f"
#: Spark has no sink for plain binary files. A bundle is the one line of a text file in ISO-8859-1, which the writer copies byte
#: by byte, and the last bytes of its seek table are the "line separator" that ends each file. Tests read the bytes back.
SEEK_MAGIC_LATIN1 = SEEK_MAGIC.decode("latin-1")


def record(kind: str, rid: int | None, url: str | None, payload: bytes, digest: str, n: int, refers_to: int | None, date: str) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if rid is None else rid}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class Bundle:
    """Frames of one file, kept in memory up to its bounded size."""

    def __init__(self, frame_bytes: int, level: int):
        self.zip, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.out, self.frames, self.index, self.open, self.size = io.BytesIO(), [], [], bytearray(), 0

    def add(self, rid: int | None, data: bytes) -> None:
        self.index.append((rid, len(self.frames), len(self.open), len(data)))
        self.open += data
        self.size += len(data)
        if len(self.open) >= self.frame_bytes:
            self.cut()

    def cut(self) -> None:
        if self.open:
            done = self.zip.compress(bytes(self.open))
            self.out.write(done)
            self.frames.append((len(done), len(self.open)))
            self.open = bytearray()

    def close(self) -> bytes:
        """The file without the last four bytes."""
        self.cut()
        names = json.dumps(self.index, separators=(",", ":")).encode()
        self.out.write(struct.pack("<II", SKIPPABLE, len(names)) + names)
        rows = [*self.frames, (len(names) + 8, 0)]
        entries = b"".join(struct.pack("<II", *x) for x in rows)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IB", len(rows), 0))
        return self.out.getvalue()


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame; the last is the index."""
    if data[-4:] != SEEK_MAGIC:
        raise ValueError("the file has no seek table")
    (n,) = struct.unpack_from("<I", data, len(data) - 9)
    rows, start = [], 0
    for packed, size in struct.iter_unpack("<II", data[len(data) - 9 - 8 * n : len(data) - 9]):
        rows.append((start, packed, size))
        start += packed
    return rows


def read_frame(data: bytes, row: tuple[int, int, int]) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[row[0] : row[0] + row[1]], max_output_size=row[2])


def read_index(data: bytes) -> list[list]:
    """[record id, frame, offset in the frame, length] of each record."""
    start, packed, _ = seek_table(data)[-1]
    return json.loads(data[start + 8 : start + packed])


def parse(data: bytes) -> tuple:
    """(id, type, payload size, digest, id referred to) of one record; a response's digest is taken from its bytes."""
    head, _, block = data.partition(b"\r\n\r\n")
    field = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = block[: int(field["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    said, urn = field["WARC-Payload-Digest"].removeprefix("sha1:"), lambda x: int(x[10:-1]) if x and x[10:-1] else None
    if field["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (said, n):
            raise ValueError(f"record {field['WARC-Record-ID']} does not hold the payload it names")
    return urn(field["WARC-Record-ID"]), field["WARC-Type"], n, said, urn(field.get("WARC-Refers-To"))


def write_archives(
    pages: DataFrame,
    path: str,
    columns: tuple[str, str, str] = ("page_id", "url", "html"),
    revisit_from: int = 0,
    bundle_bytes: int = 8 << 20,
    frame_bytes: int = 128 << 10,
    level: int = 3,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write one record per row of ``pages`` into bundles under ``path``. Memory of a task: one bundle and one record."""
    rid, url, body = (F.col(c) for c in columns)
    payload = F.coalesce(body.cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(rid.cast("long").alias("rid"), url.cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n"))
    digests = stage(rows.select("rid", "sha", "n"), "warc-digests")
    heads = digests.filter(F.col("n") >= revisit_from).groupBy("sha", "n").agg(F.max("rid").alias("head"), F.count(F.lit(1)).alias("copies"))
    heads = stage(heads.filter("copies > 1 and head is not null").select("sha", "n", "head", "copies"), "warc-heads")
    # Only rows whose payload probably occurs twice are joined with the heads, and of those only rows that may be a response
    # carry their payload along: the largest id of each payload, rows without an id and payloads below ``revisit_from``.
    key, own = F.xxhash64("sha", "n"), F.xxhash64("sha", "n", "rid")
    twice = heads.select(key.alias("k"))
    largest = maybe_in(digests, key, twice).groupBy("sha", "n").agg(F.max("rid").alias("rid")).select(own.alias("k"))
    seen = probably_in(rows, key, twice, "twice")
    alone = seen.filter("not twice").select("rid", "url", "sha", "n", F.lit(None).cast("long").alias("head"), "payload")
    held = probably_in(seen.filter("twice"), own, largest, "first")
    carried = F.when(F.col("first") | F.col("rid").isNull() | (F.col("n") < revisit_from), F.col("payload"))
    known = with_groups(held.select("rid", "url", "sha", "n", carried.alias("payload")), heads, ["sha", "n"], "copies", digests.count())
    revisit = F.col("head").isNotNull() & ~F.col("rid").eqNullSafe(F.col("head"))
    copies = known.select("rid", "url", "sha", "n", F.when(revisit, F.col("head")).alias("head"), F.when(~revisit, F.col("payload")).alias("payload"))
    ready = alone.unionByName(copies)

    def pack(batches):
        bundle = Bundle(frame_bytes, level)
        for pdf in batches:
            head = pdf["head"].astype("Int64")
            ids = pdf["rid"].astype("Int64")
            for i, u, sha, n, h, p in zip(ids, pdf["url"], pdf["sha"], pdf["n"], head, pdf["payload"]):
                i, h = (None if x is pd.NA else int(x) for x in (i, h))
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                bundle.add(i, record("response" if h is None else "revisit", i, u, p if h is None else b"", digest, int(n), h, date))
                if bundle.size >= bundle_bytes:
                    yield pd.DataFrame({"data": [bundle.close()]})
                    bundle = Bundle(frame_bytes, level)
        if bundle.index:
            yield pd.DataFrame({"data": [bundle.close()]})

    files = ready.mapInPandas(pack, "data binary").select(F.col("data").cast("string"))
    files.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", SEEK_MAGIC_LATIN1).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record_id, record_type, payload_bytes, payload_digest, refers_to. Frames are read one by one."""

    def unpack(batches):
        for pdf in batches:
            for data in pdf["content"]:
                frames, index, at, frame = seek_table(data), read_index(data), -1, b""
                rows = []
                for _, f, offset, length in index:
                    if f != at:
                        at, frame = f, read_frame(data, frames[f])
                    rows.append(parse(frame[offset : offset + length]))
                out = pd.DataFrame(rows, columns=["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"])
                yield out.astype({"record_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(unpack, "record_id long, record_type string, payload_bytes long, payload_digest string, refers_to long")


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """Where each record lies: record_id, path, frame, frame_start, frame_bytes, offset, length."""

    def look(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                frames = seek_table(data)
                rows = [(i, name, f, frames[f][0], frames[f][1], o, n) for i, f, o, n in read_index(data)]
                yield pd.DataFrame(rows, columns=["record_id", "path", "frame", "frame_start", "frame_bytes", "offset", "length"]).astype({"record_id": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(look, "record_id long, path string, frame int, frame_start long, frame_bytes long, offset long, length long")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).withColumnRenamed("record_id", "page_id")


OP4_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), h AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS sha FROM p
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY sha, payload_bytes) AS head,
         array_to_string([array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || sha[1 + 5 * i : 5 + 5 * i])::BIGINT >> s) & 31) + 1]
           for s in [15, 10, 5, 0]], '') for i in range(8)], '') AS payload_digest
  FROM h
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM d
"""
