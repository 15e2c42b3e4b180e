"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress alone; a bundle ends with a seek table (the seekable format's skippable
frame), so any Zstandard reader still reads the bundle from its start, and a reader with the table seeks to a frame.
Writing returns a catalog from record identifiers to (bundle, frame, offset in the frame). Tasks write bundles of their
own under fresh names and put them into the catalog only when they are closed: a bundle that a lost task left behind is
in no catalog and is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, join_counted, new_dir, tidied

#: Bytes of records after which a frame ends, and of compressed frames and number of records after which a bundle does.
FRAME_BYTES, BUNDLE_BYTES, BUNDLE_RECORDS = 1 << 20, 256 << 20, 200_000
LEVEL = 3
# Fixed values of the seekable format: magic numbers of a skippable frame and of the table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CATALOG = "record_id string, bundle string, frame long, frame_start long, frame_bytes long, start long, length long"
RECORDS = "record_id string, record_type string, page_id long, url string, refers_to_record string, payload_bytes long, payload_digest string, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(record_id: str, page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit of the record refers_to, whose block is the response's header without payload.

    A url that a header line can't hold as it is is quoted, and said to be. A null url or page_id has no line.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        plain = url == url.strip() and url.isprintable() and url != ""
        lines += [f"WARC-Target-URI: {url}"] if plain else [f"WARC-Target-URI: {quote(url, safe='')}", "WARC-Target-URI-Quoted: 1"]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    block = http if refers_to else http + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8").split("\r\n")[1:])}


def decode_records(frame: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(start, length, headers, block) of each record of a frame."""
    at = 0
    while at < len(frame):
        if frame[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at {at}")
        body = frame.index(b"\r\n\r\n", at) + 4
        headers = _headers(frame[at : body - 4])
        end = body + int(headers["content-length"])
        if frame[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield at, end + 4 - at, headers, frame[body:end]
        at = end + 4


def _record(headers: dict[str, str], block: bytes) -> tuple:
    """A row of RECORDS; a response's payload is held against its digest, a revisit has none of its own."""
    stop = block.index(b"\r\n\r\n") + 4
    http, payload = _headers(block[: stop - 4]), block[stop:]
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (payload_digest(payload) != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"payload of {headers['warc-record-id']} is not what its header says")
    url = headers.get("warc-target-uri")
    if url is not None and "warc-target-uri-quoted" in headers:
        url = unquote(url)
    page, other = headers.get("warc-page-id"), headers.get("warc-refers-to")
    return (headers["warc-record-id"].strip("<>"), kind, None if page is None else int(page), url, other and other.strip("<>"), int(http["content-length"]), digest, payload if kind == "response" else None)


class Bundle:
    """One file in the making: frames, then the seek table."""

    def __init__(self, folder: str, level: int):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.system, path = fs.FileSystem.from_uri(folder)
        self.file = self.system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.coder = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held, self.size, self.at = [], 0, 0
        self.frames: list[tuple[int, int]] = []
        self.rows: list[tuple[str, int, int, int]] = []

    def add(self, record_id: str, record: bytes) -> None:
        self.rows.append((record_id, len(self.frames), self.size, len(record)))
        self.held.append(record)
        self.size += len(record)

    def end_frame(self) -> None:
        if self.held:
            packed = self.coder.compress(b"".join(self.held))
            self.file.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size, self.at = [], 0, self.at + len(packed)

    def close(self) -> pa.RecordBatch:
        """The file's rows of the catalog."""
        self.end_frame()
        body = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.file.close()
        sizes = np.array(self.frames, np.int64).reshape(-1, 2)
        starts, (ids, frames, at, length) = np.cumsum(sizes[:, 0]) - sizes[:, 0], zip(*self.rows)
        of = np.array(frames)
        columns = [pa.array(ids), pa.array([self.name] * len(ids)), pa.array(of), pa.array(starts[of]), pa.array(sizes[of, 0]), pa.array(at, pa.int64()), pa.array(length, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CATALOG.split(", ")])


def seek_table(system: fs.FileSystem, path: str) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, bytes) of each frame, from the table at a bundle's end."""
    with system.open_input_file(path) as f:
        size = f.size()
        count, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE or flags & 0x7C:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = f.read_at(width * count, size - 9 - width * count)
    entries = [struct.unpack_from("<II", table, width * k) for k in range(count)]
    starts = np.cumsum([0, *(c for c, _ in entries)]).tolist()
    return [(s, c, d) for s, (c, d) in zip(starts, entries)]


def decided(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """(page_id, url, payload, record_id, refers_to_record) of every page, written: of pages with equal payloads of at
    least so many bytes the one with the smallest id (null last, of equal ids any one) is the response, others revisit it.

    Payloads count as equal by SHA-256 and length. Groups are reduced to one row before they meet the pages; rows of
    groups of one never meet them at all.
    """
    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    x = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    key = F.concat_ws(":", F.sha2("payload", 256), F.length("payload").cast("string"))
    x = cut(x.withColumns({"key": key, "row": F.monotonically_increasing_id()}))
    digits = F.md5(F.concat_ws(":", F.lit("page"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.col("row").cast("string")))
    name = F.concat_ws("-", F.lit("urn:uuid:"), *(F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    x = x.withColumn("record_id", F.regexp_replace(name, "^urn:uuid:-", "urn:uuid:"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "record_id"))
    of_size = x.where(F.length("payload") >= min_bytes)
    groups = cut(of_size.groupBy("key").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("first.record_id").alias("target")))
    own = F.when((F.col("record_id") != F.col("target")) & (F.length("payload") >= min_bytes), F.col("target"))
    return join_counted(x, groups, "key", "left").select("page_id", "url", "payload", "record_id", own.alias("refers_to_record"))


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> tuple[str, DataFrame]:
    """(folder, catalog): a record for every page, in bundles under a folder that all executors share.

    folder is a URI or path that pyarrow's file systems open (a new one in the shared folder, if none is given). Payloads
    are the texts in UTF-8 (null: empty); which page is a response is ``decided``. date stands in every record, as pages
    have none. A record longer than a frame takes one of its own. Extra columns are left out; an empty table writes no
    bundle and gives an empty catalog.
    """
    spark = pages.sparkSession
    folder = (folder or new_dir(spark, "warc")).rstrip("/")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for part in by_bytes(batch):
                for page_id, url, payload, record_id, target in zip(*(c.to_pylist() for c in part.columns)):
                    bundle = bundle or Bundle(folder, level)
                    bundle.add(record_id, encode_record(record_id, page_id, url, bytes(payload), target, date))
                    if bundle.size >= frame_bytes:
                        bundle.end_frame()
                    if bundle.at >= bundle_bytes or len(bundle.rows) >= BUNDLE_RECORDS:
                        yield bundle.close()
                        bundle = None
        if bundle:
            yield bundle.close()

    rows = decided(pages, min_bytes, id_col, url_col, text_col)
    return folder, cut(rows.mapInArrow(tidied(run), CATALOG))


def frames(folder: str, catalog: DataFrame) -> DataFrame:
    """(bundle, frame, start, bytes, raw_bytes) of the catalog's bundles, from the seek tables that end them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                table = seek_table(system, f"{path}/{name}")
                columns = [pa.array([name] * len(table), pa.string()), pa.array(range(len(table)), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*table))]
                yield pa.RecordBatch.from_arrays(columns, ["bundle", "frame", "start", "bytes", "raw_bytes"])

    return catalog.select("bundle").distinct().mapInArrow(run, "bundle string, frame long, start long, bytes long, raw_bytes long")


def _frame(file: pa.NativeFile, coder: zstandard.ZstdDecompressor, start: int, size: int) -> bytes:
    return coder.decompress(file.read_at(size, start))


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*found), fields)], [n for n, _ in fields])


def read(folder: str, catalog: DataFrame) -> DataFrame:
    """RECORDS of all bundles of a catalog, each payload held against its digest; revisits have a null payload.

    Frames, not bundles, are dealt to tasks; a task seeks to its frames and holds one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        coder, name, file = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            for bundle, start, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if bundle != name:
                    name, file = bundle, system.open_input_file(f"{path}/{bundle}")
                yield _rows([_record(headers, block) for _, _, headers, block in decode_records(_frame(file, coder, start, size))])

    own = frames(folder, catalog)
    return own.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame").select("bundle", "start", "bytes").mapInArrow(tidied(run), RECORDS)


def lookup(folder: str, catalog: DataFrame, ids: DataFrame, id_col: str = "record_id") -> DataFrame:
    """RECORDS of the wanted identifiers: each frame that has any is read once, and only those of its records parsed.

    Identifiers that are null or in no record are left out, repeated ones are found once.
    """
    wanted = ids.select(F.col(id_col).alias("record_id")).where("record_id IS NOT NULL").distinct()
    own = catalog.join(wanted, "record_id", "left_semi").groupBy("bundle", "frame_start", "frame_bytes").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, start, size, at in zip(*(batch.column(k).to_pylist() for k in range(4))):
                with system.open_input_file(f"{path}/{bundle}") as file:
                    frame = _frame(file, coder, start, size)
                one = (next(decode_records(frame[x["start"] : x["start"] + x["length"]])) for x in at)
                yield _rows([_record(headers, block) for _, _, headers, block in one])

    return own.mapInArrow(tidied(run), RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, url, record_id, record_type, payload_bytes, payload_digest, refers_to) of records read back; a revisit
    has the size and digest of the response that it refers to, and that response's page_id in refers_to.

    Only responses that some revisit names are joined, and a much revisited one is one row of the smaller side.
    """
    x = cut(records.drop("payload"))
    revisits = x.where("record_type = 'revisit'")
    named = revisits.select("refers_to_record").distinct()
    target = x.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    target = cut(target.join(named.hint("merge"), "refers_to_record", "left_semi"))
    got = join_counted(revisits, target, "refers_to_record").withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("_digest")})
    columns = ["page_id", "url", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    return x.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(got.select(columns))


def oracle_sql() -> str:
    """DuckDB SQL for what is read back of pages: digests as base 32 of 20 bits at a time."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    four = " || ".join(f"substr('{letters}', 1 + ((v >> {s}) & 31)::INT, 1)" for s in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, array_to_string([{four} FOR v IN [('0x' || substr(h, 1 + 5 * g, 5))::BIGINT FOR g IN range(8)]], '') AS digest, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""
