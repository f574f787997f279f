"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about a megabyte that decompress by themselves. A bundle
ends with a seek table in a skippable frame (the public seekable format), which gives each
frame's compressed and decompressed size, and an index maps every record to its bundle, frame,
offset within the frame and length. Reading one record decompresses one frame; a plain
Zstandard reader sees an ordinary WARC file.

Bundles carry a name that is unique to the task attempt, and only the index written by
successful attempts says which ones belong to the result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.llm.shared import new_folder, saved, spread

#: Uncompressed bytes after which a frame, and a bundle, is closed.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 28
#: Bytes of shared payloads' first pages that every task may get, and what one takes besides its key and address.
MOST_BROADCAST, ROW_BYTES = 32 << 20, 120
#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of the WARC 1.1 standard: the profile of revisits with an equal payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FOOTER = struct.Struct("<IBI")
_INDEX = [("page_id", pa.string()), ("file", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page: str | None) -> str:
    return "<urn:page>" if page is None else f"<urn:page:{quote(page, safe='')}>"


def _page(name: str) -> str | None:
    return None if name == "<urn:page>" else unquote(name[len("<urn:page:"):-1])


def _address(url: str | None, page: str | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else _name(page)[1:-1]


def _record(page: str | None, url: str | None, payload: bytes, of: str | None, of_url: str | None, date: str) -> bytes:
    """One record: a response with the payload, or a revisit of page ``of`` with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if of is not None else http + payload
    fields = {
        "WARC-Type": "response" if of is None else "revisit",
        "WARC-Record-ID": _name(page),
        "WARC-Date": date,
        "WARC-Target-URI": _address(url, page),
        "WARC-Payload-Digest": "sha1:" + payload_digest(payload),
    }
    if of is not None:
        fields |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": _name(of), "WARC-Refers-To-Target-URI": _address(of_url, of), "WARC-Refers-To-Date": date}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class _Bundle:
    """Writes one bundle, holding one frame at a time."""

    def __init__(self, folder: str, frame_bytes: int):
        self._frame_bytes = frame_bytes
        self.name = f"pages-{uuid.uuid4().hex}.warc.zst"
        files, place = arrow_fs.FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        self._stream = files.open_output_stream(f"{place}/{self.name}", compression=None)
        self._sizes: list[tuple[int, int]] = []
        self._frame: list[bytes] = []
        self._held = self.written = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset and length of the record."""
        place = (len(self._sizes), self._held, len(record))
        self._frame.append(record)
        self._held += len(record)
        self.written += len(record)
        if self._held >= self._frame_bytes:
            self._flush()
        return place

    def _flush(self) -> None:
        if self._frame:
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(self._frame))
            self._stream.write(data)
            self._sizes.append((len(data), self._held))
            self._frame, self._held = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self._sizes) + _FOOTER.pack(len(self._sizes), 0, SEEKABLE)
        self._stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self._stream.close()


class BundleReader:
    """Random access to the frames of a bundle."""

    def __init__(self, folder: str, name: str):
        files, place = arrow_fs.FileSystem.from_uri(f"{folder}/{name}")
        self._file = files.open_input_file(place)
        end = self._file.size()
        n, _, magic = _FOOTER.unpack(self._read(end - _FOOTER.size, _FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        table = self._read(end - _FOOTER.size - 8 * n, 8 * n)
        self.frames, at = [], 0
        for packed, size in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, size))
            at += packed

    def _read(self, at: int, size: int) -> bytes:
        self._file.seek(at)
        return self._file.read(size)

    def frame(self, number: int) -> bytes:
        at, packed, size = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self._read(at, packed), max_output_size=max(size, 1))

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset:offset + length]

    def close(self) -> None:
        self._file.close()


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Fields and block of the record at ``at``, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not at the start of a record")
    fields = dict(line.split(": ", 1) for line in lines)
    start, size = end + 4, int(fields["Content-Length"])
    return fields, data[start:start + size], start + size + 4


def mark_revisits(df: DataFrame, key: str, url: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """Adds to key, url and payload the page that each row revisits: refers_to and its address refers_url.

    Of rows with equal payloads of at least ``least_bytes`` the smallest key is the response, the
    others refer to it. A null payload is an empty one. Null keys are never referred to; if all keys
    of a payload are null, all its rows are responses, and so are rows that repeat the smallest key.
    The smallest key per payload is found with partial aggregates, so a payload of a third of all
    pages is one small row per task. What several pages share is written and measured: up to
    MOST_BROADCAST bytes every task gets it, and no payload is shuffled; beyond that the payloads are joined by
    a shuffle, which can be split where it is uneven.
    """
    value = F.coalesce(df[payload].cast("string"), F.lit("")).cast("binary")
    rows = df.select(df[key].alias("key"), df[url].cast("string").alias("url"), value.alias("payload"), F.sha1(value).alias("sha"), F.octet_length(value).alias("size"))
    copied = rows.filter(F.col("size") >= least_bytes)
    first = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "url")))
    firsts = (copied.groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
              .select(F.col("sha").alias("first_sha"), F.col("first.key").alias("first_key"), F.col("first.url").alias("first_url"), F.lit(least_bytes).alias("least")))
    firsts = saved(firsts, "warc-firsts")
    taken = F.sum(F.lit(ROW_BYTES) + F.coalesce(F.octet_length("first_url"), F.lit(0)) + F.coalesce(F.octet_length(F.col("first_key").cast("string")), F.lit(0)))
    few = (firsts.agg(taken).first()[0] or 0) <= MOST_BROADCAST
    joined = rows.join(F.broadcast(firsts) if few else firsts, (F.col("sha") == F.col("first_sha")) & (F.col("size") >= F.col("least")), "left")
    refers = F.col("first_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    return joined.select("key", "url", "payload", F.when(refers, F.col("first_key")).alias("refers_to"), F.when(refers, F.col("first_url")).alias("refers_url"))


def write_bundles(marked: DataFrame, folder: str, date: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes the rows of ``mark_revisits`` and returns the written index: page_id, file, frame, offset, length."""
    rows = marked.select(F.col("key").cast("string"), "url", "payload", F.col("refers_to").cast("string"), "refers_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            places = []
            for page, url, payload, of, of_url in zip(*(c.to_pylist() for c in batch.columns)):
                bundle = bundle or _Bundle(folder, frame_bytes)
                places.append((page, bundle.name, *bundle.add(_record(page, url, payload, of, of_url, date))))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if places:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*places), _INDEX)], [n for n, _ in _INDEX])
        if bundle:
            bundle.close()

    return saved(rows.mapInArrow(run, "page_id string, file string, frame long, offset long, length long"), "warc-index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Reads all records of the indexed bundles: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Pages as text. Payloads of responses are checked against their digest. One task per bundle,
    which holds one frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                reader = BundleReader(folder, name)
                for number in range(len(reader.frames)):
                    data, at, found = reader.frame(number), 0, []
                    while at < len(data):
                        fields, block, at = parse(data, at)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = fields["WARC-Type"]
                        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"{fields['WARC-Record-ID']} in {name} is damaged")
                        of = fields.get("WARC-Refers-To")
                        found.append((_page(fields["WARC-Record-ID"]), size, digest, kind, of and _page(of)))
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                reader.close()

    bundles = saved(index.select("file").distinct(), "warc-bundles")
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    return spread(bundles, bundles.count()).mapInArrow(run, schema)


def warc_archive(df: DataFrame, key: str, url: str, payload: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row into bundles in a new shared folder and reads them back.

    One row per record: ``key``, payload_bytes and payload_digest of the full payload, record_type,
    refers_to. Repeated rows are repeated records. No rows, no bundles. A missing address is the
    record's own name. Other columns are not read.
    """
    kind = df.schema[key].dataType
    folder = new_folder(df.sparkSession, "warc")
    index = write_bundles(mark_revisits(df, key, url, payload, least_bytes), folder, date)
    found = read_bundles(index, folder)
    return found.select(F.col("page_id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
