"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

``write_archives`` writes ``pages`` into archives of bounded size in a folder that all executors reach; each
archive carries a dictionary trained on its own first records. ``read_archives`` streams archives frame by frame,
so a task holds one record at a time, and validates version line, headers, block length, digests and the length
that the HTTP header states. A repeated payload is written once, in the record of the smallest page id; the other
pages get revisit records that refer to it.

Files of lost or repeated task attempts have names of their own. Only files listed by attempts that succeeded are
read, so a lost executor neither loses nor doubles records.

Defined results: a null or empty html is an empty payload; a null url gives a record without target; rows that
repeat the smallest page id of a payload are responses all; rows without an id are responses that nothing refers
to; an empty table gives an empty list of archives. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.session import shared_folder, staged

# Fixed values of the two formats.
VERSION = b"WARC/1.1\r\n"
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "payload binary")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(none|-?[0-9]+)>", urn)
    if not found:
        raise ValueError(f"record id {urn[:80]!r}")
    return None if found[1] == "none" else int(found[1])


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One response, or one revisit if it refers to a page: its block is the HTTP header alone."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}",
             f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"header line {line[:80]!r}")
        key = name.strip().decode().lower()
        if key in out:
            raise ValueError(f"header {key} is repeated")
        out[key] = value.strip().decode()
    return out


def parse(raw: bytes) -> tuple:
    """The fields of ``RECORD`` of one whole record; ValueError says what is wrong with it."""
    if not raw.startswith(VERSION):
        raise ValueError(f"version line {raw[:20]!r}")
    head, gap, rest = raw[len(VERSION):].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("the header doesn't end")
    header = _headers(head.split(b"\r\n"))
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in header:
            raise ValueError(f"header {name} is missing")
    if not re.fullmatch("[0-9]+", header["content-length"]):
        raise ValueError(f"length {header['content-length']!r}")
    size = int(header["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError(f"the block should have {size} bytes, the frame has {len(rest) - 4}")
    if "warc-block-digest" in header and header["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("the block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, *fields = http.split(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError("the block has no HTTP header")
    stated = int(_headers(fields).get("content-length", "-1"))
    kind, refers_to, says = header["warc-type"], None, header["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if stated != len(payload) or says != digest(payload):
            raise ValueError("the payload's length or digest differs")
    elif kind == "revisit":
        if payload or stated < 0 or "warc-refers-to" not in header:
            raise ValueError("a revisit has a payload or refers to nothing")
        refers_to, payload = _page_id(header["warc-refers-to"]), None
    else:
        raise ValueError(f"type {kind!r}")
    return _page_id(header["warc-record-id"]), header.get("warc-target-uri"), kind, refers_to, stated, says, payload


def train(records: list[bytes], size: int) -> bytes:
    """A dictionary from an archive's first records; empty if they are too few or too short for one."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b""


def frames(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The content of each frame of an open archive; skippable frames are passed over."""
    data, reader, first = b"", None, True

    def fill(n: int) -> bool:
        nonlocal data
        while len(data) < n and (more := source.read(chunk)):
            data += more
        return len(data) >= n

    while fill(1):
        if not fill(4):
            raise ValueError("the archive ends inside a frame's magic number")
        magic = int.from_bytes(data[:4], "little")
        if magic in SKIPPABLE_MAGIC:
            if not fill(8) or not fill(8 + int.from_bytes(data[4:8], "little")):
                raise ValueError("the archive ends inside a skippable frame")
            end = 8 + int.from_bytes(data[4:8], "little")
            if first and magic == DICTIONARY_MAGIC:
                content = data[8:end]
                if int.from_bytes(content[:4], "little") == FRAME_MAGIC:
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            data, first = data[end:], False
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"magic number {magic:#x}")
        first, frame, out = False, (reader or zstandard.ZstdDecompressor()).decompressobj(), []
        while not frame.eof:
            if not data and not fill(1):
                raise ValueError("the archive ends inside a frame")
            out.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def write_archives(pages: DataFrame, folder: str, max_bytes: int = 64 << 20, dictionary_bytes: int = 16 << 10,
                   train_bytes: int = 2 << 20, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write rows (page_id, url, html, refers_to) and return the archives: path, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = fs.FileSystem.from_uri(folder)
        disk.create_dir(root, recursive=True)

        def archive(first: list[bytes], rest: Iterator[bytes]) -> tuple[str, int, int]:
            name = f"{root}/{uuid.uuid4().hex}.warc.zst"
            trained = train(first, dictionary_bytes)
            options = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
            packer, n, size = zstandard.ZstdCompressor(level=level, **options), 0, 0
            with disk.open_output_stream(name, compression=None) as out:
                if trained:
                    out.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(trained).to_bytes(4, "little") + trained)
                for part in (first, rest):
                    for raw in part:
                        out.write(packer.compress(raw))
                        n, size = n + 1, size + len(raw)
                        if size >= max_bytes:
                            return name, n, size
            return name, n, size

        records = (record(page_id, url, (html or "").encode(), refers_to, date) for batch in batches
                   for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        done = []
        while True:
            first, size = [], 0
            for raw in records:
                first.append(raw)
                size += len(raw)
                if size >= min(train_bytes, max_bytes):
                    break
            if not first:
                break
            done.append(archive(first, records))
        columns = list(zip(*done, strict=True)) if done else [[], [], []]
        types = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)],
                                         ["path", "records", "bytes"])

    listed = pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long")
    return staged(listed)


def read_archives(archives: DataFrame, folder: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """The records of the listed archives, columns ``RECORD`` and ``problem``.

    ``strict`` raises at the first broken record; otherwise it becomes a row with the reason in ``problem``,
    and an archive that breaks off gives one such row for its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORD.split(", ")] + ["problem"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

        def rows(path: str) -> Iterator[tuple]:
            with disk.open_input_stream(path, compression=None) as source:
                content = frames(source)
                while True:
                    try:
                        raw = next(content, None)
                    except (ValueError, zstandard.ZstdError) as e:
                        if strict:
                            raise ValueError(f"{path}: {e}") from e
                        yield *[None] * 7, str(e)
                        return
                    if raw is None:
                        return
                    try:
                        found = parse(raw)
                    except ValueError as e:
                        if strict:
                            raise ValueError(f"{path}: {e}") from e
                        yield *[None] * 7, str(e)
                        continue
                    yield *(found if payloads else (*found[:6], None)), None

        out, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    out.append(row)
                    size += 200 + len(row[6] or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names)

    # One archive per task: a list file of many lines is small, so it has to be dealt out.
    n = max(1, archives.count())
    dealt = archives.select("path").repartition(min(n, 100_000), "path")
    return dealt.mapInArrow(run, f"{RECORD}, problem string")


def mark_repeats(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows (page_id, url, html, refers_to): refers_to is the smallest page id with the same payload, if another."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("key"), F.octet_length(payload).alias("size"))
    first = staged(
        rows.groupBy("key", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & (F.col("size") >= min_bytes)).select("key", "first"))
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    return rows.join(first, "key", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def round_trip(pages: DataFrame, min_bytes: int = 0, **options) -> DataFrame:
    """Write archives of ``pages`` in the shared folder and read them back."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(mark_repeats(pages, min_bytes), folder, **options), folder, payloads=False)
