"""Zstandard web archives: one frame for each record, the dictionary in the leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, kept_whole, small_batches

#: Magic number of the skippable frame that holds the dictionary, and of ordinary frames (fixed values of the formats).
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed at this many compressed bytes; the dictionary is learned from at most DICT_PAGES pages of at most DICT_PAGE_BYTES.
ROLL_BYTES, DICT_PAGES, DICT_PAGE_BYTES, DICT_BYTES = 16 << 20, 400, 64 << 10, 64 << 10
#: Revisits above which their lookup shuffles instead of broadcasting (about 60 bytes each).
BROADCAST_REVISITS = 500_000
CHUNK = 1 << 14
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


class ArchiveError(ValueError):
    """A malformed archive: says where and what."""


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    if not (urn.startswith("<urn:x-page:") and urn.endswith(">")):
        raise ArchiveError(f"record id {urn!r}")
    return int(urn[12:-1]) if urn[12:-1] else None


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record: headers, block (HTTP headers, and the payload unless it revisits another's) and end mark."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes], where: str) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"{where}: header line {line!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _length(headers: dict[str, str], where: str) -> int:
    n = headers.get("content-length", "")
    if not n.isdigit():
        raise ArchiveError(f"{where}: Content-Length {n!r}")
    return int(n)


def parse(data: bytes, where: str) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of one record, all of it checked."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or not lines[0].startswith(b"WARC/1."):
        raise ArchiveError(f"{where}: no WARC header")
    h = _headers(lines[1:], where)
    kind, n = h.get("warc-type"), _length(h, where)
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"{where}: block of {len(rest) - 4} bytes, Content-Length {n}")
    http, blank, payload = rest[:n].partition(b"\r\n\r\n")
    lines = http.split(b"\r\n")
    if not blank or not lines[0].startswith(b"HTTP/"):
        raise ArchiveError(f"{where}: no HTTP header")
    size = _length(_headers(lines[1:], where), where)
    digest = h.get("warc-payload-digest", "")
    if not digest.startswith("sha1:") or "warc-record-id" not in h:
        raise ArchiveError(f"{where}: a required header is missing")
    if kind == "response":
        if len(payload) != size or digest32(payload) != digest[5:]:
            raise ArchiveError(f"{where}: the payload does not fit its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in h:
        raise ArchiveError(f"{where}: record type {kind!r}")
    refers = _page_of(h["warc-refers-to"]) if kind == "revisit" else None
    return _page_of(h["warc-record-id"]), h.get("warc-target-uri"), size, digest[5:], kind, refers


def frames(data, where: str):
    """(offset, content) of every frame of an archive; the leading skippable frame's dictionary serves all."""
    view, at, dictionary = memoryview(data), 0, None
    if len(view) >= 8 and struct.unpack("<I", view[:4])[0] == DICT_MAGIC:
        n = struct.unpack("<I", view[4:8])[0]
        raw = bytes(view[8 : 8 + n])
        if len(raw) != n:
            raise ArchiveError(f"{where}: the dictionary is cut off")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + n
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        if bytes(view[at : at + 4]) != struct.pack("<I", FRAME_MAGIC):
            raise ArchiveError(f"{where}: no frame at byte {at}")
        start, one, parts = at, unpack.decompressobj(), []
        try:
            while not one.eof:
                if at >= len(view):
                    raise ArchiveError(f"{where}: the frame at byte {start} is cut off")
                parts.append(one.decompress(view[at : at + CHUNK]))
                at = min(at + CHUNK, len(view))
        except zstandard.ZstdError as e:
            raise ArchiveError(f"{where}: the frame at byte {start}: {e}") from e
        at -= len(one.unused_data)
        yield start, b"".join(parts)


def learn_dictionary(pages: DataFrame) -> bytes | None:
    """A dictionary from whole pages: about DICT_PAGES of them by a hash of page_id, each of at most DICT_PAGE_BYTES; None from too few.

    Only pages drawn by their hash are read whole and sent to the driver, so it receives at most some 2 *
    DICT_PAGES * DICT_PAGE_BYTES = 26 MB, however many pages there are. The dictionary shortens archives, no record depends on it.
    """
    fit = pages.select("page_id", "html").filter(F.octet_length("html").between(1, DICT_PAGE_BYTES))
    share = DICT_PAGES / 2 / max(1, fit.count())
    dice = F.pmod(F.xxhash64("page_id", F.lit(7)), F.lit(1 << 40)) / (1 << 40)
    rows = fit.filter(dice < share).limit(DICT_PAGES) if share < 1 else fit.limit(DICT_PAGES)
    texts = sorted(r["html"].encode() for r in rows.collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes() if len(texts) >= 8 else None
    except zstandard.ZstdError:
        return None


def _write(folder: str, dictionary: bytes | None):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        part, k, parts, size, n, done = TaskContext.get().partitionId(), 0, [], 0, 0, []

        def close():
            nonlocal k, parts, size, n
            name, temp = f"{root}/part-{part:06d}-{k:04d}.warc.zst", f"{root}/_{uuid.uuid4().hex}"
            head = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""
            with fs.open_output_stream(temp) as f:
                f.write(head)
                for p in parts:
                    f.write(p)
            fs.move(temp, name)  # whole or not at all; a task run again writes the same bytes
            done.append((name, n, size + len(head)))
            k, parts, size, n = k + 1, [], 0, 0

        for b in small_batches(batches):
            for page_id, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                parts.append(packer.compress(record(page_id, url, (html or "").encode(), refers_to, revisit)))
                size, n = size + len(parts[-1]), n + 1
                if size >= ROLL_BYTES:
                    close()
        if parts:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, least: int = 0) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id bigint, url string, html string); the table of archives.

    Of rows with equal payloads of at least ``least`` bytes the smallest page_id is a response and the others
    revisit it. Null html is empty, a null url has no header, a null page_id comes after all others. ``folder``: a URI that the executors share (file, hdfs, s3, gs).
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    key = F.struct(F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("bytes"))
    light = pages.select("page_id", key.alias("k")).filter(F.col("k.bytes") >= least)
    # partial minima: a payload that fills a third of the table leaves each task as one row
    firsts = light.groupBy("k").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("k").alias("fk"), "first")
    again = light.join(firsts, F.col("k") == F.col("fk")).filter(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("r_id"), F.col("k").alias("rk"), F.col("first").alias("refers_to")).distinct()
    again = scratch.write(again, "revisits")
    few = again.count() <= BROADCAST_REVISITS
    # joined by page, not by payload: no page is hot
    on = F.col("page_id").eqNullSafe(F.col("r_id")) & (key == F.col("rk"))
    rows = pages.select("page_id", "url", "html").join(F.broadcast(again) if few else again, on, "left")
    rows = rows.select("page_id", "url", "html", F.col("rk").isNotNull().alias("revisit"), "refers_to")
    if not few:  # after a shuffle the order of rows is not fixed: a task run again is to write the same archives
        rows = rows.sortWithinPartitions("page_id", "url", F.xxhash64("html"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return scratch.write(rows.mapInArrow(_write(folder, learn_dictionary(pages)), "archive string, records bigint, bytes bigint"), "manifest")


def _read(batches):
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            rows = []
            for at, data in frames(content.as_buffer(), path):
                rows.append(parse(data, f"{path} at byte {at}"))
                if len(rows) >= 5000:
                    yield _table(rows)
                    rows = []
            if rows:
                yield _table(rows)


def _table(rows) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the ``*.warc.zst`` files of ``folder``; a malformed one raises ArchiveError with its place."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(_read, RECORDS)


def _read_listed(batches):
    for b in batches:
        for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fs, name = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as f:
                data, found = f.read_buffer(), 0
            rows = []
            for at, content in frames(data, path):
                rows.append(parse(content, f"{path} at byte {at}"))
                if len(rows) >= 5000:
                    yield _table(rows)
                    found, rows = found + len(rows), []
            if rows:
                yield _table(rows)
            if found + len(rows) != records:
                raise ArchiveError(f"{path}: {found + len(rows)} records, {records} were written")


def read_listed(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives that :func:`write_archives` lists, whatever else lies in ``folder``; counts are checked."""
    n = max(1, manifest.count())  # a row an archive of some 16 MB
    names = manifest.select(F.concat(F.lit(folder + "/"), F.substring_index("archive", "/", -1)), "records")
    return names.repartition(min(n, 20_000)).mapInArrow(_read_listed, RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives of all ``pages``.

    payload: the html in UTF-8, null counts as empty. Length and digest (bare upper-case base32 SHA-1) are
    those of the full payload, of revisits too. Every row gets a record; rows that repeat a page_id with
    equal html are responses both if that id is the smallest. A null page_id is larger than any other. Extra
    columns are not read. An empty table gives an empty table.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = write_archives(pages, scratch.path("archives"), scratch, least)
    written = manifest.agg(F.sum("records")).first()[0] or 0
    if written:
        out = kept_whole(read_listed(manifest, scratch.path("archives")).drop("url"))
    else:
        out = pages.sparkSession.createDataFrame([], RECORDS).drop("url")
    scratch.drop()
    return out
