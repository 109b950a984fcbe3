"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

``write_archives`` turns rows into WARC 1.1 records. Equal payloads are written once: the
row with the smallest id is a ``response``, the others are ``revisit`` records of it that
hold only the HTTP headers of the response. A file starts with a skippable frame (magic
0x184D2A5D) that holds the Zstandard dictionary, trained on the first pages that a task has for the file,
itself compressed; each record is one frame, so any record can be read from its offset. A
file is closed at ``FILE_BYTES`` and a new one begun.

``read_archives`` reads files as rows. It loads the dictionary, decodes one frame at a
time in small pieces, and checks for each record the version line, the required headers,
the block length, the HTTP length and the digests. A fault raises, or is told in the column
``problem`` with ``strict=False``.

Only ids and digests are grouped to find equal payloads; the pages meet that result in a
join which Spark may split where one payload is frequent. A repeated task writes files of
a new name, and only files named in the stored list of a finished task are read.

Defined cases: a null page is an empty payload; empty payloads are equal to each other and
so revisit the first (``least`` sets the smallest payload that is matched); a null URL
gives ``urn:page:<id>``, and a page without id is written with ``WARC-Record-ID``
``urn:page:none`` and is never referred to; repeated ids are separate records, of equal
pages with the smallest id each one is a response; an empty table gives no file and an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from docweft.llm import files
from docweft.session import new_path, stored

VERSION = b"WARC/1.1"
SKIPPABLE = 0x184D2A5D
#: Bytes after which a file is closed, of the dictionary, of the pages it is trained on, and of a piece read.
FILE_BYTES, DICT_BYTES, SAMPLE_BYTES, PIECE = 256 << 20, 64 << 10, 4 << 20, 1 << 16
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length")
WRITTEN = "path string, records long, bytes long"
READ = (
    "path string, frame_offset long, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary, problem string"
)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id) -> str:
    return "urn:page:none" if page_id is None or pd.isna(page_id) else f"urn:page:{int(page_id)}"


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page_id, url, html, first) -> bytes:
    """The bytes of one record; ``first`` is the id of the response that it revisits, or null."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    urn = page_urn(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = first is not None and not pd.isna(first)
    block = http if again else http + payload
    head = [
        VERSION.decode(), f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <{urn}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url) if url and clean(url) else urn}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if again:
        head += [f"WARC-Refers-To: <{page_urn(first)}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the samples; none where there are too few for one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        return None


def opening(dictionary: zstandard.ZstdCompressionDict | None) -> bytes:
    if dictionary is None:
        return b""
    body = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
    return SKIPPABLE.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


class Archive:
    """One file being written."""

    def __init__(self, path: str, samples: list[bytes]):
        dictionary = trained(samples)
        self.path, self.records = path, 0
        system, inner = files.opened(path)
        self.out = system.open_output_stream(inner, compression=None)  # else Arrow packs the file by its name
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        start = opening(dictionary)
        self.out.write(start)
        self.bytes = len(start)

    def add(self, data: bytes) -> None:
        frame = self.packer.compress(data)
        self.out.write(frame)
        self.bytes += len(frame)
        self.records += 1

    def close(self) -> pd.DataFrame:
        self.out.close()
        return pd.DataFrame({"path": [self.path], "records": [self.records], "bytes": [self.bytes]})


def writer(folder: str, file_bytes: int):
    #: A small file trains its dictionary on no more than it may hold.
    sample = min(SAMPLE_BYTES, file_bytes)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files.make_folder(folder)
        archive, waiting, held, number = None, [], 0, 0
        name = files.attempt_name("part")

        def begin() -> Iterator[pd.DataFrame]:
            """Opens a file with the records that were held back; files that these fill are closed."""
            nonlocal archive, number
            samples = list(waiting)
            for x in waiting:
                if archive is None:
                    number += 1
                    archive = Archive(files.under(folder, f"{name}-{number:04d}.warc.zst"), samples)
                archive.add(x)
                if archive.bytes >= file_bytes:
                    yield archive.close()
                    archive = None
            waiting.clear()

        for batch in batches:
            for row in batch.itertuples(index=False):
                data = record(row.page_id, row.url, row.html, row.first)
                if archive is None:  # the first pages are held back to train the dictionary
                    waiting.append(data)
                    held += len(data)
                    if held < sample:
                        continue
                    held = 0
                    yield from begin()
                    continue
                archive.add(data)
                if archive.bytes >= file_bytes:
                    yield archive.close()
                    archive = None
        yield from begin()
        if archive is not None:
            yield archive.close()

    return write


def write_archives(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None,
    least: int = 0, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes the pages and returns the stored list of files: ``path, records, bytes``."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.withColumn("sha", F.unhex(F.sha1(body))).withColumn("size", F.octet_length(body))
    copies = (
        rows.filter((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("sha")
        .agg(F.min("page_id").alias("smallest"), F.count("*").alias("n")).filter("n > 1").select("sha", "smallest")
    )
    linked = rows.join(copies, "sha", "left").select(
        "page_id", "url", "html", F.when(F.col("smallest") != F.col("page_id"), F.col("smallest")).alias("first")
    )
    return stored(linked.mapInPandas(writer(folder, file_bytes), WRITTEN), "warc-list")


def frames(path: str) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each frame, read piece by piece."""
    system, inner = files.opened(path)
    with system.open_input_stream(inner, compression=None) as source:
        data, at = source.read(8), 0
        dictionary = None
        if len(data) == 8 and int.from_bytes(data[:4], "little") == SKIPPABLE:
            size = int.from_bytes(data[4:], "little")
            body = source.read(size)
            if len(body) != size:
                raise ValueError(f"{path}: the dictionary is cut off")
            if body[:4] == (0xFD2FB528).to_bytes(4, "little"):
                body = zstandard.ZstdDecompressor().decompress(body)
            dictionary, data, at = zstandard.ZstdCompressionDict(body), b"", 8 + size
        unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
        while True:
            data = data or source.read(PIECE)
            if not data:
                return
            one, out, used = unpacker.decompressobj(), [], 0
            while True:
                out.append(one.decompress(data))
                used += len(data)
                if one.eof:
                    data = one.unused_data
                    used -= len(data)
                    break
                data = source.read(PIECE)
                if not data:
                    raise ValueError(f"{path}: the frame at {at} is cut off")
            yield at, b"".join(out)
            at += used


def headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "surrogatepass").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"no header: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parsed(data: bytes) -> dict:
    """The record in one frame; raises ValueError where it breaks the format."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version != VERSION:
        raise ValueError("no WARC/1.1 record")
    named = headers(lines)
    if missing := [x for x in REQUIRED if x.lower() not in named]:
        raise ValueError(f"missing {', '.join(missing)}")
    length = named["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length is not that of the block")
    block = rest[:-4]
    if (said := named.get("warc-block-digest")) and said != f"sha1:{digest(block)}":
        raise ValueError("wrong block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    inner = headers(http.partition(b"\r\n")[2])
    size = inner.get("content-length", "")
    kind = named["warc-type"]
    if not gap or not size.isdigit():
        raise ValueError("no HTTP length")
    if kind == "response":
        if int(size) != len(payload):
            raise ValueError("HTTP length is not that of the payload")
        if named.get("warc-payload-digest") != f"sha1:{digest(payload)}":
            raise ValueError("wrong payload digest")
    elif kind != "revisit" or "warc-refers-to" not in named or payload:
        raise ValueError(f"unexpected {kind} record")
    return {
        "record_type": kind, "record_id": named["warc-record-id"].strip("<>"), "target_uri": named.get("warc-target-uri"),
        "refers_to": named["warc-refers-to"].strip("<>") if kind == "revisit" else None,
        "payload_digest": named["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": int(size),
        "payload": payload if kind == "response" else None,
    }


def reader(strict: bool, content: bool):
    columns = [x.split()[0] for x in READ.split(", ")]

    def table(rows: list[dict]) -> pd.DataFrame:
        # a broken record has no more than its place and problem: its other columns are null, whatever their type
        whole = {c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns}
        return pd.DataFrame(whole).astype({"frame_offset": "i8", "payload_bytes": "Int64"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows, held = [], 0
                for at, data in frames(path):
                    try:
                        row = parsed(data) | {"problem": None}
                    except ValueError as error:
                        if strict:
                            raise ValueError(f"{path}, frame at {at}: {error}") from error
                        row = {"problem": str(error)}
                    if not content:
                        row["payload"] = None
                    rows.append({"path": path, "frame_offset": at} | row)
                    held += len(row.get("payload") or b"") + 500
                    if held >= 8 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    return read


def read_archives(listed: DataFrame, strict: bool = True, content: bool = True) -> DataFrame:
    """The records of the files in column ``path``; a file is the unit of a task. ``content=False`` leaves payloads out."""
    count = max(1, listed.count())
    return listed.select("path").repartition(count, "path").mapInPandas(reader(strict, content), READ)
