"""WARC archives: writing, and normalising of monolithic gzip files.

``write`` puts pages into archives that are one gzip stream each.  ``normalise`` inflates such a stream once from start
to end, writes every record as a gzip member of its own and a sidecar index of offsets beside the new archive.
``read`` opens archives by their index, one member at a time.

Of pages with equal payloads (SHA-1 and length) that with the largest page_id is a response, the others are revisits
of it.  A null html is an empty payload; a null page_id is always a response and refers nowhere; rows that repeat the
largest page_id with its payload are all responses; a null url becomes a urn; line ends in urls are escaped; extra
columns are ignored; an empty table writes no archives.  Every attempt of a task writes files of its own name in the
shared folder, and only files that a finished task has reported are read, so lost executors leave nothing half-written in
the result.  Archives are closed at ``ARCHIVE_BYTES``; tasks hold one record and one buffer in memory.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import stored
from trailmark.sources.workdir import new_folder

#: Bytes of records after which an archive is closed; bytes read or inflated at once.
ARCHIVE_BYTES, STEP = 256_000_000, 1 << 20
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, at bigint, length bigint"
_GZIP = 31


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit if ``refers_to`` is given."""
    target = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{target}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is None:
        head.append("X-No-Url: 1")
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Named fields of a record's head, by lower-case name."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and payload of a whole record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    found = fields(head)
    block = rest[: int(found["content-length"])]
    return found, block.partition(b"\r\n\r\n")[2]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Archive:
    """A file of one gzip stream, open for writing."""

    def __init__(self, folder: str):
        self.path, self.size, self.n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
        system, place = _place(self.path)
        self.out, self.gzip = system.open_output_stream(place, compression=None), zlib.compressobj(1, zlib.DEFLATED, _GZIP)

    def add(self, raw: bytes) -> None:
        self.out.write(self.gzip.compress(raw))
        self.size, self.n = self.size + len(raw), self.n + 1

    def close(self) -> pd.DataFrame:
        self.out.write(self.gzip.flush())
        self.out.close()
        return pd.DataFrame({"archive": [self.path], "n": [self.n]})


def revisits(rows: DataFrame) -> DataFrame:
    """(page_id, sha, size, refers_to) of pages whose payload a page with a larger id has too.

    Ids and digests alone meet by payload, in stored tables of which Spark splits what belongs to a frequent payload; the
    payloads themselves are dealt by page.
    """
    names = stored(rows.where("page_id is not null").select("page_id", "sha", "size").distinct(), "payloads")
    met = names.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("refers_to"))
    again = stored(met.where("first < refers_to").drop("first"), "repeated-payloads")
    return names.join(again, ["sha", "size"]).where("page_id < refers_to").select("page_id", "sha", "size", "refers_to")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """(archive, n): the pages written as archives of one gzip stream each, a stored table."""
    system, place = _place(folder)
    system.create_dir(place, recursive=True)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    rows = rows.join(revisits(rows), ["page_id", "sha", "size"], "left").select("page_id", "url", "html", "refers_to")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = None
        for frame in frames:
            for i, url, html, to in zip(*(frame[c].array for c in ("page_id", "url", "html", "refers_to")), strict=True):
                archive = archive or _Archive(folder)
                archive.add(record(None if pd.isna(i) else int(i), url, html.encode(), None if pd.isna(to) else int(to)))
                if archive.size >= ARCHIVE_BYTES:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    # ids as text, so that large ones stay exact beside nulls
    texts = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return stored(texts.mapInPandas(put, "archive string, n bigint"), "archives")


def inflated(archive: str) -> Iterator[bytes]:
    """The archive's gzip stream (or streams) inflated in steps of bounded size."""
    system, place = _place(archive)
    with system.open_input_stream(place, compression=None) as source:
        gzip = zlib.decompressobj(_GZIP)
        while data := source.read(STEP):
            while data:
                yield gzip.decompress(data, STEP)
                data = gzip.unconsumed_tail
                if gzip.eof:
                    data, gzip = gzip.unused_data, zlib.decompressobj(_GZIP)
        yield gzip.flush()


def records_of(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of inflated bytes."""
    held, need = bytearray(), 0
    for piece in stream:
        held += piece
        while len(held) >= need:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                need = len(held) + 1
                break
            need = end + 8 + int(fields(bytes(held[:end]))["content-length"])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("an archive ends inside a record")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, index, n): every archive rewritten with a member for each record and a sidecar index, a stored table."""
    system, place = _place(folder)
    system.create_dir(place, recursive=True)

    def rewritten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame.archive:
                path, at, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                system, place = _place(path)
                with system.open_output_stream(place, compression=None) as out, system.open_output_stream(f"{place}.index", compression=None) as index:
                    for raw in records_of(inflated(archive)):
                        gzip = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
                        member = gzip.compress(raw) + gzip.flush()
                        found = fields(raw[: raw.find(b"\r\n\r\n")])
                        line = {"at": at, "length": len(member), "id": found["warc-record-id"], "type": found["warc-type"]}
                        out.write(member)
                        index.write(json.dumps(line).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pd.DataFrame({"archive": [path], "index": [f"{path}.index"], "n": [n]})

    count = max(1, archives.count())
    return stored(archives.select("archive").repartition(count).mapInPandas(rewritten, "archive string, index string, n bigint"), "members")


def read(members: DataFrame) -> DataFrame:
    """Rows of all records, each opened at its offset.  Size and digest of a response come from its payload."""

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, index in zip(frame.archive, frame["index"], strict=True):
                system, place = _place(archive)
                lines = system.open_input_stream(_place(index)[1], compression=None).read().splitlines()
                with system.open_input_file(place) as source:
                    for a in range(0, len(lines), 2000):
                        yield _rows(source, archive, lines[a : a + 2000])

    count = max(1, members.count())
    rows = members.select("archive", "index").repartition(count).mapInPandas(opened, RECORDS.replace("page_id bigint", "page_id string").replace("refers_to bigint", "refers_to string"))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("page_id", "refers_to")})


def _rows(source, archive: str, lines: list[bytes]) -> pd.DataFrame:
    out = []
    for line in lines:
        entry = json.loads(line)
        source.seek(entry["at"])
        found, payload = parsed(zlib.decompress(source.read(entry["length"]), _GZIP))
        whole = found["warc-type"] == "response"
        digest = base32_sha1(payload) if whole else found["warc-payload-digest"].removeprefix("sha1:")
        size = len(payload) if whole else int(found["x-payload-length"])
        url = None if "x-no-url" in found else found["warc-target-uri"]
        out.append((found.get("x-page-id"), url, size, digest, found["warc-type"], found.get("x-refers-to-page-id"), archive, entry["at"], entry["length"]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in RECORDS.split(", ")])


def round_trip(pages: DataFrame) -> DataFrame:
    """The pages written, normalised and read back."""
    base = new_folder(pages.sparkSession, "warc")
    return read(normalise(write(pages, f"{base}/streams"), f"{base}/members"))
