"""WARC archives: a writer, a normaliser of monolithic gzip files, and an index reader.

``write`` makes files whose records share one gzip stream, as some crawlers leave
them.  Such a file can only be read from its start.  ``normalise`` inflates each
file once, as a stream, and writes every record as a gzip member of its own beside
a sidecar index (a JSON line for each record: offset, length, type, ids, digest).
``read`` fetches records by those offsets.

Files go to a shared folder through Arrow's file systems.  A file gets its final
name when it is whole, and that name depends on the partition only, so a task that
runs again after a lost executor replaces its own files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import cut, decoded, picked

#: Bytes of records after which a written file is closed.
FILE_BYTES = 64 << 20
#: Groups of equal payloads of which a table is sent to all executors; with more, rows are shuffled to them.
BROADCAST_GROUPS = 200_000
#: Files that a task of the normaliser has at most.
FILES_PER_TASK = 16
#: Bytes of payloads that ``read`` gives back at once, about.
READ_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"


def record_id(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{coded(page)}/{digest}')}>"


def coded(page: str | None) -> str | None:
    """An id as it stands in a header: percent-encoded, so that blanks and line ends in it come back; ``%`` alone for an empty one."""
    return None if page is None else quote(page, safe="") or "%"


def plain(page: str | None) -> str | None:
    return None if page is None else "" if page == "%" else unquote(page)


def record(page: str | None, url: str | None, payload: bytes, kind: str, refers_to: str | None) -> bytes:
    """A response with the payload, or a revisit with its HTTP header only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(page, digest), "WARC-Date": DATE, "WARC-Target-URI": target or None,
        "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Page-ID": coded(page), "WARC-Payload-Length": len(payload),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None,
        "WARC-Refers-To": record_id(refers_to, digest) if kind == "revisit" else None, "WARC-Refers-To-Page-ID": coded(refers_to),
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class Inflated:
    """A gzip file of one member or many, as a stream of bytes."""

    def __init__(self, source, step: int = 1 << 20):
        self.source, self.step, self.buffer, self.engine, self.rest, self.inside = source, step, bytearray(), zlib.decompressobj(31), b"", False

    def more(self) -> bool:
        data = self.rest or self.source.read(self.step)
        self.rest = b""
        if not data:
            if self.inside:
                raise EOFError("a gzip member is cut short")
            return False
        if self.engine.eof:
            self.engine = zlib.decompressobj(31)
        self.buffer += self.engine.decompress(data, 8 * self.step)
        self.inside = not self.engine.eof
        self.rest = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with ``mark``; None at the end."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more():
                if self.buffer.strip():
                    raise EOFError("a record is cut short")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise EOFError("a record is cut short")
        data = bytes(self.buffer[:n])
        del self.buffer[:n]
        return data


def records(stream: Inflated) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, whole record as bytes), one at a time."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:] if line)}
        yield fields, head + stream.take(int(fields["content-length"]) + 4)


def payload_of(whole: bytes) -> bytes:
    block = whole[whole.index(b"\r\n\r\n") + 4 : -4]
    return block[block.index(b"\r\n\r\n") + 4 :]


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


class Kept:
    """A file that gets its name when it is whole."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.store, self.path, self.draft = store, path, f"{path}.{uuid.uuid4().hex}.draft"
        self.out, self.size = store.open_output_stream(self.draft, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.draft, self.path)

    def drop(self) -> None:
        """Remove what a failed task has written."""
        self.out.close()
        if self.store.get_file_info(self.draft).type == fs.FileType.File:
            self.store.delete_file(self.draft)


def roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(page, url, payload, kind, refers_to) as the archive will have them.

    Of equal payloads of ``least`` bytes or more, the rows with the largest id are responses
    and the others revisit it; null ids are smaller than any.  Only groups of two rows or
    more are looked up; payloads are not shuffled unless there are very many such groups.
    """
    rows = picked(pages, page=id_col, url=url_col, html=html_col)
    rows = rows.select("page", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = cut(rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    known = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    earlier = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    return rows.join(known, "digest", "left").select(F.col("page").cast("string").alias("page"), "url", "payload", F.when(earlier, "revisit").otherwise("response").alias("kind"), F.when(earlier, F.col("first").cast("string")).alias("refers_to"))


def write(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of ``rows`` (see ``roles``), one gzip stream each; (path, records), computed once.  An empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = at(folder)
        part, made, out, count, size = TaskContext.get().partitionId(), [], None, 0, 0

        def close() -> None:
            out.write(engine.flush())
            out.close()
            made.append((out.path, count))

        try:
            for batch in batches:
                plain_ = [c.cast(pa.binary()) for c in batch.columns]
                for k in range(batch.num_rows):  # one at a time, as payloads may be long
                    if out is None:
                        out, engine, count, size = Kept(store, f"{base}/pages-{part:06d}-{len(made):04d}.warc.gz"), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                    page, url, payload, kind, refers_to = (None if x is None else x if c == 2 else decoded(x) for c, x in enumerate(c[k].as_py() for c in plain_))
                    data = record(page, url, payload, kind, refers_to)
                    out.write(engine.compress(data))
                    count, size = count + 1, size + len(data)
                    if size >= file_bytes:
                        close()
                        out = None
            if out is not None:
                close()
                out = None
        finally:
            if out is not None:
                out.drop()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "records"])

    at(folder)[0].create_dir(at(folder)[1], recursive=True)
    return cut(rows.mapInArrow(run, "path string, records long"))


def normalise(files: DataFrame, folder: str, remove: bool = False) -> DataFrame:
    """Each file of ``files`` (path) with a member for each record and a sidecar index in ``folder``; (path, records), computed once.

    ``remove``: the files go once their copies are whole.
    """

    def one(path: str) -> tuple[str, int]:
        store, source = at(path)
        target, base = at(folder)
        name = f"{base}/{source.rpartition('/')[2].removesuffix('.gz').removesuffix('.warc')}"
        out, index, n = Kept(target, f"{name}.warc.gz"), Kept(target, f"{name}.index.json"), 0
        whole_ = False
        try:
            with store.open_input_stream(source, compression=None) as stream:
                for fields, whole in records(Inflated(stream)):
                    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = engine.compress(whole) + engine.flush()
                    line = {"file": out.path, "offset": out.size, "length": len(member), "type": fields["warc-type"], "record_id": fields["warc-record-id"], "digest": fields.get("warc-payload-digest"), "uri": fields.get("warc-target-uri")}
                    index.write(json.dumps(line).encode() + b"\n")
                    out.write(member)
                    n += 1
            whole_ = True
        finally:
            for file in (out, index):
                file.close() if whole_ else file.drop()
        return out.path, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(p) for p in batch.column(0).to_pylist()]  # paths only; a file is read as a stream
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    at(folder)[0].create_dir(at(folder)[1], recursive=True)
    paths = files.select("path")
    n = files.count()
    tasks = max(1, min(n, 4 * files.sparkSession.sparkContext.defaultParallelism), -(-n // FILES_PER_TASK))
    done = cut(paths.repartition(tasks).mapInArrow(run, "path string, records long"))
    if remove:
        gone(paths)
    return done


def gone(paths: DataFrame) -> None:
    """Delete the files that ``paths`` names, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, file = at(path)
                if store.get_file_info(file).type == fs.FileType.File:
                    store.delete_file(file)
            yield batch

    paths.mapInArrow(run, "path string").count()


INDEX = "file string, offset long, length long, type string, record_id string, digest string, uri string"


FIELDS = "page string, type string, digest string, payload_length long, refers_to string, uri string"


def read(spark: SparkSession, folder: str, per_task: int = 2000, payloads: bool = True) -> DataFrame:
    """The records that the indexes in ``folder`` list: (page, type, digest, payload_length, refers_to, uri) and, unless told otherwise, payload.

    Records are dealt out by file and stretch of it, then fetched by offset, one at a time.
    A response's digest and length are those of what was read; a revisit has those of its
    header, and no payload.
    """
    names = [*(f.split()[0] for f in FIELDS.split(", ")), "payload"]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        wide = len(names) if payloads else len(names) - 1
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(wide)], names[:wide])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, rows, held = None, None, [], 0
        for batch in batches:
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if file != name:
                    name, source = file, at(file)[0].open_input_file(at(file)[1])
                whole = zlib.decompress(source.read_at(length, offset), 31)
                head = whole[: whole.index(b"\r\n\r\n")].decode().split("\r\n")[1:]
                fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head)}
                payload = payload_of(whole) if fields["warc-type"] == "response" else None
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-payload-digest"] != f"sha1:{digest}":
                    raise ValueError(f"a payload in {file} does not have the digest of its record")
                size = len(payload) if payload is not None else int(fields["warc-payload-length"])
                rows.append((plain(fields.get("warc-page-id")), fields["warc-type"], digest, size, plain(fields.get("warc-refers-to-page-id")), fields.get("warc-target-uri"), payload if payloads else None))
                held += size if payloads and payload is not None else 0
                if held >= READ_BYTES or len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows, held = [], 0
        yield batch_of(rows)

    index = spark.read.schema(INDEX).json(f"{folder}/*.index.json").select("file", "offset", "length")
    # An explicit number: the index is small, but what its rows stand for is not, so tasks must not be merged by its bytes.
    dealt = index.repartition(max(1, -(-index.count() // per_task)), "file", F.floor(F.col("offset") / (per_task * 4096))).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, FIELDS + ", payload binary" * payloads)


def round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Archive ``pages`` as monolithic files, normalise these and read the result by its index.

    (id, payload_bytes, payload_digest, record_type, refers_to), one row for each row of
    ``pages``.  A null payload is empty; payloads are kept whole, byte for byte.  Equal
    payloads: see ``roles``; rows that tie for the largest id are all responses.  Ids of any
    type that has a string form come back as they were.  An empty table gives no rows.
    Other columns don't matter; of columns with equal names the first is meant.  The archives
    stay in ``folder``.
    """
    kind = pages.schema.fields[pages.columns.index(id_col)].dataType.simpleString()
    files = write(roles(pages, id_col, url_col, html_col, least), f"{folder}/raw")
    normalise(files, f"{folder}/warc", remove=True)
    if not files.take(1):
        back = pages.sparkSession.createDataFrame([], FIELDS)
    else:
        back = read(pages.sparkSession, f"{folder}/warc", payloads=False)
    return back.select(F.col("page").cast(kind).alias(id_col), F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
