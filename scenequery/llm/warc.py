"""WARC archives: writing, and a chunked record table read back from them.

Writer: each task streams its pages into one .warc.gz (a gzip member per
record), CHUNK bytes of a payload at a time out of the Arrow batch that holds it.  Reader: each task streams an archive and emits rows (record_id,
chunk_no, chunk_offset, chunk_bytes, payload_sha1, is_last, data): `payload_sha1`
is the digest of the payload up to and including this chunk, so the last chunk
carries that of the whole, and neither side ever holds a whole record of the
archive; only CHUNK bytes of a payload are in hand at once.

Records with equal payloads (SHA-1 and length) of at least MIN_REVISIT bytes:
that with the largest page_id is a response, the others are revisits, which
hold no payload and name the response's record.

Defined results: a null html is an empty payload (one chunk of 0 bytes); pages
repeated in all of page_id, url and payload are one response and revisits of the same
page_id; a null page_id is kept and sorts lowest; an empty table writes no
archive and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenequery.llm.common import materialise, shared_dir

MIN_REVISIT, CHUNK, LEVEL = 1000, 1 << 16, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records bigint, n_bytes bigint"
CHUNKS = "record_id string, page_id bigint, record_type string, refers_to_id string, chunk_no int, chunk_offset bigint, chunk_bytes int, payload_sha1 string, is_last boolean, digest_ok boolean, data binary"


def plan(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages as records: page_id, url, payload, digest (hex), nth, record_type, refers_to (page_id of a revisit's response).

    Only ids and digests meet by digest, after a partial maximum; payloads move once, by page_id.
    """
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    x = x.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    big = x.filter(F.col("size") >= min_bytes).select("page_id", "digest", "size")
    first = big.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"))
    key = F.concat_ws("/", F.col("page_id").cast("string"), "digest")  # never null, so that join and window deal out alike
    other = big.join(first, ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(key.alias("key"), "refers_to").distinct()
    y = x.withColumn("key", key).join(other, "key", "left").withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("url")))
    again = (F.col("size") >= min_bytes) & (F.col("nth") > 1)
    revisit = F.col("refers_to").isNotNull() | again
    return y.select("page_id", "url", "payload", "digest", "nth", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.coalesce("refers_to", "page_id")).alias("refers_to"))


def record_id(page_id, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{nth}')}>"


def records(row: dict):
    """The pieces of one WARC record."""
    revisit, payload = row["record_type"] == "revisit", row["payload"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    size = len(http) + (0 if revisit else len(payload))
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    target = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'], row['digest'], row['nth'])}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if row['page_id'] is None else row['page_id']}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'], row['digest'], 1)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    yield "\r\n".join(head).encode() + b"\r\n\r\n" + http
    if not revisit:
        view = memoryview(payload)
        for i in range(0, len(payload), CHUNK):
            yield view[i : i + CHUNK]
    yield b"\r\n\r\n"


def _write(folder: str):
    from pyarrow import fs as pafs

    def run(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, n, batch = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz", 0, first
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            while batch is not None:
                payload = batch.column("payload")
                for i, row in enumerate(batch.drop_columns(["payload"]).to_pylist()):
                    row["payload"] = memoryview(payload[i].as_buffer())  # the batch's own bytes, not a copy
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    for piece in records(row):
                        out.write(z.compress(piece))
                    out.write(z.flush())
                    n += 1
                batch = next(batches, None)
            size = out.tell()
        yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([n]), pa.array([size])], ["path", "n_records", "n_bytes"])

    return run


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages' archives; the manifest has a row per file that counts (a lost task's file has none)."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    return materialise(plan(pages).mapInArrow(_write(folder), MANIFEST), "warc-manifest")


class Stream:
    """The decompressed bytes of a .warc.gz, piece by piece."""

    def __init__(self, raw, size: int = CHUNK):
        self.raw, self.size, self.z, self.held, self.packed = raw, size, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        if self.z.eof:
            rest = self.z.unused_data
            self.z, self.packed = zlib.decompressobj(31), rest
        else:
            self.packed = self.z.unconsumed_tail
        if not self.packed:
            self.packed = self.raw.read(self.size)
            if not self.packed:
                return False
        self.held += self.z.decompress(self.packed, self.size)
        return True

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def head(self) -> bytes:
        """Up to and without the next empty line; b"" at the end."""
        at = -1
        while (at := self.held.find(b"\r\n\r\n", max(0, at))) < 0 and self._more():
            pass
        if at < 0:
            return b""
        out = bytes(self.held[:at])
        del self.held[: at + 4]
        return out


def chunks_of(raw, size: int = CHUNK):
    """The chunk rows of one archive, as tuples in the order of CHUNKS."""
    s = Stream(raw)
    while head := s.head():
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
        left = int(fields["Content-Length"]) - len(s.head()) - 4
        kind, page = fields["WARC-Type"], fields.get("X-Page-Id", "").strip()
        said = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
        sha, no, offset = hashlib.sha1(), 0, 0
        while True:
            data = s.read(min(size, left))
            left -= len(data)
            sha.update(data)
            last = not left or not data
            yield (fields["WARC-Record-ID"], int(page) if page else None, kind, fields.get("WARC-Refers-To"), no, offset, len(data), sha.hexdigest() if kind == "response" else said, last, (sha.hexdigest() == said) if last and kind == "response" else None, data)
            no, offset = no + 1, offset + len(data)
            if last:
                break
        s.read(4)


def _schema(with_data: bool) -> pa.Schema:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.binary()]
    return pa.schema([(x.split()[0], k) for x, k in zip(CHUNKS.split(", "), kinds)][: None if with_data else -1])


def _read(with_data: bool):
    from pyarrow import fs as pafs

    schema = _schema(with_data)
    most = 64 if with_data else 4096

    def run(batches):
        def put(rows):
            return pa.record_batch([pa.array(c, k.type) for c, k in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(p, compression=None) as raw:
                    rows = []
                    for row in chunks_of(raw):
                        rows.append(row if with_data else row[:-1])
                        if len(rows) == most:
                            yield put(rows)
                            rows = []
                    if rows:
                        yield put(rows)

    return run


def chunks(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives that the manifest names."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(n, "path").mapInArrow(_read(with_data), CHUNKS if with_data else CHUNKS.rpartition(",")[0])


def report(pages: DataFrame) -> DataFrame:
    """A row per page, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks, digest_ok."""
    last = materialise(chunks(write(pages), with_data=False).filter("is_last"), "warc-records")
    size = (F.col("chunk_offset") + F.col("chunk_bytes")).alias("payload_bytes")
    whole = last.filter("record_type = 'response'").select("record_id", "page_id", size, F.col("payload_sha1").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), (F.col("chunk_no") + 1).alias("n_chunks"), "digest_ok")
    seen = last.filter("record_type = 'revisit'").select("page_id", F.col("refers_to_id").alias("record_id"), F.col("payload_sha1").alias("said"))
    to = whole.select("record_id", "payload_bytes", "payload_digest", F.col("page_id").alias("refers_to"))
    again = seen.join(to, "record_id").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to", F.lit(0).alias("n_chunks"), (F.col("said") == F.col("payload_digest")).alias("digest_ok"))
    return whole.drop("record_id").unionByName(again)
