import hashlib
import io
import zlib

from scenequery.llm import warc as W


def expected(pages):
    groups = {}
    for p, _, h in pages:
        groups.setdefault((h or "").encode(), []).append(-1 if p is None else p)
    out = []
    for data, ids in groups.items():
        top, used = max(ids), False
        for p in ids:
            again = len(data) >= 1000 and (p != top or used)
            used |= p == top
            out.append((None if p < 0 else p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", (None if top < 0 else top) if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def test_odd_pages(spark):
    big, huge = "é" * 700, "line\r\n\r\n" * 50_000
    pages = [(1, "u", big), (2, "u", big), (9, "u\r\nX: y", big), (9, "u", big), (3, None, "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (None, "u", "k" * 1000), (7, "u", huge), (8, "u", huge), (10, "u", "WARC/1.1\r\n\r\n" * 9), (12, "u", "q" * 1000), (12, "u", "q" * 1000)]
    df = spark.createDataFrame([(*p, "z", 1) for p in pages], "page_id long, url string, html string, digest string, nth int")
    r = W.report(df)
    assert got(r) == expected(pages)
    assert all(x.digest_ok for x in r.collect())


def test_empty(spark):
    assert W.report(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_chunks_rebuild_payload():
    data = bytes(range(256)) * 1000
    row = {"page_id": 5, "url": "u", "payload": data, "digest": hashlib.sha1(data).hexdigest(), "nth": 1, "record_type": "response", "refers_to": None}
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    packed = b"".join(z.compress(x) for x in W.records(row)) + z.flush()
    rows = list(W.chunks_of(io.BytesIO(packed + packed), 10_000))
    first = rows[: len(rows) // 2]
    assert b"".join(r[-1] for r in first) == data and max(len(r[-1]) for r in rows) <= 10_000
    for k, r in enumerate(first):
        assert r[4] == k and r[5] == k * 10_000 and r[7] == hashlib.sha1(data[: r[5] + r[6]]).hexdigest()
    assert [r[8] for r in first] == [False] * (len(first) - 1) + [True] and first[-1][9]


def test_whole_table(spark, sf):
    from scenequery.llm.queries import op1_warc_records

    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(op1_warc_records(spark, sf)) == expected(pages)


def test_chunk_table_with_data(spark):
    """The chunks of a record, put together, are its payload, and each carries the digest up to its end."""
    pages = [(k, "u", "".join(chr(97 + (k * i) % 26) for i in range(n))) for k, n in ((1, 0), (2, 5), (3, W.CHUNK), (4, 3 * W.CHUNK + 17))]
    rows = W.chunks(W.write(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    for p, _, h in pages:
        mine = sorted((r for r in rows if r.page_id == p), key=lambda r: r.chunk_no)
        data = b"".join(bytes(r.data) for r in mine)
        assert data == h.encode() and max(len(r.data) for r in mine) <= W.CHUNK and [r.is_last for r in mine] == [False] * (len(mine) - 1) + [True]
        for r in mine:
            assert r.payload_sha1 == hashlib.sha1(data[: r.chunk_offset + r.chunk_bytes]).hexdigest()
