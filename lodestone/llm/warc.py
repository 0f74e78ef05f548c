"""WARC archives compressed record by record with an embedded Zstandard dictionary.

An archive is one .warc.zst file: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one Zstandard frame
per record, first of all a warcinfo record. The dictionary is built from records of the archive itself. Archives close at
ARCHIVE_BYTES of records, so a worker holds one at a time, and each is a row (archive, records, data) that Spark writes and
reads: no task opens a file of its own, and a lost executor's archives are written anew. export writes the rows out as files.

Payloads that come again are stored once: of equal payloads of at least min_bytes, the page with the smallest id is a response, the
others are revisit records that refer to it. Whole payloads are shuffled only where their digest repeats and isn't one of
the hottest: a Bloom filter over repeated digests lets the others pass, and digests with more than a HOT_SHARE-th of all
rows, of which there are fewer than HOT_SHARE, are broadcast.

Cases: a null html is an empty payload; null ids never are the smallest and refer to the page that is; rows that repeat the smallest
id are responses too; null urls become a urn; an empty table gives no archives; extra columns are ignored. On reading, a
response whose payload doesn't give its digest is an error.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, in_bloom, materialize

#: Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 1 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
HOT_SHARE = 1000  # a digest of more than this part of all rows is hot


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}:{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit carries the HTTP head only, whose Content-Length is the full payload's."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page is not None:
        head.append(f"Page-ID: {page}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    """The record that opens an archive."""
    block = b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id(None, name)}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and HTTP block of one record; the size and digest of a response are those of the payload that is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] == "warcinfo":
        return {"fields": fields, "payload": block, "payload_bytes": len(block), "digest": None}
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    full = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated or len(payload) != full:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't the one that was written")
    return {"fields": fields, "payload": payload, "payload_bytes": full, "digest": stated}


def build_archive(records: list[bytes]) -> bytes:
    import zstandard

    sample, size = [], 0
    for r in records[:: max(1, len(records) // 400)]:
        sample.append(r[: SAMPLE_BYTES // 8])
        size += len(sample[-1])
        if size > SAMPLE_BYTES:
            break
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=LEVEL, k=256, d=8)
    except zstandard.ZstdError:  # too little to train on: the records themselves
        dictionary = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content = dictionary.as_bytes()
    dictionary.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE_MAGIC, len(content)), content, *map(compressor.compress, records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    content = data[8 : 8 + size]
    # trained dictionaries have a magic number of their own
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        frame, parts, step = reader.decompressobj(), [], 1 << 14
        while not frame.eof:
            some = view[at : at + step]
            if not len(some):
                raise ValueError("the last record is cut off")
            parts.append(frame.decompress(some))
            at += len(some)
            step = min(step * 2, 1 << 20)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def write(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives (archive, records, data) of all pages."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    # only payloads that repeat have a first page to refer to; the minimum is taken before the shuffle too
    seen = rows.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = materialize(seen.where("n > 1 AND first IS NOT NULL"), "first")
    # fewer than HOT_SHARE digests, as the rows of each are more than that part of all
    least = max(first.agg(F.sum("n")).first()[0] or 0, 1) // HOT_SHARE
    hot = F.broadcast(first.where(F.col("n") > least).selectExpr("sha AS hot_sha", "first AS hot_first"))
    bits = pages.sparkSession.sparkContext.broadcast(bloom(first.where(F.col("n") <= least).select(F.substring("sha", 1, 16).alias("k"))))

    @F.arrow_udf("boolean")
    def suspected(keys: pa.Array) -> pa.Array:
        return pa.array(in_bloom(bits.value, keys.to_pylist()))

    marked = rows.join(hot, F.col("sha") == F.col("hot_sha"), "left").withColumn("suspect", suspected(F.expr("substring(sha, 1, 16)")))
    at_once = marked.where("hot_sha IS NOT NULL OR NOT suspect").select("page_id", "url", "payload", "sha", F.col("hot_first").alias("first"))
    rest = marked.where("hot_sha IS NULL AND suspect").select("page_id", "url", "payload", "sha").join(first.select("sha", "first").hint("shuffle_hash"), "sha", "left")
    joined = at_once.unionByName(rest)

    def work(batches):
        held, size, number = [], 0, 0

        def close():
            name = f"part-{TaskContext.get().partitionId():06d}-{number:05d}.warc.zst"
            data = build_archive([warcinfo(name), *held])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int32()), pa.array([data], pa.binary())], ["archive", "records", "data"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha", "first")), strict=True):
                page, url, payload, sha, first_page = (x.as_py() for x in row)
                revisit = first_page is not None and first_page != page
                raw = record(page, url, payload, base64.b32encode(sha).decode(), first_page, revisit)
                held.append(raw)
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return joined.select("page_id", "url", "payload", "sha", "first").mapInArrow(work, "archive string, records int, data binary")


def read(archives: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""

    def work(batches):
        for batch in batches:
            for data in batch.column("data"):
                out = []
                for raw in read_archive(data.as_py()):
                    x = parse(raw)
                    f = x["fields"]
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    page, refers = f.get("Page-ID"), f.get("Refers-To-Page-ID")
                    out.append((None if page is None else int(page), x["payload_bytes"], x["digest"], f["WARC-Type"], None if refers is None else int(refers), None if f["WARC-Type"] == "revisit" else x["payload"]))
                    if len(out) >= 500:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    return archives.select("data").mapInArrow(work, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a .warc.zst file to a folder that every executor has mounted: (archive, bytes) of what was written.

    A file appears under its name only when it is whole, and a task that runs again writes the same bytes. Names are those of
    one call of write, so a folder holds one.
    """

    def work(batches):
        for batch in batches:
            names, data = batch.column("archive").to_pylist(), batch.column("data")
            for name, x in zip(names, data, strict=True):
                part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(x.as_buffer())
                os.replace(part, os.path.join(folder, name))
            yield pa.RecordBatch.from_arrays([batch.column("archive"), pa.array([x.as_buffer().size for x in data], pa.int64())], ["archive", "bytes"])

    os.makedirs(folder, exist_ok=True)
    return materialize(archives.select("archive", "data").mapInArrow(work, "archive string, bytes bigint"), "exported")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def _base32_sql(digest: str) -> str:
    """Base32 of a SHA-1 in hex: four times 40 bits, eight letters each."""
    part = lambda i: f"('0x' || substr({digest}, {10 * i + 1}, 10))::bigint"
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({part(i)} >> {35 - 5 * j}) & 31)::int + 1, 1)" for i in range(4) for j in range(8))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages), w AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, {_base32_sql('d')} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM w
"""
