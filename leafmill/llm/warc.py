"""WARC archives compressed with Zstandard: one frame per record, the dictionary in front.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record
is one frame that needs it. The reader loads the dictionary, decodes frame by frame, and checks each
record: version line, required headers, block length, closing line ends, block and payload digests,
and the length that the HTTP header states.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, parallel, small_batches, utf8
from leafmill.llm.exact_dedup import exact_dedup
from leafmill.llm.files import RollingFile, new_folder, opened

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
IDENTITY = "urn:page:"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page: int | None, url: str | None, payload: bytes, refers: int | None, date: str) -> bytes:
    """A response record, or a revisit of the page ``refers`` without the payload."""
    uri = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url or "") or f"{IDENTITY}{page}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <{IDENTITY}{page}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{IDENTITY}{refers}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_dictionary(samples: list[bytes], size: int = 16 << 10) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; where these are too few, their beginning serves as it is."""
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 64 << 20, sample: int = 256) -> DataFrame:
    """Write ``page_id, url, body, refers_to`` rows; return where each record is.

    The dictionary of a task's archives is trained on its first ``sample`` records (at most 4 MB).
    Returns ``page_id, archive, offset, length``.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    schema = pa.schema([("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        out = RollingFile(folder, ".warc.zst", archive_bytes)
        waiting, held, words, frames = [], 0, None, None

        def put(rows):
            done = []
            for page, record in rows:
                if out.roll():
                    front = words.as_bytes()
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(front)) + front)
                data = frames.compress(record)
                done.append({"page_id": page, "archive": f"{folder}/{out.name}", "offset": out.write(data), "length": len(data)})
            return pa.RecordBatch.from_pylist(done, schema=schema)

        def start():
            some = make_dictionary([r for _, r in waiting[:sample]])
            return some, zstandard.ZstdCompressor(level=6, dict_data=some, write_content_size=True, write_checksum=True)

        for batch in batches:
            for row in batch.to_pylist():
                waiting.append((row["page_id"], record_bytes(row["page_id"], row["url"], row["body"], row["refers_to"], date)))
                held += len(waiting[-1][1])
                if words is None and (len(waiting) >= sample or held > 4 << 20):
                    words, frames = start()
                if words is not None:
                    yield put(waiting)
                    waiting, held = [], 0
        if waiting:
            if words is None:
                words, frames = start()
            yield put(waiting)
        out.close()

    return cut(pages.select("page_id", "url", "body", "refers_to").mapInArrow(run, "page_id long, archive string, offset long, length long"))


def parse_record(data: bytes) -> dict:
    """A decoded record's headers and payload figures; raises ValueError on what isn't a valid one."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"a header without a name: {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [x for x in REQUIRED if x not in headers]:
        raise ValueError(f"missing headers: {missing}")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, stated {length}")
    block = rest[:-4]
    if (stated := headers.get("warc-block-digest", "")).startswith("sha1:") and stated[5:] != digest32(block):
        raise ValueError("the block's digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    size = int(found[1]) if found else len(payload)
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "response":
        if size != len(payload):
            raise ValueError(f"payload of {len(payload)} bytes, stated {size}")
        if stated and stated != digest32(payload):
            raise ValueError("the payload's digest differs")
        stated = digest32(payload)
    elif headers["warc-type"] == "revisit" and (payload or "warc-refers-to" not in headers):
        raise ValueError("a revisit with a payload or without a target")
    return {"headers": headers, "payload": payload, "payload_bytes": size, "payload_digest": stated}


def frames(stream, step: int = 64 << 10):
    """The decoded frames of an open archive, by the dictionary of its leading skippable frame."""
    head = stream.read(8)
    words, rest = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        (size,) = struct.unpack("<I", head[4:])
        raw, rest = stream.read(size), b""
        if len(raw) != size:
            raise ValueError("the dictionary is cut off")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # it may be compressed itself
            raw = zstandard.ZstdDecompressor().decompress(raw)
        words = zstandard.ZstdCompressionDict(raw)
    plain = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    while rest or (rest := stream.read(step)):
        frame, parts = plain.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(step)
            if not rest:
                raise ValueError("the last frame is cut off")
        yield b"".join(parts)


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the archives named in column ``archive``; one row per record, every record checked.

    Returns ``page_id, record_type, refers_to, url, payload_bytes, payload_digest``, and ``payload``
    (null for revisits) if asked for. Each archive is read by one task, from front to end.
    """

    def number(named: str | None) -> int | None:
        found = re.fullmatch(rf"<{IDENTITY}(-?\d+)>", named or "")
        return int(found[1]) if found else None

    names = ["page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = opened(uri)
                rows, held = [], 0
                with fs.open_input_stream(path) as stream:
                    for data in frames(stream):
                        r = parse_record(data)
                        h = r["headers"]
                        rows.append((number(h["warc-record-id"]), h["warc-type"], number(h.get("warc-refers-to")), h.get("warc-target-uri"), r["payload_bytes"], r["payload_digest"], r["payload"] if h["warc-type"] == "response" else None)[: len(names)])
                        held += len(data)
                        if len(rows) >= 1000 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    n = parallel(archives.sparkSession)
    schema = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    return archives.select("archive").distinct().repartition(n).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write a record per row and return the index of :func:`write_archives`.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest identifier is a
    response and the others revisit it. A null payload is empty, a null address is named after the
    identifier; rows that repeat an identifier and payload are each a record of the same type; rows
    with a null identifier are responses unless an equal payload has one. An empty table writes nothing.
    """
    small_batches(pages.sparkSession)
    verdict = exact_dedup(pages, key, html, keep="max").select("id", "keep_id", F.col("text_sha256").alias("sha")).distinct()
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), utf8(html).alias("body"))
    rows = rows.withColumn("sha", F.sha2("body", 256)).alias("p")
    both = rows.join(verdict.alias("v"), F.col("p.page_id").eqNullSafe(F.col("v.id")) & (F.col("p.sha") == F.col("v.sha")))
    other = ~F.col("keep_id").eqNullSafe(F.col("page_id")) & (F.octet_length("body") >= least)
    return write_archives(both.select("page_id", "url", "body", F.when(other, F.col("keep_id")).alias("refers_to")))


def op2_warc(spark, sf_dir):
    index = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, max(page_id) AS best FROM p GROUP BY body),
h AS (SELECT p.page_id, p.body, g.best, sha1(p.body) AS hex FROM p JOIN g USING (body))
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) % 32 + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM h
"""
