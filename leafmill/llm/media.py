"""Media columns: content-addressed payloads in tar shards.

Every payload is stored losslessly as an 8-bit grey PNG, 64 samples to a row, under its digest in a
tar shard; a shard holds a payload once. Rows carry digest, shard, offset and length. Metadata
columns come from range reads of the 33 bytes of signature and header alone; features come from the
stored bytes read back, each stored payload being read once for all of its rows in the shard.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, documents, parallel, small_batches, utf8
from leafmill.llm.files import RollingFile, new_folder, opened

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def padded(body: bytes) -> bytes:
    """``body`` with zero bytes up to a positive multiple of the row width."""
    return body + bytes(max(WIDTH, -(-len(body) // WIDTH) * WIDTH) - len(body))


def png(payload: bytes) -> bytes:
    """An 8-bit grey image of the payload's bytes, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> dict:
    """Width, height, bit depth and colour type from the first 33 bytes; raises on anything else."""
    if len(head) < HEADER_BYTES or head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "depth": depth, "colour": colour}


def png_samples(data: bytes) -> bytes:
    """The payload of an image that :func:`png` made."""
    head, at, idat = png_header(data), 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk's checksum differs")
        if kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(head["height"], head["width"] + 1)
    if raw[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and which of 16 equal stretches are above the mean."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    mean = x.mean()
    above = [int(part.mean() > mean) for part in np.array_split(x, 16)]
    return f"{len(x) // WIDTH}x{WIDTH};mean={mean:.3f};dev={x.std():.3f};profile={''.join(map(str, above))}"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = 64 << 20) -> DataFrame:
    """Write the payloads; return ``id, n_bytes, digest, shard, offset, length``, one row per input row.

    A null text is the empty payload, which is padded like any other. Equal texts share one place
    within a shard, and the digest everywhere. Null or repeated identifiers pass through; an empty
    table writes nothing; other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "media")

    def run(batches):
        out, there = RollingFile(folder, ".tar", shard_bytes), {}
        for batch in batches:
            rows = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = raw.as_py()
                payload = padded(body)
                digest = hashlib.sha256(payload).hexdigest()
                if out.roll():
                    there = {}
                if digest not in there:
                    data = png(payload)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(data)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT))
                    there[digest] = (out.write(data), len(data))
                    out.write(bytes(-len(data) % 512))
                rows.append((k, len(body), digest, f"{folder}/{out.name}", *there[digest]))
                if out.at >= out.limit:
                    out.write(bytes(1024))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, KINDS, strict=True)], INDEX)
        if out.stream is not None and out.at < out.limit:
            out.write(bytes(1024))
        out.close()

    INDEX, KINDS = ["id", "n_bytes", "digest", "shard", "offset", "length"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    small_batches(spark)
    source = docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("body"))
    return cut(source.mapInArrow(run, "id long, n_bytes long, digest string, shard string, offset long, length long"))


def by_place(index: DataFrame, stretch: int = 8 << 20) -> DataFrame:
    """Rows of one stretch of a shard together, in the order of the file."""
    n = parallel(index.sparkSession)
    return index.repartition(n, F.col("shard"), F.floor(F.col("offset") / stretch)).sortWithinPartitions("shard", "offset")


def over_places(index: DataFrame, columns: str, what) -> DataFrame:
    """Add ``columns``: ``what(read, offset, length)`` once for each place, for all its rows."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        shard, place, file, got = None, None, None, None
        for batch in batches:
            table = batch.to_pydict()
            added = []
            for s, o, n in zip(table["shard"], table["offset"], table["length"], strict=True):
                if s != shard:
                    if file is not None:
                        file.close()
                    fs, path = opened(s)
                    shard, place, file = s, None, fs.open_input_file(path)
                if o != place:
                    place, got = o, what(lambda size, at: file.read_at(size, at), o, n)
                added.append(got)
            more = list(zip(*added, strict=True)) if added else [()] * len(names)
            kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in columns.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(more, kinds, strict=True))], [*batch.schema.names, *names])
        if file is not None:
            file.close()

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    return by_place(index).mapInArrow(run, f"{kept}, {columns}")


def fill_metadata(index: DataFrame) -> DataFrame:
    """Add ``width, height, depth, colour`` by reading headers only."""

    def what(read, offset, length):
        return tuple(png_header(read(min(HEADER_BYTES, length), offset)).values())

    return over_places(index, "width long, height long, depth long, colour long", what)


def fill_features(index: DataFrame) -> DataFrame:
    """Add what the stored bytes give: payload and media digests, lengths, the tail's checksum, the feature."""

    def what(read, offset, length):
        head = png_header(read(min(HEADER_BYTES, length), offset))
        data = read(length, offset)
        payload = png_samples(data)
        if len(payload) != head["width"] * head["height"]:
            raise ValueError("the image's size differs from its header's")
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload))

    return over_places(index, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", what)


def op9_media(spark, sf_dir):
    full = fill_features(fill_metadata(store(documents(spark, sf_dir))))
    return full.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth", "colour")
