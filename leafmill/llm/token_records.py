"""Token ids as length-delimited binary records with a separate offset index.

A data file is a run of frames: the payload's length (8 bytes, little-endian), its masked CRC-32C, the
payload, and the payload's masked CRC-32C (the public TFRecord framing). A payload is one document: its
identifier (8 bytes), a flag for a null one, the width of an id in bytes, and the ids. Beside each data
file stands an index of the same framing with one frame: offset, length and number of ids of every
record, so that any record is read by itself, in any order.

Documents are dealt by ranges of their identifiers, so that files, in the order of the manifest, hold
them in ascending order. The manifest has a row for each file; the ids before a file are a running sum
over these rows.
"""

from __future__ import annotations

import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.boundaries import Boundaries
from leafmill.llm.bpe import TOGETHER, TOGETHER_ROWS, utf8_only
from leafmill.llm.common import Remembered, cut, parallel, small_batches, utf8
from leafmill.llm.files import RollingFile, new_folder, opened
from leafmill.llm.token_counts import read_spec
from leafmill.shared import running_before

#: The reversed polynomial of CRC-32C and the constant that masks it (fixed values of the format).
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes whose checksum is looked up at once.
BLOCK = 512
#: What stands in a payload before the ids: identifier, whether it is null, bytes of an id.
HEAD = "<qBB"
HEAD_BYTES = struct.calcsize(HEAD)
#: Pre-tokens in each of the two generations that a worker remembers.
REMEMBERED = 250_000
INDEX_ENTRY = np.dtype([("offset", "<u8"), ("length", "<u4"), ("n_ids", "<u4")])


class Crc32c:
    """CRC-32C of many byte strings at once.

    A checksum is linear: a byte's share depends on itself and on how many bytes follow, so a block is
    one table lookup a byte and an exclusive or; blocks are then chained. Zeros in front change nothing.
    """

    def __init__(self):
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
        followed = np.empty((BLOCK, 256), np.uint32)
        followed[-1] = one
        for i in range(BLOCK - 2, -1, -1):
            followed[i] = (followed[i + 1] >> 8) ^ one[followed[i + 1] & 255]
        self.table = followed.ravel()
        self.places = np.arange(BLOCK, dtype=np.int32) * 256
        # a register is the same as its four bytes upon the first four of the block that follows
        self.step = followed[:4].tolist()

    def _blocks(self, data: np.ndarray) -> np.ndarray:
        """The checksum of each block, from a register of zero."""
        rows = data.reshape(-1, BLOCK)
        out = np.empty(len(rows), np.uint32)
        for at in range(0, len(rows), 256):  # as much as fits a cache
            out[at : at + 256] = np.bitwise_xor.reduce(np.take(self.table, rows[at : at + 256] + self.places), axis=1)
        return out

    def masked(self, parts: list) -> list[int]:
        """The masked checksum of each part; every part has four bytes or more."""
        blocks = [-(-len(p) // BLOCK) for p in parts]
        ends = np.cumsum(blocks, dtype=np.int64).tolist()
        data = np.zeros((ends[-1] if ends else 0) * BLOCK, np.uint8)
        for p, end in zip(parts, ends, strict=True):
            begin = end * BLOCK - len(p)
            data[begin : end * BLOCK] = np.frombuffer(p, np.uint8)
            data[begin : begin + 4] ^= 255  # a register of ones is the same as four inverted bytes
        sums, (a, b, c, d), out, at = self._blocks(data).tolist(), self.step, [], 0
        for end in ends:
            r = 0
            for s in sums[at:end]:
                r = a[r & 255] ^ b[r >> 8 & 255] ^ c[r >> 16 & 255] ^ d[r >> 24] ^ s
            at = end
            r ^= 0xFFFFFFFF
            out.append(((r >> 15 | r << 17) + MASK) & 0xFFFFFFFF)
        return out


_crc: list[Crc32c] = []


def crc() -> Crc32c:
    """The tables of this process, made once."""
    if not _crc:
        _crc.append(Crc32c())
    return _crc[0]


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    sums = crc().masked([*lengths, *payloads])
    first, second = sums[: len(payloads)], sums[len(payloads) :]
    return [b"".join((n, struct.pack("<I", a), p, struct.pack("<I", b))) for n, a, p, b in zip(lengths, first, payloads, second, strict=True)]


def payloads_of(found: list[bytes]) -> list[memoryview]:
    """The payloads of whole frames; raises on any whose length or checksums aren't right."""
    views = [memoryview(f) for f in found]
    for v in views:
        if len(v) < 16 or struct.unpack_from("<Q", v)[0] != len(v) - 16:
            raise ValueError("a record's length differs from its frame's")
    sums = crc().masked([x for v in views for x in (v[:8], v[12:-4])])
    for v, a, b in zip(views, sums[::2], sums[1::2], strict=True):
        if struct.unpack_from("<I", v, 8)[0] != a or struct.unpack_from("<I", v, len(v) - 4)[0] != b:
            raise ValueError("a record's checksum differs")
    return [v[12:-4] for v in views]


def ids_of(payload) -> tuple[int | None, np.ndarray]:
    """Identifier and ids of a payload."""
    key, null, width = struct.unpack_from(HEAD, payload)
    if width not in (2, 4) or (len(payload) - HEAD_BYTES) % width:
        raise ValueError("a record's payload isn't a run of ids")
    return None if null else key, np.frombuffer(payload, f"<u{width}", offset=HEAD_BYTES)


class LibraryCodec:
    """Ids as the tokenizers library gives them; it sees each distinct pre-token of a block that isn't remembered once.

    Pre-tokens that begin with a space are sent many in a row, which the library takes apart again where they were joined.
    """

    def __init__(self, said: str, added: list[str], together: int = 512):
        import regex
        from tokenizers import Tokenizer

        self.library, self.boundaries, self.known = Tokenizer.from_str(said), Boundaries(), Remembered(REMEMBERED)
        self.special = regex.compile("|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True)).encode()) if added else None
        self.together = 1 if any(c.isspace() for a in added for c in a) else together

    def _looked_up(self, pieces: list[bytes]) -> list[bytes]:
        """The ids, in four bytes each, of pre-tokens that nothing is known of."""
        texts = [p.decode("utf-8") for p in pieces]
        joined = [k for k, s in enumerate(texts) if s[0] == " " and not s[1:2].isspace() and len(s) > 1]
        alone = np.ones(len(texts), bool)
        out: list = [None] * len(texts)
        for at in range(0, len(joined), 16 * self.together):
            groups = [joined[i : i + self.together] for i in range(at, min(at + 16 * self.together, len(joined)), self.together)]
            for group, e in zip(groups, self.library.encode_batch(["".join([texts[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4").tobytes()
                cuts = [0, *((np.flatnonzero(np.diff(e.word_ids)) + 1) * 4).tolist(), len(ids)]
                if len(cuts) == len(group) + 1:  # as many words as were joined
                    alone[group] = False
                    for k, a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
                        out[k] = ids[a:b]
        left = np.flatnonzero(alone).tolist()
        for at in range(0, len(left), 4096):
            some = left[at : at + 4096]
            for k, e in zip(some, self.library.encode_batch_fast([texts[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and where each text's begin, with the end of all behind."""
        data = np.frombuffer(b"".join(bodies), np.uint8)
        ends = np.cumsum([len(x) for x in bodies], dtype=np.int64)
        begins = np.append(0, ends[:-1]).astype(np.int64)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(bodies) + 1, np.int64)
        specials = []
        if self.special is not None:
            for begin, raw in zip(begins.tolist(), bodies, strict=True):
                specials += [(begin + m.start(), begin + m.end()) for m in self.special.finditer(raw)]
        # what stands between added tokens is a text of its own
        cuts = np.unique(np.concatenate([begins, np.array(specials, np.int64).ravel()]))
        starts = self.boundaries.pieces(data, cuts)
        if specials:
            inside = np.zeros(len(data) + 1, np.int32)
            for a, b in specials:
                inside[a + 1] += 1
                inside[b] -= 1
            starts = starts[np.cumsum(inside)[starts] == 0]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = list(map(self.known.get, distinct))
        new = [k for k, x in enumerate(found) if x is None]
        times = np.bincount(at, minlength=len(distinct)).tolist()
        for k, ids in zip(new, self._looked_up([distinct[k] for k in new]), strict=True):
            found[k] = ids
            if times[k] > 1:
                self.known.put(distinct[k], ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = pa.array(np.frombuffer(b"".join(found), "<i4"))
        ids = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), flat).take(coded.indices).flatten()
        before = np.append(0, np.cumsum(sizes[at]))
        return ids.to_numpy(zero_copy_only=False), before[np.append(np.searchsorted(starts, begins), len(starts))]


MANIFEST = "part int, seq int, file string, records long, n_ids long"


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", file_bytes: int = 64 << 20) -> DataFrame:
    """Encode and write the documents; return the manifest: ``part, seq, file, records, n_ids, start``.

    Rows in the order of (part, seq) hold the documents in ascending order of their identifiers, null
    first; rows of one identifier go by the hash of their texts. ``start`` is the number of ids in all
    files before. A null or empty text is the end id alone; a text is encoded whole, whatever its length;
    rows that repeat are written each; an empty table writes no file; other columns are not read.
    Each attempt of a task writes files of its own, and only those of the attempt that counts are listed.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "records")
    said, added = read_spec(tokenizer_path)
    shared = spark.sparkContext.broadcast((said, added))

    def run(batches):
        import os

        from tokenizers import Tokenizer  # noqa: F401  fails here, not in the middle of a file

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        codec = LibraryCodec(*shared.value)
        width = 2 if max(codec.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, out = TaskContext.get().partitionId(), RollingFile(folder, ".tfrecord", file_bytes)
        index, done = [], []

        def close():
            if index:
                entries = np.concatenate(index)
                fs, path = opened(f"{folder}/{out.name}.index")
                with fs.open_output_stream(path) as f:
                    f.write(frames([entries.tobytes()])[0])
                done.append({"part": part, "seq": len(done), "file": f"{folder}/{out.name}", "records": len(entries), "n_ids": int(entries["n_ids"].sum())})
                index.clear()

        def put(keys, bodies):
            ids, offsets = codec.encode(bodies)
            ids, at = ids.astype(f"<u{width}"), offsets.tolist()
            end = end_id.to_bytes(width, "little")
            made = frames([struct.pack(HEAD, k or 0, k is None, width) + ids[a:b].tobytes() + end for k, a, b in zip(keys, at[:-1], at[1:], strict=True)])
            counts = np.diff(offsets) + 1
            first = 0
            while first < len(made):
                if out.stream is not None and out.at >= out.limit:
                    close()
                out.roll()
                # as many as the file has room for
                last, size = first, out.at
                while last < len(made) and size < out.limit:
                    size += len(made[last])
                    last += 1
                entries = np.zeros(last - first, INDEX_ENTRY)
                entries["length"] = [len(x) for x in made[first:last]]
                entries["offset"] = out.at + np.cumsum(entries["length"], dtype=np.int64) - entries["length"]
                entries["n_ids"] = counts[first:last]
                out.write(b"".join(made[first:last]))
                index.append(entries)
                first = last

        keys, bodies, held = [], [], 0
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                bodies.append(utf8_only(raw.as_py()))
                held += len(bodies[-1])
                if held >= TOGETHER or len(keys) >= TOGETHER_ROWS:
                    put(keys, bodies)
                    keys, bodies, held = [], [], 0
        if keys:
            put(keys, bodies)
        out.close()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("n_ids", pa.int64())]))

    small_batches(spark)
    source = docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("body"))
    # the row's number only spreads rows that are alike in everything else
    keyed = source.withColumn("h", F.xxhash64("body")).withColumn("n", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(parallel(spark), F.col("id").asc_nulls_first(), "h", "n").sortWithinPartitions(F.col("id").asc_nulls_first(), "h")
    manifest = cut(ranged.select("id", "body").mapInArrow(run, MANIFEST))
    return running_before(manifest, ["part", "seq"], F.col("n_ids"), "start")


def read_index(file: str) -> np.ndarray:
    """The entries of a data file's index, checked."""
    fs, path = opened(f"{file}.index")
    with fs.open_input_stream(path) as f:
        (body,) = payloads_of([f.read()])
    return np.frombuffer(body, INDEX_ENTRY)


def read_files(manifest: DataFrame, stretch: int = 8 << 20) -> DataFrame:
    """Every record in the order of its file: ``id, start, n_tokens, ids_crc32, file, offset, length``.

    A task reads a file in stretches, checks each frame and that the index says the same. ``start`` is the number of
    ids of all documents before, ``ids_crc32`` the CRC-32 of the ids as 32-bit little-endian integers.
    """
    kinds = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def read(file, start, records, n_ids):
        entries = read_index(file)
        if len(entries) != records or int(entries["n_ids"].sum()) != n_ids:
            raise ValueError(f"the index of {file} differs from the manifest")
        ends = (entries["offset"] + entries["length"]).astype(np.int64)
        fs, path = opened(file)
        with fs.open_input_file(path) as f:
            if f.size() != int(ends[-1]):
                raise ValueError(f"{file} doesn't end where its index does")
            first = 0
            while first < len(entries):
                begin = int(entries["offset"][first])
                last = max(first + 1, int(np.searchsorted(ends, begin + stretch, "right")))
                body = memoryview(f.read_at(int(ends[last - 1]) - begin, begin))
                mine = entries[first:last]
                places = [(int(o), int(n)) for o, n in zip(mine["offset"], mine["length"], strict=True)]
                rows = []
                for payload, (o, n), want in zip(payloads_of([body[o - begin : o - begin + n] for o, n in places]), places, mine["n_ids"].tolist(), strict=True):
                    key, ids = ids_of(payload)
                    if len(ids) != want:
                        raise ValueError(f"{file}: a record has other ids than its index says")
                    rows.append((key, start, want, zlib.crc32(ids.astype("<u4").tobytes()), file, o, n))
                    start += want
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                first = last

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from read(row["file"], row["start"], row["records"], row["n_ids"])

    n = parallel(manifest.sparkSession)
    return manifest.select("file", "start", "records", "n_ids").repartition(n).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long, file string, offset long, length long")


def places(manifest: DataFrame) -> DataFrame:
    """``file, offset, length`` of every record, from the indexes alone."""
    kinds = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                entries = read_index(file)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(entries)), pa.array(entries["offset"].astype(np.int64)), pa.array(entries["length"].astype(np.int64))], schema=kinds)

    return manifest.select("file").repartition(parallel(manifest.sparkSession)).mapInArrow(run, "file string, offset long, length long")


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """``id, ids`` of every document in a pseudo-random order that the seed fixes; records are read one by one through the index."""
    kinds = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        files = {}
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["file"] not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    fs, path = opened(row["file"])
                    files[row["file"]] = fs.open_input_file(path)
                found.append(files[row["file"]].read_at(row["length"], row["offset"]))
            got = [ids_of(p) for p in payloads_of(found)]
            sizes = np.cumsum([0, *(len(x) for _, x in got)])
            flat = np.fromiter(chain.from_iterable(x.tolist() for _, x in got), np.int32, int(sizes[-1]))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))], schema=kinds)
        for f in files.values():
            f.close()

    small_batches(manifest.sparkSession)
    order = F.xxhash64(F.lit(seed), F.element_at(F.split("file", "/"), -1), "offset")
    return places(manifest).orderBy(order, "file", "offset").mapInArrow(run, "id long, ids array<int>")


def op11_token_records(spark, sf_dir, tokenizer_path: str | None = None):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_records(docs, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_files(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
