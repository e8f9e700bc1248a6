"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash, displace: keys are dealt to buckets,
the largest bucket first gets a displacement that puts all its keys on free places, and buckets of
one key name their place outright) finds a whole pre-token's id with one probe and one comparison.
Tier two, for pre-tokens that are no vocabulary entry: the bytes are a linked list, candidate merges
wait in a heap by rank and place, and the lowest is applied until none is left.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import uuid
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import Remembered, documents, small_batches, utf8
from leafmill.llm.pretokens import Cutter

#: Chunks in each of the two generations that a worker remembers.
REMEMBERED = 100_000
#: Bytes and rows that are encoded together, unless one text alone is longer.
TOGETHER, TOGETHER_ROWS = 16 << 20, 20_000
_64 = (1 << 64) - 1
_SECOND, _THIRD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class PerfectHash:
    """A minimal perfect hash from byte strings to their ids; its size is the vocabulary's."""

    def __init__(self, ids: dict[bytes, int]):
        n = self.n = max(1, len(ids))
        self.shifts: np.ndarray | None = None
        self.buckets = max(1, n // 3)
        dealt: dict[int, list[tuple[int, bytes]]] = {}
        for key in ids:
            h = xxhash.xxh3_64_intdigest(key)
            dealt.setdefault(h % self.buckets, []).append((h, key))
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.ids = [0] * n
        for bucket, members in sorted(dealt.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                break
            d = 1
            while True:
                places = [self._place(h, d) for h, _ in members]
                if len(set(places)) == len(places) and all(self.keys[p] is None for p in places):
                    break
                d += 1
            self.shift[bucket] = d
            for p, (_, key) in zip(places, members, strict=True):
                self.keys[p], self.ids[p] = key, ids[key]
        free = (p for p in range(n) if self.keys[p] is None)
        for bucket, members in sorted(dealt.items()):
            if len(members) == 1:
                p = next(free)
                self.shift[bucket] = -p - 1
                self.keys[p], self.ids[p] = members[0][1], ids[members[0][1]]

    def _place(self, h: int, d: int) -> int:
        x = (h + d * _SECOND) & _64
        x = (x ^ x >> 31) * _THIRD & _64
        return (x >> 20) % self.n

    def get(self, key: bytes) -> int:
        """The id, or -1 for what isn't in the vocabulary."""
        return self.get_all([key])[0]

    def get_all(self, keys: list[bytes]) -> list[int]:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        if self.shifts is None:
            self.shifts = np.array(self.shift, np.int64)
        d = self.shifts[(h % np.uint64(self.buckets)).astype(np.int64)]
        x = h + d.astype(np.uint64) * np.uint64(_SECOND)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_THIRD)
        places = np.where(d < 0, -d - 1, ((x >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)).tolist()
        known, ids = self.keys, self.ids
        return [ids[p] if known[p] == key else -1 for p, key in zip(places, keys, strict=True)]


def merge_bytes(piece: bytes, rank) -> list[int]:
    """BPE of one pre-token: a heap of candidate merges over linked bytes."""
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0: none starts here any more
    back = list(range(-1, n - 1))  # where the part before the one that starts here starts
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if not i < j < stop or end[j] != stop:
            continue  # one of its parts has been merged since
        end[i], end[j] = stop, 0
        if stop < n:
            back[stop] = i
            if (r := rank(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        p = back[i]
        if p >= 0 and (r := rank(piece[p:stop])) is not None:
            heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(rank(piece[i : end[i]]))
        i = end[i]
    return out


class Codec:
    """Encodes and decodes texts; remembers a bounded number of chunks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash):
        self.rank, self.whole, self.cut = ranks.get, whole, Cutter(pattern)
        bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for key, i in ranks.items():
            bytes_of[i] = key
        self.bytes_of = pa.array(bytes_of, pa.large_binary())
        self.decimals = pa.array([f"{i} " for i in range(len(bytes_of))], pa.large_string())
        self.known = Remembered(REMEMBERED)

    def _pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of distinct pre-tokens: whole entries, and merges for the others."""
        rank = self.rank
        return [(i,) if i >= 0 else tuple(merge_bytes(p, rank)) for p, i in zip(pieces, self.whole.get_all(pieces), strict=True)]

    def _chunks(self, chunks: list[bytes], times: list[int]) -> list[tuple[int, ...]]:
        """The ids of distinct chunks; those that occur more than once are remembered."""
        get = self.known.get
        found = [get(raw) for raw in chunks]
        new, parts, place = [], [], {}
        for k, raw in enumerate(chunks):
            if found[k] is None:
                new.append(k)
                parts.append([place.setdefault(p, len(place)) for p in self.cut.raw_pieces(raw)])
        ids = self._pieces(list(place))
        for k, at in zip(new, parts, strict=True):
            mine = found[k] = ids[at[0]] if len(at) == 1 else tuple(i for x in at for i in ids[x])
            if times[k] > 1:
                self.known.put(chunks[k], mine)
        return found

    def encode(self, bodies: list[bytes]) -> Encoded:
        """Encode texts together: each distinct chunk of them is looked up once."""
        bodies, cuts = list(bodies), {}
        for k, raw in enumerate(bodies):
            parts = self.cut.apart(raw.decode("utf-8"))
            if parts is not None:
                parts = [x.encode("utf-8") for x in parts]
                cuts[k] = np.cumsum([0, *map(len, parts[:-1])])
                bodies[k] = b"".join(parts)  # less than the text where the pattern passes over some of it
        data = np.frombuffer(b"".join(bodies), np.uint8)
        ends = np.cumsum([len(x) for x in bodies], dtype=np.int64)
        begins = np.append(0, ends[:-1]).astype(np.int64)
        first = data == 32  # a chunk begins with each space, and with a text
        first[begins[ends > begins]] = True
        for k, at in cuts.items():
            first[begins[k] : ends[k]] = False
            if len(bodies[k]):
                first[begins[k] + at] = True
        starts = np.flatnonzero(first)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        at = coded.indices.to_numpy()
        known = self._chunks(coded.dictionary.to_pylist(), np.bincount(at, minlength=len(coded.dictionary)).tolist())
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        flat = pa.array(np.fromiter(chain.from_iterable(known), np.int32, int(sizes.sum())))
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), flat)
        ids = lists.take(coded.indices).flatten()
        before = np.append(0, np.cumsum(sizes[at]))
        return Encoded(ids, before[np.append(np.searchsorted(starts, begins), len(starts))])

    def written(self, got: Encoded) -> list[memoryview]:
        """For each text the ids as decimals with single spaces between."""
        return _texts(self.decimals.take(got.ids), got.offsets, 1)

    def decode(self, got: Encoded) -> list[memoryview]:
        """For each text the bytes that its ids stand for."""
        return _texts(self.bytes_of.take(got.ids), got.offsets, 0)


@dataclass
class Encoded:
    """The ids of texts one after the other; ``offsets[k]`` to ``offsets[k + 1]`` are text k's."""

    ids: pa.Array
    offsets: np.ndarray


def _texts(entries: pa.Array, offsets: np.ndarray, spare: int) -> list[memoryview]:
    """The bytes of the entries between offsets, less ``spare`` at the end where there are any."""
    if not len(entries):
        return [memoryview(b"")] * (len(offsets) - 1)
    ends = np.frombuffer(entries.buffers()[1], np.int64)[offsets]
    body = memoryview(entries.buffers()[2])
    return [body[a : max(a, b - spare)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def utf8_only(raw: bytes) -> bytes:
    """The bytes, with U+FFFD for what isn't UTF-8."""
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode("utf-8")
    return raw


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_codecs: dict[str, Codec] = {}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` per row, and ``ids`` if asked for.

    The driver reads the ranks, and the two tables are broadcast: their size is the vocabulary's. A
    null or empty text has no tokens; a text is encoded whole, whatever its length. Rows that repeat
    give equal rows, null identifiers pass through, an empty table gives none, and no other column is
    read. Text is taken as Spark holds it, in UTF-8; bytes that aren't are read as U+FFFD.
    """
    spark: SparkSession = docs.sparkSession
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, pattern, PerfectHash(ranks)))

    name = f"{spark.sparkContext.applicationId} {uuid.uuid4()}"

    def run(batches):
        codec = _codecs.get(name)
        if codec is None:  # one for each Python worker and call
            _codecs.clear()
            codec = _codecs[name] = Codec(*shared.value)

        def encoded(keys, bodies):
            gc.disable()  # nothing here makes cycles, and scanning what is remembered would cost more than the rest
            got = codec.encode(bodies)
            sha = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (codec.written(got), codec.decode(got))]
            columns = [pa.array(keys, pa.int64()), pa.array(np.diff(got.offsets), pa.int64()), *sha]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(got.offsets, pa.int32()), got.ids))
                names.append("ids")
            gc.enable()
            return pa.RecordBatch.from_arrays(columns, names)

        keys, bodies, held = [], [], 0
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                bodies.append(utf8_only(raw.as_py()))
                held += len(bodies[-1])
                if held >= TOGETHER or len(keys) >= TOGETHER_ROWS:
                    yield encoded(keys, bodies)
                    keys, bodies, held = [], [], 0
        if keys:
            yield encoded(keys, bodies)

    small_batches(spark)
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("body")).mapInArrow(run, schema)


def op10_bpe(spark, sf_dir, ranks_path: str | None = None):
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")
