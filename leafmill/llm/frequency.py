"""How often each of many keys occurs, without a row for each key.

Keys of 48 bits stand in blocks. A block sends its distinct keys with their numbers of occurrences,
cut by key range and packed, to where the range is counted; the sums return to the block as arrays.
A key travels in about five bytes, once for each block that has it, however often it occurs there.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, parallel

BITS = 48
MASK = np.uint64((1 << BITS) - 1)
#: Keys in a block, unless one row alone has more.
BLOCK_KEYS = 1 << 20


def pack(a, kind: str = "<u4") -> bytes:
    return zlib.compress(np.ascontiguousarray(a, dtype=kind).tobytes(), 1)


def unpack(b: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype=kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Six bytes a key, in order."""
    low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
    return low.tobytes() + (keys >> np.uint64(32)).astype("<u2").tobytes()


def unpack_keys(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return np.frombuffer(b, "<u4", n).astype(np.uint64) | (np.frombuffer(b, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


ASK = pa.schema([("block", pa.string()), ("part", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("times", pa.binary())])
ANSWER = pa.schema([("block", pa.string()), ("part", pa.int32()), ("counts", pa.binary())])


def counts_of(keys: np.ndarray, got: list[dict] | None) -> np.ndarray:
    """For each of a block's keys, in their order, how often it occurs in all blocks."""
    if not len(keys):
        return np.zeros(0, np.uint32)
    counts = np.concatenate([unpack(x["counts"]) for x in sorted(got or [], key=lambda x: x["part"])])
    return counts[np.unique(keys, return_inverse=True)[1]]


def with_counts(blocks: DataFrame) -> DataFrame:
    """``blocks`` (``block``, ``keys`` as of :func:`pack_keys`, and others) with the answers as ``got``, for :func:`counts_of`.

    ``blocks`` has to be a table that has been cut, since its rows are read twice.
    """
    parts = min(parallel(blocks.sparkSession, 16), 1 << 16)

    def ask(batches):
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, times = np.unique(unpack_keys(packed.as_py()), return_counts=True)
                if not len(keys):
                    continue
                part = ((keys * np.uint64(parts)) >> np.uint64(BITS)).astype(np.int64)
                starts = np.flatnonzero(np.diff(part, prepend=-1))
                rows = []
                for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True):
                    mine = keys[a:b]
                    high = np.diff(mine >> np.uint64(32), prepend=np.uint64(0))
                    rows.append({"block": name, "part": int(part[a]), "low": (mine & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), "high": pack(high, "<u2"), "times": pack(times[a:b])})
                yield pa.RecordBatch.from_pylist(rows, schema=ASK)

    def count(batches):
        def answer(rows):
            keys = [np.frombuffer(r["low"], "<u4").astype(np.uint64) | (np.cumsum(unpack(r["high"], "<u2"), dtype=np.uint64) << np.uint64(32)) for r in rows]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(place, np.concatenate([unpack(r["times"]) for r in rows]), len(distinct)).astype(np.int64)[place]
            ends = np.cumsum([len(k) for k in keys])
            each = np.split(np.minimum(sums, 2**32 - 1), ends[:-1])
            return pa.RecordBatch.from_pylist([{"block": r["block"], "part": r["part"], "counts": pack(c)} for r, c in zip(rows, each, strict=True)], schema=ANSWER)

        held, part = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part and held:
                    yield answer(held)
                    held = []
                part = row["part"]
                held.append(row)
        if held:
            yield answer(held)

    asks = blocks.select("block", "keys").mapInArrow(ask, "block string, part int, low binary, high binary, times binary")
    counted = cut(asks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, "block string, part int, counts binary"))
    # a block has at most ``parts`` answers
    return blocks.join(counted.groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias("got")), "block", "left")
