"""Token counts: count the pieces of each distinct pre-token once and join to frequencies.

Rows of (document, pre-token, frequency) would be several times the input, so both sides are packed
by block. A block is a run of documents of a partition, at most ``block_bytes`` of text (8 to
64 MB by the number of partitions, or one longer document): it has a dictionary of its distinct pre-tokens and, for each document, the places
and frequencies in that dictionary. The dictionaries, cut by a hash of the pre-token, are shuffled
by that hash; there each distinct pre-token is counted once, by the library, and the counts return
to their blocks as arrays, where they are multiplied with the frequencies and summed. No ids are kept.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, documents, parallel, small_batches, utf8
from leafmill.llm.pretokens import Cutter

#: The pattern of byte-level pre-tokenizers (a fixed value of the format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pack(a, kind: str = "<u4") -> bytes:
    return zlib.compress(np.ascontiguousarray(a, dtype=kind).tobytes(), 1)


def unpack(b: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype=kind)


def read_spec(path: str) -> tuple[str, list[str]]:
    """The tokenizer file's text and its added tokens; raises if its pre-tokens aren't byte-level ones."""
    with open(path, encoding="utf-8") as f:
        said = f.read()
    spec = json.loads(said)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = spec.get("added_tokens") or []
    if not plain or spec.get("normalizer") or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
        raise ValueError(f"{path}: only byte-level tokenizers without a normalizer are split into pre-tokens here")
    return said, [a["content"] for a in added]


class Block:
    """Documents that share a dictionary of pre-tokens."""

    def __init__(self, cutter: Cutter):
        self.cutter = cutter
        self.place: dict[str, int] = {}
        self.chunk: dict[str, tuple[int, ...]] = {}
        self.docs: list[tuple[object, int, int, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key, raw: bytes, special: re.Pattern | None) -> None:
        text = raw.decode("utf-8", "replace")
        specials, stretches = 0, [text]
        if special is not None and special.search(text):
            specials, stretches = len(special.findall(text)), special.split(text)
        seen: Counter[str] = Counter()
        for s in stretches:
            seen.update(self.cutter.chunks(s))
        places: Counter[int] = Counter()
        for chunk, n in seen.items():
            got = self.chunk.get(chunk)
            if got is None:
                got = self.chunk[chunk] = tuple(self.place.setdefault(p, len(self.place)) for p in self.cutter.pieces(chunk) if p)
            for i in got:
                places[i] += n
        self.docs.append((key, len(raw), specials, np.fromiter(places.keys(), np.uint32, len(places)), np.fromiter(places.values(), np.uint32, len(places))))
        self.size += len(raw)

    def row(self, name: str, parts: int) -> dict:
        """Renumber by (hash part, first seen) and pack."""
        pieces = [p.encode("utf-8") for p in self.place]
        part = np.array([zlib.crc32(p) % parts for p in pieces], dtype=np.int64)
        order = np.argsort(part, kind="stable")
        new = np.empty(len(pieces), dtype=np.uint32)
        new[order] = np.arange(len(pieces), dtype=np.uint32)
        places, times = [], []
        for *_, i, n in self.docs:
            i = new[i]
            o = np.argsort(i)
            places.append(np.diff(i[o], prepend=np.uint32(0)))
            times.append(n[o])
        cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.uint32)
        asks = []
        for h in np.unique(part):
            mine = [pieces[i] for i in order[np.searchsorted(part[order], h, "left") : np.searchsorted(part[order], h, "right")]]
            asks.append({"part": int(h), "lengths": pack([len(p) for p in mine]), "bytes": zlib.compress(b"".join(mine), 1)})
        return {
            "block": name,
            "keys": [d[0] for d in self.docs],
            "n_bytes": [d[1] for d in self.docs],
            "specials": [d[2] for d in self.docs],
            "distinct": pack([len(d[3]) for d in self.docs]),
            "places": pack(cat(places)),
            "times": pack(cat(times)),
            "asks": asks,
        }


ASK = pa.struct([("part", pa.int32()), ("lengths", pa.binary()), ("bytes", pa.binary())])
BLOCK = pa.schema(
    [("block", pa.string()), ("keys", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("specials", pa.list_(pa.int64())), ("distinct", pa.binary()), ("places", pa.binary()), ("times", pa.binary()), ("asks", pa.list_(ASK))]
)
BLOCK_DDL = "block string, keys array<long>, n_bytes array<long>, specials array<long>, distinct binary, places binary, times binary, asks array<struct<part:int,lengths:binary,bytes:binary>>"


def token_counts(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", block_bytes: int | None = None) -> DataFrame:
    """``id, n_bytes, n_tokens`` per row: what the tokenizers library counts for the whole text.

    No begin, end or other special tokens are added; those spelled out in a text count one each, as
    the library does by default. Nulls count as empty (0 tokens). Rows that repeat are counted each,
    null identifiers pass through, an empty table gives none, other columns are not read.
    """
    spark = docs.sparkSession
    if block_bytes is None:  # with more parts larger blocks, so that a block's share in a part doesn't shrink to nothing
        block_bytes = min(64, max(8, parallel(spark) // 32)) << 20
    said, added = read_spec(tokenizer_path)
    special = "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True) if a) or None
    parts = parallel(spark, 16)
    shared = spark.sparkContext.broadcast(said)

    def blocks(batches):
        cutter, find, seq = Cutter(BYTE_LEVEL), re.compile(special) if special else None, 0
        task = TaskContext.get().partitionId()
        now = Block(cutter)

        def flush():
            return pa.RecordBatch.from_pylist([now.row(f"{task}-{seq}", parts)], schema=BLOCK)

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now.add(k, raw.as_py(), find)
                if now.size >= block_bytes:
                    yield flush()
                    now, seq = Block(cutter), seq + 1
        if now.docs:
            yield flush()

    def count(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        known: dict[bytes, int] = {}
        last = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] != last:  # rows come sorted by part: what was known is of no more use
                    known, last = {}, row["part"]
                ends = np.cumsum(unpack(row["lengths"]), dtype=np.int64).tolist()
                body = zlib.decompress(row["bytes"])
                pieces = [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                new = [p for p in pieces if p not in known]
                for at in range(0, len(new), 4096):
                    some = new[at : at + 4096]
                    for p, e in zip(some, tokenizer.encode_batch_fast([x.decode("utf-8") for x in some], add_special_tokens=False), strict=True):
                        known[p] = len(e)
                out.append({"block": row["block"], "part": row["part"], "counts": pack([known[p] for p in pieces])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("block", pa.string()), ("part", pa.int32()), ("counts", pa.binary())]))

    def total(batches):
        for batch in batches:
            for row in batch.to_pylist():
                got = sorted(row["got"] or [], key=lambda x: x["part"])
                counts = np.concatenate([unpack(x["counts"]) for x in got]).astype(np.int64) if got else np.zeros(0, np.int64)
                distinct = unpack(row["distinct"]).astype(np.int64)
                steps, times = unpack(row["places"]).astype(np.int64), unpack(row["times"]).astype(np.int64)
                sums, at = [], 0
                for n, extra in zip(distinct.tolist(), row["specials"], strict=True):
                    sums.append(int(counts[np.cumsum(steps[at : at + n])] @ times[at : at + n]) + extra)
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(sums, pa.int64())], ["id", "n_bytes", "n_tokens"])

    small_batches(spark)
    packed = cut(docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("body")).mapInArrow(blocks, BLOCK_DDL))
    asks = packed.select("block", F.explode("asks").alias("a")).select("block", "a.part", "a.lengths", "a.bytes")
    counted = asks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, "block string, part int, counts binary")
    # a block has at most ``parts`` rows here
    back = counted.groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias("got"))
    both = packed.drop("asks").join(back, "block", "left")
    return both.mapInArrow(total, "id long, n_bytes long, n_tokens long")


def op4_token_counts(spark, sf_dir, tokenizer_path: str | None = None):
    import public_tokenizers

    counts = token_counts(documents(spark, sf_dir), tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
