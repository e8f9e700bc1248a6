"""N-gram Jaccard join by parity sketches.

1. A text becomes its set of word n-grams. Equal sets are one class from here on.
2. The parts of a class's parity sketches (see :class:`leafmill.llm.parity.Bands`) are joined: similar
   sets share a part, and one of those that are rare for both. The classes that share such a part are
   a group.
3. Each group has a hub, the class that shares most (the original, if the group is one of copies); a
   hub's cluster is all classes of its groups. Every class is compared with its hubs: that gives links,
   and the difference of the class from the hub.
4. Two classes of a cluster that are in different components after that differ from each other in what
   their differences don't share. To be similar, with differences of d and e elements from the hub and
   at most L from each other, they share (d + e - L) / 2 elements of these, which is more than 0 (if it
   weren't, both were similar to the hub). So differences are joined as sets by their rarest elements,
   each with its place in the order of rarity, which bounds how many more can be shared. Copies with
   edits of their own share next to nothing there, and no group's pairs are listed.
5. What is left is rejected by the Hamming distance of whole sketches, a lower bound of the symmetric
   difference, or verified on the texts' sets.
6. Components of all links, each named by its smallest document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, documents, join_sized, release, small_batches, utf8
from leafmill.llm.components import components
from leafmill.llm.frequency import BLOCK_KEYS, MASK, counts_of, pack_keys, unpack_keys, with_counts
from leafmill.llm.parity import Bands, Shingler, hamming, mix, sketch

SETS = "block string, rows array<struct<id:long,th:long,n:long,hi:long,lo:long,sketch:binary>>, keys binary, row binary, length binary, spare binary"
ROW = pa.struct([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sketch", pa.binary())])
SET_SCHEMA = pa.schema([("block", pa.string()), ("rows", pa.list_(ROW)), ("keys", pa.binary()), ("row", pa.binary()), ("length", pa.binary()), ("spare", pa.binary())])
#: Rows in a block at most.
BLOCK_ROWS = 4096


def with_hash(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, the text's own hash, which tells rows apart where identifiers don't, and the text."""
    body = utf8(text)
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(body).alias("th"), body.alias("body"))


def shingle_sets(rows: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """Blocks of rows with size, signature and sketch of each row's set, and the keys of its parts.

    Of equal sets in a block only the first has keys.
    """

    def run(batches):
        shingles, bands = Shingler(width), Bands(p, q)
        task, seq = TaskContext.get().partitionId(), 0

        def block():
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            lists = [np.array(x, "<u4").tobytes() for x in (row, length, spare)]
            return pa.RecordBatch.from_pylist([dict(zip(SET_SCHEMA.names, (f"{task}-{seq}", rows, pack_keys(flat), *lists), strict=True))], schema=SET_SCHEMA)

        rows, keys, row, length, spare, seen, held = [], [], [], [], [], set(), 0
        for batch in batches:
            for i, th, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingles(raw.as_py())
                sign = xxhash.xxh3_128_digest(s.tobytes())
                hi, lo = int.from_bytes(sign[:8], "little", signed=True), int.from_bytes(sign[8:], "little", signed=True)
                for k, may_go in () if sign in seen else bands.keys(s):
                    keys.append(k)
                    row.append(len(rows))
                    length.append(len(k))
                    spare.append(may_go)
                    held += len(k)
                seen.add(sign)
                rows.append({"id": i, "th": th, "n": len(s), "hi": hi, "lo": lo, "sketch": sketch(s) if len(s) else b""})
                if held >= BLOCK_KEYS or len(rows) >= BLOCK_ROWS:
                    yield block()
                    seq += 1
                    rows, keys, row, length, spare, seen, held = [], [], [], [], [], set(), 0
        if rows:
            yield block()

    return rows.mapInArrow(run, SETS)


def _from_top(owner: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by owner, most frequent key first, and the place of each within its owner."""
    order = np.lexsort((keys, -counts.astype(np.int64), owner))
    sorted_ = owner[order]
    starts = np.flatnonzero(np.diff(sorted_, prepend=-1))
    return order, np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))


def rare_parts(blocks: DataFrame, firsts: DataFrame) -> DataFrame:
    """``key, node, weight``: parts of the sketches of ``firsts`` that others may share and that may not be left out.

    ``weight`` is how often a class's parts occur in all.
    """

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts = unpack_keys(r["keys"]), counts_of(unpack_keys(r["keys"]), r["got"])
                row, length, spare = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("row", "length", "spare"))
                own = np.zeros(len(r["hi"]), bool)
                own[r["at"] or []] = True
                inst = np.repeat(np.arange(len(row)), length)
                order, place = _from_top(inst, counts, keys)
                of = inst[order]
                kept = order[(place >= spare[of]) & own[row[of]] & (counts[order] > 1)]
                of = row[inst[kept]]
                weight = np.bincount(of, counts[kept], len(own)).astype(np.int64)
                node = np.array(r["hi"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[kept].view(np.int64)), pa.array(node[of]), pa.array(weight[of])], ["key", "node", "weight"])

    asked = with_counts(blocks).join(firsts.groupBy("block").agg(F.collect_list("at").alias("at")), "block", "left")
    return asked.select("keys", "row", "length", "spare", "got", "at", F.col("rows.hi").alias("hi")).mapInArrow(run, "key long, node long, weight long")


def close_sketches(pairs: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs ``a, b`` whose sketches' Hamming distance leaves them the chance of being similar."""
    a = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    # sizes alone already exclude some: the smaller one is the most they share, the larger one the least of the union
    both = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * q >= F.greatest("na", "nb") * p)

    def run(batches):
        bands = Bands(p, q)
        for batch in batches:
            c = batch.to_pydict()
            fit = [hamming(x, y) <= bands.differ(m + n) for x, y, m, n in zip(c["sa"], c["sb"], c["na"], c["nb"], strict=True)]
            yield batch.filter(pa.array(fit, pa.bool_())).select(["a", "b"])

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def differences(pairs: DataFrame, texts: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """For pairs ``a, b``: sizes, the size of the symmetric difference, if they are similar, and the difference itself where ``wanted``.

    ``b`` is the one that occurs in many pairs: its set is made once for those that stand together.
    """
    a = texts.select(F.col("node").alias("a"), F.col("body").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("body").alias("tb"))

    def run(batches):
        shingles = Shingler(width)
        last, hub = None, None
        for batch in batches:
            n, m, d, fit, diff = [], [], [], [], []
            for y, wanted, ta, tb in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if y != last:
                    last, hub = y, shingles(tb.as_py())
                mine = shingles(ta.as_py())
                far = np.setxor1d(mine, hub, assume_unique=True)
                common = (len(mine) + len(hub) - len(far)) // 2
                n.append(len(mine))
                m.append(len(hub))
                d.append(len(far))
                fit.append(common > 0 and q * common >= p * (common + len(far)))
                diff.append(far.tobytes() if wanted else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(d, pa.int64()), pa.array(fit, pa.bool_()), pa.array(diff, pa.binary())],
                ["a", "b", "n", "m", "d", "similar", "diff"],
            )

    both = pairs.join(a, "a").join(b, "b").sortWithinPartitions("b")
    return both.select("a", "b", "wanted", "ta", "tb").mapInArrow(run, "a long, b long, n long, m long, d long, similar boolean, diff binary")


PLACED = "ck long, node long, comp long, own boolean, n long, d long, i long, reach long"


def placed_elements(clusters: DataFrame, p: int, q: int) -> DataFrame:
    """The elements of differences that a similar set's difference may share, with their places.

    ``reach`` is the largest difference of a partner that can share enough from place ``i`` on.
    """
    fields = ("node", "comp", "own", "n", "d")
    schema = pa.schema([("block", pa.string()), *((f, pa.list_(pa.bool_() if f == "own" else pa.int64())) for f in fields), ("keys", pa.binary())])

    def pack(batches):
        task, seq = TaskContext.get().partitionId(), 0
        rows, keys, held = [], [], 0

        def block():
            lists = {f: [r[f] for r in rows] for f in fields}
            return pa.RecordBatch.from_pylist([{"block": f"{task}-{seq}", **lists, "keys": pack_keys(np.concatenate(keys))}], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                hub = np.array([r["hub"]], np.int64).view(np.uint64)
                keys.append(mix(np.frombuffer(r.pop("diff"), np.uint64) ^ mix(hub)) & MASK)
                rows.append(r)
                held += len(keys[-1])
                if held >= BLOCK_KEYS or len(rows) >= BLOCK_ROWS:
                    yield block()
                    seq += 1
                    rows, keys, held = [], [], 0
        if rows:
            yield block()

    def place(batches):
        bands = Bands(p, q)
        for batch in batches:
            for r in batch.to_pylist():
                keys = unpack_keys(r["keys"])
                counts = counts_of(keys, r["got"])
                n, d = np.array(r["n"], np.int64), np.array(r["d"], np.int64)
                own = np.repeat(np.arange(len(d)), d)
                order, top = _from_top(own, counts, keys)
                of = own[order]
                i = d[of] - 1 - top  # the rarest is the first
                widest = np.array([bands.differ(int(x) + int(x) * q // p) for x in n], np.int64)
                reach = d[of] - 2 * i + widest[of]
                keep = (counts[order] > 1) & (reach > 0)
                of, at = of[keep], order[keep]
                columns = [keys[at].view(np.int64), np.array(r["node"], np.int64)[of], np.array(r["comp"], np.int64)[of], np.array(r["own"], bool)[of], n[of], d[of], i[keep], reach[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["ck", "node", "comp", "own", "n", "d", "i", "reach"])

    ddl = "block string, node array<long>, comp array<long>, own array<boolean>, n array<long>, d array<long>, keys binary"
    blocks = cut(clusters.select("hub", *fields, "diff").mapInArrow(pack, ddl))
    return with_counts(blocks).mapInArrow(place, PLACED)


def within_reach(rows: DataFrame) -> DataFrame:
    """The rows that may have a partner at the same element, told by the least and most that others have there.

    ``own`` are those of the hub's component, which need no partner among themselves.
    """
    seen = [F.min(F.when(own, F.col("d"))).alias(f"{x}_d") for x, own in (("in", F.col("own")), ("out", ~F.col("own")))]
    seen += [F.max(F.when(own, F.col("reach"))).alias(f"{x}_reach") for x, own in (("in", F.col("own")), ("out", ~F.col("own")))]
    bounds = rows.groupBy("ck").agg(*seen, F.count(F.lit(1)).alias("c")).where("c > 1 and out_d is not null").drop("c")
    outside = (F.col("reach") >= F.col("out_d")) & (F.col("d") <= F.col("out_reach"))
    inside = (F.col("reach") >= F.col("in_d")) & (F.col("d") <= F.col("in_reach")) & ~F.col("own")
    return cut(rows.join(bounds, "ck").where(outside | F.coalesce(inside, F.lit(False))).select(*rows.columns))


def cluster_pairs(differing: DataFrame, labels: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs ``a, b`` of clusters' classes in different components that may be similar (step 4)."""
    comp = labels.select(F.col("node").alias("a"), "comp")
    hub_comp = labels.select(F.col("node").alias("b"), F.col("comp").alias("hub_comp"))
    now = differing.where("diff is not null").join(comp, "a", "left").join(hub_comp, "b", "left")
    comp_, hub_ = F.coalesce("comp", F.col("a")), F.coalesce("hub_comp", F.col("b"))
    now = now.select(F.col("b").alias("hub"), F.col("a").alias("node"), comp_.alias("comp"), (comp_ == hub_).alias("own"), "n", "d", "diff")
    open_ = now.groupBy("hub").agg(F.min("own").alias("closed")).where("not closed").select("hub")
    rows = within_reach(cut(placed_elements(now.join(open_, "hub", "left_semi"), p, q)))
    rows = within_reach(rows)  # once more, without those that only the first pass's rows could reach
    x = rows.select("ck", *(F.col(c).alias(f"x_{c}") for c in ("node", "comp", "n", "d", "i")))
    y = rows.select("ck", *(F.col(c).alias(f"y_{c}") for c in ("node", "comp", "n", "d", "i")))
    apart = F.floor((F.col("x_n") + F.col("y_n")) * (q - p) / F.lit(q + p))
    enough = 2 * F.least(F.col("x_d") - F.col("x_i"), F.col("y_d") - F.col("y_i")) >= F.col("x_d") + F.col("y_d") - apart
    both = x.join(y, "ck").where((F.col("x_node") < F.col("y_node")) & (F.col("x_comp") != F.col("y_comp")) & enough)
    return both.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def _link(members: DataFrame, nodes_of, p: int, q: int, width: int):
    """Component labels ``node, comp`` of all classes that are linked, or None without any link.

    ``nodes_of(nodes)`` gives their sketches and texts.
    """
    spark = members.sparkSession
    top = F.max(F.struct("weight", "node")).alias("top")
    hubs = members.groupBy("key").agg(top, F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.col("top.node").alias("b"))
    pairs = cut(members.join(hubs, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    release(spark)
    if not pairs.take(1):
        return None
    sketches, texts = nodes_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    counted = pairs.join(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c")), "b")
    # the only class beside a hub is compared with no other, so that a rejected one needs no text
    alone = close_sketches(counted.where("c = 1").select("a", "b"), sketches, p, q).withColumn("wanted", F.lit(False))
    compared = counted.where("c > 1").select("a", "b", F.lit(True).alias("wanted")).union(alone)
    differing = cut(differences(compared, texts, width, p, q))
    links = differing.where("similar").select("a", "b")
    if not links.take(1):
        labels = spark.createDataFrame([], "node long, comp long")
    else:
        labels = cut(components(links))
    release(spark)
    found = cut(close_sketches(cluster_pairs(differing, labels, p, q), sketches, p, q).withColumn("wanted", F.lit(False)))
    if found.take(1):
        more = cut(differences(found, texts, width, p, q).where("similar").select("a", "b"))
        if more.take(1):
            # the components so far are stars; with the new links they are all that counts
            labels = cut(components(more.union(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")))))
    return labels


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, p: int = 8, q: int = 10) -> DataFrame:
    """``id, n_shingles, component_id, text_hash, first`` per row: documents with Jaccard similarity ``p/q`` or more are linked.

    Shingles are ``width`` words; texts without words, null ones among them, are linked with nothing,
    and shorter ones are one shingle. Components are named by their smallest identifier; null
    identifiers name none unless a component has no others. ``first`` marks the row that stands for its
    component (by identifier, null last, then text; rows that repeat both are all marked), and
    every row that is linked with nothing. ``text_hash`` (``xxhash64`` of the text) tells rows of one
    identifier apart. Rows that repeat are one class. No links are left out, whatever a group's size:
    see the module's text. Sets are compared by 64-bit hashes of their shingles. Empty tables give an
    empty result, other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = with_hash(docs, key, text)
    blocks = cut(shingle_sets(source, width, p, q))
    sets = cut(blocks.select("block", F.posexplode("rows").alias("at", "r")).select("block", "at", "r.*").withColumnRenamed("hi", "node"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    rep = F.min(F.struct("block", "at", "th")).alias("rep")
    classes = cut(sets.where("n > 0").groupBy("node", "lo").agg(F.min(place).alias("place"), rep).select("node", "lo", "place", "rep.*"))
    members = cut(rare_parts(blocks, classes.select("block", "at")))
    del blocks
    release(spark)

    def nodes_of(nodes):
        here = cut(join_sized(classes.select("node", "block", "at", "th"), cut(nodes), "node", row_bytes=24))
        sketches = cut(sets.select("block", "at", "n", "sketch").join(here.select("block", "at", "node"), ["block", "at"]).select("node", "n", "sketch"))
        bodies = join_sized(source.select("th", "body"), here.select("th", "node"), "th", row_bytes=32)
        return sketches, cut(bodies.select("node", "body").dropDuplicates(["node"]))

    labels = _link(members, nodes_of, p, q, width)
    named = classes.select("node", "lo", "place")
    if labels is not None:
        best = named.join(labels, "node").groupBy("comp").agg(F.min("place").alias("best"))
        named = named.join(labels, "node", "left").join(best, "comp", "left").select("node", "lo", F.coalesce("best", "place").alias("place"))
    rows = sets.select("id", "th", "n", "node", "lo").join(named, ["node", "lo"], "left")
    linked = (F.col("n") > 0) & F.col("place.id").isNotNull()
    stands = (F.col("n") == 0) | (F.col("id").eqNullSafe(F.col("place.id")) & (F.col("th") == F.col("place.th")))
    return rows.select("id", F.col("n").alias("n_shingles"), F.when(linked, F.col("place.id")).otherwise(F.col("id")).alias("component_id"), F.col("th").alias("text_hash"), stands.alias("first"))


def op1_near_dups(spark, sf_dir):
    found = jaccard_components(documents(spark, sf_dir), width=3, p=9, q=10)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
