"""Lloyd's algorithm over distinct quantised vectors with their multiplicities.

Components become integers, so equal vectors are equal bytes: they are grouped once, however many
rows hold them, and the rounds run over distinct vectors weighted by their numbers. All sums are of
integers, exact in any order. Assignments are joined back to the rows at the end; vectors that very
many rows hold are dealt to as many parts as their numbers ask for.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, free_name, parallel

#: Quantised components up to this size give squared distances below 2**63.
LARGEST = 1 << 27


def quantised(vector: str, size: int, scale: int) -> Column:
    """``floor(scale * x)`` of every component; null for a vector that isn't ``size`` finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # multiplied as doubles, before anything is rounded to integers
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    whole = F.transform(whole, lambda x: F.when(F.abs(x) <= LARGEST, x.cast("int")).otherwise(F.raise_error(F.lit("a component is too large to be clustered exactly")).cast("int")))
    return F.when((F.size(vector) == size) & F.coalesce(fine, F.lit(False)), whole)


def packed(vectors: DataFrame, column: str) -> DataFrame:
    """The column of integer arrays as bytes (four a component), which group and join faster."""

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(column)
            lists = batch.column(k)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4")
            size = len(flat) // max(1, len(lists)) * 4
            offsets = np.arange(len(lists) + 1, dtype=np.int32) * size
            body = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield batch.set_column(k, column, body)

    kept = ", ".join(f"{f.name} {'binary' if f.name == column else f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, kept)


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the nearest centroid (the smaller one of equals) and the squared distance."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        d = np.einsum("ij,ij->i", d, d)
        closer = d < best
        best[closer], at[closer] = d[closer], k
    return at, best


def assigned(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add ``cluster`` and ``distance``."""
    shared = distinct.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, best = nearest(matrix(batch.column(0)), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(best)], ["vec", "weight", "cluster", "distance"])

    return distinct.select("vec", "weight").mapInArrow(run, "vec binary, weight long, cluster int, distance long")


def moved(distinct: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: the floor of each cluster's mean; those of empty clusters stay.

    Each batch sums its clusters; what comes to the driver is a sum for each cluster and component.
    """
    shared = distinct.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, w = matrix(batch.column(0)), batch.column(1).to_numpy()
                at, _ = nearest(x, shared.value)
                rows = []
                for k in np.unique(at).tolist():
                    mine = at == k
                    rows.append({"cluster": k, "weight": int(w[mine].sum()), "sums": (w[mine] @ x[mine]).tolist()})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("cluster", pa.int32()), ("weight", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    parts = distinct.select("vec", "weight").mapInArrow(run, "cluster int, weight long, sums array<long>")
    sums = parts.select("cluster", "weight", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("s").alias("s"), F.sum("weight").alias("n"))
    out = [list(c) for c in centroids]
    for r in sums.collect():  # clusters x components
        out[r["cluster"]][r["i"]] = r["s"] // r["n"]
    return out


def weighted_lloyd(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256``, a row for each row that is kept.

    Kept are vectors of ``size`` components, all of them finite numbers. The first centroids are those of the
    ``k`` kept rows with the smallest SHA-256 of ``seed:id`` (a null identifier comes last; rows of one
    identifier go by their vectors); with fewer rows there are fewer centroids. Rows that repeat are
    assigned each; an empty table, or one in which nothing is kept, gives none; other columns are not
    read. A component beyond 2**27 after scaling is an error, since distances would not be exact.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").alias("id"), quantised(f"`{vector}`", size, scale).alias("vec")).where("vec IS NOT NULL")
    rows = cut(packed(rows, "vec"))
    distinct = cut(rows.groupBy("vec").agg(F.count(F.lit(1)).alias("weight")))
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(by_hash.alias("h"), "vec").orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()  # k rows
    centroids = [np.frombuffer(r["vec"], "<i4").tolist() for r in first]
    if not centroids:
        centroids = [[0] * size]
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    told = cut(assigned(distinct, centroids))
    inertia = {r["cluster"]: r["s"] for r in told.groupBy("cluster").agg(F.sum(F.col("weight") * F.col("distance")).alias("s")).collect()}  # a row for each cluster
    about = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(inertia)]
    clusters = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    # a vector of more than a part's share of rows goes to several parts; there are at most as many of these as parts
    parts = parallel(spark)
    share = max(1, rows.count() // (4 * parts))
    hot = told.where(F.col("weight") > share).select("vec", F.ceil(F.col("weight") / share).cast("int").alias("copies"))
    dealt = rows.join(F.broadcast(hot), "vec", "left").select("id", "vec", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("copies")), F.lit(0)).cast("int").alias("part"))
    copies = F.when(F.col("weight") > share, F.ceil(F.col("weight") / share)).otherwise(1).cast("int")
    answers = told.select("vec", "cluster", "distance", F.explode(F.sequence(F.lit(0), copies - 1)).alias("part"))
    return dealt.join(answers, ["vec", "part"]).join(F.broadcast(clusters), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark, sf_dir):
    found = weighted_lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumnRenamed("id", "vec_id")


def _rounds(n: int) -> str:
    out = []
    for r in range(1, n + 1):
        out.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, min(s * 16 + n) % 16 AS n FROM (
    SELECT e.rid, c.n, sum((e.x - c.x) * (e.x - c.x)) AS s FROM e JOIN c{r - 1} c ON e.i = c.i GROUP BY e.rid, c.n) GROUP BY rid),
c{r} AS MATERIALIZED (
  SELECT c.n, c.i, coalesce(m.x, c.x) AS x FROM c{r - 1} c LEFT JOIN (
    SELECT a.n, e.i, CAST(floor(CAST(sum(e.x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{r} a JOIN e ON e.rid = a.rid GROUP BY a.n, e.i) m
  ON m.n = c.n AND m.i = c.i),""")
    return "".join(out)


#: The sums are small enough here for doubles to divide them exactly.
OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
raw AS (SELECT rid, unnest(range(64)) AS i, unnest(embedding) AS x FROM v),
fine AS (SELECT rid FROM raw GROUP BY rid HAVING count(x) = 64 AND bool_and(isfinite(x))),
e AS MATERIALIZED (SELECT rid, i, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM raw JOIN fine USING (rid)),
seed AS MATERIALIZED (
  SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS n
  FROM v JOIN fine USING (rid) ORDER BY sha256('1:' || vec_id) LIMIT 16),
c0 AS MATERIALIZED (SELECT n, i, x FROM seed JOIN e USING (rid)),{_rounds(3)}
d AS MATERIALIZED (
  SELECT rid, min(s * 16 + n) % 16 AS n, min(s * 16 + n) // 16 AS distance FROM (
    SELECT e.rid, c.n, sum((e.x - c.x) * (e.x - c.x)) AS s FROM e JOIN c3 c ON e.i = c.i GROUP BY e.rid, c.n) GROUP BY rid),
h AS (SELECT n, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY n)
SELECT v.vec_id, CAST(d.n AS INTEGER) AS cluster, CAST(d.distance AS BIGINT) AS distance,
       CAST(sum(d.distance) OVER (PARTITION BY d.n) AS BIGINT) AS cluster_inertia, CAST(sum(d.distance) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM d JOIN v USING (rid) JOIN h ON h.n = d.n
"""
