"""Centroid clustering in whole numbers: partial distances over dimensions of high variance first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Dimensions that are summed between two looks at which centroids are still near enough.
STEP = 8
#: Components beyond this are refused: their squared distances might not fit in 64 bits.
LARGEST = 2**27
#: Rows that a kernel compares at once.
ROWS = 8_192


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, the smaller number where two are as near.

    Centroids come in turn. A row adds up its squared differences in ``order``, a few dimensions a step, and
    leaves a centroid once its sum is strictly above the row's best; rows that stay finish all dimensions.
    """
    vectors, centroids = np.ascontiguousarray(vectors[:, order]), centroids[:, order]
    best, number = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int32)
    for k, centroid in enumerate(centroids):
        rows, part = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        for at in range(0, len(order), STEP):
            gap = vectors[rows, at : at + STEP] - centroid[at : at + STEP]
            part = part + np.einsum("ij,ij->i", gap, gap)
            near = part <= best[rows]
            if not near.all():
                rows, part = rows[near], part[near]
        closer = part < best[rows]
        best[rows[closer]], number[rows[closer]] = part[closer], k
    return number, best


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, v): rows whose vector has exactly ``dimensions`` components, none null or not finite; v = floor(scale * x)."""
    vector = F.col(vector_col).cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.where((F.size(vector) == dimensions) & ~odd)
    most = F.lit(LARGEST / scale)
    fits = lambda x: F.when(F.abs(x) < most, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")))
    return kept.select(F.col(id_col).alias("id"), F.transform(vector, fits).alias("v"))


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("v"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _matrix(part, dimensions)


def _spread(dimensions: int):
    """Per task: the count, and each dimension's sum and sum of squares as floats; they only choose an order."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        for _, m in _blocks(batches, dimensions):
            m = m.astype(np.float64)
            n, sums, squares = n + len(m), sums + m.sum(0), squares + (m * m).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dimensions), pa.int32()), pa.array([float(n)] * dimensions), pa.array(sums), pa.array(squares)], ["dimension", "n", "s", "q"]
        )

    return kernel


def _sums(centroids: np.ndarray, order: np.ndarray):
    """Per task: for each centroid with rows, their count and component sums (decimal texts, as they may outgrow
    64 bits between tasks)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dimensions = centroids.shape
        counts, sums = [0] * k, [[0] * dimensions for _ in range(k)]
        for _, m in _blocks(batches, dimensions):
            number, _ = nearest(m, centroids, order)
            for c in np.unique(number):
                rows = m[number == c]
                counts[c] += len(rows)
                sums[c] = [a + b for a, b in zip(sums[c], rows.sum(0).tolist())]
        found = [(c, d, counts[c], str(sums[c][d])) for c in range(k) if counts[c] for d in range(dimensions)]
        kinds = pa.int32(), pa.int32(), pa.int64(), pa.string()
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], ["cluster", "dimension", "n", "s"])

    return kernel


def _assigned(centroids: np.ndarray, order: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m in _blocks(batches, centroids.shape[1]):
            number, distance = nearest(m, centroids, order)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number), pa.array(distance)], ["id", "cluster", "distance"])

    return kernel


def cluster_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    salt: str = "3:",
) -> DataFrame:
    """Per kept vector: its id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    Vectors become whole numbers once and are written; every round reads them, sums each cluster within a task,
    and only k rows of sums a task are shuffled, whatever a cluster's size or the copies of a vector. The driver
    holds k centroids. Sums are exact, so that a result doesn't depend on tasks or their order.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite. The first centroids are the k
    kept vectors with the least sha256 of salt and id (null ids last; repeated ids by their components); with fewer
    vectors there are fewer centroids, and with none no rows. Ties go to the smaller number, and a centroid that
    loses all its vectors stays. Repeated rows and null ids are vectors as others are. Other columns aren't looked
    at. Components of 2^27 / 1024 or more are an error, as their distance may not fit in 64 bits.
    """
    vectors = written(whole_vectors(df, id_col, vector_col, dimensions))
    text = F.concat(F.lit(salt), F.col("id").cast("string"))
    first = vectors.orderBy(F.sha2(text, 256).asc_nulls_last(), "v").limit(k).collect()
    shape = f"id {dict(vectors.dtypes)['id']}, cluster int, distance long"
    if not first:
        nothing = vectors.select("id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
        return nothing.withColumnRenamed("id", id_col)
    spread = vectors.mapInArrow(_spread(dimensions), "dimension int, n double, s double, q double").groupBy("dimension")
    variance = {r["dimension"]: r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in spread.agg(*(F.sum(c).alias(c) for c in "nsq")).collect()}
    order = np.array(sorted(range(dimensions), key=lambda d: (-variance[d], d)))
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        parts = vectors.mapInArrow(_sums(centroids, order), "cluster int, dimension int, n long, s string")
        totals = parts.groupBy("cluster", "dimension").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        centroids = centroids.copy()
        for r in totals.collect():  # k x dimensions rows
            centroids[r["cluster"], r["dimension"]] = int(r["s"]) // r["n"]
    found = written(vectors.mapInArrow(_assigned(centroids, order), shape))
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    rows = [(c, s, sum(inertia.values()), digest(c)) for c, s in inertia.items()]
    about = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> str:
    """SQL for DuckDB: a row for each vector and dimension, and one step for each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"d{r} as materialized (select id, c, sum((x - y) * (x - y)) as d from v join c{r} using (i) group by 1, 2),\n"
            f"a{r} as materialized (select id, c, d from d{r} qualify row_number() over (partition by id order by d, c) = 1)"
        )
        if r < rounds:
            steps.append(
                f"m{r} as materialized (select c, i, floor_div(sum(x), count(*)) as y from v join a{r} using (id) group by 1, 2),\n"
                f"c{r + 1} as materialized (select c, i, coalesce(m.y, o.y) as y from c{r} o left join m{r} m using (c, i))"
            )
    chain = ",\n".join(steps).replace("floor_div(sum(x), count(*))", "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)")
    return f"""
with e as (select row_number() over () as id, vec_id, embedding from embeddings where len(embedding) = {dimensions}
  and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dimensions}),
v as materialized (select id, i, floor({scale} * embedding[i]::double)::hugeint as x from e, range(1, {dimensions + 1}) t(i)),
f as (select id, row_number() over (order by sha256('3:' || vec_id), embedding) - 1 as c from e qualify c < {k}),
c0 as materialized (select c, i, x as y from v join f using (id)),
{chain},
t as (select c, sha256(string_agg(y::bigint::varchar, ',' order by i)) as s from c{rounds} group by 1)
select vec_id, c::int as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, s as centroid_sha256
from a{rounds} join e using (id) join t using (c)"""
