"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is scaled to length 1, rotated by a seeded random orthogonal matrix and kept as the signs of its
coordinates, packed into bits, with one correction scalar: its inner product with the unit vector of its signs. The
inner product with a rotated query is estimated from the bits and divided by that scalar; the scalar also bounds the
error at BOUND standard deviations. In each block the FIRST candidates by estimate are scored exactly, in double precision
on the original vectors; then all whose upper bound reaches the k-th best of these, so that only the bound's tail can
lose a neighbour.

Queries and indexed rows meet in blocks of fixed sizes; a block pair returns k rows for each query. Nothing is fitted
on the data: the rotation depends on the dimension and the seed alone.

Defined cases: vectors that are null, empty, of length zero or holding null or non-finite components take no part, nor
do rows without an id. Vectors of different dimensions are not compared. Of rows that repeat a query's id, the one
whose vector sorts first is the query, and none of them is its candidate. With fewer candidates than k, all are
returned. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

DATA_BLOCK = 8192
QUERY_BLOCK = 4096
BOUND = 4.0
#: Candidates of a block that are scored before the bounds are looked at.
FIRST = 64
SEED = 20


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for each dimension and seed."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def index(vectors: DataFrame, id_col="vec_id", vector_col="embedding", seed: int = SEED) -> DataFrame:
    """All valid rows with their codes: vec_id, vec (doubles), dim, norm, code (packed bits), align; staged."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec_id"), vec.alias("vec")).where(F.coalesce(fine, F.lit(False)) & (F.size("vec") > 0))
    rows = rows.withColumn("dim", F.size("vec")).withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    rows = rows.where((F.col("norm") > 0) & (F.col("norm") < float("inf")))

    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            code, align = np.full(b.num_rows, None, dtype=object), np.zeros(b.num_rows)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                some = b.take(pa.array(at))
                z = _matrix(some.column(1), dim) / some.column(3).to_numpy()[:, None] @ rotation(dim, seed)
                code[at] = [x.tobytes() for x in np.packbits(z > 0, axis=1)]
                align[at] = np.abs(z).sum(axis=1) / np.sqrt(dim)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.binary()), pa.array(align)], names=[*b.schema.names, "code", "align"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return common.stage(rows.mapInArrow(run, f"vec_id {kind}, vec array<double>, dim int, norm double, code binary, align double"), "codes")


def _search(k: int, bound: float, seed: int, out: pa.Schema):
    def run(queries, data):
        if not queries.num_rows or not data.num_rows:
            return out.empty_table()
        dim = data["dim"][0].as_py()
        q, x = _matrix(queries["vec"], dim), _matrix(data["vec"], dim)
        q_norm, x_norm = queries["norm"].to_numpy(), data["norm"].to_numpy()
        q_id, x_id = queries["vec_id"].to_numpy(zero_copy_only=False), data["vec_id"].to_numpy(zero_copy_only=False)
        zq = (q / q_norm[:, None] @ rotation(dim, seed) / np.sqrt(dim)).astype(np.float32)
        bits = np.frombuffer(b"".join(data["code"].to_pylist()), np.uint8).reshape(len(x), -1)
        signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
        align = data["align"].to_numpy()
        error = (bound * np.sqrt(np.maximum(0, 1 - align**2)) / align / np.sqrt(max(1, dim - 1)) + 1e-5).astype(np.float32)
        exact = lambda i, rows: (x[rows] * q[i]).sum(axis=1) / (x_norm[rows] * q_norm[i])
        found = [[], [], []]
        for low in range(0, len(q), 64):
            about = zq[low : low + 64] @ signs.T / align.astype(np.float32)
            for i, row in enumerate(about, low):
                other = np.flatnonzero(x_id != q_id[i])
                if len(other) > FIRST:  # the k-th best of the most promising is a floor that the others' bounds must reach
                    first = other[np.argpartition(row[other], -FIRST)[-FIRST:]]
                    floor = np.partition(exact(i, first), -k)[-k] if k <= FIRST else -np.inf
                    other = other[row[other] + error[other] >= floor - 1e-9]
                near, score = other, exact(i, other)
                best = np.lexsort((x_id[near], -score))[:k]
                found[0].extend([q_id[i]] * len(best)), found[1].extend(x_id[near[best]]), found[2].extend(score[best])
        return pa.table([pa.array(c, f.type) for c, f in zip(found, out)], schema=out)

    return run


def search(codes: DataFrame, is_query: Column, k: int = 5, bound: float = BOUND, seed: int = SEED, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """The k nearest other rows of each row that is_query picks, by cosine: query_id, rank, vec_id, score."""
    n = {r.dim: (r.n, r.q) for r in codes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).collect()}
    sizes = F.lit(None).cast("array<int>")
    for dim, (rows, asked) in n.items():  # a few dimensions
        sizes = F.when(F.col("dim") == dim, F.array(F.lit(-(-rows // data_block)), F.lit(max(1, -(-asked // query_block))))).otherwise(sizes)
    hashed = F.xxhash64("vec_id")
    every = lambda i: F.explode(F.sequence(F.lit(0), (sizes[i] - 1).cast("int")))
    one = lambda i: F.pmod(hashed, sizes[i].cast("long")).cast("int")
    asked = codes.where(is_query).groupBy("vec_id").agg(F.min(F.struct("vec", "dim", "norm")).alias("r")).select("vec_id", "r.*")
    asked = asked.withColumn("q_block", one(1)).withColumn("x_block", every(0))
    data = codes.withColumn("x_block", one(0)).withColumn("q_block", every(1))
    kind = codes.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {kind}, score double"
    out = pa.schema([(f.name, f.type) for f in common.arrow_schema(codes.sparkSession.createDataFrame([], schema).schema)])
    keys = ("dim", "q_block", "x_block")
    near = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(_search(k, bound, seed, out), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(common.read_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) / (q.norm * x.norm) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.e) = len(x.e)
  WHERE q.vec_id % 50 = 0 AND q.norm > 0 AND x.norm > 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
