"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to length one and rotated by a fixed random rotation; the signs of the rotated components are
packed into bits, beside one correction scalar (the inner product of the rotated vector with its own
code). The inner product of a query with a vector is estimated from the packed bits and that scalar, with an
error bound that shrinks with the dimension. In each shard, vectors whose upper bound reaches the k-th best lower
bound are reranked by their exact cosine in double precision.

Base vectors are dealt to shards of bounded size by a hash of their id, and the queries go to every shard, a stated
query set against all rows in blocks. A task holds one shard and takes queries in batches, so its memory does not
grow with the number of queries or of vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids; vectors
are compared with those of their own dimension; rows that repeat an id count once (the smallest vector); ties go to the
smaller id; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadencia.llm import common

#: Half-width of the estimate's error bound in standard deviations.
EPSILON = 2.5
SHARD_ROWS = 16_384
LEAST_SHARDS = 24
_BASE_BLOCK, _QUERY_BLOCK = 4_096, 256


def rotation(dimension: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dimension]).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction scalars) of vectors of length one."""
    turned = vectors @ turn.T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])


def estimate(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, queries x codes; error bound of each code)."""
    dimension = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dimension).astype(np.float32) * 2 - 1
    products = (queries @ turn.T).astype(np.float32) @ signs.T / np.sqrt(dimension)
    scalars = np.maximum(scalars, 1e-6)
    bound = EPSILON * np.sqrt(np.maximum(1 - scalars**2, 0)) / scalars / np.sqrt(max(dimension - 1, 1)) + 1e-5
    return products / scalars.astype(np.float32), bound.astype(np.float32)


def cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, query_norm: float) -> np.ndarray:
    return (vectors * query).sum(1) / (norms * query_norm)


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, common.power_scaled(vectors)
        vectors = self.vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.turn = rotation(vectors.shape[1])
        self.codes, self.scalars = encode(vectors / self.norms[:, None], self.turn)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        queries = common.power_scaled(queries)
        norms = np.sqrt((queries * queries).sum(1))
        unit = queries / norms[:, None]
        low = np.full((len(queries), k), -np.inf, np.float32)  # the k best lower bounds so far
        upper = []
        for a in range(0, len(self.ids), _BASE_BLOCK):
            block = slice(a, a + _BASE_BLOCK)
            guess, bound = estimate(self.codes[block], self.scalars[block], unit, self.turn)
            own = self.ids[block][None, :] == query_ids[:, None]
            lower = np.where(own, -np.inf, guess - bound)
            low = np.sort(np.concatenate([low, np.partition(lower, -min(k, lower.shape[1]), axis=1)[:, -k:]], axis=1), axis=1)[:, -k:]
            upper.append(np.where(own, -np.inf, guess + bound))
        upper = np.concatenate(upper, axis=1)
        for i in range(len(queries)):
            near = np.flatnonzero(upper[i] >= max(low[i, 0], -1e30))
            score = cosines(self.vectors[near], self.norms[near], queries[i], norms[i])
            for j in np.lexsort((self.ids[near], -score))[:k]:
                yield int(query_ids[i]), int(self.ids[near][j]), float(score[j])


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & good & F.exists("v", lambda x: x != 0))


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest base vectors of each query other than the row of its own id."""
    base, queries = _usable(base, id_col, vector_col), _usable(queries, id_col, vector_col)
    shards = max(LEAST_SHARDS, -(-base.count() // SHARD_ROWS))
    dealt = base.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "v")
    asked = queries.groupBy("id").agg(F.min("v").alias("v")).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "id", "v")
    rows = dealt.unionByName(asked).withColumn("dim", F.size("v")).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "asks", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, shard = None, [], [], None
        for b in batches:
            place = np.column_stack([b.column(c).to_numpy() for c in ("shard", "dim", "asks")])
            number, flat = b.column("id").to_numpy(), b.column("v").flatten().to_numpy()
            at = np.r_[0, np.cumsum(place[:, 1])]
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo == hi:
                    continue
                block = flat[at[lo] : at[hi]].reshape(hi - lo, -1)
                if (now := tuple(place[lo, :2])) != key:
                    key, ids, vectors, shard = now, [], [], None
                if not place[lo, 2]:
                    ids.append(number[lo:hi])
                    vectors.append(block)
                    continue
                if not ids:
                    continue
                if shard is None:
                    every, first = np.unique(np.concatenate(ids), return_index=True)
                    shard = Shard(every, np.concatenate(vectors)[first])
                for q in range(lo, hi, _QUERY_BLOCK):
                    stop = min(q + _QUERY_BLOCK, hi)
                    found = list(zip(*shard.search(number[q:stop], block[q - lo : stop - lo], k), strict=True)) or [[]] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark, sf_dir: str) -> DataFrame:
    base = common.read_table(spark, sf_dir, "embeddings")
    return nearest(base, base.filter(F.col("vec_id") % 50 == 0))
