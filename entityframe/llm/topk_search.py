"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are grouped by length into buckets of bounded size. The longest buckets give every query a first threshold;
for any other bucket the threshold turns into a local cosine threshold. Beyond 1 the whole bucket is left out; if it is
high, candidates are bounded coordinate by coordinate, else by length alone. Remaining products are computed exactly.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, ship, written

#: Vectors of a bucket and of a query block, up to the unevenness of a hash, and queries whose products are held at once.
BUCKET_ROWS, BLOCK_ROWS, AT_ONCE = 4096, 2048, 256
#: Buckets of the longest vectors that are broadcast together, a few MB each.
MOST_HEADS = 16
#: Local cosine threshold from which coordinates are used, and how many of them.
COORDINATE_FROM, FOCUS = 0.6, 4
_ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
PACKED = "bucket int, dim int, top_norm double, ids binary, norms binary, vectors binary"


@contextmanager
def small_batches(spark, rows: int):
    """Arrow batches of so many rows, for rows that hold whole blocks."""
    before = spark.conf.get(_ROWS_A_BATCH)
    spark.conf.set(_ROWS_A_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_A_BATCH, before)


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (floor(scale * component) as long), dim and squared norm; vectors null, empty, or with null or non-finite components go."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)) & (F.size("v") > 0))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    return rows.select("id", "v", F.size("v").alias("dim"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm"))


def _pack(rows: DataFrame) -> DataFrame:
    """A row for each bucket: ids, norms and vectors in order of falling norm."""

    def run(table: pa.Table) -> pa.Table:
        norms = table.column("norm").to_numpy()
        order = np.lexsort((table.column("id").to_numpy(), -norms))
        dim = table.column("dim")[0].as_py()
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)[order]
        return pa.table({"bucket": [table.column("bucket")[0].as_py()], "dim": [dim], "top_norm": [float(norms.max())], "ids": [table.column("id").to_numpy()[order].tobytes()], "norms": [norms[order].tobytes()], "vectors": [v.astype("<i8" if np.abs(v).max() >= 1 << 15 else "<i2").tobytes()]},
                        pa.schema([("bucket", pa.int32()), ("dim", pa.int32()), ("top_norm", pa.float64()), ("ids", pa.binary()), ("norms", pa.binary()), ("vectors", pa.binary())]))

    return rows.groupBy("bucket").applyInArrow(run, PACKED)


def _unpack(dim: int, ids: bytes, norms: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    v = np.frombuffer(vectors, "<i2" if len(vectors) == 2 * dim * len(i) else "<i8").reshape(-1, dim)
    return i, np.frombuffer(norms, "<f8"), v


def _products(q: np.ndarray, v: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products: in doubles while they hold every sum, else in 64-bit integers."""
    if bound < 2.0**52:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def _best(ids: np.ndarray, scores: np.ndarray, own: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero((scores >= least) & (ids != own))
    if len(at) > k:
        cut = -np.partition(-scores[at], k - 1)[k - 1]
        at = at[scores[at] >= cut]
    at = at[np.lexsort((ids[at], -scores[at]))][:k]
    return ids[at], scores[at]


def search_block(q: tuple, b: tuple, least: np.ndarray, k: int):
    """Yields (row of the query, ids, scores) of up to k vectors of the bucket that may be among a query's best."""
    (q_ids, q_norms, q_vec), (ids, norms, vec) = q, b
    slack = 1 + 1e-9
    bound = float(q_norms.max(initial=0)) * float(norms.max(initial=0)) + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(q_norms > 0, least / q_norms, np.where(least > 0, np.inf, -np.inf))  # least length of a partner
    local = need / max(norms[0], 1e-300)
    lengthy = np.flatnonzero((local <= slack) & (local < COORDINATE_FROM))
    for by_length in np.split(lengthy, range(AT_ONCE, len(lengthy), AT_ONCE)) if len(lengthy) else []:
        n = int(np.searchsorted(-norms, -need[by_length].min() / slack, "right")) if need[by_length].min() > 0 else len(ids)
        scores = _products(q_vec[by_length], vec[:n], bound)
        for row, s in zip(by_length, scores, strict=True):
            yield row, *_best(ids[:n], s, q_ids[row], least[row], k)
    by_coordinate = np.flatnonzero((local <= slack) & (local >= COORDINATE_FROM))
    if len(by_coordinate):
        unit = vec / norms[:, None]
        for row in by_coordinate:
            theta = min(1.0, local[row])
            direction = q_vec[row] / q_norms[row]
            keep = norms >= need[row] / slack
            reach = np.arccos(theta) + 1e-7  # a partner's angle to the query, and so the change of its angle to an axis
            for f in np.argsort(-np.abs(direction))[:FOCUS]:
                angle = np.arccos(np.clip(direction[f], -1, 1))
                keep &= (unit[:, f] >= np.cos(min(np.pi, angle + reach)) - 1e-9) & (unit[:, f] <= np.cos(max(0.0, angle - reach)) + 1e-9)
            at = np.flatnonzero(keep)
            if len(at):
                yield row, *_best(ids[at], _products(q_vec[row : row + 1], vec[at], bound)[0], q_ids[row], least[row], k)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by `every`, the k best of all other rows.

    Ties go to the smaller id; with fewer than k others, all. Vectors of another length than the query's aren't
    compared. Null ids take no part; rows with the query's own id aren't its partners, and rows that repeat an id are
    queries and partners of their own.
    Other columns are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = written(
        quantised(vectors, scale, id_col, vector).withColumn("band", F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 16)).otherwise(-99999).cast("int")), "vectors")
    is_query = F.pmod("id", F.lit(every)) == 0
    # bands are as many as 1/16 octaves between the shortest and the longest vector
    bands = rows.groupBy("dim", "band").agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q"), F.max("norm").alias("norm")).orderBy("dim", F.desc("band")).collect()
    spec, q_spec, heads, n_buckets, n_blocks, seen = [], [], [], 0, 0, {}
    for r in bands:
        parts, blocks = -(-r["n"] // BUCKET_ROWS), -(-r["q"] // BLOCK_ROWS)
        spec.append((r["dim"], r["band"], n_buckets, parts, n_blocks, max(1, blocks)))
        for i in range(parts):
            if seen.get(r["dim"], 0) < max(BUCKET_ROWS, 4 * k):  # the longest vectors of the dimension
                heads.append(n_buckets + i)
                seen[r["dim"]] = seen.get(r["dim"], 0) + r["n"] // parts
        n_buckets, n_blocks = n_buckets + parts, n_blocks + blocks
        q_spec.append(blocks)
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not spec or not n_blocks:
        return spark.createDataFrame([], empty)
    places = spark.createDataFrame(spec, "p_dim int, p_band int, first int, parts int, first_block int, blocks int")
    placed = rows.join(places, (rows["dim"] == places["p_dim"]) & (rows["band"] == places["p_band"]))
    h = F.xxhash64("id", F.lit(7))
    buckets = written(_pack(placed.withColumn("bucket", (F.col("first") + F.pmod(h, "parts")).cast("int")).select("bucket", "id", "v", "dim", "norm")), "buckets")
    blocks = written(_pack(placed.where(is_query).withColumn("bucket", (F.col("first_block") + F.pmod(h, "blocks")).cast("int")).select("bucket", "id", "v", "dim", "norm")), "blocks")
    names = [f"q_{c}" for c in blocks.columns]
    blocks = blocks.toDF(*names)

    def first(batches):
        for batch in batches:
            yield from _searched(batch.to_pylist(), k)

    found = "block int, at int, query_id bigint, vec_id bigint, score bigint"
    # a query row is known by its block and its place there, so rows with one id have rankings of their own
    best = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    with small_batches(spark, 8):
        longest = buckets.where(F.col("bucket").isin(heads))  # two buckets for each length of vectors at most
        pairs = blocks.join(F.broadcast(longest) if len(heads) <= MOST_HEADS else longest, F.col("q_dim") == F.col("dim"))
        near = written(pairs.mapInArrow(first, found), "near")
        # the k-th best so far of each query, by block; a block needs no bucket whose longest vector is too short for all
        ranked = near.withColumn("rank", F.row_number().over(best))
        least = ranked.where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("at", "score")).alias("least"))
        wide = blocks.join(least, blocks["q_bucket"] == least["block"], "left").withColumn("need", _need("q_ids", "q_top_norm", "least")).drop("block")
        wide = written(wide, "query-blocks")
        ends = F.broadcast(spark.createDataFrame([(s[0], s[2], s[3], float(r["norm"])) for s, r in zip(spec, bands, strict=True)], "b_dim int, first int, parts int, longest double"))
        reach = wide.select("q_bucket", "q_dim", "need").join(ends, (F.col("q_dim") == F.col("b_dim")) & (F.col("longest") >= F.col("need")))
        todo = reach.select(F.col("q_bucket").alias("at_block"), F.explode(F.expr("sequence(first, first + parts - 1)")).alias("b")).where(~F.col("b").isin(heads))
        pairs = todo.join(buckets, F.col("b") == F.col("bucket")).join(wide, F.col("at_block") == F.col("q_bucket"))
        far = written(pairs.mapInArrow(first, found), "far")
    out = near.unionByName(far).withColumn("rank", F.row_number().over(best))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _need(ids: str, top_norm: str, least: str):
    """The least length of a vector that any query of a block can use: by its smallest k-th score and longest query.

    Minus infinity while a query has fewer than k vectors, or if that score isn't positive.
    """
    lowest = F.array_min(F.transform(F.col(least), lambda x: x["score"]))
    full = F.size(least) == F.octet_length(ids) / 8
    return F.when(full & (lowest > 0) & (F.col(top_norm) > 0), lowest / F.col(top_norm) * (1 - 1e-9)).otherwise(F.lit(float("-inf")))


def _searched(rows: list[dict], k: int):
    for r in rows:
        q = _unpack(r["dim"], r["q_ids"], r["q_norms"], r["q_vectors"])
        b = _unpack(r["dim"], r["ids"], r["norms"], r["vectors"])
        least = np.full(len(q[0]), -np.inf)
        for x in r.get("least") or []:
            least[x["at"]] = x["score"]
        out = [(row, ids, scores) for row, ids, scores in search_block(q, b, least, k)]
        n = [len(ids) for _, ids, _ in out]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(sum(n), r["q_bucket"], np.int32)), pa.array(rows := np.repeat(np.array([i for i, _, _ in out], np.int32), n)), pa.array(q[0][rows]),
             pa.array(np.concatenate([x for _, x, _ in out] or [np.empty(0, np.int64)])), pa.array(np.concatenate([x for *_, x in out] or [np.empty(0, np.int64)]))],
            ["block", "at", "query_id", "vec_id", "score"])


def op6_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
