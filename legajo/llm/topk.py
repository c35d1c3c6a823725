"""Exact top-k inner products: vectors in buckets by length, pruned by the cosine a bucket must reach, then verified."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.common import checked, ranked, ship, stored

#: Relative slack of bounds in floating point, so that rounding never prunes.
SLACK = 1e-9
#: Buckets at most, whatever the number of rows: what all queries see of them fits into a broadcast of 1 MB.
MAX_BUCKETS = 1 << 16
#: Largest sum that double precision holds exactly; beyond it products are made in whole numbers.
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``id, v, dim, norm``: components as floor(scale * x), x as double. Rows with a null id, a null or empty
    vector, or a null, infinite or NaN component take no part."""
    checked(vectors, id_col, vector_col)
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return rows.select("id", "v", F.size("v").alias("dim"), F.sqrt(square).alias("norm"))


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers, exact: in double precision where the sums fit, which is faster."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    if most < EXACT:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


def search(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of one bucket for each query of one block, above its ``least`` score.

    A vector of the bucket with length n is below the score s of query q unless its cosine reaches s / (|q| n). From
    the local threshold t, with n the bucket's largest length, each query takes the cheaper of two prunings: by
    length, the vectors of at least s / |q|, a prefix of the bucket; by coordinate, those whose share x of an axis
    is near enough to the query's share f: at an angle of arccos t at most between both vectors, x lies within
    t f -+ sqrt((1 - t²)(1 - f²)), or up to 1 (-1) where the axis itself is nearer. Products of what is left are exact.
    """
    order = np.argsort(-rows["norm"].to_numpy(), kind="stable")
    ids, norms = rows["id"].to_numpy()[order], rows["norm"].to_numpy()[order]
    v = np.stack(rows["v"].to_numpy())[order].astype(np.int64)
    unit = v / np.maximum(norms, 1e-300)[:, None]
    q = np.stack(queries["v"].to_numpy()).astype(np.int64)
    q_ids, q_norms = queries["id"].to_numpy(), queries["norm"].to_numpy()
    least = queries["least"].to_numpy(np.float64, na_value=-np.inf) if "least" in queries else np.full(len(q), -np.inf)
    sorted_axes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found: list[tuple[int, np.ndarray, np.ndarray]] = []

    def best(i: int, take: np.ndarray | slice, scores: np.ndarray) -> None:
        own = ids[take]
        ok = (own != q_ids[i]) & (scores >= least[i])
        own, scores = own[ok], scores[ok]
        if len(own) > k:
            # ties at the k-th score stay until the ids decide
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            own, scores = own[scores >= edge], scores[scores >= edge]
            top = np.lexsort((own, -scores))[:k]
            own, scores = own[top], scores[top]
        if len(own):
            found.append((i, own, scores))

    prefix: dict[int, list[int]] = {}
    for i in range(len(q)):
        bound = q_norms[i] * norms[0] * (1 + SLACK)
        if least[i] > 0 and bound < least[i]:
            continue
        local = least[i] / bound if least[i] > 0 else 0.0
        by_length = len(norms) if local <= 0 else int(np.searchsorted(-norms, -least[i] / (q_norms[i] * (1 + SLACK)), side="right"))
        if local > 0:
            axis = int(np.abs(q[i]).argmax())
            f = q[i][axis] / q_norms[i]
            reach = np.sqrt(max(0.0, (1 - local * local) * (1 - min(1.0, f * f)))) + SLACK
            if axis not in sorted_axes:
                at = np.argsort(unit[:, axis], kind="stable")
                sorted_axes[axis] = (at, unit[at, axis])
            at, values = sorted_axes[axis]
            low = local * f - reach
            high = local * f + reach
            if f >= local:
                high = 1.0 + SLACK
            if -f >= local:
                low = -1.0 - SLACK
            a, b = np.searchsorted(values, low, side="left"), np.searchsorted(values, high, side="right")
            if b - a < by_length:
                take = np.sort(at[a:b])
                best(i, take, products(v[take], q[i : i + 1])[0] if len(take) else np.zeros(0, np.int64))
                continue
        prefix.setdefault(-(-by_length // 1024) * 1024, []).append(i)
    for size, members in prefix.items():
        for at in range(0, len(members), 64):
            part = members[at : at + 64]
            scores = products(v[:size], q[part])
            for i, s in zip(part, scores, strict=True):
                best(i, slice(0, size), s)
    return pd.DataFrame({
        "query_id": np.concatenate([np.full(len(o), q_ids[i]) for i, o, _ in found]) if found else np.zeros(0, np.int64),
        "vec_id": np.concatenate([o for _, o, _ in found]) if found else np.zeros(0, np.int64),
        "score": np.concatenate([s for _, _, s in found]) if found else np.zeros(0, np.int64),
    })


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024,
    bucket_rows: int = 8192, block_queries: int = 4096,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query (rows with ``is_query``, over
    ``id``) with every other row of its dimension, ties to the smaller id; all, where there are fewer.

    Rows are sorted by dimension and falling length and cut into buckets of ``bucket_rows`` (more where there would
    be over ``MAX_BUCKETS`` of them); queries come in blocks of
    ``block_queries``. First each query meets the bucket of the longest rows, which gives it a score to beat. Then it
    goes only to buckets whose longest row can still reach that score. A task holds one bucket and one block. Rows
    that share the query's id are its own and no candidates; of queries with one id the smallest vector asks.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors, id_col, vector_col, scale).withColumn("_tie", F.monotonically_increasing_id())
    order = ranked(rows, "vectors", "dim", F.desc("norm"), "id", "_tie")
    size = max(bucket_rows, -(-order.count() // MAX_BUCKETS))
    order = stored(order.withColumn("bucket", F.floor(F.col("pos") / size)).drop("pos", "_tie"), "buckets")
    # a bucket holds one dimension in a search: its key is both
    stats = order.groupBy("dim", "bucket").agg(F.max("norm").alias("longest"))
    queries = order.where(is_query).groupBy("id").agg(F.min(F.struct("v", "dim", "norm")).alias("q")).select("id", "q.*")
    queries = stored(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(1 << 20))), "queries")
    blocks = max(1, -(-queries.count() // block_queries))
    queries = queries.withColumn("block", F.pmod("block", F.lit(blocks)))
    first = stats.groupBy("dim").agg(F.min("bucket").alias("bucket"))

    def met(asked: DataFrame) -> DataFrame:
        """``asked`` has a row for each query and bucket; one task for each bucket and block."""
        wanted = asked.select(F.col("dim").alias("_dim"), F.col("bucket").alias("_bucket"), F.col("block").alias("_block")).distinct()
        there = order.join(wanted, (F.col("dim") == F.col("_dim")) & (F.col("bucket") == F.col("_bucket")))
        there = there.select("id", "v", "norm", F.col("_dim").alias("dim"), F.col("_bucket").alias("bucket"), F.col("_block").alias("block"))
        key = ["dim", "bucket", "block"]
        return there.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(
            lambda r, q: search(r, q, k) if len(r) and len(q) else search_nothing(), "query_id long, vec_id long, score long"
        )

    start = stored(met(queries.join(F.broadcast(first), "dim")), "first-scores")  # a row for each dimension
    kth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    beaten = start.withColumn("r", F.row_number().over(kth)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    known = queries.join(beaten, "id", "left")
    rest = stats.join(first.withColumnRenamed("bucket", "_first"), "dim").where("bucket <> _first")
    # what a bucket can give: by falling length, a query's buckets are those down to the last that reaches its score
    steps = rest.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("bucket", "longest"))).alias("steps"))
    reach = F.filter("steps", lambda s: F.col("least").isNull() | (F.col("least") <= 0) | (s["longest"] * F.col("norm") * (1 + SLACK) >= F.col("least")))
    asked = known.join(F.broadcast(steps), "dim").select(  # MAX_BUCKETS entries
"id", "v", "dim", "norm", "block", "least", F.explode(reach).alias("s")
    ).select(
        "id", "v", "dim", "norm", "block", "least", F.col("s.bucket").alias("bucket")
    )
    every = start.unionAll(met(asked))
    return every.withColumn("rank", F.row_number().over(kth)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_nothing() -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
