"""Exact top-k inner products by norm-bucketed retrieval.

Component x of a vector becomes floor(scale * x); scores are integer products, so
results are exact and ties are certain.  Vectors are cut into levels by length: the first
holds the longest ones (about ``LEVEL_ROWS``), every further one twice as many.  Levels are searched
in falling length, and a query whose k-th best score so far is beyond |q| times a level's
longest vector meets no more levels; levels grow with the logarithm of the table.

Within a level, blocks of queries meet parts of the candidates, both of bounded size.  Such a
task sorts its candidates by length and cuts them into buckets.  For a query q with its k-th
best score so far s, a bucket whose longest vector has length l needs a cosine of at least s / (|q| l):

* above 1, the bucket and all shorter ones hold no result and are skipped;
* close to 1 (``COORDINATE_FROM``), candidates must lie close to q in every
  coordinate, so those outside the feasible interval of q's largest coordinates go;
* otherwise only the vectors that are long enough alone (|p| >= s / |q|) stay.

Survivors are verified by exact products.  Every task sends at most k rows per query, and the
last choice is made among those.  Ties go to the smaller id.  Nothing of the tables goes through
the driver or a broadcast, and plans do not depend on the number of queries.

Edge cases: vectors that are null, or hold null or non-finite components, take no
part; vectors of another dimension than the query are not candidates for it; a
query is not its own candidate (by id); empty tables give an empty result; repeated
rows count as candidates each and once as a query; other vectors under a query's id are
queries of their own; other columns are ignored.  A vector whose integer length is 2**31 or
more raises an error, as its scores might not fit a long.  Very long vectors make smaller blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import ensure_checkpoint_dir, spark_partitions, tidied

LEVEL_ROWS = 1 << 18  # vectors of the first level
TASK_VALUES = 1 << 22  # components of the candidates that a task holds
QUERY_VALUES = 1 << 19  # components of the queries that a task holds
BUCKET_ROWS = 256
COORDINATE_FROM = 0.75
FOCUS = 3
_EPS = 1e-9


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v (integers), norm of the vectors that take part."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_x"))
    bad = F.exists("_x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    own = own.where(F.col("_x").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    own = own.select("vec_id", F.transform("_x", lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-(2.0**31))), F.lit(2.0**31)))).alias("_w"))
    norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = own.withColumn("norm", norm)
    whole = F.when(F.col("norm") < 2.0**31, F.col("_w")).otherwise(F.raise_error(F.concat(F.lit("vector too long for exact scores: id "), F.col("vec_id").cast("string"))))
    return own.select("vec_id", whole.cast("array<int>").alias("v"), "norm")


def _merge(scores, ids, new_scores, new_ids, k):
    s, i = np.concatenate([scores, new_scores]), np.concatenate([ids, new_ids])
    order = np.lexsort((i, -s))[:k]
    return s[order], i[order]


def search_block(qid, q, cid, c, k, floor):
    """Best (scores, ids) of every query over the candidates of one task; scores below a query's ``floor`` may be missing."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qid)
    norm = np.sqrt((c.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-norm, kind="stable")
    cid, c, norm = cid[order], c[order], norm[order]
    unit = c / np.maximum(norm, 1e-300)[:, None]
    qn = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    focus = np.argsort(-np.abs(q), axis=1)[:, :FOCUS]
    exact = float(qn.max(initial=0)) * float(norm.max(initial=0)) < 2**53  # products are exact as doubles
    wide = c.astype(np.float64) if exact else None
    for lo in range(0, len(c), BUCKET_ROWS):
        hi = min(lo + BUCKET_ROWS, len(c))
        longest = norm[lo]
        full = np.array([len(b[0]) >= k for b in best])
        kth = np.maximum(np.array([float(b[0][-1]) if f else -np.inf for b, f in zip(best, full, strict=True)]), floor)
        full |= kth > -np.inf
        reach = qn * longest
        need = np.where(full & (reach > 0), kth / np.maximum(reach, 1e-300), -np.inf)
        # a tie can still win by its id, so equality stays; a zero vector or query scores 0
        alive = np.flatnonzero(~full | (need <= 1 + _EPS) | (kth <= 0))
        if not len(alive):
            break
        easy = alive[need[alive] < COORDINATE_FROM]
        if len(easy):
            keep = norm[lo:hi]
            prod = (q[easy].astype(np.float64) @ wide[lo:hi].T).astype(np.int64) if exact else q[easy] @ c[lo:hi].T
            ok = prod >= kth[easy][:, None]
            ok &= (keep[None, :] * qn[easy][:, None] >= kth[easy][:, None] * (1 - _EPS)) | (kth[easy][:, None] <= 0)
            for r in np.flatnonzero(ok.any(1)):
                at = easy[r]
                m = np.flatnonzero(ok[r] & (cid[lo:hi] != qid[at]))
                if len(m) > 4 * k:
                    cut = np.partition(prod[r, m], len(m) - k)[len(m) - k]
                    m = m[prod[r, m] >= cut]
                best[at] = _merge(*best[at], prod[r, m], cid[lo:hi][m], k)
        for at in alive[need[alive] >= COORDINATE_FROM]:
            t = min(1.0, need[at])
            f = focus[at]
            x = q[at, f] / qn[at]
            spread = np.sqrt(np.maximum(0, (1 - t * t) * (1 - x * x))) + 1e-7
            u = unit[lo:hi][:, f]
            lower = np.where(x <= -t, -1.0, x * t - spread)
            upper = np.where(x >= t, 1.0, x * t + spread)
            m = np.flatnonzero(((u >= lower - 1e-7) & (u <= upper + 1e-7)).all(1) & (cid[lo:hi] != qid[at]))
            if len(m):
                best[at] = _merge(*best[at], c[lo:hi][m] @ q[at], cid[lo:hi][m], k)
    return best


def _search(k: int):
    """A block of queries (rows with ``asked``) against a part of the candidates, of one dimension."""

    def run(table: pa.Table) -> pa.Table:
        asked = table["asked"].to_numpy()
        ids, floors = table["vec_id"].to_numpy(), table["floor"].to_numpy(zero_copy_only=False)
        flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = flat.reshape(len(ids), -1)
        q, c = np.flatnonzero(asked), np.flatnonzero(~asked)
        best = search_block(ids[q], rows[q], ids[c], rows[c], k, np.nan_to_num(floors[q].astype(np.float64), nan=-np.inf, neginf=-np.inf)) if len(q) and len(c) else []
        own = table["own"].fill_null(0).to_numpy()[q]
        n = [len(s) for s, _ in best]
        cat = lambda k: np.concatenate([b[k] for b in best]) if best else np.zeros(0, np.int64)
        return pa.table({"query_id": np.repeat(ids[q][: len(best)], n), "own": np.repeat(own[: len(best)], n), "vec_id": cat(1), "score": cat(0)})

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k highest integer inner products."""
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = integers(vectors, id_col, vector_col, scale)
    asked = integers(queries, id_col, vector_col, scale).withColumn("own", F.xxhash64("v")).dropDuplicates(["vec_id", "own"])
    n, values = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    levels = max(1, math.ceil(math.log2(max(1, n) / LEVEL_ROWS)) + 1)
    shares = [1 - 0.5**j for j in range(levels - 1, 0, -1)]
    bounds = rows.agg(F.percentile_approx("norm", F.array(*(F.lit(x) for x in shares)), 10_000)).first()[0] if shares and n else []
    bounds = sorted(set(bounds), reverse=True)  # a level holds the lengths from its bound on
    per_row, best = max(1.0, values / max(1, n)), None
    rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id"))
    for level in range(len(bounds) + 1):
        low, high = bounds[level] if level < len(bounds) else None, bounds[level - 1] if level else None
        part = rows
        if low is not None:
            part = part.where(F.col("norm") >= low)
        if high is not None:
            part = part.where(F.col("norm") < high)
        live = asked.withColumn("floor", F.lit(None).cast("long"))
        if best is not None:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "own", F.col("score").alias("floor"))
            live = asked.join(kth, ["vec_id", "own"], "left").where(F.col("floor").isNull() | (F.col("floor") <= 0) | (F.col("floor") <= F.col("norm") * high * (1 + _EPS)))
        n_live = live.count()
        if not n_live:
            break
        n_part = part.count() if bounds else n
        least = min(spark_partitions(spark), math.ceil(n_part / (8 * BUCKET_ROWS)))  # enough tasks for a small level
        parts, blocks = max(1, least, math.ceil(n_part * per_row / TASK_VALUES)), max(1, math.ceil(n_live * per_row / QUERY_VALUES))
        place = lambda seed, m: F.pmod(F.xxhash64("vec_id", "norm", F.lit(seed)), F.lit(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        none = F.lit(None).cast("long")
        c = part.select("vec_id", "v", none.alias("own"), none.alias("floor"), F.lit(False).alias("asked"), place(1, parts).alias("part"), every(blocks).alias("block"))
        q = live.select("vec_id", "v", "own", "floor", F.lit(True).alias("asked"), every(parts).alias("part"), place(2, blocks).alias("block"))
        met = c.unionByName(q).withColumn("dim", F.size("v")).where("dim > 0")
        found = met.groupBy("part", "block", "dim").applyInArrow(tidied(_search(k)), "query_id long, own long, vec_id long, score long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k)
        if level < len(bounds):
            best = best.checkpoint()
    if best is None:
        best = spark.createDataFrame([], "query_id long, own long, vec_id long, score long, rank int")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
