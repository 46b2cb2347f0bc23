"""Approximate nearest neighbours with a permutation index.

Pivots are a bounded sample of the vectors. Every vector is represented by its ``prefix`` nearest pivots in order, and
posted, with the rank, in the inverted file of each of them. A query walks the inverted files of its own pivots, sums
the footrule distance of each posted vector (missing pivots count as rank ``prefix``), and the best ``candidates`` are
compared exactly.

Equal vectors are one class, posted once; a class answers with its least ids, so a crowd of copies costs no more than
one vector and exact ties are complete. Classes are dealt to shards of about ``shard_rows``; a task holds one shard with
its inverted files and one block of queries, so memory is bounded, and the shards' answers are merged by rank.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component, or whose length differs
from the commonest one, take no part, nor do rows without an id. Equal cosines rank by the smaller id. Repeated rows of
one id count once; of different vectors the least counts, compared component by component. Fewer neighbours than asked for are all returned. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from logfathom.llm.common import durable

PIVOTS = 256
PREFIX = 24
CANDIDATES = 1024
SHARD_ROWS = 4096
QUERY_BLOCK = 2048
FOUND = "query_id long, vec_id long, score double"


def _usable(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    x = F.col("x")
    own = vectors.select(F.col(key).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    good = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    own = own.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(good)
    top = own.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return own.where(F.size("x") == (top[0] if top else 0))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, which changes no cosine, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Indexes of the nearest pivots of each unit vector, nearest first."""
    near = -(x @ pivots.T)
    prefix = min(prefix, near.shape[1])
    part = np.argpartition(near, prefix - 1, axis=1)[:, :prefix]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1).astype(np.int32)


def build_index(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = 5, pivots: int = PIVOTS, prefix: int = PREFIX, shard_rows: int = SHARD_ROWS) -> dict:
    """``classes``: shard, ids (the k + 1 least of the class), vector and its pivot order; ``members``: id and vector."""
    members = durable(_usable(vectors, key, embedding).groupBy("vec_id").agg(F.min("x").alias("x")))
    # per task at most k + 1 ids of each class go into the shuffle
    least = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    salted = members.groupBy("x", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(least.alias("ids"))
    merged = salted.groupBy("x").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    classes = durable(merged)
    n = classes.count()
    sample = classes.select("x").orderBy(F.xxhash64("x")).limit(pivots).toPandas()["x"]  # at most ``pivots`` vectors
    points = _unit(np.array(sample.tolist(), dtype=float).reshape(len(sample), -1)) if len(sample) else np.zeros((0, 0))
    shards = max(1, -(-n // shard_rows))

    @F.pandas_udf("array<int>")
    def order_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(nearest_pivots(_unit(np.stack(batch)), points, prefix)) if len(batch) else [])

    shard = F.pmod(F.xxhash64(F.lit(3), "x"), F.lit(shards)).cast("int")
    return {"classes": durable(classes.select(shard.alias("shard"), "ids", "x", order_of("x").alias("pivots"))), "members": members, "shards": shards, "points": points, "prefix": prefix}


def footrule_best(query: np.ndarray, lists: dict[int, tuple[np.ndarray, np.ndarray]], rows: int, prefix: int, most: int) -> np.ndarray:
    """Rows of the shard with the least footrule distance to a query's pivot order."""
    if most >= rows:
        return np.arange(rows)
    gain = np.zeros(rows, np.int32)  # footrule = a constant of the query - gain
    for rank, pivot in enumerate(query):
        posted = lists.get(int(pivot))
        if posted is not None:
            at, ranks = posted
            gain[at] += 2 * prefix - rank - ranks - np.abs(rank - ranks)
    return np.argpartition(-gain, most - 1)[:most]


def search(index: dict, queries: DataFrame, k: int = 5, candidates: int = CANDIDATES) -> DataFrame:
    """The k nearest of every query (vec_id, x): query_id, rank, vec_id, score."""
    prefix, shards, points = index["prefix"], index["shards"], index["points"]
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x, q = _scaled(np.stack(left["x"])), _scaled(np.stack(right["x"]))
        norm, qnorm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
        order = np.stack(left["pivots"])
        by_pivot = np.argsort(order, axis=None, kind="stable")
        pivot, starts = np.unique(order.ravel()[by_pivot], return_index=True)
        posted = np.split(by_pivot, starts[1:])
        lists = {int(p): (at // order.shape[1], at % order.shape[1]) for p, at in zip(pivot, posted, strict=True)}
        ids = left["ids"].tolist()
        out = []
        for i, own in enumerate(nearest_pivots(q / qnorm[:, None], points, prefix)):
            at = footrule_best(own, lists, len(x), prefix, candidates)
            # the sum of products in the vector's order, so that a score does not depend on the shard
            score = (x[at] * q[i]).sum(1) / (norm[at] * qnorm[i])
            me = right["vec_id"].iat[i]
            first = np.sort(score)[::-1][min(k, len(score) - 1)]  # its own class may hold a place
            for j in np.flatnonzero(score >= first):
                out += [(me, v, score[j]) for v in ids[at[j]] if v != me]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    block = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(blocks)).cast("int")
    asked = queries.select(block.alias("block"), "vec_id", "x").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    stored = index["classes"].withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = stored.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(find, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
