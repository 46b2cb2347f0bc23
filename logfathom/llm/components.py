"""Connected components of a table of links, by alternating large-star and small-star steps on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.llm.common import durable


def _star(pairs: DataFrame) -> DataFrame:
    """Point every v of (u, v) at the least member of u's star; the least members are written first, so a join on a
    busy u meets two plain shuffles and can be split."""
    least = durable(pairs.groupBy("u").agg(F.min("v").alias("m")))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _star(down)
    rest = star.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(star.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every linked node but the least of each component, which names it.

    Null ends and loops count for nothing; repeated links do no harm; no links give no rows.
    """
    edges = durable(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct())
    seen = None
    while True:
        print_of = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))), F.max(F.xxhash64("v", "u"))).first()
        if not print_of[0] or print_of == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = print_of
        edges = durable(_small(durable(_large(edges))))
