"""Merkle manifest of a dataset: leaf digests, one tree per source, one tree over the sources, a proof for every row.

Rows get their place in their source by a range partition and prefix sums over its partitions, so no source is sorted in
one task. Windows then run over blocks of ``FAN ** LEVELS`` consecutive leaves. Inside a block, the node of a level is
held by the first leaf below it, so its siblings lie at fixed distances: lag and lead columns, masked by the node's slot
and the length of its run, supply them, and rows that are first children hash the parents. Every leaf takes the siblings of
its ancestors from the last such row before it. The blocks' tops are the leaves of the next round, a ``FAN ** LEVELS``-th
of the rows, and a leaf's path is joined from both; the trees' tops are the leaves of the tree over the sources.

Defined results: leaves ascend by doc_id, null first, equal ids by their leaf digest; equal rows are leaves of their own.
Sources are ordered by UTF-8 bytes, null first, and the empty source is not the null one. A row without doc_id is never
tampered with. A table of one row has that leaf as subroot and root, an empty proof, and an empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfathom.llm.common import durable

FAN = 3
LEVELS = 6  # of one block: 729 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value in a leaf: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, part, h) and the kept columns: the row's leaf; the part stands for its source and sorts like it, null first."""
    part = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    return docs.select("doc_id", part.alias("part"), digest(*(field(F.col(c)) for c in fields)).alias("h"), *keep)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``pos``, the row's place in its part, and ``n``, the rows of the part.

    Rows are dealt into ranges and numbered there; a part's rows in earlier ranges are summed over ranges only.
    """
    ranges = rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    numbered = durable(ranges.withColumn("at", F.monotonically_increasing_id())).withColumn("slab", F.shiftright("at", 33))
    runs = numbered.groupBy("part", "slab").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("part")  # a row per range
    before = F.coalesce(F.sum("rows").over(whole.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", "slab", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    found = numbered.join(runs, ["part", "slab"])
    return found.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "slab", "shift")


def climb(rows: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Rows (part, pos, n, h, ...) with their block, their path in it (siblings before and after, level by level) and, on
    the first row of each block, the block's top."""
    inside = Window.partitionBy("part", "block").orderBy("pos")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("block", F.expr(f"pos div {fan**levels}")).withColumn("top", F.col("h"))
    links = []
    for level in range(levels):
        step = fan**level
        slot = F.expr(f"(pos div {step}) % {fan}")
        nodes = F.expr(f"(n + {step - 1}) div {step}")
        run = F.least(F.lit(fan), nodes - F.expr(f"pos div {step}") + slot)
        near = {f"_{d}": (F.lag("top", -d * step) if d < 0 else F.lead("top", d * step)).over(inside) for d in range(1 - fan, fan) if d}
        found = found.withColumns(near)
        empty = F.lit("")
        before = F.concat(*(F.when(slot >= d, F.col(f"_{-d}")).otherwise(empty) for d in range(fan - 1, 0, -1)))
        after = F.concat(*(F.when(slot + d < run, F.col(f"_{d}")).otherwise(empty) for d in range(1, fan)))
        holds = (F.expr(f"pos % {step}") == 0) & (nodes > 1)
        found = found.withColumn("link", F.when(holds, F.struct(before.alias("before"), after.alias("after"))))
        parent = F.when(F.expr(f"pos % {step * fan}") == 0, F.when(nodes > 1, digest("top", "link.after")).otherwise(F.col("top")))
        links.append(f"link{level}")
        found = found.withColumns({"top": parent, links[-1]: F.last("link", ignorenulls=True).over(so_far)}).drop("link", *near)
    path = F.filter(F.array(*links), lambda x: x.isNotNull())
    return found.withColumn("path", path).drop(*links)


def grow(rows: DataFrame, most: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with their whole path and all that ``crown`` adds to their tree's top; ``most`` is the size of the largest part.

    ``crown`` takes one row per part (part, pos, n, h) and adds path, subroot and root.
    """
    span = FAN**LEVELS
    climbed = climb(rows)
    tops = climbed.where(f"pos % {span} = 0").select("part", F.col("block").alias("pos"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("top").alias("h"))
    tops = durable(tops)
    above = crown(tops) if most <= span else grow(tops, -(-most // span), crown)
    above = above.select("part", F.col("pos").alias("block"), F.col("path").alias("upper"), "subroot", "root")
    joined = climbed.drop("top").join(above, ["part", "block"])
    return joined.withColumn("path", F.concat("path", "upper")).drop("upper", "block")


def over_parts(tops: DataFrame) -> DataFrame:
    """The tree over the trees: adds every tree's path to the root, its subroot and the root."""
    ends = tops.select(F.lit("").alias("part"), F.col("part").alias("tree"), F.col("h"))
    no_path = F.expr("cast(array() as array<struct<before: string, after: string>>)")
    last = lambda top: top.withColumns({"path": no_path, "subroot": F.col("h"), "root": F.col("h")})
    found = grow(placed(ends, "tree"), tops.count(), last)
    return found.select(F.col("tree").alias("part"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("h").alias("subroot"), "root")


def manifest(rows: DataFrame) -> DataFrame:
    """Leaves (doc_id, part, h, ...) with path, subroot and root."""
    # equal rows can be told apart when ranges are cut
    numbered = durable(rows.withColumn("tie", F.monotonically_increasing_id()))
    ordered = placed(numbered, "doc_id", "h", "tie").drop("tie")
    most = numbered.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    return grow(ordered, most, over_parts)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda own, x: digest(x["before"], own, x["after"]))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(x["before"], x["after"]))), 256)


def tampered() -> Column:
    """Leaf of the row without the newlines of its text if crc32 of its decimal doc_id is even, else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return F.when(chosen, digest(*(field(text if c == "text" else F.col(c)) for c in FIELDS)))
