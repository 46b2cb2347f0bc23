"""Filter interaction audit: what every filter removes in every order of filters, and its Shapley share.

A document is reduced to the set of filters it fails, and documents are counted by part and set, so a part of any size
becomes at most 2^n rows before anything else happens. The subsets of filters already applied form a lattice. An edge
leads from a state to the state with one more filter and carries what that filter removes and keeps there. Forward path
counting gives the orders that reach a state, backward counting those that leave it; their product is the number of orders
through an edge. Removals weighted by it and summed by filter are the Shapley shares times the number of orders, and each
step of each order reads the same edges.

Defined results: null texts are empty, null parts become the empty text. A document whose text another one with a smaller
id has is a copy, whatever happens to that one; rows without an id are never copies, and rows that share id and text are
no copies of each other. Repeated labels of an id count as 1 if any of them is 1; labels without documents don't count.
An empty table has no parts and gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfathom.llm.common import durable

# The five filters and their limits.
FILTERS = ("A", "B", "C", "D", "E")
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 3
MARKS = r"[#$%&*|]"
GAP = r"[\x20\x09-\x0D]+"


def lattice(filters: int) -> list[tuple[int, int, int]]:
    """Edges (state, filter, orders through the edge): states are bit sets of applied filters."""
    states = 1 << filters
    bits = range(filters)
    reaching, leaving = [1] + [0] * (states - 1), [0] * (states - 1) + [1]
    for s in range(1, states):
        reaching[s] = sum(reaching[s ^ (1 << f)] for f in bits if s >> f & 1)
    for s in range(states - 2, -1, -1):
        leaving[s] = sum(leaving[s | (1 << f)] for f in bits if not s >> f & 1)
    return [(s, f, reaching[s] * leaving[s | (1 << f)]) for s in range(states) for f in bits if not s >> f & 1]


def steps(filters: tuple[str, ...]) -> list[tuple[str, int, int, int]]:
    """(order, step, state before it, filter) of every order."""
    out = []
    for order in itertools.permutations(range(len(filters))):
        state = 0
        for at, f in enumerate(order):
            out.append(("".join(filters[i] for i in order), at + 1, state, f))
            state |= 1 << f
    return out


def bit_set(failures: list[Column]) -> Column:
    """The set of failed filters as bits; an unknown failure is none."""
    return sum((F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(failures)), F.lit(0))


def edges(rows: DataFrame, filters: int, weights: tuple[str, ...] = ()) -> DataFrame:
    """One row per part and lattice edge, from rows of (part, failed, weights...): kept, removed, redundant, unique_fails,
    ``<weight>_lost`` and the filter's ``shapley`` sum over all orders."""
    counts = rows.groupBy("part", "failed").agg(F.count("*").alias("n"), *(F.sum(F.col(w).cast("bigint")).alias(w) for w in weights))
    table = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("state", "filter", "orders"), e, strict=True))) for e in lattice(filters)))
    spread = counts.withColumn("edge", F.explode(table)).select("part", "failed", "n", *weights, "edge.*")
    here = F.col("failed").bitwiseAND(F.col("state")) == 0
    fails = F.expr("failed & shiftleft(1, filter)") != 0
    total = lambda c, where: F.sum(F.when(where, F.col(c)).otherwise(F.lit(0).cast("bigint")))
    found = spread.groupBy("part", "state", "filter", "orders").agg(
        total("n", here & ~fails).alias("kept"),
        total("n", here & fails).alias("removed"),
        total("n", ~here & fails).alias("redundant"),
        total("n", F.expr("failed = shiftleft(1, filter)")).alias("unique_fails"),
        *(total(w, here & fails).alias(f"{w}_lost") for w in weights),
    )
    own = Window.partitionBy("part", "filter")  # 2^(filters - 1) edges
    return found.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(own))


def audit(rows: DataFrame, filters: tuple[str, ...] = FILTERS, weights: tuple[str, ...] = ()) -> DataFrame:
    """``edges`` read along every order: one row per part, filter_order and step, zeros included."""
    path = rows.sparkSession.createDataFrame(steps(filters), "filter_order string, step int, state int, filter int")
    # n! n rows of the filters alone, whatever the data
    found = edges(rows, len(filters), weights).join(F.broadcast(path), ["state", "filter"])
    lost = [f"{w}_lost" for w in weights]
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley")


def text_failures(text: Column) -> list[Column]:
    """Failure conditions A to D of a text that isn't null."""
    words = F.array_remove(F.split(text, GAP), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * capitals > CAPITALS_PERCENT * F.length(text),
        text.rlike(MARKS),
    ]


def failed_filters(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed) of every document under the five filters.

    Texts become 32-byte digests first. The first id of each digest is found by partial aggregation, and rows meet it by
    digest and id together, so thousands of copies of one text spread over all tasks.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    rows = durable(docs.select("doc_id", part, digest, bit_set(text_failures(text)).alias("failed")))
    named = rows.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull(), F.lit(1 << 4)).otherwise(0)
    met = named.join(first, ["digest", "doc_id"], "left")
    known = met.select("doc_id", "part", (F.col("failed") + copy).alias("failed"))
    return known.unionByName(rows.where("doc_id is null").select("doc_id", "part", "failed"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` (quality 1) and ``toxic`` (toxic 1) as 0 or 1."""
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
    known = known.groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    joined = rows.where("doc_id is not null").join(known, "doc_id", "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over documents, by language, with good and toxic documents lost."""
    return audit(with_labels(failed_filters(docs), labels), FILTERS, ("good", "toxic"))
