"""Near-duplicate detection by chosen-path set similarity join.

A document is the set of its distinct shingles (``WIDTH`` words, hashed to 64 bits). Documents with the same set are one
class, named by its smallest id. A class is embedded as its minwise tokens under ``TOKENS`` hash functions and walks down
``TREES`` independent trees: at a node it follows the two tokens that the node selects, so two sets of Jaccard similarity
s share each branch with probability s. Above one half a pair's common branches multiply faster than they die out: at
0.75 a tree loses a pair with probability 1/9 at most however deep it grows, six trees with about 1e-5. Dissimilar sets
part quickly.

Nodes of up to ``LEAF`` classes are compared exhaustively, larger ones branch again, down to ``DEPTH``. A comparison first
looks at one bit of every token: pairs that differ in more bits than a pair at the limit does with probability 2e-7 are
dropped, the others are confirmed on the full sets.

What is still large at ``DEPTH`` is a crowd of similar sets. Members that share too few of their shingles with any other
can't link and leave. The rest is compared with the most central members of one of its nodes, and what then lies outside
a node's largest component with everything in the node that it isn't connected to. Only links inside one component are skipped, so
components are complete and no crowd is expanded into all pairs: the last comparison is dealt in blocks of bounded size,
to which each set travels once, and counts the intersections of two blocks' sets as products of 0/1 matrices.

Defined results: words are split at ASCII white space, A-Z in lower case. A text with fewer words than ``WIDTH`` has its
whole sequence as the one shingle; null and wordless texts have none and link with nothing. Rows that share a doc_id
count as one document with all their texts' links, and give a row each. A row without doc_id joins the component of its
class if that has an id, else it is kept and has no component. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfathom.llm.common import durable, mix64, window_hashes, word_hashes, words_of
from logfathom.llm.components import components

WIDTH = 5
SIMILARITY = 75  # per cent
TOKENS = 128
TREES = 6
LEAF = 16
DEPTH = 4
HUBS = 4  # central members of each node that all its members are compared with
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20  # of one side of a block comparison, about
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(window_hashes(word_hashes(words_of(text)), width))


def tokens(shingles: np.ndarray, count: int = TOKENS) -> np.ndarray:
    """Minwise tokens of a set, 16 bits of each."""
    own = (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        seeds = mix64(np.arange(1, count + 1, dtype=np.uint64))
        flip, factor = (seeds >> np.uint64(32)).astype(np.uint32), seeds.astype(np.uint32) | np.uint32(1)
        best = np.full(count, np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(own), 8192):
            best = np.minimum(best, ((own[None, at : at + 8192] ^ flip[:, None]) * factor[:, None]).min(axis=1))
        return (mix64(best.astype(np.uint64) + seeds) >> np.uint64(48)).astype(np.uint16)


def children(own: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The two nodes that a set with the given tokens goes to below each node."""
    with np.errstate(over="ignore"):
        branch = mix64(np.concatenate([nodes * _STEP, (nodes + np.uint64(1)) * _STEP]))
        chosen = own[(branch >> np.uint64(20)) % np.uint64(len(own))].astype(np.uint64)
        return mix64(branch + chosen * np.uint64(0xC4CEB9FE1A85EC53))


def _roots(trees: int) -> np.ndarray:
    return mix64(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(1000003))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, size and 128-bit key of the set, its tokens and one bit of each; no key for an empty set."""

    @F.pandas_udf("n long, key binary, tokens binary, bits array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch:
                own = shingle_set(text, width)
                if len(own):
                    t = tokens(own)
                    bits = np.packbits((t & 1).astype(np.uint8)).view(np.int64)
                    out.append((len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), t.tobytes(), bits))
                else:
                    out.append((0, None, None, None))
            yield pd.DataFrame(out, columns=["n", "key", "tokens", "bits"], dtype=object)

    found = docs.select("doc_id", run("text").alias("s")).select("doc_id", "s.*")
    return found.select("doc_id", "n", "key", "tokens", F.col("bits")[0].alias("b0"), F.col("bits")[1].alias("b1"))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """rep and full set (64-bit hashes, sorted) of the wanted classes."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(text, width).tobytes() for text in batch])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted.distinct(), "rep", "left_semi")
    return texts.select("rep", run("text").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the similarity."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pd.Series(out, dtype=bool)

    first = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    both = first.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.where(run("sa", "sb")).select("a", "b").distinct()


def _sized(entries: DataFrame) -> DataFrame:
    """Entries of nodes with company, with the node's number of classes."""
    sizes = durable(entries.groupBy("node").agg(F.count("*").alias("members")).where("members > 1"))
    return entries.join(sizes, "node")


def _may_link(left: str, right: str, percent: int):
    """Sizes and token bits allow the pair to be a link."""
    small, large = F.least(f"{left}.n", f"{right}.n"), F.greatest(f"{left}.n", f"{right}.n")
    differ = sum((F.bit_count(F.col(f"{left}.b{i}").bitwiseXOR(F.col(f"{right}.b{i}"))) for i in (0, 1)), F.lit(0))
    rate = (1 - percent / 100) / 2
    return (100 * small >= percent * large) & (differ <= math.ceil(TOKENS * rate + 5.3 * math.sqrt(TOKENS * rate * (1 - rate))))


def _pairs(left: DataFrame, right: DataFrame, percent: int, also) -> DataFrame:
    """Pairs (a < b) of classes that share a node and may link."""
    near = left.alias("x").join(right.alias("y"), (F.col("x.node") == F.col("y.node")) & _may_link("x", "y", percent) & also)
    return near.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _descend(members: DataFrame, classes: DataFrame, roots: np.ndarray | None) -> DataFrame:
    """The classes' entries one level deeper (node, rep and n only); from the roots if they have no nodes yet."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for nodes, owns in batches:
            out = []
            for at, own in zip(nodes, owns, strict=True):
                above = roots if at is None else np.asarray(at, np.int64).view(np.uint64)
                out.append(np.unique(children(np.frombuffer(own, np.uint16), above).view(np.int64)))
            yield pd.Series(out, dtype=object)

    if roots is None:
        own = members.groupBy("rep", "n").agg(F.collect_set("node").alias("nodes"))  # trees x 2^depth at most
        own = own.join(classes.select("rep", "n", "tokens"), ["rep", "n"])
    else:
        own = classes.select("rep", "n", "tokens", F.lit(None).cast("array<long>").alias("nodes"))
    return own.select("rep", "n", F.explode(run("nodes", "tokens")).alias("node"))


def _labels(classes: DataFrame, comps: DataFrame) -> DataFrame:
    found = classes.join(comps, classes["rep"] == comps["node_id"], "left").drop("node_id")
    return found.withColumn("component", F.coalesce("component", "rep"))


def _central(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Crowd members that may link with another one, with how common their shingles are in the crowd."""

    @F.pandas_udf("array<long>")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.frombuffer(s, np.int64) for s in batch], dtype=object)

    reps = durable(crowd.select("rep").distinct())
    held = sets.join(reps, "rep").select("rep", F.explode(spell("shingles")).alias("g"))
    common = durable(held.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"))
    seen = held.join(common, "g").groupBy("rep").agg(F.count("*").alias("shared"), F.sum("df").alias("weight"))
    return crowd.join(seen, "rep").where(F.col("shared") * 100 >= percent * F.col("n"))


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, exactly."""
    both = np.zeros((len(left), len(right)), np.float32)  # counts below 2^24 are exact
    a, b = np.concatenate(left), np.concatenate(right)
    rows_a, rows_b = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    shared = np.intersect1d(a, b)
    if not len(shared):
        return both
    where = []
    for values, rows in ((a, rows_a), (b, rows_b)):
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        own = shared[at] == values
        order = np.argsort(at[own], kind="stable")
        where.append((at[own][order], rows[own][order]))
    (col_a, rows_a), (col_b, rows_b) = where
    many_a, many_b = np.bincount(col_a, minlength=len(shared)), np.bincount(col_b, minlength=len(shared))
    rare = many_a * many_b <= 64
    # rare shingles pair by pair, common ones as columns of matrices
    begin_b = np.cumsum(many_b) - many_b
    own = rare[col_a]
    times = many_b[col_a[own]]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    cells = np.repeat(rows_a[own], times) * len(right) + rows_b[np.repeat(begin_b[col_a[own]], times) + step]
    both += np.bincount(cells, minlength=both.size).reshape(both.shape)
    common = np.flatnonzero(~rare)
    place = np.full(len(shared), -1)
    place[common] = np.arange(len(common))
    for low in range(0, len(common), 2048):
        width = min(2048, len(common) - low)
        sides = []
        for cols, rows, count in ((col_a, rows_a, len(left)), (col_b, rows_b, len(right))):
            inside = (place[cols] >= low) & (place[cols] < low + width)
            side = np.zeros((count, width), np.float32)
            side[rows[inside], place[cols[inside]] - low] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    return both


def _crossing(split: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside nodes between a member outside the main component and one of another component."""
    outside = F.col("component") != F.col("main")
    blocks = lambda rows, total: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(total / BLOCK_SHINGLES)).cast("int")
    count, total = lambda c: F.count(F.when(c, 1)), lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sizes = split.groupBy("node").agg(
        blocks(count(outside), total(outside)).alias("out_blocks"), blocks(count(F.lit(True)), total(F.lit(True))).alias("all_blocks")
    )
    members = split.join(durable(sizes), "node").join(sets, "rep")
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = members.where(outside).select("node", "rep", "component", "shingles", dealt("out_blocks").alias("x"), every("all_blocks").alias("y"), F.lit(True).alias("out"))
    second = members.select("node", "rep", "component", "shingles", every("out_blocks").alias("x"), dealt("all_blocks").alias("y"), F.lit(False).alias("out"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        out = block["out"].to_numpy(bool)
        left, right = block[out], block[~out]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        sets_l, sets_r = ([np.frombuffer(s, np.uint64) for s in side["shingles"]] for side in (left, right))
        both = intersections(sets_l, sets_r)
        sizes_l, sizes_r = (np.array([len(s) for s in side], np.float64) for side in (sets_l, sets_r))
        close = 100 * both.astype(np.float64) >= percent * (sizes_l[:, None] + sizes_r[None, :] - both)
        close &= left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]
        i, j = np.nonzero(close)
        x, y = left["rep"].to_numpy()[i], right["rep"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return first.unionByName(second).groupBy("node", "x", "y").applyInPandas(compare, "a long, b long").distinct()


def _crowd_links(crowd: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links that connect what is connected inside nodes too large to compare exhaustively."""
    members = durable(_central(crowd, sets, percent))
    bucket = F.pmod(F.xxhash64("rep"), F.lit(HUBS))
    best = F.max(F.struct(F.col("weight") / F.col("n"), -F.col("rep"), "rep", "n", "b0", "b1", "shared")).alias("h")
    hubs = durable(members.groupBy("node", bucket).agg(best).select("node", "h.rep", "h.n", "h.b0", "h.b1", "h.shared"))
    # a link has at least percent / (100 + percent) of both sizes in common, and no more than either shares with the crowd
    enough = (100 + percent) * F.least("x.shared", "y.shared") >= percent * (F.col("x.n") + F.col("y.n"))
    # the nodes of a member hold much the same crowd, so one of them does; what that leaves apart crosses below
    home = Window.partitionBy("rep", "n").orderBy("node")
    members_at_home = members.withColumn("place", F.rank().over(home)).where("place = 1")
    tried = _pairs(members_at_home, hubs, percent, enough & (F.col("x.rep") != F.col("y.rep")))
    links = durable(links.unionByName(confirmed(durable(tried), sets, percent)).distinct())

    members = durable(_labels(members, components(links).select(F.col("node").alias("node_id"), "component")))
    parts = members.groupBy("node", "component").count().groupBy("node")
    main = parts.agg(F.max(F.struct("count", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    split = durable(members.join(durable(main.select("node", F.col("main.component").alias("main"))), "node"))
    return durable(links.unionByName(_crossing(split, sets, percent)).distinct())


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = SIMILARITY, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept, one row per given row."""
    sketched = durable(sketches(docs, width))
    classes = durable(sketched.where("key is not null").groupBy("key", "n", "tokens", "b0", "b1").agg(F.min("doc_id").alias("rep")))
    known = classes.where("rep is not null")
    bits = known.select("rep", "n", "b0", "b1").distinct()
    level = durable(_sized(durable(_descend(known, known, _roots(trees)))))
    pairs = None
    for at in range(1, depth + 1):
        small, large = level.where(F.col("members") <= leaf), level.where(F.col("members") > leaf)
        compared = small.drop("members").join(bits, ["rep", "n"])
        found = _pairs(compared, compared, percent, F.col("x.rep") < F.col("y.rep"))
        pairs = found if pairs is None else pairs.unionByName(found)
        if at == depth or large.isEmpty():
            break
        level = durable(_sized(durable(_descend(large, known, None))))
    pairs = durable(pairs.distinct())
    crowd = durable(large.select("node", "rep", "n").distinct().join(bits, ["rep", "n"]))
    crowded = not crowd.isEmpty()
    wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).unionByName(crowd.select("rep"))
    sets = durable(_sets(docs, wanted, width))
    links = durable(confirmed(pairs, sets, percent))
    if crowded:
        links = _crowd_links(crowd, sets, links, percent)

    comps = components(links).select(F.col("node").alias("node_id"), "component")
    labelled = durable(_labels(classes.select("key", "rep"), comps))
    found = sketched.select("doc_id", F.col("n").alias("n_shingles"), "key").join(labelled, "key", "left")
    found = found.withColumn("component_id", F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
