"""Mixing sources to target weights, in DataFrame functions only.

Every source is laid out as one sequence of words: documents in hashed order, one after another, packed into blocks of
``block`` words and a shorter tail. Places in the layout come from two-level prefix sums (bounded buckets, then the
buckets of a source), so a source with a third of all rows never meets in one task.

The mix consists of slots of one block each. Slots are dealt in output shards, and each shard draws its source counts
from a multinomial with the targets' shares, one categorical draw a slot. The n-th slot that a source gets is mapped
through that source's pseudorandom permutation of its blocks (swap-or-not rounds, a new permutation for every pass over
the source), and slots join blocks by index. Draws beyond a source's quota are left out and missing ones are appended in
top-up shards, so each source gets its target to the word: whole passes take everything once, the rest takes the tail
first, then permuted blocks, the last one cut. The tail is the block after the last whole one; its slots lie in shards of
negative number.

``blocks`` packs the words themselves, one space between two; ``shards`` is the mixed corpus. For it slots meet the pieces of
documents while these are numbers only; each text then travels once to the slots of its document, and its pieces once to their
shard, where they are put together. What the mix takes of a document is counted over the same slots and the same pieces of documents.

Targets: ``share`` times all words, divided by weight, at most ``most`` times a source's size; the excess is shared
again by weight until none is above. Weights repeat along the sources by code point, null last.

Defined results: null and empty texts have size 0 and nothing taken, and a source of such texts has target 0. Repeated
rows are documents of their own (wholly equal ones may swap their takings). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfathom.llm.common import WORD, durable

BLOCK = 256
SHARD_SLOTS = 1024
BUCKET_DOCS = 4096
ROUNDS = 16
WEIGHTS = (3, 1, 2)
KEY = ("key0", "key1")  # 128 bits of a row; wholly equal rows share them


def _unit(*parts: Column) -> Column:
    """A pseudorandom number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def permuted(n: Column, size: Column, *seed: Column, rounds: int = ROUNDS) -> Column:
    """Position ``n`` of a pseudorandom permutation of 0 .. size-1: swap-or-not rounds, exact for any size."""

    def round_of(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("key"), i, *seed), size) - x, size)
        swap = F.pmod(F.xxhash64(F.lit("bit"), i, F.greatest(x, other), *seed), F.lit(2)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), n.cast("bigint"), round_of)


def row_key() -> list[Column]:
    parts = [F.isnull("doc_id"), F.col("doc_id"), F.isnull("source"), F.col("source"), F.col("text")]
    return [F.xxhash64(F.lit(name), *parts).alias(name) for name in KEY]


def plan_sources(sized: DataFrame, share: float, most: float, weights: tuple[float, ...], block: int) -> DataFrame:
    """One row per source: sid, size, blocks, target, and its quota of slots (passes, whole blocks, words of the last)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("cap_per_weight", "sid")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = totals.withColumn("sid", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
    s = s.withColumn("want", share * F.sum("source_size").over(whole))
    s = s.withColumn("level", (F.col("want") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(onward))
    # the first source whose cap is not below the level of those from it on sets the level for all after it
    s = s.withColumn("theta", F.min(F.when(F.col("cap_per_weight") >= F.col("level"), F.struct("cap_per_weight", "sid", "level"))).over(whole))
    s = s.withColumn("target", F.least("cap", F.coalesce(F.col("theta.level") * F.col("weight"), F.col("cap"))))
    s = s.withColumn("words", F.least(F.round("target"), F.floor("cap")).cast("bigint"))
    s = s.withColumn("blocks", F.floor(F.col("source_size") / block)).withColumn("tail", F.col("source_size") % block)
    s = s.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0))
    s = s.withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    s = s.withColumn("rest_tail", F.least("rest", "tail")).withColumn("rest_words", F.col("rest") - F.col("rest_tail"))
    s = s.withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest_words") / block))
    names = ["source", "sid", "source_size", "target", "blocks", "tail", "passes", "rest_tail", "rest_words", "quota"]
    return s.select(*names)


def lay_out(sized: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """Documents with words (and their texts, if given), with sid and the place of their first word in their source."""
    buckets = max(1, rows // BUCKET_DOCS)
    keyed = sized.where("size > 0").withColumn("h", F.xxhash64(F.lit("order"), F.col("doc_id"), F.col("size")))
    keyed = keyed.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    keyed = keyed.join(sources.select("source", "sid"), keyed["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    own = [c for c in ("text", *KEY) if c in sized.columns]
    return placed.join(sums, ["sid", "bucket"]).select("doc_id", "source", "size", *own, "sid", (F.col("base") + F.col("within")).alias("at"))


def draw_slots(spark, sources: DataFrame, slots: int, n_sources: int, seed: int) -> DataFrame:
    """Slots (shard, slot) with source and the running number of the slot within its source."""
    drawing = sources.where("quota > 0")
    running = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    shares = drawing.select("sid", "quota", F.coalesce(F.sum("quota").over(running), F.lit(0)).alias("low"))
    shares = shares.select("sid", (F.col("low") / slots).alias("low"), ((F.col("low") + F.col("quota")) / slots).alias("high"))
    cells = max(1, n_sources)  # each draw looks only at the sources that overlap its cell
    cell_of = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1))
    shares = shares.withColumn("cell", F.explode(F.sequence(cell_of(F.col("low")), cell_of(F.col("high")))))
    draws = spark.range(slots).select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), (F.col("id") % SHARD_SLOTS).alias("slot"))
    draws = draws.withColumn("u", _unit(F.lit(seed), F.col("shard"), F.col("slot"))).withColumn("cell", cell_of(F.col("u")))
    drawn = draws.join(shares, "cell").where("u >= low and u < high").select("shard", "slot", "sid")
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("n"))  # the shard's multinomial counts
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    in_shard = Window.partitionBy("shard", "sid").orderBy("slot")
    numbered = drawn.withColumn("k", F.row_number().over(in_shard) - 1).join(base, ["shard", "sid"])
    numbered = numbered.select("shard", "slot", "sid", (F.col("base") + F.col("k")).alias("n"))
    kept = numbered.join(sources.select("sid", "quota"), "sid").where("n < quota").drop("quota")
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    short = drawing.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    extra = short.select("sid", F.explode(F.sequence("got", F.col("quota") - 1)).alias("n"))
    shards = (slots + SHARD_SLOTS - 1) // SHARD_SLOTS
    extra = extra.select((shards + F.floor(F.col("n") / SHARD_SLOTS)).alias("shard"), (F.col("n") % SHARD_SLOTS).alias("slot"), "sid", "n")
    return kept.unionByName(extra)


def blocks_of_slots(slots: DataFrame, sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Slots joined with the block they take and the number of words taken from its start."""
    s = slots.join(sources.select("sid", "blocks", "passes", "rest_words", "quota"), "sid")
    epoch = F.floor(F.col("n") / F.col("blocks"))
    s = s.withColumn("block", permuted(F.col("n") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("sid"), epoch))
    last = (F.col("n") == F.col("quota") - 1) & (F.col("rest_words") % block > 0)
    return s.select("shard", "slot", "sid", "block", F.when(last, F.col("rest_words") % block).otherwise(block).alias("words"))


def tail_slots(sources: DataFrame, most: float) -> DataFrame:
    """Slots for the tails: one for each whole pass over a source and one for the words of the rest."""
    copies = F.transform(F.sequence(F.lit(0), F.col("passes").cast("int")), lambda i: F.struct(i.alias("copy"), F.when(i < F.col("passes"), F.col("tail")).otherwise(F.col("rest_tail")).alias("words")))
    each = sources.select("sid", F.col("blocks").alias("block"), F.inline(copies)).where("words > 0")
    place = F.col("sid") * (int(most) + 1) + F.col("copy")
    shard = F.lit(-1) - F.floor(place / SHARD_SLOTS)
    return each.select(shard.alias("shard"), (place % SHARD_SLOTS).alias("slot"), "sid", "block", "words")


def cut_pieces(placed: DataFrame, block: int) -> DataFrame:
    """Every document cut at the blocks' borders: block, the place of the piece in it (``low`` to ``high``) and, if there are
    texts, its words. A document's words are split once."""
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)

    def piece(b: Column) -> Column:
        low, high = F.greatest(F.col("at") - b * block, F.lit(0)), F.least(F.col("at") + F.col("size") - b * block, F.lit(block))
        own = [F.slice("all_words", (b * block + low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("words")] if "text" in placed.columns else []
        return F.struct(b.alias("block"), low.alias("low"), high.alias("high"), *own)

    if "text" in placed.columns:
        placed = placed.withColumn("all_words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    kept = [c for c in placed.columns if c not in ("text", "all_words")]
    return placed.select(*kept, F.inline(F.transform(F.sequence(first, last), piece)))


def pack_blocks(pieces: DataFrame) -> DataFrame:
    """(sid, block, packed): the words of each block in order. A block holds ``block`` words at most, so its group is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("low", "words")))
    return pieces.groupBy("sid", "block").agg(F.flatten(F.transform(parts, lambda p: p["words"])).alias("packed"))


def fill_slots(texts: DataFrame, placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """The slots with their words, a shard's slots in one partition (a shard is ``SHARD_SLOTS`` blocks at most).

    A text is read for all copies of its row at once, so it takes part once however often the row is given.
    """
    pieces = cut_pieces(placed.select(*KEY, "sid", "at", "size"), block).join(slots, ["sid", "block"]).where("low < words")
    begin = (F.col("block") * block + F.col("low") - F.col("at") + 1).cast("int").alias("begin")
    length = (F.least("high", "words") - F.col("low")).cast("int").alias("length")
    part = F.struct("shard", "slot", "sid", "block", "words", "low", begin, length)
    plan = pieces.groupBy(*KEY, "at").agg(F.collect_list(part).alias("parts"))

    once = F.lag(F.lit(1)).over(Window.partitionBy(*KEY).orderBy(*KEY))
    own = texts.where("size > 0").withColumn("again", once).where("again is null")
    own = own.join(plan, [*KEY]).select("source", "parts", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("all_words"))

    def cut(p: Column) -> Column:
        return F.array_join(F.slice("all_words", p["begin"], p["length"]), " ")

    keys = ["shard", "slot", "sid", "block", "words"]
    cuts = F.transform("parts", lambda p: F.struct(*[p[k].alias(k) for k in keys], p["low"].alias("low"), cut(p).alias("piece")))
    dealt = own.select("source", F.inline(cuts)).repartition("shard")
    slot = dealt.groupBy("shard", "slot", "source", "sid", "block", "words").agg(F.sort_array(F.collect_list(F.struct("low", "piece"))).alias("pieces"))
    return slot.select("shard", "slot", "source", "sid", "block", "words", F.array_join(F.col("pieces.piece"), " ").alias("text"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = 17) -> dict[str, DataFrame]:
    """``shards``: the mixed corpus, one row per slot with its text; ``slots``: the same without texts; ``blocks``: the packed
    words of every source; ``taken``: every document with the words the mix takes of it. Texts move only for those read."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    whole = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("mark"), *row_key(), "text")
    sized = durable(whole.drop("text"))
    sources = durable(plan_sources(sized, share, most, weights, block))
    head = sources.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()
    rows = sized.count()
    placed = durable(lay_out(sized, sources, rows))
    drawn = blocks_of_slots(draw_slots(spark, sources, head[1], head[0], seed), sources, block, seed)
    slots = durable(drawn.unionByName(tail_slots(sources, most)))

    blocks = pack_blocks(cut_pieces(lay_out(whole, sources, rows), block))
    shards = fill_slots(whole, placed, slots, block)

    times = slots.groupBy("sid", "block").agg(F.collect_list("words").alias("cuts"))  # a block is drawn ``most`` times at most
    plan = sources.select("sid", "source_size", "target")
    hit = cut_pieces(placed.drop(*KEY).join(plan, "sid"), block).join(times, ["sid", "block"], "left")
    overlap = lambda words: F.greatest(F.lit(0), F.least("high", words) - F.col("low"))
    got = F.coalesce(F.aggregate("cuts", F.lit(0).cast("bigint"), lambda acc, words: acc + overlap(words)), F.lit(0))
    keys = ["doc_id", "source", "size", "source_size", "target"]
    some = hit.withColumn("got", got).groupBy(*keys, "sid", "at").agg(F.sum("got").alias("taken")).select(*keys, "taken")
    empty = sized.where("size = 0")
    empty = empty.join(sources, empty["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    none = empty.withColumn("taken", F.lit(0).cast("bigint")).select(*keys, "taken")
    return {"shards": shards, "slots": slots, "blocks": blocks, "taken": some.unionByName(none)}


def write_shards(mixed: DataFrame, path: str) -> None:
    """The mixed corpus as Parquet, a shard's slots together, as ``mix`` gives them, and in order."""
    mixed.sortWithinPartitions("shard", "slot").write.parquet(path)
